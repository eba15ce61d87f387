"""Sharding by minimax contiguous partition, with DataFrame functions only.

Documents of equal text form an atomic group. Groups stand in one order (large ones first), with running
sums of their sizes. The smallest capacity at which greedy filling needs no more than the given shards is
found by search: every round checks several capacities at once, each check being a few scans of the running
sums for the last group that still fits. The groups are then cut there.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, spill, table, workspace

#: Capacities that one round of the search checks.
PROBES = 31
_LOW = (1 << 33) - 1


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` sorted over all partitions, with ``pid`` and the row's place ``at`` in its partition."""
    n = partitions(df.sparkSession)
    out = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    out = out.withColumn("pid", F.shiftright("_m", 33)).withColumn("at", F.col("_m").bitwiseAND(F.lit(_LOW))).drop("_m")
    return spill(out, "ranged")


def _before(df: DataFrame, what: str) -> DataFrame:
    """``pid`` and the sum of ``what`` over all earlier partitions; as many rows as partitions."""
    totals = df.groupBy("pid").agg(F.expr(what).alias("total"))
    return totals.select("pid", F.expr("sum(total) over (order by pid) - total").cast("long").alias("before"))


class Sums:
    """Running sums of the groups (``pid``, ``w``, ``upto``), and where each partition's end: a row a partition on the driver."""

    def __init__(self, sums: DataFrame):
        self.sums = sums
        ends = sums.groupBy("pid").agg(F.max("upto"), F.max("w")).collect()
        self.pids, self.ends, self.widest = map(list, zip(*sorted(map(tuple, ends)), strict=True)) if ends else ([], [], [])

    def furthest(self, bounds: list[int]) -> list[int]:
        """For each bound the largest running sum at or below it, zero if none; only partitions that hold one are read."""
        place = [bisect_right(self.ends, b) for b in bounds]
        below = [self.ends[n - 1] if n else 0 for n in place]
        open_ = {n for n in place if n < len(self.ends)}
        if not open_:
            return below
        inside = self.sums.where(F.col("pid").isin([self.pids[n] for n in sorted(open_)]))
        row = inside.agg(*(F.max(F.when(F.col("upto") <= b, F.col("upto"))).alias(f"b{i}") for i, b in enumerate(bounds))).first()
        return [max(x or 0, y) for x, y in zip(row, below, strict=True)]

    def widest_after(self, start: int) -> int:
        """The largest group after a running sum."""
        n = bisect_right(self.ends, start)
        row = self.sums.where((F.col("pid") == self.pids[n]) & (F.col("upto") > start)).agg(F.max("w")).first() if n < len(self.ends) else [0]
        return max([row[0] or 0, *self.widest[n + 1 :]])


def _cuts(sums: Sums, start: int, capacities: list[int], shards: int) -> list[list[int]]:
    """Greedy cuts after ``start`` at each capacity: where each of the shards ends."""
    ends = [[] for _ in capacities]
    at = [start] * len(capacities)
    for _ in range(shards):
        at = sums.furthest([a + c for a, c in zip(at, capacities, strict=True)])
        for e, a in zip(ends, at, strict=True):
            e.append(a)
    return ends


def minimax_cuts(sums: Sums, total: int, largest: int, shards: int) -> list[int]:
    """Ends of the shards, by the running sums of groups from the largest on.

    A group that alone exceeds an even share takes a shard for itself, as no partition can do better; what is
    left is then cut at its own smallest capacity, so that one hot group doesn't leave the others uneven.
    """
    out: list[int] = []
    start = 0
    while shards and start < total:
        mean = -(-(total - start) // shards)
        if largest > mean:
            start += largest
            out.append(start)
            shards -= 1
            largest = sums.widest_after(start)
            continue
        # greedy filling wastes less than one group a shard, so mean + largest is always enough
        low, high = max(mean, largest), mean + largest
        ends = None
        while low < high:
            probes = sorted({low + (high - low) * i // (PROBES + 1) for i in range(PROBES + 1)})
            found = _cuts(sums, start, probes, shards)
            good = next((i for i, e in enumerate(found) if e[-1] == total), None)
            if good is None:
                low = probes[-1] + 1
            else:
                high, ends = probes[good], found[good]
                low = probes[good - 1] + 1 if good else high
        out += ends or _cuts(sums, start, [high], shards)[0]
        break
    return out


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, size, text_crc32, shard, slot)``, one row per input row.

    ``size`` is the text's UTF-8 length plus one. Rows of equal text (null counts as empty) share a shard:
    they are grouped by size, CRC-32 and XXH64 of the text, and should two texts ever agree on all three they
    would merely travel together. Shards are numbered from 0; ``slot`` numbers a shard's rows without gaps,
    by group, then id (nulls first), then place in the input, so ties and repeated rows are told apart. Fewer
    groups than shards leave the last shards empty; an empty table gives no rows. Other columns aren't read.
    A hot group's rows are summed before they meet, and are dealt out by id where they are numbered.
    """
    with workspace() as keep:
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = spill(
            docs.select(
                F.col(id_col).alias("i"),
                (F.octet_length(text) + 1).cast("long").alias("size"),
                F.crc32(text.cast("binary")).alias("crc"),
                F.xxhash64(text).alias("h"),
                F.monotonically_increasing_id().alias("r"),
            ),
            "sizes",
        )
        key = ["size", "crc", "h"]
        groups = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("w", F.col("size") * F.col("n")).withColumn("neg", -F.col("w"))
        ranged = _ranged(groups, "neg", *key)
        inner = ranged.withColumn("within", F.expr("sum(w) over (partition by pid order by at rows unbounded preceding)"))
        sums = spill(inner.join(F.broadcast(_before(ranged, "sum(w)")), "pid").select("pid", *key, "w", "n", (F.col("within") + F.col("before")).alias("upto")), "running-sums")
        total, largest = sums.agg(F.coalesce(F.max("upto"), F.lit(0)), F.coalesce(F.max("w"), F.lit(0))).first()
        ends = minimax_cuts(Sums(sums), total, largest, shards)
        number = F.lit(0)
        for e in ends[:-1]:
            number = number + (F.col("upto") > e).cast("int")
        placed = sums.select(*(F.col(k).alias(f"g_{k}") for k in key), number.alias("shard"), "upto")
        on = [F.col(k) == F.col(f"g_{k}") for k in key]
        joined = rows.join(placed, on).select("i", "size", "crc", "shard", "upto", "r")
        numbered = _ranged(joined, "upto", "i", "r")
        sized = numbered.groupBy("shard").agg(F.count("*").alias("rows"))
        first = sized.select("shard", F.expr("sum(rows) over (order by shard) - rows").alias("first"))
        out = numbered.join(F.broadcast(_before(numbered, "count(*)")), "pid").join(F.broadcast(first), "shard")
        return keep(spill(out.select(F.col("i").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("at") - F.col("first")).alias("slot")), "shards"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
