"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_spilled, spill


#: Edges that a written file holds at least, where there are as many.
EDGES_PER_FILE = 250_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given by long columns ``a`` and ``b``.

    Returns ``(node, root)``, one row per node with an edge; ``root`` is the smallest node of its component.
    Self-loops, repeated edges and rows with a null end are ignored; no edges give no rows. Every round is
    written to the shared folder, so lineage stays short and a lost executor costs one round at most. Nodes
    and edges never reach the driver, which sees a count and a checksum per round. A hub's edges meet its
    minimum in a sort-merge join, which adaptive execution splits if the hub is hot.
    """
    now = spill(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen = _mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # contraction adds no edges, so the last count bounds what a round writes, and into how many files
        new = spill(_small_star(_large_star(now)).coalesce(max(1, seen[0] // EDGES_PER_FILE)), "edges")
        drop_spilled(now)
        now, before, seen = new, seen, _mark(new)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every edge points from a node straight at its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    # the count needs ``e`` without repeats, so Spark makes ``e`` once for both sides and not once more for its minima
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    own, other = F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
    return (
        e.join(least, "u")
        .select(F.explode(F.when(F.col("n") > 1, F.array(own, other)).otherwise(F.array(own))).alias("x"))
        .select("x.u", "x.v")
        .where("u <> v")
        .distinct()
    )


def forest(comp: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` with the components of ``comp``, one per node that isn't a root."""
    return comp.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
