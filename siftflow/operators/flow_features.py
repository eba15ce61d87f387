"""Window features of flows: 21 columns per address and five-minute window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flow import at_least_one, has_flag, is_syn_only, iso_millis, share, window_start
from ..schemas import FLOW_FEATURES

#: Columns that fix the order of arrival where a result depends on it.
TARGET = ["src4_addr", "win", "dst4_addr", "dst_port"]


def normalize(flows: DataFrame) -> DataFrame:
    """Flows with null fields as ``""`` or 0, epoch milliseconds, and the window; other columns pass through."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("src4_addr", "dst4_addr", "tcp_flags")}
    number = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("in_packets", "in_bytes", "proto", "src_port", "dst_port")}
    out = flows.withColumns(text | number | {"first_ms": iso_millis("first"), "last_ms": iso_millis("last")})
    return out.withColumn("win", window_start(F.col("first_ms")))


def valid_time(normal: DataFrame) -> DataFrame:
    """Rows whose start time can be read; totals are counted before this."""
    return normal.where("first_ms is not null")


def roles(normal: DataFrame) -> DataFrame:
    """``(ip, win, port, outbound)``: every flow under its source and under its destination, in one scan."""
    both = F.array(
        F.struct(F.col("src4_addr").alias("ip"), F.col("win"), F.col("dst_port").alias("port"), F.lit(True).alias("outbound")),
        F.struct(F.col("dst4_addr").alias("ip"), F.col("win"), F.col("dst_port").alias("port"), F.lit(False).alias("outbound")),
    )
    return valid_time(normal).select(F.inline(both)).where("ip <> ''")


def port_use(normal: DataFrame) -> DataFrame:
    """``(ip, win, port_symmetry, called_ports)`` for all addresses seen.

    ``port_symmetry`` counts the ports an address both calls and is called on, ``called_ports`` those it calls.
    """
    ports = roles(normal).groupBy("ip", "win", "port").agg(F.bool_or("outbound").alias("o"), F.bool_or(~F.col("outbound")).alias("i"))
    return ports.groupBy("ip", "win").agg(F.count_if(F.col("o") & F.col("i")).alias("port_symmetry"), F.count_if("o").alias("called_ports"))


def port_symmetry(normal: DataFrame) -> DataFrame:
    return port_use(normal).drop("called_ports")


def port_symmetry_joined(normal: DataFrame) -> DataFrame:
    """The same for calling addresses, as a join of the two port sets; zero where nothing meets."""
    seen = roles(normal).distinct()
    out = seen.where("outbound").select("ip", "win", "port")
    met = out.join(seen.where("not outbound").select("ip", "win", "port"), ["ip", "win", "port"]).groupBy("ip", "win").agg(F.count("*").alias("n"))
    return out.select("ip", "win").distinct().join(met, ["ip", "win"], "left").select("ip", "win", F.coalesce("n", F.lit(0)).cast("long").alias("port_symmetry"))


def _with_gaps(outbound: DataFrame, iat_cap: int | None, order: list[str]) -> DataFrame:
    """Rows with ``gap``: milliseconds since the target's previous start, 0 for its first, null beyond the cap."""
    start = F.col("first_ms")
    if iat_cap is not None:
        arrival = Window.partitionBy(*TARGET).orderBy(*order)
        outbound = outbound.withColumn("arrived", F.row_number().over(arrival))
        start = F.when(F.col("arrived") <= iat_cap, start)
    sorted_ = Window.partitionBy(*TARGET).orderBy("start")
    # rows beyond the cap have no start and sort first, so the first real start follows a null
    gap = F.coalesce(F.col("start") - F.lag("start").over(sorted_), F.when(F.col("start").isNotNull(), 0).cast("long"))
    return outbound.withColumn("start", start).withColumn("gap", gap)


def _sums(normal: DataFrame, iat_cap: int | None, order: list[str] | None) -> DataFrame:
    """Per calling address and window: sums, gaps and the number of peers.

    One exchange by peer serves the gaps of each target and both sums within; the sums of peers then meet by
    address, which also counts them.
    """
    rows = valid_time(normal).where("src4_addr <> ''").repartition("src4_addr", "win", "dst4_addr")
    rows = _with_gaps(rows, iat_cap, order or ["first_ms"])
    duration = F.greatest(F.coalesce(F.col("last_ms") - F.col("first_ms"), F.lit(0)), F.lit(0)) / 1000.0
    peers = rows.groupBy("src4_addr", "win", "dst4_addr").agg(
        F.count("*").alias("n"),
        F.sum("in_bytes").alias("bytes"),
        F.sum("in_packets").alias("packets"),
        F.count_if(F.col("proto") == 6).alias("tcp"),
        F.count_if(F.col("proto") == 17).alias("udp"),
        F.count_if(F.col("proto") == 1).alias("icmp"),
        F.count_if(is_syn_only(F.col("tcp_flags"))).alias("syn"),
        F.count_if(has_flag(F.col("tcp_flags"), "R")).alias("rst"),
        F.count_if(F.col("dst_port") < 1024).alias("known"),
        F.sum(duration).alias("duration"),
        F.count("gap").alias("gaps"),
        F.sum("gap").alias("gap_sum"),
        F.sum(F.col("gap") * F.col("gap")).alias("gap_sq"),
    )
    total = [c for c in peers.columns if c not in ("src4_addr", "win", "dst4_addr")]
    return peers.groupBy(F.col("src4_addr").alias("ip"), "win").agg(*(F.sum(c).alias(c) for c in total), F.count("*").alias("dsts"))


def _features() -> list[Column]:
    """All features from ``_sums`` and ``port_use``; null for addresses that don't call."""
    n, c = F.col("n"), F.col
    mean = share(c("gap_sum"), c("gaps")) / 1000
    # whole numbers up to the division, so sums of any order give the same variance
    exact = {k: c(k).cast("decimal(19,0)") for k in ("gaps", "gap_sum", "gap_sq")}
    spread = (exact["gaps"] * exact["gap_sq"] - exact["gap_sum"] * exact["gap_sum"]).cast("double")
    variance = F.when(c("gaps") > 1, spread / (c("gaps") * (c("gaps") - 1)).cast("double") / 1e6).otherwise(0.0)
    return [
        n.cast("double").alias("flow_count"),
        c("dsts").cast("double").alias("unique_dst_ips"),
        c("called_ports").cast("double").alias("unique_dst_ports"),
        c("bytes").cast("double").alias("total_bytes"),
        c("packets").cast("double").alias("total_packets"),
        (c("bytes") / n).alias("avg_bytes_per_flow"),
        (c("packets") / n).alias("avg_packets_per_flow"),
        (c("tcp") / n * 100).alias("pct_tcp"),
        (c("udp") / n * 100).alias("pct_udp"),
        (c("icmp") / n * 100).alias("pct_icmp"),
        (c("known") / n * 100).alias("pct_well_known_ports"),
        (100 - c("known") / n * 100).alias("pct_high_ports"),
        (c("duration") / n).alias("avg_duration"),
        mean.alias("iat_mean"),
        variance.alias("iat_variance"),
        c("port_symmetry").cast("double").alias("port_symmetry"),
        (c("dsts") / F.greatest("called_ports", F.lit(1))).alias("ip_port_ratio"),
        (c("bytes") / at_least_one(c("packets"))).alias("avg_payload_per_packet"),
        (c("syn") / n * 100).alias("pct_syn_only"),
        (c("rst") / n * 100).alias("pct_rst"),
        F.when(mean > 0, F.sqrt(variance) / mean).otherwise(0.0).alias("iat_cv"),
    ]


def outbound_features(normal: DataFrame, iat_cap: int | None = None, order: list[str] | None = None) -> DataFrame:
    """``(ip, win)`` and the features of addresses that call.

    ``iat_cap`` keeps only the first so many arrivals of a target for the gaps, in the given order.
    """
    found = port_use(normal).join(_sums(normal, iat_cap, order), ["ip", "win"])
    return found.select("ip", "win", *_features())


def flow_features(flows: DataFrame, include_inbound_only: bool = True, iat_cap: int | None = None, order: list[str] | None = None, fragment: Column | None = None) -> DataFrame:
    """``(ip, win)`` and the 21 features of ``FLOW_FEATURES``.

    Addresses that are only called get zeros, or are left out. ``fragment`` (say, the input file) keeps the
    windows of different parts of the input apart; it comes back as ``fragment``; null is
    a part like any other.
    """
    normal = normalize(flows)
    if fragment is not None:
        # the parts' windows are told apart by a composite window
        normal = normal.withColumn("win", F.struct("win", fragment.alias("fragment")))
    found = port_use(normal).join(_sums(normal, iat_cap, order), ["ip", "win"], "left" if include_inbound_only else "inner")
    out = found.select("ip", "win", F.col("n").isNotNull().alias("_calls"), *_features())
    out = out.select("ip", "win", *(F.when(F.col("_calls"), F.col(f)).otherwise(0.0).alias(f) for f in FLOW_FEATURES))
    if fragment is not None:
        out = out.select("ip", F.col("win.fragment").alias("fragment"), F.col("win.win").alias("win"), *FLOW_FEATURES)
    return out
