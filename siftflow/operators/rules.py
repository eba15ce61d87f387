"""Threshold and pair rules over flows, and the weighted risk they add up to.

Rules hold as soon as any prefix of the flows, in order of arrival, meets them. Counts only grow, so most
rules need the final counts alone; three look at quotients or spans, which can fall back, and use running
windows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.flow import round2
from .flow_features import normalize

# Reasons as results name them.
FREQUENCY = "Frequency of Connections"
REUSE = "IP Reuse & Repeated Connections"
PEERS = "P2P C2 Communications"
SIZE = "Packet Size Anomalies"
PORTS = "C2_Suspicious_Ports"
KNOWN = "C2_Known_Proxies"
SMALL = "C2_Small_Packets"


@dataclass(frozen=True)
class Thresholds:
    frequency_of_connections: int = 10
    ip_reuse_connections: int = 3
    p2p_unique_peers: int = 5
    packet_size_anomaly_min_flows: int = 100
    packet_size_anomaly_avg_bytes: int = 500
    small_avg_packet_bytes: int = 200
    min_packets_for_avg: int = 10
    suspicious_port_connection_count: int = 10
    suspicious_port_time_window_sec: float = 600
    behavioral_connection_count: int = 50
    behavioral_time_window_sec: float = 300


@dataclass(frozen=True)
class Weights:
    frequency_of_connections: float = 1
    ip_reuse_repeated_connections: float = 1
    p2p_c2_communications: float = 75
    packet_size_anomalies: float = 75
    c2_suspicious_ports: float = 1
    c2_known_proxies: float = 1
    c2_small_packets: float = 1

    def by_reason(self) -> dict[str, float]:
        return dict(zip((FREQUENCY, REUSE, PEERS, SIZE, PORTS, KNOWN, SMALL), (getattr(self, f.name) for f in fields(self)), strict=True))


@dataclass(frozen=True)
class RuleConfig:
    suspicious_ports: tuple[int, ...] = ()
    known_c2_ips: tuple[str, ...] = ()
    thresholds: Thresholds = field(default_factory=Thresholds)
    weights: Weights = field(default_factory=Weights)

    @classmethod
    def load(cls, path: str) -> RuleConfig:
        """Read a JSON file; keys that are left out keep their defaults, and errors name the file."""
        try:
            with open(path, encoding="utf-8") as f:
                raw = json.load(f)
            return cls(tuple(raw.get("suspicious_ports", ())), tuple(raw.get("known_c2_ips", ())), Thresholds(**raw.get("thresholds", {})), Weights(**raw.get("weights", {})))
        except (OSError, ValueError, TypeError) as e:
            raise ValueError(f"rule configuration {path}: {e}") from e


#: Ranges of the first order column that running values of one key are computed in, each in a task of its own.
RANGES = 1024
_COMBINE = {"sum": lambda before, now: F.coalesce(before, F.lit(0)) + F.coalesce(now, F.lit(0)), "min": F.least, "max": F.greatest}


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], whole: DataFrame | None = None) -> DataFrame:
    """``rows`` with running values over each key's rows in order: name to ``("sum" | "min" | "max", of what)``.

    A key's rows are cut into ``RANGES`` equal ranges of the first order column (null: the first range; not a
    number: one range), which are added up by themselves and then offset by what came before, so that no task
    needs all rows of a busy key. Rows move once, dealt by key and range. ``whole`` is a table that holds at
    least these rows and is cheaper to find the column's ends in.
    """
    kind = rows.schema[order[0]].dataType
    place = F.lit(0)
    if isinstance(kind, T.NumericType):
        first = F.col(order[0]).cast("double")
        ends = (rows if whole is None else whole).select(order[0])
        low, high = ends.agg(F.min(first)).scalar(), ends.agg(F.max(first)).scalar()
        span = high - low  # not a finite number if an end isn't
        at = F.least(F.floor((first - low) / span * RANGES), F.lit(RANGES - 1))
        place = F.when(first.isNull(), -1).when((span > 0) & (span < float("inf")), at).otherwise(0)
    rows = rows.withColumn("_range", place.cast("int"))
    rows = rows.withColumns({f"_of_{name}": of for name, (_, of) in values.items()})
    ranges = rows.groupBy(*keys, "_range").agg(*(getattr(F, how)(f"_of_{name}").alias(f"_part_{name}") for name, (how, _) in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(*keys, "_range", *(getattr(F, how)(f"_part_{name}").over(earlier).alias(f"_before_{name}") for name, (how, _) in values.items()))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(before, [*keys, "_range"])
    met = met.withColumns({f"_now_{name}": getattr(F, how)(f"_of_{name}").over(within) for name, (how, _) in values.items()})
    met = met.withColumns({name: _COMBINE[how](F.col(f"_before_{name}"), F.col(f"_now_{name}")) for name, (how, _) in values.items()})
    return met.drop("_range", *(f"_{what}_{name}" for what in ("of", "now", "before") for name in values))


def _hits(df: DataFrame, reason: str) -> DataFrame:
    return df.select(F.col("src4_addr").alias("ip")).distinct().withColumn("reason", F.lit(reason))


def _from_source(normal: DataFrame) -> DataFrame:
    return normal.where("src4_addr <> ''")


def _pairs(normal: DataFrame) -> DataFrame:
    return normal.where("src4_addr <> '' and dst4_addr <> ''")


def frequency(normal: DataFrame, config: RuleConfig, order: list[str]) -> DataFrame:
    n = _from_source(normal).groupBy("src4_addr").count()
    return _hits(n.where(F.col("count") > config.thresholds.frequency_of_connections), FREQUENCY)


def reuse(normal: DataFrame, config: RuleConfig, order: list[str]) -> DataFrame:
    n = _pairs(normal).groupBy("src4_addr", "dst4_addr").count()
    return _hits(n.where(F.col("count") > config.thresholds.ip_reuse_connections), REUSE)


def peers(normal: DataFrame, config: RuleConfig, order: list[str]) -> DataFrame:
    n = _pairs(normal).groupBy("src4_addr").agg(F.count_distinct("dst4_addr").alias("n"))
    return _hits(n.where(F.col("n") > config.thresholds.p2p_unique_peers), PEERS)


def _small_average(rows: DataFrame, config: RuleConfig, order: list[str]) -> DataFrame:
    """Sources that at some point have had ten or more flows with bytes, and few bytes on average."""
    data = _from_source(rows).where("in_bytes > 0").select("src4_addr", "in_bytes", *order)
    found = running(data, ["src4_addr"], order, {"n": ("sum", F.lit(1)), "b": ("sum", F.col("in_bytes"))}, rows)
    return _hits(found.where((F.col("n") >= 10) & (F.expr("b div n") < config.thresholds.packet_size_anomaly_avg_bytes)), SIZE)


def packet_size(normal: DataFrame, config: RuleConfig, order: list[str]) -> DataFrame:
    """Many flows with bytes, or at some point ten or more of them with few bytes on average."""
    many = _from_source(normal).where("in_bytes > 0").groupBy("src4_addr").count().where(F.col("count") > config.thresholds.packet_size_anomaly_min_flows)
    return _hits(many, SIZE).unionByName(_small_average(normal, config, order)).distinct()


def known_addresses(normal: DataFrame, config: RuleConfig, order: list[str]) -> DataFrame:
    if not config.known_c2_ips:
        return _hits(normal.limit(0), KNOWN)
    known = list(config.known_c2_ips)
    return _hits(_from_source(normal).where(F.col("src4_addr").isin(known) | F.col("dst4_addr").isin(known)), KNOWN)


def small_packets_flow(config: RuleConfig) -> Column:
    """Enough packets, and few bytes in each on average (whole bytes)."""
    t = config.thresholds
    enough = F.col("in_packets") >= t.min_packets_for_avg
    return F.when(enough, F.expr("in_bytes div in_packets") < t.small_avg_packet_bytes).otherwise(False)


def _pair_span() -> dict[str, tuple[str, Column]]:
    """Running values of a pair: flows, and from when to when."""
    return {"n": ("sum", F.lit(1)), "begin": ("min", F.col("first_ms")), "end": ("max", F.greatest("first_ms", "last_ms"))}


def _pair_rule(normal: DataFrame, order: list[str], flag: Column, count: int, seconds: float, reason: str) -> DataFrame:
    """Pairs that at some point have had a flagged flow, more than ``count`` flows, and all within a span.

    The span runs from the earliest start to the latest start or end. Without any readable time it is zero;
    with ends alone it is too long for any limit.
    """
    rows = running(_pairs(normal), ["src4_addr", "dst4_addr"], order, _pair_span() | {"flagged": ("max", F.coalesce(flag, F.lit(False)))}, normal)
    span = _span(F.col("begin"), F.col("end"))
    return _hits(rows.where(F.col("flagged") & (F.col("n") > count) & (span < seconds)), reason)


def suspicious_ports(normal: DataFrame, config: RuleConfig, order: list[str]) -> DataFrame:
    t = config.thresholds
    bad = F.col("dst_port").isin(list(config.suspicious_ports)) if config.suspicious_ports else F.lit(False)
    return _pair_rule(normal, order, bad, t.suspicious_port_connection_count, t.suspicious_port_time_window_sec, PORTS)


def small_packets(normal: DataFrame, config: RuleConfig, order: list[str]) -> DataFrame:
    t = config.thresholds
    return _pair_rule(normal, order, small_packets_flow(config), t.behavioral_connection_count, t.behavioral_time_window_sec, SMALL)


Rule = Callable[[DataFrame, RuleConfig, list[str]], DataFrame]
#: The rules in use; append a function that returns ``(ip, reason)`` to extend them.
_BUILT_IN: tuple[Rule, ...] = (frequency, reuse, peers, packet_size, known_addresses, suspicious_ports, small_packets)
RULES: list[Rule] = [*_BUILT_IN]


def pattern_rule(flows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``(ip, reason)`` for each pattern that a flow's JSON matches; the name of a pattern is its reason."""
    text = F.to_json(F.struct(*flows.columns))
    hits = F.filter(F.array(*(F.when(F.rlike(text, F.lit(p)), F.lit(name)) for name, p in patterns.items())), lambda x: x.isNotNull())
    return flows.select(F.col("src4_addr").alias("ip"), F.explode(hits).alias("reason")).distinct()


def missing_keys(flows: DataFrame, keys: tuple[str, ...] = ("src4_addr", "dst4_addr", "in_bytes")) -> DataFrame:
    """``(records, incomplete)``: flows that lack any of the keys; they are counted, not dropped."""
    lacks = F.lit(False)
    for k in keys:
        lacks = lacks | (F.col(k).isNull() if k in flows.columns else F.lit(True))
    return flows.agg(F.count("*").alias("records"), F.count_if(lacks).alias("incomplete"))


def _span(begin: Column, end: Column) -> Column:
    """Seconds from the earliest start to the latest start or end; zero without times, endless with ends alone."""
    return F.when(end.isNull(), 0.0).when(begin.isNull(), float("inf")).otherwise((end - begin) / 1000.0)


def built_in(normal: DataFrame, config: RuleConfig, order: list[str]) -> DataFrame:
    """``(ip, reason)`` of all built-in rules: running spans by pair, running sizes by source, and plain counts of both.

    The rules that share a key and a kind of pass share it; counts need no order, and are added up before they move.
    """
    t, c = config.thresholds, F.col
    none = F.lit(False)
    bad_port = c("dst_port").isin(list(config.suspicious_ports)) if config.suspicious_ports else none
    known = list(config.known_c2_ips)
    is_known = c("src4_addr").isin(known) | c("dst4_addr").isin(known) if known else none

    def reasons(rows: DataFrame, found: dict[str, Column]) -> DataFrame:
        held = F.array_compact(F.array(*(F.when(condition, F.lit(reason)) for reason, condition in found.items())))
        return rows.select(c("src4_addr").alias("ip"), F.explode(held).alias("reason")).distinct()

    values = _pair_span() | {"bad": ("max", F.coalesce(bad_port, none)), "small": ("max", F.coalesce(small_packets_flow(config), none))}
    columns = ["src4_addr", "dst4_addr", "dst_port", "in_bytes", "in_packets", "first_ms", "last_ms", *order]
    pairs = running(_pairs(normal).select(*dict.fromkeys(columns)), ["src4_addr", "dst4_addr"], order, values, normal).withColumn("span", _span(c("begin"), c("end")))
    of_pairs = reasons(pairs, {
        REUSE: c("n") > t.ip_reuse_connections,
        PORTS: c("bad") & (c("n") > t.suspicious_port_connection_count) & (c("span") < t.suspicious_port_time_window_sec),
        SMALL: c("small") & (c("n") > t.behavioral_connection_count) & (c("span") < t.behavioral_time_window_sec),
    })
    sources = _from_source(normal).groupBy("src4_addr").agg(F.count("*").alias("n"), F.count_if(c("in_bytes") > 0).alias("data"), F.max(F.coalesce(is_known, none)).alias("known"))
    of_sources = reasons(sources, {FREQUENCY: c("n") > t.frequency_of_connections, SIZE: c("data") > t.packet_size_anomaly_min_flows, KNOWN: c("known")})
    found = of_pairs.unionByName(of_sources).unionByName(_small_average(normal, config, order)).unionByName(peers(normal, config, order))
    return found.distinct()


def triggered(flows: DataFrame, config: RuleConfig, order: list[str], rules: list[Rule] | None = None) -> DataFrame:
    """``(ip, reason)`` of all rules, each pair once.

    Of ``RULES`` (or ``rules``) the built-in ones run together, others one by one; no rules give no rows.
    """
    normal = normalize(flows)
    chosen = RULES if rules is None else rules
    together = all(r in chosen for r in _BUILT_IN)
    found = [built_in(normal, config, order)] if together else []
    found += [rule(normal, config, order) for rule in chosen if not (together and rule in _BUILT_IN)]
    out = normal.sparkSession.createDataFrame([], "ip string, reason string")
    for hits in found:
        out = out.unionByName(hits)
    return out


def risk_scores(reasons: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``(ip, reasons array, risk)``: the share of all weights that an address's reasons have, in percent.

    Reasons without a weight count nothing; addresses at zero are left out.
    """
    known = F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))))
    total = float(sum(weights.values()))
    weight = F.coalesce(F.try_element_at(known, F.col("reason")), F.lit(0.0))
    sums = reasons.distinct().groupBy("ip").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.sum(weight).alias("w"))
    risk = F.least(round2(F.col("w") / total * 100), F.lit(100.0))
    return sums.select("ip", "reasons", risk.alias("risk")).where("risk > 0")


def script_scores(flows: DataFrame, patterns: dict[str, str], weights: dict[str, float], frequency_limit: int = 10, reuse_limit: int = 3, peer_limit: int = 5, size_limit: int = 1000) -> DataFrame:
    """The simpler rule set: plain counts for the first four rules, patterns for the rest.

    Its size rule counts all flows of a source, with or without bytes.
    """
    normal = normalize(flows)
    config = RuleConfig(thresholds=Thresholds(frequency_of_connections=frequency_limit, ip_reuse_connections=reuse_limit, p2p_unique_peers=peer_limit))
    counts = _from_source(normal).groupBy("src4_addr").count()
    found = [frequency(normal, config, []), reuse(normal, config, []), peers(normal, config, []), _hits(counts.where(F.col("count") > size_limit), SIZE)]
    if patterns:
        found.append(pattern_rule(flows, patterns))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return risk_scores(out, weights)
