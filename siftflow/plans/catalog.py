"""The registered queries over the driver's tables, and the SQL that must agree with them.

Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert
from ..operators import flow_features as ff
from ..operators import model as md
from ..operators import packet_features as pf
from ..operators import report, rules, training
from ..schemas import FLOW_FEATURES, PACKET_FEATURES
from ..sources.router import file_type_counts
from ..streaming import windows
from ..scratch import remove, scratch_path
from ..sources import flows as src
from .derive import FLOWS_SQL, ORDER, PACKETS_SQL, flows, flows_of, lineitem, lineitem_stream, packets, packets_of
from .toy_model import FLOW_TREES, PACKET_TREES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Test thresholds: with the defaults some rules hold for every derived address and others for none.
TEST_RULES = rules.RuleConfig(
    suspicious_ports=(6667, 23),
    known_c2_ips=("10.0.0.7", "10.0.0.61"),
    thresholds=rules.Thresholds(
        frequency_of_connections=1480, ip_reuse_connections=40, p2p_unique_peers=31, packet_size_anomaly_min_flows=1_000_000_000, packet_size_anomaly_avg_bytes=11_000,
        suspicious_port_connection_count=3, suspicious_port_time_window_sec=2400, small_avg_packet_bytes=200, min_packets_for_avg=10, behavioral_connection_count=2,
        behavioral_time_window_sec=1200,
    ),
)
PATTERNS = {"irc_port": '"dst_port":6667', "syn_probe": r'"tcp_flags":"[^"AFR]*S'}
ENSEMBLE = md.Ensemble.parse(FLOW_TREES, len(FLOW_FEATURES))


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        name = f.__name__.lstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ff.normalize(flows(spark, sf_dir))


def _round(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*((F.floor(F.col(f"`{c}`") * 1e6 + 0.5) / 1e6).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns))


def _outbound(spark: SparkSession, sf_dir: str, names: list[str], cap: int | None = None) -> DataFrame:
    return _round(ff.outbound_features(_normal(spark, sf_dir), cap, ORDER).select("ip", "win", *names), names)


def _six(sql: str) -> str:
    """A number at six places, by the operations that ``_round`` uses, so that ties fall alike."""
    return f"floor(({sql}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"


# ---- SQL shared by several queries -------------------------------------------------------------------------

_RAW = {
    "flow_count": "count(*)", "unique_dst_ips": "count(DISTINCT dst4_addr)", "unique_dst_ports": "count(DISTINCT dst_port)", "total_bytes": "sum(in_bytes)",
    "total_packets": "sum(in_packets)", "avg_bytes_per_flow": "sum(in_bytes) / count(*)", "avg_packets_per_flow": "sum(in_packets) / count(*)",
    "pct_tcp": "count(*) FILTER (proto = 6) / count(*) * 100", "pct_udp": "count(*) FILTER (proto = 17) / count(*) * 100", "pct_icmp": "count(*) FILTER (proto = 1) / count(*) * 100",
    "pct_well_known_ports": "count(*) FILTER (dst_port < 1024) / count(*) * 100", "pct_high_ports": "100 - count(*) FILTER (dst_port < 1024) / count(*) * 100",
    "avg_duration": "sum(greatest(last_ms - first_ms, 0) / 1000.0::DOUBLE) / count(*)", "ip_port_ratio": "count(DISTINCT dst4_addr) / greatest(count(DISTINCT dst_port), 1)",
    "avg_payload_per_packet": "sum(in_bytes) / CASE WHEN sum(in_packets) = 0 THEN 1 ELSE sum(in_packets) END",
    "pct_syn_only": "count(*) FILTER (tcp_flags LIKE '%S%' AND NOT regexp_matches(tcp_flags, '[AFR]')) / count(*) * 100", "pct_rst": "count(*) FILTER (tcp_flags LIKE '%R%') / count(*) * 100",
}


def _features_sql(names: list[str]) -> str:
    return f"WITH {FLOWS_SQL} SELECT src4_addr AS ip, win, {', '.join(f'{_six(f"CAST({_RAW[n]} AS DOUBLE)")} AS {n}' for n in names)} FROM flows GROUP BY 1, 2"


def _iat_sql(cap: int | None) -> str:
    """CTEs ending in ``iat(ip, win, iat_mean, iat_variance, iat_cv)``."""
    arrived = f"SELECT *, row_number() OVER (PARTITION BY src4_addr, win, dst4_addr, dst_port ORDER BY {', '.join(ORDER)}) AS rn FROM flows"
    return f"""{FLOWS_SQL}, arrived AS ({arrived}),
gaps AS (SELECT src4_addr AS ip, win, coalesce((first_ms - lag(first_ms) OVER (PARTITION BY src4_addr, win, dst4_addr, dst_port ORDER BY first_ms)), 0) AS gap
  FROM arrived{f' WHERE rn <= {cap}' if cap else ''}),
moments AS (SELECT ip, win, CAST(sum(gap) AS DOUBLE) / count(*) / 1000 AS iat_mean,
  CASE WHEN count(*) > 1 THEN CAST(count(*) * sum(gap * gap) - sum(gap) * sum(gap) AS DOUBLE) / CAST(count(*) * (count(*) - 1) AS DOUBLE) / 1000000.0::DOUBLE ELSE 0 END AS iat_variance FROM gaps GROUP BY 1, 2),
iat AS (SELECT *, CASE WHEN iat_mean > 0 THEN sqrt(iat_variance) / iat_mean ELSE 0 END AS iat_cv FROM moments)"""


_IAT_NAMES = ["iat_mean", "iat_variance", "iat_cv"]
_IAT_OUT = ", ".join(f"{_six(n)} AS {n}" for n in _IAT_NAMES)
_SYMMETRY = """ports AS (SELECT DISTINCT src4_addr AS ip, win, dst_port AS port, TRUE AS o FROM flows UNION SELECT DISTINCT dst4_addr, win, dst_port, FALSE FROM flows),
sides AS (SELECT ip, win, port, bool_or(o) AS o, bool_or(NOT o) AS i FROM ports GROUP BY 1, 2, 3),
symmetry AS (SELECT ip, win, CAST(count(*) FILTER (o AND i) AS BIGINT) AS port_symmetry, bool_or(o) AS calls FROM sides GROUP BY 1, 2)"""
_ALL21 = f"""{_iat_sql(None)}, {_SYMMETRY},
raw AS (SELECT src4_addr AS ip, win, {', '.join(f'CAST({_RAW[n]} AS DOUBLE) AS {n}' for n in _RAW)} FROM flows GROUP BY 1, 2),
features AS (SELECT s.ip, s.win, {', '.join('CAST(s.port_symmetry AS DOUBLE) * CASE WHEN s.calls THEN 1 ELSE 0 END AS port_symmetry' if n == 'port_symmetry' else f'coalesce({n}, 0) AS {n}' for n in FLOW_FEATURES)}
  FROM symmetry s LEFT JOIN raw ON raw.ip = s.ip AND raw.win = s.win LEFT JOIN iat ON iat.ip = s.ip AND iat.win = s.win)"""
_TREES = ENSEMBLE.margin_sql(FLOW_FEATURES)
_SCORED = f"{_ALL21}, scored AS (SELECT *, 1 / (1 + exp(-(0.0 + {' + '.join(f'({t})' for t in _TREES)}))) AS probability FROM features)"
_BEST = f"{_SCORED}, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY ip ORDER BY probability DESC, win) = 1)"
_ROLES_ROUND = ", ".join(f"{_six(n)} AS {n}" for n in FLOW_FEATURES)


# ---- projections and filters -------------------------------------------------------------------------------

_COLUMNS = "first, last, in_packets, in_bytes, proto, tcp_flags, src_port, dst_port, src4_addr, dst4_addr"


@_query(
    f"WITH {FLOWS_SQL} SELECT {', '.join(ORDER)}, strftime(make_timestamp(first_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') AS first, strftime(make_timestamp(last_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') AS last, {_COLUMNS[13:]} FROM flows"
)
def flow_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select(*ORDER, *_COLUMNS.split(", "))


@_query(f"WITH {FLOWS_SQL} SELECT {', '.join(ORDER)}, first_ms, win FROM flows WHERE l_linenumber <> 7")
def filter_valid_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = flows(spark, sf_dir).withColumn("first", F.when(F.col("l_linenumber") == 7, F.replace("first", F.lit("-"), F.lit("/"))).otherwise(F.col("first")))
    return ff.valid_time(ff.normalize(broken)).select(*ORDER, "first_ms", "win")


@_query(f"WITH {FLOWS_SQL} SELECT {', '.join(ORDER)} FROM flows WHERE tcp_flags LIKE '%S%' AND NOT regexp_matches(tcp_flags, '[AFR]')")
def syn_only_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).where(ff.is_syn_only(F.col("tcp_flags"))).select(*ORDER)


@_query(f"WITH {FLOWS_SQL} SELECT {', '.join(ORDER)} FROM flows WHERE tcp_flags LIKE '%R%'")
def rst_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).where(ff.has_flag(F.col("tcp_flags"), "R")).select(*ORDER)


# ---- window features of flows ------------------------------------------------------------------------------


def _feature_query(name: str, names: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _outbound(spark, sf_dir, names)

    run.__name__ = name
    _query(_features_sql(names))(run)


_feature_query("window_flow_counts", ["flow_count", "total_bytes", "total_packets", "avg_bytes_per_flow", "avg_packets_per_flow", "avg_payload_per_packet"])
_feature_query("window_distincts", ["unique_dst_ips", "unique_dst_ports", "ip_port_ratio"])
_feature_query("window_protocol_pct", ["pct_tcp", "pct_udp", "pct_icmp", "pct_syn_only", "pct_rst"])
_feature_query("window_port_pct", ["pct_well_known_ports", "pct_high_ports"])
_feature_query("window_duration", ["avg_duration"])


@_query(f"WITH {FLOWS_SQL}, {_SYMMETRY} SELECT ip, win, port_symmetry FROM symmetry WHERE calls")
def port_symmetry_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ff.port_symmetry_joined(_normal(spark, sf_dir))


@_query(f"WITH {FLOWS_SQL}, {_SYMMETRY} SELECT ip, win, port_symmetry FROM symmetry")
def port_symmetry_onepass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ff.port_symmetry(_normal(spark, sf_dir))


@_query(f"WITH {FLOWS_SQL}, {_SYMMETRY}, calls AS (SELECT src4_addr AS ip, win, count(*)::BIGINT AS flow_count FROM flows GROUP BY 1, 2) SELECT c.ip, c.win, flow_count, coalesce(port_symmetry, 0)::BIGINT AS port_symmetry FROM calls c LEFT JOIN (SELECT * FROM symmetry WHERE port_symmetry > 2) s ON s.ip = c.ip AND s.win = c.win")
def features_left_join_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = _normal(spark, sf_dir)
    calls = normal.groupBy(F.col("src4_addr").alias("ip"), "win").agg(F.count("*").alias("flow_count"))
    some = ff.port_symmetry(normal).where("port_symmetry > 2")
    return calls.join(some, ["ip", "win"], "left").select("ip", "win", "flow_count", F.coalesce("port_symmetry", F.lit(0)).cast("long").alias("port_symmetry"))


@_query(f"WITH {FLOWS_SQL}, r AS (SELECT src4_addr AS ip, win, dst_port AS port, TRUE AS outbound FROM flows UNION ALL SELECT dst4_addr, win, dst_port, FALSE FROM flows) SELECT ip, win, port, outbound, count(*)::BIGINT AS n FROM r GROUP BY 1, 2, 3, 4")
def role_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ff.roles(_normal(spark, sf_dir)).groupBy("ip", "win", "port", "outbound").agg(F.count("*").alias("n"))


@_query(f"WITH {_iat_sql(None)} SELECT ip, win, {_IAT_OUT} FROM iat")
def iat_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outbound(spark, sf_dir, _IAT_NAMES)


@_query(f"WITH {_iat_sql(3)} SELECT ip, win, {_IAT_OUT} FROM iat")
def iat_capped3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outbound(spark, sf_dir, _IAT_NAMES, 3)


@_query(f"WITH {_iat_sql(10)} SELECT ip, win, {_IAT_OUT} FROM iat")
def iat_capped10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outbound(spark, sf_dir, _IAT_NAMES, 10)


@_query(f"WITH {_ALL21} SELECT ip, win, {_ROLES_ROUND} FROM features")
def flow_features_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ff.flow_features(flows(spark, sf_dir)), FLOW_FEATURES)


@_query(f"WITH {FLOWS_SQL}, {_SYMMETRY} SELECT ip, win, 0.0::DOUBLE AS flow_count, 0.0::DOUBLE AS pct_high_ports FROM symmetry WHERE NOT calls")
def inbound_only_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ff.flow_features(flows(spark, sf_dir)).where("flow_count = 0").select("ip", "win", "flow_count", "pct_high_ports")


@_query(f"WITH {FLOWS_SQL} SELECT src4_addr AS ip, CAST(l_linenumber % 2 AS VARCHAR) AS fragment, win, CAST(count(*) AS DOUBLE) AS flow_count FROM flows GROUP BY 1, 2, 3")
def flow_features_fragmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ff.flow_features(flows(spark, sf_dir), include_inbound_only=False, fragment=(F.col("l_linenumber") % 2).cast("string"))
    return found.select("ip", "fragment", "win", "flow_count")


# ---- rules -------------------------------------------------------------------------------------------------

_T = TEST_RULES.thresholds
_BY_ORDER = f"ORDER BY {', '.join(ORDER)} ROWS UNBOUNDED PRECEDING"
_PAIR = f"PARTITION BY src4_addr, dst4_addr {_BY_ORDER}"


def _pair_sql(flag: str, count: int, seconds: float) -> str:
    return f"""SELECT DISTINCT src4_addr AS ip FROM (SELECT src4_addr, count(*) OVER w AS n, bool_or({flag}) OVER w AS f,
      (max(greatest(first_ms, last_ms)) OVER w - min(first_ms) OVER w) / 1000.0 AS span FROM flows WINDOW w AS ({_PAIR})) WHERE f AND n > {count} AND span < {seconds}"""


_RULE_SQL = {
    rules.FREQUENCY: f"SELECT src4_addr AS ip FROM flows GROUP BY 1 HAVING count(*) > {_T.frequency_of_connections}",
    rules.REUSE: f"SELECT DISTINCT src4_addr AS ip FROM (SELECT src4_addr FROM flows GROUP BY src4_addr, dst4_addr HAVING count(*) > {_T.ip_reuse_connections})",
    rules.PEERS: f"SELECT src4_addr AS ip FROM flows GROUP BY 1 HAVING count(DISTINCT dst4_addr) > {_T.p2p_unique_peers}",
    rules.SIZE: f"""SELECT DISTINCT src4_addr AS ip FROM (SELECT src4_addr, count(*) OVER w AS n, sum(in_bytes) OVER w AS b FROM flows WHERE in_bytes > 0
      WINDOW w AS (PARTITION BY src4_addr {_BY_ORDER})) WHERE n > {_T.packet_size_anomaly_min_flows} OR (n >= 10 AND b // n < {_T.packet_size_anomaly_avg_bytes})""",
    rules.KNOWN: "SELECT DISTINCT src4_addr AS ip FROM flows WHERE src4_addr IN ('10.0.0.7', '10.0.0.61') OR dst4_addr IN ('10.0.0.7', '10.0.0.61')",
    rules.PORTS: _pair_sql("dst_port IN (6667, 23)", _T.suspicious_port_connection_count, _T.suspicious_port_time_window_sec),
    rules.SMALL: _pair_sql(f"in_packets >= {_T.min_packets_for_avg} AND in_bytes // in_packets < {_T.small_avg_packet_bytes}", _T.behavioral_connection_count, _T.behavioral_time_window_sec),
}
_TRIGGERED = f"{FLOWS_SQL}, triggered AS (" + " UNION ALL ".join(f"SELECT ip, '{k}' AS reason FROM ({v})" for k, v in _RULE_SQL.items()) + ")"
_WEIGHTS = TEST_RULES.weights.by_reason()
_WEIGHT_SQL = "CASE reason " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _WEIGHTS.items()) + " END"
_RISK = f"least(floor(sum({_WEIGHT_SQL}) / {float(sum(_WEIGHTS.values()))} * 100 * 100 + 0.5) / 100, 100.0)"


def _rule_query(name: str, rule: rules.Rule, reason: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rule(_normal(spark, sf_dir), TEST_RULES, ORDER)

    run.__name__ = name
    _query(f"WITH {FLOWS_SQL} SELECT ip, '{reason}' AS reason FROM ({_RULE_SQL[reason]})")(run)


_rule_query("rule_frequency", rules.frequency, rules.FREQUENCY)
_rule_query("rule_reuse", rules.reuse, rules.REUSE)
_rule_query("rule_p2p", rules.peers, rules.PEERS)
_rule_query("rule_packet_size_running", rules.packet_size, rules.SIZE)
_rule_query("rule_known_set_semi", rules.known_addresses, rules.KNOWN)
_rule_query("rule_suspicious_ports_running", rules.suspicious_ports, rules.PORTS)
_rule_query("rule_small_packets_running", rules.small_packets, rules.SMALL)


@_query(f"WITH {FLOWS_SQL} SELECT src4_addr AS ip, 'Packet Size Anomalies' AS reason FROM flows WHERE in_bytes > 0 GROUP BY 1 HAVING count(*) > 1490")
def rule_packet_size_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch for many flows with bytes, at a limit that some addresses pass and no average can."""
    config = rules.RuleConfig(thresholds=rules.Thresholds(packet_size_anomaly_min_flows=1490, packet_size_anomaly_avg_bytes=0))
    return rules.packet_size(_normal(spark, sf_dir), config, ORDER)


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.risk_scores(rules.triggered(flows(spark, sf_dir), TEST_RULES, ORDER), _WEIGHTS)


@_query(f"WITH {_TRIGGERED} SELECT ip, CAST({_RISK} AS DOUBLE) AS risk FROM triggered GROUP BY 1 HAVING {_RISK} > 0")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir).select("ip", "risk")


@_query(f"WITH {_TRIGGERED} SELECT ip, string_agg(reason, ', ' ORDER BY reason) AS reasons FROM triggered GROUP BY 1 HAVING {_RISK} > 0")
def risk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir).select("ip", F.array_join("reasons", ", ").alias("reasons"))


_PATTERN_SQL = f"""{FLOWS_SQL}, hits AS (SELECT src4_addr AS ip, 'irc_port' AS reason FROM flows WHERE dst_port = 6667
  UNION SELECT src4_addr, 'syn_probe' FROM flows WHERE regexp_matches(tcp_flags, '^[^AFR]*S'))"""


@_query(f"WITH {_PATTERN_SQL} SELECT ip, reason FROM hits")
def pattern_rules_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.pattern_rule(flows(spark, sf_dir).select(*_COLUMNS.split(", ")), PATTERNS)


_SCRIPT_WEIGHTS = {rules.FREQUENCY: 1, rules.REUSE: 1, rules.PEERS: 75, rules.SIZE: 75, "irc_port": 1, "syn_probe": 1, "unused": 1}


@_query(
    f"WITH {_PATTERN_SQL}, t AS (SELECT * FROM hits"
    + f" UNION SELECT src4_addr, '{rules.FREQUENCY}' FROM flows GROUP BY 1 HAVING count(*) > 1480"
    + f" UNION SELECT src4_addr, '{rules.REUSE}' FROM flows GROUP BY src4_addr, dst4_addr HAVING count(*) > 40"
    + f" UNION SELECT src4_addr, '{rules.PEERS}' FROM flows GROUP BY 1 HAVING count(DISTINCT dst4_addr) > 31"
    + f" UNION SELECT src4_addr, '{rules.SIZE}' FROM flows GROUP BY 1 HAVING count(*) > 1500)"
    + " SELECT ip, CAST(floor(sum(CASE WHEN reason IN ('"
    + f"{rules.PEERS}', '{rules.SIZE}') THEN 75 ELSE 1 END) / 155.0 * 100 * 100 + 0.5) / 100 AS DOUBLE) AS risk FROM t GROUP BY 1"
)
def script_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.script_scores(flows(spark, sf_dir), PATTERNS, _SCRIPT_WEIGHTS, 1480, 40, 31, 1500).select("ip", "risk")


# ---- scoring and reports -----------------------------------------------------------------------------------


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ff.flow_features(flows(spark, sf_dir))


@_query(f"WITH {_SCORED} SELECT ip, win, {_six('probability')} AS probability FROM scored")
def tree_score_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(md.score_case(_features(spark, sf_dir), ENSEMBLE, FLOW_FEATURES).select("ip", "win", "probability"), ["probability"])


@_query(f"WITH {_SCORED} SELECT ip, win, {_six('probability')} AS probability FROM scored")
def tree_score_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(md.score(_features(spark, sf_dir), ENSEMBLE, FLOW_FEATURES).select("ip", "win", "probability"), ["probability"])


@_query(f"WITH {_BEST} SELECT ip, win, {_six('probability')} AS probability FROM best")
def max_prob_per_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(md.best_window(md.score(_features(spark, sf_dir), ENSEMBLE, FLOW_FEATURES)).select("ip", "win", "probability"), ["probability"])


def _paths(node: dict, above: tuple = ()) -> list[tuple[list[str], list[int], float]]:
    """Conditions, split features and leaf of every path, for the oracle of contributions."""
    if "leaf" in node:
        return [([c for c, _ in above], [f for _, f in above], node["leaf"])]
    f = int(node["split"][1:])
    out = []
    for child in node["children"]:
        sign = "<" if child["nodeid"] == node["yes"] else ">="
        out += _paths(child, (*above, (f"{FLOW_FEATURES[f]} {sign} {node['split_condition']}", f)))
    return out


def _contribution_sql() -> str:
    rows = []
    for tree in FLOW_TREES:
        for conditions, features, leaf in _paths(tree):
            for f in features:
                rows.append(f"SELECT ip, win, {f} AS idx, {FLOW_FEATURES[f]} AS value, {leaf}::DOUBLE / {len(features)} AS part FROM features WHERE {' AND '.join(conditions)}")
    return " UNION ALL ".join(rows)


@_query(
    f"""WITH {_ALL21}, parts AS ({_contribution_sql()}), sums AS (SELECT ip, win, idx, max(value) AS value, round(sum(part), 6) AS contribution FROM parts GROUP BY 1, 2, 3 HAVING round(sum(part), 6) <> 0)
SELECT ip, win, row_number() OVER (PARTITION BY ip, win ORDER BY contribution DESC, idx)::INT AS place, idx::INT AS idx, floor(value * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS value, contribution FROM sums
QUALIFY row_number() OVER (PARTITION BY ip, win ORDER BY contribution DESC, idx) <= 4"""
)
def top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = md.contributions(_features(spark, sf_dir), ENSEMBLE, FLOW_FEATURES)
    top = found.select("ip", "win", F.posexplode(F.slice("contributions", 1, md.TOP_REASONS)).alias("pos", "c"))
    return _round(top.select("ip", "win", (F.col("pos") + 1).alias("place"), F.col("c.index").alias("idx"), F.col("c.value").alias("value"), F.round("c.contribution", 6).alias("contribution")), ["value"])


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.results(_features(spark, sf_dir), ENSEMBLE, FLOW_FEATURES)


@_query(f"WITH {_BEST} SELECT ip, {_six('probability * 100')} AS probability FROM best WHERE NOT probability > 0.5 ORDER BY probability DESC, ip LIMIT 5")
def top5_benign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(report.top_benign(_results(spark, sf_dir)).select("ip", "probability"), ["probability"])


@_query(f"WITH {_BEST} SELECT ip, {_six('probability * 100')} AS probability FROM best ORDER BY probability DESC, ip LIMIT 10")
def top10_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(report.top_overall(_results(spark, sf_dir)).select("ip", "probability"), ["probability"])


@_query(f"WITH {_BEST} SELECT (SELECT count(*) FROM flows)::BIGINT AS records, (count(*) FILTER (probability > 0.5))::BIGINT AS botnet_ips, count(*)::BIGINT AS ips FROM best")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(_results(spark, sf_dir), flows(spark, sf_dir))


@_query()
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.result_lines(report.ranked(_results(spark, sf_dir))).select("ip", "is_botnet", "line")


@_query(f"WITH {_BEST} SELECT ip, printf('[BENIGN TRAFFIC ] IP: %-15s | ML Probability: %6.2f%%', ip, floor(probability * 10000 + 0.5) / 100) AS line FROM best WHERE NOT probability > 0.5")
def report_lines_benign(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _results(spark, sf_dir).where("not is_botnet").withColumn("probability", F.floor(F.col("probability") * 100 + 0.5) / 100)
    return report.result_lines(whole).select("ip", "line")


# ---- packets -----------------------------------------------------------------------------------------------

_PACKET_RAW = {
    "Header_Length": "(20 * count(*) FILTER (proto = 6) + 8 * count(*) FILTER (proto IN (17, 1))) / count(*)", "Time_To_Live": "sum(ttl) / count(*)",
    "Rate": "CASE WHEN count(*) >= 2 AND max(ts) > min(ts) THEN count(*) / (max(ts) - min(ts)) ELSE 0 END",
    **{f"{n}_flag_number": f"count(*) FILTER (tcp_flags LIKE '%{c}%') / count(*)" for n, c in pf.FLAGS.items()},
    **{f"{n}_count": f"count(*) FILTER (tcp_flags LIKE '%{pf.FLAGS[n]}%')" for n in ("syn", "ack", "fin", "rst")},
    **{n: f"count(*) FILTER (port IN ({', '.join(map(str, p))})) / count(*)" for n, p in pf.APPLICATIONS.items()},
    **{n: f"count(*) FILTER (proto = {p}) / count(*)" for n, p in pf.PROTOCOLS.items()},
    "IPv": "1", "LLC": "0", "Tot sum": "sum(length)", "Min": "min(length)", "Max": "max(length)", "AVG": "avg(length)", "Std": "sqrt(coalesce(var_samp(length), 0))",
    "Tot size": "avg(length)", "IAT": "CASE WHEN count(*) >= 2 THEN (max(ts) - min(ts)) / (count(*) - 1) ELSE 0 END", "Number": "count(*)", "Variance": "coalesce(var_samp(length), 0)",
    "Protocol Type": "CASE greatest(count(*) FILTER (proto = 6), count(*) FILTER (proto = 17), count(*) FILTER (proto = 1), count(*) FILTER (proto = 2)) WHEN count(*) FILTER (proto = 6) THEN 6 WHEN count(*) FILTER (proto = 17) THEN 17 WHEN count(*) FILTER (proto = 1) THEN 1 ELSE 2 END",
}


@_query(f"WITH {PACKETS_SQL} SELECT ip, win, " + ", ".join(f'{_six(f"CAST({_PACKET_RAW[n]} AS DOUBLE)")} AS "{n}"' for n in PACKET_FEATURES) + " FROM roles GROUP BY 1, 2")
def packet_features_39(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(pf.packet_features(packets(spark, sf_dir)), PACKET_FEATURES)


@_query(f"WITH {PACKETS_SQL} SELECT ip, win, CAST({_PACKET_RAW['Protocol Type']} AS DOUBLE) AS protocol FROM roles GROUP BY 1, 2")
def packet_protocol_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.packet_features(packets(spark, sf_dir)).select("ip", "win", F.col("Protocol Type").alias("protocol"))


def _packet_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pf.packet_features(packets(spark, sf_dir))
    return md.results(found, md.Ensemble.parse(PACKET_TREES, len(PACKET_FEATURES)), PACKET_FEATURES)


#: Best packet window of each address, the trees written out; a zero goes where a missing value does.
_PACKET_BEST = f"""{PACKETS_SQL}, pf AS (SELECT ip, win, {_PACKET_RAW['Rate']} AS rate, sum(length) AS total, count(*) FILTER (tcp_flags LIKE '%S%') / count(*) AS syn FROM roles GROUP BY 1, 2),
pp AS (SELECT ip, win, 1 / (1 + exp(-(CASE WHEN rate = 0 OR rate < 0.25 THEN -0.5::DOUBLE WHEN total = 0 OR total < 40000 THEN 0.7::DOUBLE ELSE -0.1::DOUBLE END
  + CASE WHEN syn = 0 THEN 0.9::DOUBLE WHEN syn < 0.4 THEN 0.2::DOUBLE ELSE 0.9::DOUBLE END))) AS probability FROM pf),
pbest AS (SELECT ip, max(probability) AS probability FROM pp GROUP BY 1)"""


@_query(f"WITH {_PACKET_BEST} SELECT ip, {_six('probability * 100')} AS probability, probability > 0.5 AS is_botnet FROM pbest")
def packet_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_packet_results(spark, sf_dir).select("ip", "probability", "is_botnet"), ["probability"])


@_query(f"WITH {_BEST}, {_PACKET_BEST.replace(FLOWS_SQL + ',', '')} SELECT 'flow' AS origin, ip, {_six('probability * 100')} AS probability FROM best UNION ALL SELECT 'packet', ip, {_six('probability * 100')} FROM pbest")
def union_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of flows and of packets, each by its own features and model."""
    both = [found.select(F.lit(origin).alias("origin"), "ip", "probability") for origin, found in (("flow", _results(spark, sf_dir)), ("packet", _packet_results(spark, sf_dir)))]
    return _round(both[0].unionByName(both[1]), ["probability"])


# ---- sources: written, then read back -----------------------------------------------------------------------

_READ_BACK = f"WITH {FLOWS_SQL} SELECT strftime(make_timestamp(first_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') AS first, strftime(make_timestamp(last_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') AS last, {_COLUMNS[13:]} FROM flows"


def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """A column of text as files of the shared folder, which go when the application ends."""
    path = scratch_path(spark, name)
    lines.write.text(path)
    return path


@_query(_READ_BACK)
def source_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With commas, blank lines and broken records between the flows."""
    text = F.to_json(F.struct(*_COLUMNS.split(", ")))
    line = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("  "), text, F.lit(" ,"))).otherwise(text)
    broken = F.when(F.col("l_linenumber") == 3, F.concat(line, F.lit('\n\n{"first": "2024')))
    return src.read_ndjson(spark, _written(spark, flows(spark, sf_dir).select(F.coalesce(broken, line).alias("value")), "ndjson"))


@_query(_READ_BACK)
def source_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays in files of many flows each."""
    text = F.to_json(F.struct(*_COLUMNS.split(", ")))
    # arrays of bounded length: neighbours in a partition
    rows = flows(spark, sf_dir).select(text.alias("text"), F.floor(F.monotonically_increasing_id() / 1000).alias("n")).groupBy("n").agg(F.concat(F.lit("["), F.array_join(F.collect_list("text"), ",\n")).alias("value"))
    path = scratch_path(spark, "array")
    rows.select("value").repartition(8).write.option("lineSep", "]\n[").text(path)
    return src.read_json_array(spark, path)


@_query(f"WITH {FLOWS_SQL} SELECT first_ms, last_ms, in_packets, in_bytes, proto, CASE WHEN proto = 6 THEN '....S...' ELSE '........' END AS tcp_flags, src_port, dst_port, src4_addr, dst4_addr, label FROM flows")
def source_connection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connection log in CSV: other names and layouts, hexadecimal ports, durations and states instead of ends and flags."""
    f = ff.normalize(flows(spark, sf_dir))
    name = F.when(F.col("proto") == 6, "tcp").when(F.col("proto") == 17, "UDP").otherwise("icmp")
    start = F.replace(F.replace(F.col("first"), F.lit("-"), F.lit("/")), F.lit("T"), F.lit(" "))
    duration = ((F.col("last_ms") - F.col("first_ms")) / 1000).cast("string")
    port = F.concat(F.lit("0x"), F.lower(F.hex("dst_port")))
    out = {"StartTime": start, "Dur": duration, "Proto": name, "SrcAddr": F.col("src4_addr"), "Sport": F.col("src_port"), "DstAddr": F.col("dst4_addr"), "Dport": port, "State": F.lit("S_"), "TotPkts": F.col("in_packets"), "TotBytes": F.col("in_bytes"), "Label": F.col("label")}
    path = scratch_path(spark, "log")
    f.select(*(c.cast("string").alias(k) for k, c in out.items())).write.option("header", True).csv(path)
    read = ff.normalize(src.convert_connection_log(src.read_connection_log(spark, path)))
    return read.select("first_ms", "last_ms", "in_packets", "in_bytes", "proto", "tcp_flags", "src_port", "dst_port", "src4_addr", "dst4_addr", "label")


@_query(f"SELECT * REPLACE (CASE WHEN tcp_flags = '' THEN '........' ELSE tcp_flags END AS tcp_flags) FROM ({_READ_BACK})")
def source_raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of text, keys in several spellings."""
    c = F.col
    flags = F.when(c("tcp_flags") == "", "........").otherwise(c("tcp_flags"))
    lines = {
        "first": F.concat(F.lit("1234 ["), F.replace("first", F.lit("T"), F.lit(" ")), F.lit("]")), "LAST": F.concat(F.lit("1234 ["), F.replace("last", F.lit("T"), F.lit(" ")), F.lit("]")),
        "in packets": c("in_packets"), "in_bytes": c("in_bytes"), "proto": F.concat("proto", F.lit(" NAME")), "tcp flags": F.concat(F.lit("0x02 "), flags),
        "src port": c("src_port"), "dst_port": c("dst_port"), "src4 addr": c("src4_addr"), "dst addr": c("dst4_addr"),
    }
    block = F.concat(F.lit("Flow Record:\n"), *(F.concat(F.lit(f"  {k} = "), v.cast("string"), F.lit("\n")) for k, v in lines.items()))
    return src.read_raw_export(spark, _written(spark, flows(spark, sf_dir).select(block.alias("value")), "raw")).select(*_COLUMNS.split(", "))


@_query(f"WITH {FLOWS_SQL} SELECT count(*) FILTER (l_linenumber = 3) AS bad, '{{\"first\": \"2024' AS first_bad FROM flows")
def source_bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records can't be read, and the first of them."""
    text = F.when(F.col("l_linenumber") == 3, '{"first": "2024').otherwise(F.to_json(F.struct(*_COLUMNS.split(", "))))
    return src.bad_records(src.read_ndjson(spark, _written(spark, flows(spark, sf_dir).select(text.alias("value")), "bad"), mode="keep"))


# ---- streams of all features --------------------------------------------------------------------------------


def _streamed(spark: SparkSession, fragments: windows.Fragments, *parts: DataFrame) -> DataFrame:
    """Each part as a stream's next files, all windows closed at the end."""
    where = scratch_path(spark, "stream-in")
    checkpoint = scratch_path(spark, "stream-checkpoint")
    for part in parts:
        part.write.mode("append").parquet(where)
        fragments.start(spark.readStream.schema(part.schema).parquet(where), checkpoint).awaitTermination()
    fragments.flush(spark)
    remove(spark, where)
    return fragments.read(spark)


@_query(f"WITH {_ALL21} SELECT ip, win, {_ROLES_ROUND} FROM features")
def stream_flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 21 features from a stream, each window as it closes: what the batch finds."""
    fragments = windows.Fragments.of_flows(scratch_path(spark, "stream"))
    fragments.start(flows_of(lineitem_stream(spark, sf_dir)), scratch_path(spark, "stream-checkpoint")).awaitTermination()
    fragments.flush(spark)
    return _round(fragments.read(spark).select("ip", "win", *FLOW_FEATURES), FLOW_FEATURES)


@_query(ORACLE_SQL["packet_features_39"])
def stream_packet_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = windows.Fragments.of_packets(scratch_path(spark, "stream"))
    fragments.start(packets_of(lineitem_stream(spark, sf_dir)), scratch_path(spark, "stream-checkpoint")).awaitTermination()
    fragments.flush(spark)
    return _round(fragments.read(spark).select("ip", "win", *PACKET_FEATURES), PACKET_FEATURES)


@_query(
    f"""WITH {FLOWS_SQL}, latest AS (SELECT max(first_ms) FILTER (l_orderkey % 10 <> 0) // 1000 - 300 AS edge FROM flows),
parts AS (SELECT *, l_orderkey % 10 = 0 AND win + 300 <= (SELECT edge FROM latest) AS late FROM flows)
SELECT src4_addr AS ip, win, late, count(*)::DOUBLE AS flow_count, sum(in_bytes)::DOUBLE AS total_bytes, count(DISTINCT dst4_addr)::DOUBLE AS unique_dst_ips FROM parts GROUP BY 1, 2, 3"""
)
def stream_late_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the flows comes after all others: in windows that have closed by then, as fragments of their own."""
    rows = lineitem(spark, sf_dir)
    found = _streamed(spark, windows.Fragments.of_flows(scratch_path(spark, "stream")), flows_of(rows.where("l_orderkey % 10 <> 0")), flows_of(rows.where("l_orderkey % 10 = 0")))
    return found.where("flow_count > 0").select("ip", "win", (F.col("batch") == 1).alias("late"), "flow_count", "total_bytes", "unique_dst_ips")


# ---- labels, conversion, files, streams, training ----------------------------------------------------------


@_query(f"WITH {FLOWS_SQL} SELECT src4_addr AS ip, win, max(CASE WHEN lower(label) LIKE '%bot%' THEN 1 ELSE 0 END)::INT AS is_botnet, count(*)::DOUBLE AS flow_count FROM flows GROUP BY 1, 2")
def label_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.labelled_windows(flows(spark, sf_dir)).select("ip", "win", "is_botnet", "flow_count")


@_query("SELECT (count(*) FILTER (quality = 1))::BIGINT AS positives, (count(*) FILTER (quality = 0))::BIGINT AS negatives, floor(count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1) * 1e6 + 0.5) / 1e6 AS imbalance_ratio, floor(count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1) * 1e6 + 0.5) / 1e6 AS scale_pos_weight FROM labels")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(training.class_balance(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality"), ["imbalance_ratio", "scale_pos_weight"])


@_query(f"WITH {FLOWS_SQL} SELECT (count(*) FILTER (label LIKE '%Bot%'))::BIGINT AS botnet, (count(*) FILTER (label LIKE '%Normal'))::BIGINT AS normal, (count(*) FILTER (label LIKE '%Background'))::BIGINT AS background, 0::BIGINT AS other FROM flows")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.flows import label_counts as count

    return count(flows(spark, sf_dir))


_STATES = ["S_FA", "FA_FA", "s_", "SRA_X", "S_R", "R_A", "", "XAX", "SR_A", "PA_PA"]
_STATE_PICK = "element_at(array(" + ", ".join(f"'{s}'" for s in _STATES) + "), CAST(l_partkey % 10 AS INT) + 1)"
_STATE_SQL = "(ARRAY[" + ", ".join(f"'{s}'" for s in _STATES) + "])[(l_partkey % 10)::INT + 1]"


@_query(
    f"""WITH {FLOWS_SQL}, s AS (SELECT {', '.join(ORDER)}, proto, upper({_STATE_SQL}) AS s FROM flows)
SELECT {', '.join(ORDER)}, CASE WHEN proto <> 6 THEN '........' {' '.join(f"WHEN starts_with(s, '{p}') THEN '{f}'" for p, f in convert.STATE_FLAGS)} WHEN contains(s, 'A') THEN '..A.....' ELSE '........' END AS flags FROM s"""
)
def converter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select(*ORDER, convert.state_flags(F.expr(_STATE_PICK), F.col("proto")).alias("flags"))


@_query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN (l_partkey % 65536)::INT WHEN 1 THEN (l_partkey % 65536)::INT WHEN 2 THEN 0 ELSE 0 END AS port FROM lineitem"""
)
def converter_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 65536
    text = F.when(F.col("l_partkey") % 4 == 0, k.cast("string")).when(F.col("l_partkey") % 4 == 1, F.concat(F.lit("0x"), F.lower(F.hex(k)))).when(F.col("l_partkey") % 4 == 2, " ").otherwise("http")
    return flows(spark, sf_dir).select(*ORDER, convert.port_number(text).alias("port"))


@_query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS iso, strftime(ts + INTERVAL 1500 MILLISECOND, '%Y-%m-%dT%H:%M:%S.%g') AS until FROM events")
def converter_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSSSSS")
    iso = convert.iso_time(text)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", iso.alias("iso"), convert.end_time(iso, F.lit(1.5)).alias("until"))


@_query()
def file_type_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_type_counts(spark, sf_dir).select("kind", "files", "bytes", "shown")


QUERIES["file_type_counts"] = QUERIES.pop("file_type_counts_query")

_HOURLY = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@_query(_HOURLY)
def hourly_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.event_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("total", F.round("total", 4))


@_query(_HOURLY)
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream, in complete mode, so that no window waits for a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a stream reads folders; the name picks the table out of this one
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counted = windows.event_counts(stream)
    out = windows.run_available(counted, f"hourly_{uuid.uuid4().hex}", mode="complete")
    return out.withColumn("total", F.round("total", 4))


@_query(
    """WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 1 AND toxic = 1) AS tp FROM labels)
SELECT tn, fp, fn, tp, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS recall FROM c"""
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column of a fixed table held against another."""
    return training.confusion(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", "toxic")


@_query()
def train_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's default model on labelled windows, evaluated on the held-out fifth."""
    data = training.labelled_windows(flows(spark, sf_dir))
    train, test = training.stratified_split(data, ["ip", "win"], "is_botnet")
    columns = [f"f{i}" for i in range(len(FLOW_FEATURES))]
    weight = training.class_balance(train).first()["scale_pos_weight"] or 1.0
    model = training.train(training.numbered_features(train, FLOW_FEATURES), columns, pos_weight=weight)
    return training.confusion(training.predict(model, training.numbered_features(test, FLOW_FEATURES), columns))

