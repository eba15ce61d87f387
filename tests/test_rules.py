import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import DST, OTHER, SRC, flow, flows
from siftflow.operators import rules
from siftflow.operators.flow_features import normalize

ORDER = ["src_port"]


def at(n):
    return f"2026-03-17T{12 + n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}.000"


def hits(spark, rule, rows, config=None):
    return [r.ip for r in rule(normalize(flows(spark, rows)), config or rules.RuleConfig(), ORDER).collect()]


def numbered(n, **kw):
    return [flow(sport=i, **kw) for i in range(n)]


@pytest.mark.parametrize(("rule", "limit", "make"), [
    (rules.frequency, 10, lambda n: numbered(n)),
    (rules.reuse, 3, lambda n: numbered(n)),
    (rules.peers, 5, lambda n: [flow(dst=f"198.51.100.{i}") for i in range(n)]),
    (rules.packet_size, 100, lambda n: numbered(n, size=10_000)),
])
def test_limits(spark, rule, limit, make):
    assert hits(spark, rule, make(limit)) == []
    assert hits(spark, rule, make(limit + 1)) == [SRC]


def test_empty_peers_count_for_frequency_only(spark):
    rows = numbered(11, dst="")
    assert hits(spark, rules.frequency, rows) == [SRC]
    assert hits(spark, rules.reuse, rows) == []
    assert hits(spark, rules.peers, rows) == []


def test_small_average_holds_by_prefix(spark):
    rows = [flow(sport=i, size=100) for i in range(10)] + [flow(sport=i, size=1_000_000) for i in range(10, 20)]
    assert hits(spark, rules.packet_size, rows) == [SRC]
    assert hits(spark, rules.packet_size, rows[::-1][:5] + [flow(sport=30 + i, size=100) for i in range(5)]) == []
    assert hits(spark, rules.packet_size, [flow(sport=i, size=500) for i in range(10)]) == []
    assert hits(spark, rules.packet_size, [flow(sport=i, size=0) for i in range(20)]) == []


def test_known_addresses(spark):
    config = rules.RuleConfig(known_c2_ips=(OTHER,))
    assert hits(spark, rules.known_addresses, [flow(), flow(dst=OTHER)], config) == [SRC]
    assert hits(spark, rules.known_addresses, [flow()], config) == []
    assert hits(spark, rules.known_addresses, [flow()]) == []


def test_suspicious_ports(spark):
    config = rules.RuleConfig(suspicious_ports=(6667,))
    rows = [flow(sport=i, dport=6667 if i == 0 else 80, first=at(i)) for i in range(11)]
    assert hits(spark, rules.suspicious_ports, rows, config) == [SRC]
    assert hits(spark, rules.suspicious_ports, rows[:10], config) == []
    assert hits(spark, rules.suspicious_ports, rows[1:] + [flow(sport=99, first=at(99))], config) == []
    # what comes later doesn't undo it, but a span that was too long from the start does
    assert hits(spark, rules.suspicious_ports, [*rows, flow(sport=50, first=at(3000))], config) == [SRC]
    assert hits(spark, rules.suspicious_ports, [flow(sport=i, dport=6667, first=at(i * 60)) for i in range(11)], config) == []


def test_spans_without_times(spark):
    config = rules.RuleConfig(suspicious_ports=(6667,))
    bad = [flow(sport=i, dport=6667, first="x", last="x") for i in range(11)]
    assert hits(spark, rules.suspicious_ports, bad, config) == [SRC]
    ends = [flow(sport=i, dport=6667, first="x", last=at(i)) for i in range(11)]
    assert hits(spark, rules.suspicious_ports, ends, config) == []


def test_small_packets(spark):
    rows = [flow(sport=i, packets=10, size=1999, first=at(i)) for i in range(51)]
    assert hits(spark, rules.small_packets, rows) == [SRC]
    assert hits(spark, rules.small_packets, rows[:50]) == []
    assert hits(spark, rules.small_packets, [flow(sport=i, packets=10, size=2000, first=at(i)) for i in range(51)]) == []
    assert hits(spark, rules.small_packets, [flow(sport=i, packets=9, size=9, first=at(i)) for i in range(51)]) == []
    assert hits(spark, rules.small_packets, [flow(sport=i, packets=0, size=9, first=at(i)) for i in range(51)]) == []


def test_tiers(spark):
    weights = rules.Weights().by_reason()
    assert sum(weights.values()) == 155
    reasons = [("a", r) for r in weights if r != rules.KNOWN] + [("b", rules.FREQUENCY), ("b", rules.FREQUENCY), ("c", "unknown")]
    reasons += [("d", r) for r in (rules.FREQUENCY, rules.REUSE, rules.PEERS, rules.SIZE)] + [("e", r) for r in weights]
    got = {r.ip: r.risk for r in rules.risk_scores(spark.createDataFrame(reasons, "ip string, reason string"), weights).collect()}
    assert got == {"a": 99.35, "b": 0.65, "d": 98.06, "e": 100.0}


def test_patterns(spark):
    df = flows(spark, [flow(dport=6667), flow(src=OTHER, flags="R")])
    got = {(r.ip, r.reason) for r in rules.pattern_rule(df, {"irc": '"dst_port":6667', "reset": '"tcp_flags":"R"', "none": "zzz"}).collect()}
    assert got == {(SRC, "irc"), (OTHER, "reset")}


def test_script_rules_count_all_flows(spark):
    weights = {rules.FREQUENCY: 1, rules.REUSE: 1, rules.PEERS: 75, rules.SIZE: 75, "x": 3}
    got = rules.script_scores(flows(spark, numbered(12, size=0)), {}, weights, size_limit=11).collect()
    assert [(r.ip, r.risk) for r in got] == [(SRC, 49.68)]


def test_config(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"suspicious_ports": [1], "thresholds": {"ip_reuse_connections": 9}}))
    config = rules.RuleConfig.load(str(path))
    assert config.suspicious_ports == (1,)
    assert (config.thresholds.ip_reuse_connections, config.thresholds.p2p_unique_peers) == (9, 5)
    path.write_text("{")
    with pytest.raises(ValueError, match="rules.json"):
        rules.RuleConfig.load(str(path))
    with pytest.raises(ValueError, match="nowhere"):
        rules.RuleConfig.load("nowhere.json")


def test_triggered_from_any_rules(spark):
    def custom(normal, config, order):
        return normal.selectExpr("src4_addr AS ip", "'custom' AS reason").distinct()

    got = rules.triggered(flows(spark, [flow(), flow(dst=DST)]), rules.RuleConfig(), ORDER, [*rules.RULES, custom]).collect()
    assert [(r.ip, r.reason) for r in got] == [(SRC, "custom")]


def test_missing_keys(spark):
    df = flows(spark, [flow(), flow(src=None), flow(size=None), flow(dst=None, size=None)])
    assert rules.missing_keys(df).first()[:] == (4, 3)
    assert rules.missing_keys(df.drop("in_bytes")).first()[:] == (4, 4)


def test_rules_together_and_apart_agree(spark):
    import random

    rng = random.Random(1)
    ips = ["", SRC, DST, OTHER, "192.0.2.9"]
    rows = [
        flow(sport=i, src=rng.choice(ips), dst=rng.choice(ips), dport=rng.choice([80, 6667]), packets=rng.choice([0, 5, 10, 40]), size=rng.choice([0, 100, 4000, 90_000]), first=rng.choice([at(i * 3), at(i), "x"]), last=rng.choice([at(i * 4), "x"]))
        for i in range(600)
    ]
    limits = rules.Thresholds(120, 25, 4, 90, 30_000, 1500, 10, 6, 200, 9, 150)
    for config in (rules.RuleConfig((6667,), (OTHER,), limits), rules.RuleConfig()):
        df = flows(spark, rows)
        apart = None
        for rule in rules.RULES:
            hits = rule(normalize(df), config, ORDER)
            apart = hits if apart is None else apart.unionByName(hits)
        assert {tuple(r) for r in rules.triggered(df, config, ORDER).collect()} == {tuple(r) for r in apart.collect()}


def test_no_rules(spark):
    assert rules.triggered(flows(spark, [flow()]), rules.RuleConfig(), ORDER, rules=[]).collect() == []


@pytest.mark.parametrize("ranges", [1, 3, 1024])
def test_running_values_are_those_of_one_pass(spark, monkeypatch, ranges):
    monkeypatch.setattr(rules, "RANGES", ranges)
    rng = random.Random(1)
    data = [(rng.choice("aab"), rng.choice([None, *range(40)]), i, rng.choice([None, *range(9)])) for i in range(600)]
    df = spark.createDataFrame(data, "k string, o long, i long, v long")
    got = rules.running(df, ["k"], ["o", "i"], {"n": ("sum", F.lit(1)), "low": ("min", F.col("v")), "high": ("max", F.col("v"))})
    assert got.columns == ["k", "o", "i", "v", "n", "low", "high"]
    want, seen = {}, {}
    for k, o, i, v in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        n, low, high = seen.get(k, (0, None, None))
        values = [x for x in (low, high, v) if x is not None]
        seen[k] = want[i] = (n + 1, min(values, default=None), max(values, default=None))
    assert {r.i: (r.n, r.low, r.high) for r in got.collect()} == want
    odd = spark.createDataFrame([("a", float(x), 0) for x in ("nan", "inf", "-inf", "1", "2")] + [("a", None, 0)], "k string, o double, i long")
    assert [str(r.o) for r in rules.running(odd, ["k"], ["o"], {"n": ("sum", F.lit(1))}).orderBy("n").collect()] == ["None", "-inf", "1.0", "2.0", "inf", "nan"]
    assert rules.running(df.limit(0), ["k"], ["o", "i"], {"n": ("sum", F.lit(1))}).count() == 0


def test_a_busy_source_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the ranges are small here
    try:
        busy = spark.range(400_000).selectExpr("concat('192.0.2.', id % 1 + 1) AS src4_addr", "id AS src_port", "10000L AS in_bytes")
        found = rules.running(busy, ["src4_addr"], ["src_port"], {"n": ("sum", F.lit(1))})
        with_rows = found.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("rows"), F.max("n").alias("n")).collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(with_rows) > 1
    assert max(r.rows for r in with_rows) < 300_000
    assert max(r.n for r in with_rows) == 400_000
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_built_in_rules_are_the_single_ones(spark):
    rng = random.Random(2)
    rows = [flow(sport=i, src=f"192.0.2.{rng.randint(1, 6)}", dst=rng.choice([DST, OTHER, "", "198.51.100.9"]), dport=rng.choice([80, 6667]), size=rng.choice([0, 50, 900]), packets=rng.choice([1, 20]), first=at(rng.randint(0, 4000))) for i in range(300)]
    config = rules.RuleConfig((6667,), (OTHER,), rules.Thresholds(frequency_of_connections=50, ip_reuse_connections=14, p2p_unique_peers=2, packet_size_anomaly_min_flows=36, packet_size_anomaly_avg_bytes=300, suspicious_port_connection_count=3, suspicious_port_time_window_sec=900, behavioral_connection_count=3, behavioral_time_window_sec=900))
    df = flows(spark, rows)
    together = {tuple(r) for r in rules.triggered(df, config, ORDER).collect()}
    single = {tuple(r) for rule in rules.RULES for r in rule(normalize(df), config, ORDER).collect()}
    assert together == single
    assert len({reason for _, reason in single}) == 7
