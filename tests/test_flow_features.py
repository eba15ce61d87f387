import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import DST, OTHER, SRC, flow, flows
from siftflow.functions import convert
from siftflow.functions.flow import millis_iso
from siftflow.operators import flow_features as ff
from siftflow.schemas import FLOW_FEATURES


def by_ip(df):
    return {r.ip: r for r in df.collect()}


def test_timestamps(spark):
    cases = {"2026-03-17T12:00:00.000": True, "2024-02-29T00:00:00.000": True, "2026-03-17T12:00:00.123Z": True, "2026/03/17 12:00:00.000": False, "": False, "2026-03-17": False, "2026-13-17T12:00:00.000": False}
    got = {r.first: r.first_ms is not None for r in ff.normalize(flows(spark, [flow(first=t) for t in cases])).collect()}
    assert got == cases


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_are_utc_in_any_session(spark, zone):
    """Also where the session's clock has a gap (2026-03-08, 02:00 to 03:00 in New York)."""
    texts = {"2026-03-17T12:00:00.000": 1773748800000, "2026-03-08T02:30:00.000": 1772937000000, "2026-03-08T03:30:00.000": 1772940600000, "1969-12-31T23:59:59.999": -1}
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = ff.normalize(flows(spark, [flow(first=t) for t in texts])).withColumns({
            "back": millis_iso(F.col("first_ms")),
            "slashes": convert.iso_time(F.replace(F.replace("first", F.lit("-"), F.lit("/")), F.lit("T"), F.lit(" "))),
            "later": convert.end_time(F.col("first"), F.lit(3600.5)),
        }).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {r.first: r.first_ms for r in rows} == texts
    for r in rows:
        assert r.back == r.slashes == r.first
        assert r.win == texts[r.first] // 300_000 * 300
    assert {r.first: r.later for r in rows}["2026-03-08T01:30:00.000".replace("01:30", "02:30")] == "2026-03-08T03:30:00.500"


def test_null_fragment(spark):
    rows = flows(spark, [flow(), flow(), flow(dport=443)]).withColumn("part", F.when(F.col("dst_port") == 443, "b"))
    got = {(r.fragment, r.ip): r.flow_count for r in ff.flow_features(rows, fragment=F.col("part")).collect()}
    assert got == {(None, SRC): 2, (None, DST): 0, ("b", SRC): 1, ("b", DST): 0}


def test_roles_of_one_flow(spark):
    got = by_ip(ff.flow_features(flows(spark, [flow(size=1000, dport=443)])))
    assert set(got) == {SRC, DST}
    assert (got[SRC].flow_count, got[SRC].total_bytes) == (1, 1000)
    assert all(got[DST][f] == 0 for f in FLOW_FEATURES)
    assert set(by_ip(ff.flow_features(flows(spark, [flow()]), include_inbound_only=False))) == {SRC}


def test_protocols_and_flags(spark):
    got = by_ip(ff.flow_features(flows(spark, [flow(proto=17, flags=""), flow(proto=1, flags=""), flow(flags="R"), flow(flags="S")])))[SRC]
    assert (got.pct_udp, got.pct_icmp, got.pct_tcp, got.pct_rst, got.pct_syn_only) == (25, 25, 50, 25, 25)


def test_syn_only_needs_no_answer(spark):
    rows = [flow(flags=f) for f in ("S", "....S...", "AS", "FS", "RS", "s", "")]
    assert by_ip(ff.flow_features(flows(spark, rows)))[SRC].pct_syn_only == pytest.approx(200 / 7)


def test_syn_only_flow(spark):
    got = by_ip(ff.flow_features(flows(spark, [flow(flags="S", dport=80)])))[SRC]
    assert (got.pct_syn_only, got.pct_well_known_ports, got.pct_high_ports) == (100, 100, 0)


def test_negative_duration_counts_zero(spark):
    rows = [flow(first="2026-03-17T12:00:01.000", last="2026-03-17T12:00:00.000"), flow(last="bad"), flow(last="2026-03-17T12:00:03.000")]
    assert by_ip(ff.flow_features(flows(spark, rows)))[SRC].avg_duration == 1


def test_gaps_between_starts(spark):
    got = by_ip(ff.flow_features(flows(spark, [flow(first="2026-03-17T12:00:10.000"), flow(first="2026-03-17T12:00:12.000")])))[SRC]
    assert (got.iat_mean, got.iat_variance) == (1, 2)
    assert got.iat_cv == pytest.approx(math.sqrt(2))


def test_gap_cap_keeps_first_arrivals(spark):
    starts = [50, 10, 30, 20]
    df = flows(spark, [flow(first=f"2026-03-17T12:00:{s}.000", sport=i) for i, s in enumerate(starts)])
    capped = by_ip(ff.flow_features(df, iat_cap=2, order=["src_port"]))[SRC]
    assert capped.iat_mean == 20  # 10 and 50: gaps 0 and 40
    assert by_ip(ff.flow_features(df, iat_cap=10, order=["src_port"]))[SRC].iat_mean == 10


def test_symmetry(spark):
    rows = [flow(dport=53), flow(dport=80), flow(src=OTHER, dst=SRC, dport=53), flow(src=OTHER, dst=SRC, dport=443)]
    df = ff.normalize(flows(spark, rows))
    assert by_ip(ff.port_symmetry(df))[SRC].port_symmetry == 1
    assert by_ip(ff.port_symmetry_joined(df))[SRC].port_symmetry == 1
    assert by_ip(ff.flow_features(flows(spark, rows)))[SRC].port_symmetry == 1


def test_windows(spark):
    rows = [flow(first="2026-03-17T12:00:00.000"), flow(first="2026-03-17T12:05:00.000"), flow(first="2026-03-17T12:04:59.999")]
    got = {r.win: r.flow_count for r in ff.flow_features(flows(spark, rows), include_inbound_only=False).collect()}
    assert got == {1773748800: 2, 1773749100: 1}


def test_hot_key(spark):
    one = flows(spark, [flow(size=10)])
    many = spark.range(100_000).crossJoin(one).drop("id")
    got = by_ip(ff.flow_features(many))[SRC]
    assert (got.flow_count, got.total_bytes) == (100_000, 1_000_000)


def test_nulls_and_empty_fields(spark):
    rows = [(None,) * 10, flow(src=""), flow(dst=""), flow(src=None, dst=None), ("2026-03-17T12:00:00.000", None, None, None, None, None, None, None, SRC, DST)]
    got = by_ip(ff.flow_features(flows(spark, rows)))
    assert set(got) == {SRC, DST}
    assert (got[SRC].flow_count, got[SRC].unique_dst_ips) == (2, 2)  # an empty peer is a peer here
    assert ff.flow_features(flows(spark, [])).count() == 0


def test_fragments(spark):
    df = flows(spark, [flow(sport=1), flow(sport=2), flow(sport=2)])
    got = {(r.ip, r.fragment): r.flow_count for r in ff.flow_features(df, False, fragment=F.col("src_port").cast("string")).collect()}
    assert got == {(SRC, "1"): 1, (SRC, "2"): 2}


def test_any_input_gives_finite_features(spark):
    rng = random.Random(5)
    odd = ["", "S", "ASF", "x" * 30, "日本", "\0", "-1"]
    rows = [
        (rng.choice(["2026-03-17T12:00:00.000", "", "junk", "2026-03-17T12:59:59.999"]), rng.choice(odd), rng.choice([0, 1, -5, 2**40]), rng.choice([0, -1, 2**50]), rng.randint(-3, 300), rng.choice(odd), 0, rng.randint(-1, 70000), rng.choice(odd), rng.choice(odd))
        for _ in range(300)
    ]
    for r in ff.flow_features(flows(spark, rows)).collect():
        values = [r[f] for f in FLOW_FEATURES]
        assert len(values) == 21
        assert all(v is not None and math.isfinite(v) for v in values)
