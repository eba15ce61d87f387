import math

import pytest

from helpers import DST, SRC, packet, packets
from siftflow.operators.packet_features import packet_features
from siftflow.schemas import PACKET_FEATURES


def of(df, ip=SRC):
    row = next(r for r in packet_features(df).collect() if r.ip == ip)
    return [row[f] for f in PACKET_FEATURES]


def test_four_packets(spark):
    rows = [
        packet(1000.0, length=60, flags="S", dport=443),
        packet(1000.2, src=DST, dst=SRC, sport=80, dport=1000, length=120, flags="SA"),
        packet(1000.4, length=80, flags="A", dport=80),
        packet(1000.6, length=100, flags="FA", dport=80),
    ]
    f = of(packets(spark, rows))
    want = {0: 20, 2: 6.6667, 3: 0.25, 4: 0.5, 7: 0.75, 10: 2, 11: 3, 15: 0.25, 16: 0.75, 29: 360, 30: 60, 31: 120, 32: 90, 33: 25.8199, 34: 90, 35: 0.2, 36: 4, 37: 666.6667, 38: 6}
    for i, value in want.items():
        assert f[i] == pytest.approx(value, abs=1e-3), PACKET_FEATURES[i]
    assert (f[27], f[28]) == (1, 0)


def test_directions_pick_ports(spark):
    rows = [packet(0, dport=80), packet(1, src=DST, dst=SRC, sport=80, dport=9, flags="A"), packet(2, dport=53, proto=17, flags="")]
    f = of(packets(spark, rows))
    assert f[36] == 3
    assert (f[10], f[11]) == (1, 1)
    assert (f[22] * 3, f[23] * 3, f[16] * 3, f[18] * 3) == pytest.approx((2, 1, 2, 1))
    assert f[2] > 0


def test_windows_and_keys(spark):
    df = packets(spark, [packet(0), packet(299.9), packet(300)])
    assert {(r.ip, r.win) for r in packet_features(df).collect()} == {(SRC, 0), (DST, 0), (SRC, 300), (DST, 300)}


def test_single_packet_and_arp(spark):
    f = of(packets(spark, [packet(5, proto=2054, ttl=0, flags="", sport=0, dport=0)]))
    assert (f[2], f[33], f[35], f[37]) == (0, 0, 0, 0)
    assert (f[25], f[38]) == (1, 6)


def test_protocol_ties(spark):
    assert of(packets(spark, [packet(0, proto=17), packet(1, proto=1)]))[38] == 17
    assert of(packets(spark, [packet(0, proto=2), packet(1, proto=2), packet(2, proto=1)]))[38] == 2


def test_nulls_and_empty(spark):
    df = packets(spark, [(None,) * 9, (1.0, SRC, None, None, None, None, None, None, None)])
    f = of(df)
    assert all(v is not None and math.isfinite(v) for v in f)
    assert packet_features(packets(spark, [])).count() == 0
