"""Flow and packet rows for tests."""

from siftflow.schemas import FLOW, PACKET

SRC, DST, OTHER = "192.0.2.1", "198.51.100.1", "203.0.113.1"


def flow(first="2026-03-17T12:00:00.000", last=None, packets=10, size=100, proto=6, flags="S", sport=1234, dport=80, src=SRC, dst=DST):
    return (first, last if last is not None else first, packets, size, proto, flags, sport, dport, src, dst)


def flows(spark, rows):
    return spark.createDataFrame(rows, FLOW)


def packet(time, src=SRC, dst=DST, sport=1000, dport=80, length=60, proto=6, ttl=64, flags="S"):
    return (float(time), src, dst, sport, dport, length, proto, ttl, flags)


def packets(spark, rows):
    return spark.createDataFrame(rows, PACKET)
