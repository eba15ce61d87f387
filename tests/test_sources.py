import gzip
import json
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from siftflow.functions import convert
from siftflow.schemas import PACKET, RULE_FLOW
from siftflow.sources import flows as src
from siftflow.sources import pcap, router

ROW = {"first": "2026-03-17T12:00:00.000", "last": "2026-03-17T12:00:01.000", "in_packets": 10, "in_bytes": 100, "proto": 6, "tcp_flags": "S", "src_port": 1234, "dst_port": 80, "src4_addr": "192.168.1.1", "dst4_addr": "10.0.0.1"}


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_ndjson(spark, tmp_path):
    line = json.dumps(ROW)
    path = write(tmp_path, "a.ndjson", f"{line}\n\n  {line} , \n,\n{{bad\n{line},\n")
    assert src.read_ndjson(spark, path).count() == 3
    assert src.read_ndjson(spark, path).first().in_bytes == 100
    kept = src.read_ndjson(spark, path, mode="keep")
    assert [r[src.CORRUPT] for r in kept.where(F.col(src.CORRUPT).isNotNull()).collect()] == ["{bad"]
    with pytest.raises(Exception, match="bad flow record"):
        src.read_ndjson(spark, path, mode="fail").collect()
    with pytest.raises(ValueError, match="mode"):
        src.read_ndjson(spark, path, mode="x")


def test_json_array(spark, tmp_path):
    path = write(tmp_path, "a.json", json.dumps([ROW, ROW | {"nothing": [1], "in_bytes": None}], indent=1))
    got = src.read_json_array(spark, path).collect()
    assert [r.in_bytes for r in got] == [100, None]
    assert src.read_json_array(spark, write(tmp_path, "e.json", "[]")).count() == 0
    assert src.read_json_array(spark, write(tmp_path, "t.json", '[{"first": "a"}, {"first": "b"')).count() == 1
    bad = write(tmp_path, "b.json", '[{"first": "a"}, {"first": }, {"first": "c"}]')
    assert [r.first for r in src.read_json_array(spark, bad).collect()] == ["a", "c"]
    with pytest.raises(Exception, match="bad flow record"):
        src.read_json_array(spark, bad, mode="fail").collect()


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_array_is_split(spark, tmp_path, small_splits):
    """A file is many tasks, and what they find is what one regular expression over the whole text finds."""
    rng = random.Random(8)
    parts = ['{"first": "a"}', '{"first": "é"}', '{"first": "b{c"}', '{"x": {"first": "d"}}', '{"first": "e"', "{}", "{", "}", "]", "[", ",\n", " ", '{"first":\n"f"}', "\xe9"]
    (tmp_path / "odd").mkdir()
    want = {}
    for i in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        raw = text.encode("latin-1" if i % 7 == 0 else "utf-8")
        name = f"{i}.json" + (".gz" if i % 5 == 0 else "")
        write(tmp_path, f"odd/{name}", gzip.compress(raw) if i % 5 == 0 else raw)
        want[name] = re.findall(r"\{[^}]*\}", raw.decode(errors="replace"))
    for order in (False, True):
        got = src.array_objects(spark.read, str(tmp_path / "odd"), order)
        found = {name: [] for name in want}
        for r in (got.orderBy("file", "position") if order else got).collect():
            found[r.file.rsplit("/", 1)[1]].append(r.value)
        assert found == want if order else {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
        if order:
            assert [r.position for r in got.where("file like '%/1.json'").orderBy("position").collect()] == list(range(len(want["1.json"])))
    whole = write(tmp_path, "a.json", json.dumps([ROW] * 200))
    read = src.read_json_array(spark, whole)
    assert read.count() == 200
    assert read.rdd.getNumPartitions() > 10


def test_long_field_and_order(spark, tmp_path):
    long = write(tmp_path, "l.ndjson", json.dumps(ROW | {"tcp_flags": "S" * 3_000_000}) + "\n")
    assert len(src.read_ndjson(spark, long).first().tcp_flags) == 3_000_000
    many = write(tmp_path, "m.json", json.dumps([ROW | {"src_port": i} for i in range(5000)]))
    got = src.read_rule_flows(spark, many).orderBy("position").collect()
    assert [r.src_port for r in got] == list(range(5000))
    with pytest.raises(ValueError, match="array"):
        src.read_rule_flows(spark, write(tmp_path, "o.json", json.dumps(ROW)))


LOG = "StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,sTos,dTos,TotPkts,TotBytes,SrcBytes,Label\n"


def test_connection_log(spark, tmp_path):
    rows = "2011/08/10 09:46:53.047277,1.5, TCP ,10.0.0.1,0x0303,->,10.0.0.2,,S_RA,0,0,4,300,100,flow=From-Botnet\n2011/08/10 09:46:53,x,weird,a,http,->,b,53,CON,0,0,z,,1,flow=Normal\n"
    path = write(tmp_path, "c.csv", b"\xef\xbb\xbf" + (LOG + rows).encode())
    one, two = src.convert_connection_log(src.read_connection_log(spark, path)).orderBy(F.desc("label")).collect()[::-1]
    assert (one.first, one.last) == ("2011-08-10T09:46:53.047", "2011-08-10T09:46:54.547")
    assert (one.proto, one.src_port, one.dst_port, one.tcp_flags, one.in_packets, one.in_bytes) == (6, 0x303, 0, "....S...", 4, 300)
    assert (two.first, two.last, two.proto, two.src_port, two.in_packets, two.in_bytes, two.tcp_flags) == ("2011-08-10T09:46:53.000",) * 2 + (0, 0, 0, 0, "........")
    assert src.label_counts(spark.createDataFrame([("flow=From-Botnet",), ("Normal bot",), ("x Normal",), ("BACKGROUND",), (None,)], "label string")).first()[:] == (2, 1, 1, 1)


@pytest.mark.parametrize(("state", "proto", "flags"), [("S_FA", 6, ".A.S...F"), ("s_r", 6, "....S..."), ("SR_X", 6, "....S.R."), ("R_", 6, ".....R.."), ("XA", 6, "..A....."), ("CON", 6, "........"), ("S_", 17, "........"), (None, 6, "........")])
def test_states(spark, state, proto, flags):
    df = spark.createDataFrame([(state, proto)], "s string, p int")
    assert df.select(convert.state_flags(df.s, df.p).alias("f")).first().f == flags


def test_ports_and_times(spark):
    ports = {"80": 80, " 443 ": 443, "0x1F": 31, "0xZZ": 0, "": 0, "http": 0, None: 0}
    df = spark.createDataFrame([(p,) for p in ports], "p string")
    assert {r.p: r.x for r in df.select("p", convert.port_number(F.col("p")).alias("x")).collect()} == ports
    times = {"2011/08/10 09:46:53.047277": "2011-08-10T09:46:53.047", "2011-08-10T09:46:53.5": "2011-08-10T09:46:53.500", "2011/08/10 09:46:53": "2011-08-10T09:46:53.000", "2011-08-10 09:46:53": "2011-08-10T09:46:53.000", "some day": "someTday", "": ""}
    df = spark.createDataFrame([(t,) for t in times], "t string")
    assert {r.t: r.x for r in df.select("t", convert.iso_time(F.col("t")).alias("x")).collect()} == times


RAW = """Flow Record:
  Flags         =              0x06 FLOW, Unsampled
  first         =        1713744017 [2024-04-22 00:00:17.896]
  last          =        1713744018 [2024-04-22 00:00:18.001]
  in packets    =                 3
  in bytes      =               180
  proto         =                 6 TCP
  tcp flags     =              0x02 ......S.
  src port      =             50000
  dst port      =               443
  src addr      =         192.0.2.1
  dst addr      =      198.51.100.7

Flow Record:
  src addr      =         192.0.2.2
"""


def test_raw_export(spark, tmp_path):
    path = write(tmp_path, "r.txt", RAW)
    one, two = sorted(src.read_raw_export(spark, path).collect(), key=lambda r: r.src4_addr)
    assert (one.first, one.last, one.in_packets, one.in_bytes, one.proto, one.tcp_flags) == ("2024-04-22T00:00:17.896", "2024-04-22T00:00:18.001", 3, 180, 6, "......S.")
    assert (one.src_port, one.dst_port, one.src4_addr, one.dst4_addr) == (50000, 443, "192.0.2.1", "198.51.100.7")
    assert (two.src4_addr, two.first, two.in_bytes) == ("192.0.2.2", None, None)
    assert src.read_raw_export(spark, path).dtypes == spark.createDataFrame([], RULE_FLOW).dtypes
    assert src.read_flows(spark, path).count() == 2
    assert src.read_flows(spark, write(tmp_path, "j.json", json.dumps([ROW]))).count() == 1
    with pytest.raises(ValueError, match="unknown"):
        src.read_flows(spark, path, kind="xml")


def test_training_csv(spark, tmp_path):
    path = write(tmp_path, "t.csv", "a,b,Label,c\n1,inf,benign ,9\n2,3,DDoS,9\n4,5,,9\n")
    got = src.read_training_csv(spark, [path], ["a", "b"]).orderBy("a").collect()
    assert [(r.a, r.label) for r in got] == [(1, 0), (2, 1)]
    assert got[0].b != got[0].b
    raw = spark.read.option("header", True).csv(path)
    assert {r.label for r in src.distinct_labels(raw).collect()} == {None, "DDoS", "benign"}


def frame(kind=0x0800, proto=6, flags=2, ttl=64, body=None, ihl=5, version=4, vlan=False):
    ethernet = bytes(12) + (b"\x81\x00\x00\x01" if vlan else b"") + struct.pack(">H", kind)
    if kind == 0x0806:
        return bytes(12) + struct.pack(">H", kind) + struct.pack(">HHBBH", 1, 0x800, 6, 4, 1) + b"\x0a\x0b\x0c\x0d\x0e\x0f" + bytes([192, 0, 2, 1]) + b"\x01\x02\x03\x04\x05\x06" + bytes([192, 0, 2, 2])
    ip = bytes([version << 4 | ihl, 0, 0, 0, 0, 0, 0, 0, ttl, proto, 0, 0, 192, 0, 2, 1, 198, 51, 100, 7]) + bytes((ihl - 5) * 4)
    if body is None:
        body = struct.pack(">HH", 12345, 80) + (bytes(9) + bytes([flags]) + bytes(6) if proto == 6 else bytes(4))
    return ethernet + ip + body


def capture(frames, order="<", magic=0xA1B2C3D4, link=1, tail=b""):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 100 + i, 500_000, len(f), len(f) + 6) + f
    return out + tail


@pytest.mark.parametrize("order", ["<", ">"])
def test_pcap_tcp(order):
    got = pcap.decode(capture([frame()], order)).iloc[0]
    assert (got.timestamp, got.src_ip, got.dst_ip, got.src_port, got.dst_port) == (100.5, "192.0.2.1", "198.51.100.7", 12345, 80)
    assert (got.length, got.proto, got.ttl, got.tcp_flags) == (60, 6, 64, "S")


def test_pcap_kinds():
    frames = [frame(proto=17), frame(proto=1, body=b""), frame(proto=2, body=b""), frame(0x0806), frame(proto=47), frame(kind=0x86DD), frame(vlan=True), frame(version=6), frame(body=b"1234"), frame(ihl=6, flags=0xFF), bytes(10)]
    got = pcap.decode(capture(frames))
    assert list(got.proto) == [17, 1, 2, 2054, 6]
    assert list(got.tcp_flags) == ["", "", "", "", "FSRPAUEC"]
    arp = got.iloc[3]
    assert (arp.src_ip, arp.dst_ip, arp.ttl, arp.src_port) == ("192.0.2.1", "192.0.2.2", 0, 0)
    assert pcap.decode(capture([frame(0x0806)]), arp_compat=True).iloc[0].src_ip == "10.11.12.13"


def test_pcap_edges():
    assert pcap.decode(capture([frame()], magic=0xA1B23C4D)).iloc[0].timestamp == pytest.approx(100.0005)
    assert len(pcap.decode(capture([frame()], tail=b"\0" * 10))) == 1
    assert len(pcap.decode(capture([frame()], tail=struct.pack("<IIII", 1, 1, 99, 99) + b"x"))) == 1
    assert len(pcap.decode(capture([]))) == 0
    for bad in (b"", b"\0" * 24, capture([], link=105), capture([], tail=struct.pack("<IIII", 1, 1, 70000, 70000))):
        with pytest.raises(ValueError, match="capture|magic|link|length"):
            pcap.decode(bad)


def test_router(spark, tmp_path):
    assert [router.kind_of(f"x/{n}") for n in ("a.JSON", "b.ndjson", "c.PCAP")] == ["json", "ndjson", "pcap"]
    with pytest.raises(ValueError, match="unsupported"):
        router.kind_of("a.txt")
    (tmp_path / "sub").mkdir()
    write(tmp_path, "a.json", json.dumps([ROW]))
    write(tmp_path, "sub/b.NDJSON", json.dumps(ROW) + "\n")
    write(tmp_path, "c.pcap", capture([frame(), frame()]))
    write(tmp_path, "d.pcap", b"junk")
    write(tmp_path, "e.txt", "x")
    counts = {r.kind: r.files for r in router.file_type_counts(spark, str(tmp_path)).collect()}
    assert counts == {"json": 1, "ndjson": 1, "pcap": 2, "unsupported": 1}
    found, failed = router.read_folder(spark, str(tmp_path))
    assert (found["flow"].count(), found["packet"].count(), failed.count()) == (2, 2, 1)
    assert found["flow"].select("file").distinct().count() == 2
    assert failed.first().file.endswith("d.pcap")
    assert "incomplete" in failed.first().error
    assert found["packet"].columns == [*PACKET.fieldNames(), "file"]
    (tmp_path / "none").mkdir()
    write(tmp_path, "none/x.txt", "x")
    assert router.read_folder(spark, str(tmp_path / "none"))[0] == {}


def test_bad_records_are_counted_and_shown(spark, tmp_path):
    (tmp_path / "x.ndjson").write_text('{"in_bytes": 1}\nbroken 1\n{"in_bytes": 2}\nbroken 2\n')
    kept = src.read_ndjson(spark, str(tmp_path), mode="keep")
    assert tuple(src.bad_records(kept).first()) == (2, "broken 1")
    assert src.read_ndjson(spark, str(tmp_path)).count() == 2
    assert tuple(src.bad_records(kept.where("in_bytes is not null")).first()) == (0, None)


def test_readers_can_be_registered(spark, tmp_path):
    (tmp_path / "x.txt").write_text("5\n7\n")
    src.register_reader("sizes", lambda spark, path, mode: spark.read.text(path).selectExpr("CAST(value AS BIGINT) AS in_bytes"))
    try:
        assert sorted(r.in_bytes for r in src.read_flows(spark, str(tmp_path / "x.txt"), "sizes").collect()) == [5, 7]
    finally:
        del src.READERS["sizes"]
