import json

import pytest
from pyspark.sql import functions as F

from helpers import DST, OTHER, SRC, flow, flows, packet, packets
from siftflow import cli
from siftflow.operators import flow_features as ff
from siftflow.operators import model as md
from siftflow.operators import packet_features as pf
from siftflow.operators import report, training
from siftflow.plans.toy_model import FLOW_TREES
from siftflow.schemas import FLOW, FLOW_FEATURES, LABELLED_FLOW
from siftflow.streaming import windows


def results(spark):
    rows = [("198.51.100.1", 99.5, True, "Reasons: x (1)"), ("198.51.100.2", 70.0, True, "")] + [(f"203.0.113.{i}", 40.0 - i, False, "") for i in range(6)]
    return spark.createDataFrame(rows, "ip string, probability double, is_botnet boolean, explanation string")


def test_summary(spark, capsys, tmp_path):
    text = report.summary(results(spark), 123, 1.5)
    lines = text.splitlines()
    assert sum(line.startswith("[BOTNET DETECTED] IP:") for line in lines) == 2
    assert [line.split("IP: ")[1].split()[0] for line in lines if line.startswith("[BENIGN")] == [f"203.0.113.{i}" for i in range(5)]
    assert "[BOTNET DETECTED] IP: 198.51.100.1    | ML Probability:  99.50% (Reasons: x (1))" in lines
    assert "[BOTNET DETECTED] IP: 198.51.100.2    | ML Probability:  70.00%" in lines
    assert "Done. Processed 123 records." in lines
    assert "Identified 2 specific Botnet IPs out of 8 total communicating IPs." in lines
    report.tee(text, str(tmp_path / "out.txt"))
    assert capsys.readouterr().out == text == (tmp_path / "out.txt").read_text()


def test_rule_lines_and_json(spark):
    df = spark.createDataFrame([("a", ["x"], 1.0), ("b", ["x", "y"], 98.06)], "ip string, reasons array<string>, risk double")
    assert [r.line for r in report.rule_lines(df).collect()] == ["b: 98.06% (x, y)", "a: 1.00% (x)"]
    assert json.loads(report.as_json(df).first().value)["ip"] == "a"


def test_sinks(spark, tmp_path):
    df = ff.flow_features(flows(spark, [flow()]))
    report.write_features(df, str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).columns == ["ip", "win", *FLOW_FEATURES]
    report.write_flows(flows(spark, [flow()]), str(tmp_path / "j"))
    assert spark.read.schema(FLOW).json(str(tmp_path / "j")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [flow(first=f"2026-03-17T12:{m:02d}:00.000", dport=80 + m % 3, dst=(DST, OTHER)[m % 2]) for m in range(0, 40)]
    flows(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.flow_counts(spark.readStream.schema(FLOW).parquet(str(tmp_path / "in")))
    got = {(r.ip, r.win): r for r in windows.run_available(stream, "flow_counts_test").collect()}
    want = {(r.ip, r.win): r for r in ff.flow_features(flows(spark, rows), False).collect()}
    assert 0 < len(got) < len(want)  # the last window stays open
    for key, r in got.items():
        assert (r.flow_count, r.unique_dst_ips, r.unique_dst_ports, r.pct_syn_only) == tuple(want[key][c] for c in ("flow_count", "unique_dst_ips", "unique_dst_ports", "pct_syn_only"))


def test_fragments(spark, tmp_path):
    """Windows close by the watermark; rows that come after that are fragments of their own; the end closes the rest."""
    minute = lambda m, **kw: flow(first=f"2026-03-17T12:{m:02d}:00.000", **kw)
    batches = [[minute(0), minute(1), minute(6)], [minute(12), minute(13)], [minute(2, size=7), minute(14)], []]
    stream = windows.Fragments.of_flows(str(tmp_path / "out"))
    for n, rows in enumerate(batches):
        flows(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.start(spark.readStream.schema(FLOW).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
        if n == 1:  # a batch that runs again finds the same
            stream.merge(flows(spark, rows), 1)
    for _ in range(2):
        stream.flush(spark)
    noon = 1773748800
    got = sorted((r.batch, r.win - noon, r.flow_count) for r in stream.read(spark).where("flow_count > 0").collect())
    assert got == [(-1, 300, 1), (-1, 600, 3), (1, 0, 2), (2, 0, 1)]
    assert len(list((tmp_path / "out" / "open").iterdir())) <= 2


def test_packet_fragments_equal_batch(spark, tmp_path):
    rows = packets(spark, [packet(1000 + 17 * i, dport=80 + i % 3, length=50 + i) for i in range(200)])
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.Fragments.of_packets(str(tmp_path / "out"))
    stream.start(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    stream.flush(spark)
    listed = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert listed(stream.read(spark).drop("batch")) == listed(pf.packet_features(rows))


def test_running_best(spark, tmp_path):
    schema = "ip string, win long, probability double"
    for i, row in enumerate([("a", 1, 0.5), ("a", 2, 0.8), ("a", 3, 0.3)]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            spark.createDataFrame([("b", 1, 0.1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windows.keep_best(stream, str(tmp_path / "best"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = max(int(p.name[1:]) for p in (tmp_path / "best").iterdir() if p.name.startswith("v"))
    assert {r.ip: r.probability for r in spark.read.parquet(str(tmp_path / "best" / f"v{last}")).collect()} == {"a": 0.8, "b": 0.1}
    assert len([p for p in (tmp_path / "best").iterdir() if p.name.startswith("v")]) <= 2


def labelled(spark):
    extra = (None,) * 6
    rows = [(*flow(src=f"192.0.2.{i}", size=10 if i % 4 == 0 else 5000, sport=j), *extra, "From-Botnet" if i % 4 == 0 and j == 0 else "Normal") for i in range(40) for j in range(3)]
    return spark.createDataFrame(rows, LABELLED_FLOW)


def test_training_round_trip(spark, tmp_path):
    data = training.labelled_windows(labelled(spark))
    assert data.groupBy("is_botnet").count().orderBy("is_botnet").collect()[0]["count"] == 30
    balance = training.class_balance(data).first()
    assert (balance.positives, balance.negatives, balance.scale_pos_weight) == (10, 30, 3.0)
    train, test = training.stratified_split(data, ["ip", "win"], "is_botnet")
    assert train.count() + test.count() == 40
    assert 1 <= test.where("is_botnet = 1").count() <= 4
    columns = [f"f{i}" for i in range(21)]
    model = training.train(training.numbered_features(train, FLOW_FEATURES), columns, trees=3, depth=2, pos_weight=3.0)
    rows = training.numbered_features(test, FLOW_FEATURES)
    got = training.confusion(training.predict(model, rows, columns)).first()
    assert (got.precision, got.recall) == (1, 1)
    assert training.feature_importance(model, FLOW_FEATURES, 1)[0][1] > 0
    path = str(tmp_path / "trees.json")
    training.write_trees(training.export_trees(model), path)
    scored = md.score(rows, md.Ensemble.load(path, 21), columns, zero_as_missing=False)
    assert scored.where((F.col("probability") > 0.5) != (F.col("label") == 1)).count() == 0
    with pytest.raises(ValueError, match="missing columns: zz"):
        training.require_columns(data, ["zz"])


def test_empty_class_balance(spark):
    got = training.class_balance(spark.createDataFrame([], "is_botnet int")).first()
    assert (got.positives, got.imbalance_ratio) == (0, None)


def test_cli(spark, tmp_path, capsys):
    model, data = tmp_path / "m.json", tmp_path / "in.ndjson"
    model.write_text(json.dumps(FLOW_TREES))
    record = dict(zip(FLOW.fieldNames(), flow(), strict=True))
    data.write_text("".join(json.dumps(record | {"src_port": i}) + "\n" for i in range(20)))
    assert cli.main(["--input", str(data), "--flow-model", str(model), "--output", str(tmp_path / "o.txt")]) == 0
    out = capsys.readouterr().out
    assert "Done. Processed 20 records." in out
    assert "out of 2 total communicating IPs." in out
    assert (tmp_path / "o.txt").read_text() == out
    assert cli.main(["--input", str(data)]) == 1
    assert cli.main(["--input", str(tmp_path / "x.txt"), "--flow-model", str(model)]) == 1 if (tmp_path / "x.txt").write_text("") == 0 else True
    rules = tmp_path / "rules.json"
    rules.write_text("{}")
    (tmp_path / "in.json").write_text(json.dumps([record] * 20))
    capsys.readouterr()
    assert cli.main(["--input", str(tmp_path / "in.json"), "--rules", str(rules)]) == 0
    assert capsys.readouterr().out.startswith(f"{SRC}: ")
    assert cli.main(["--input", str(tmp_path), "--list"]) == 0
    assert "ndjson: 1 files" in capsys.readouterr().out
    assert cli.main(["--input", str(tmp_path), "--yes", "--flow-model", str(model)]) == 0


def test_train_confusion_takes_the_operators_defaults(spark, monkeypatch):
    import pytest

    from siftflow.operators import training
    from siftflow.plans import catalog

    def train(df, features, label="label", **given):
        raise InterruptedError(sorted(given))

    monkeypatch.setattr(training, "train", train)
    with pytest.raises(InterruptedError, match=r"^\['pos_weight'\]$"):
        catalog.QUERIES["train_confusion"](spark, "/root/testdata/sf0.001")
