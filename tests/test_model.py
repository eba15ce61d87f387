import json

import numpy as np
import pytest

from siftflow.functions.formatting import feature_text
from siftflow.operators import model as md
from siftflow.plans.toy_model import FLOW_TREES
from siftflow.schemas import FLOW_FEATURES, PACKET_FEATURES


def leaf(n, v):
    return {"nodeid": n, "leaf": v}


def split(f, c, yes, no, missing=None, n=0):
    return {"nodeid": n, "split": f, "split_condition": c, "yes": yes["nodeid"], "no": no["nodeid"], "missing": missing if missing is not None else yes["nodeid"], "children": [yes, no]}


STUMP = split("f0", 10, leaf(1, 1.0), leaf(2, 2.0))


def contributions(tree, x):
    return md.Ensemble.parse([tree], len(x)).contributions(np.array([x], float))[0]


def test_stump():
    assert list(contributions(STUMP, [5.0])) == [1.0]
    assert list(contributions(STUMP, [15.0])) == [2.0]
    assert list(contributions(STUMP, [10.0])) == [2.0]


def test_leaf_is_split_over_its_path():
    tree = split("f0", 10, leaf(1, 0.0), split("f1", 5, leaf(3, 6.0), leaf(4, 0.0), n=2))
    assert list(contributions(tree, [15.0, 1.0])) == [3.0, 3.0]
    twice = split("f0", 10, leaf(1, 0.0), split("f0", 20, leaf(3, 6.0), leaf(4, 0.0), n=2))
    assert list(contributions(twice, [15.0, 1.0])) == [6.0, 0.0]


@pytest.mark.parametrize("name", ["bad", "f9", "x1", ""])
def test_bad_splits_give_nothing(name):
    assert not contributions(split(name, 10, leaf(1, 1.0), leaf(2, 2.0)), [5.0]).any()
    assert md.Ensemble.parse([split(name, 10, leaf(1, 1.0), leaf(2, 2.0))], 1).probability(np.array([[5.0]]))[0] == 0.5


def test_missing_child_gives_nothing():
    tree = split("f0", 10, leaf(1, 1.0), leaf(2, 2.0))
    tree["no"] = 7
    assert not contributions(tree, [15.0]).any()


def test_zero_takes_the_missing_branch_in_scores_only():
    tree = split("f0", 10, leaf(1, 1.0), leaf(2, -1.0), missing=2)
    model = md.Ensemble.parse([tree], 1)
    x = np.array([[0.0]])
    assert model.probability(x)[0] == pytest.approx(1 / (1 + np.e))
    assert model.probability(x, zero_as_missing=False)[0] == pytest.approx(1 / (1 + np.exp(-1)))
    assert model.contributions(x)[0, 0] == 1.0


def test_scores_compare_in_single_precision():
    c = 0.1
    model = md.Ensemble.parse([split("f0", c, leaf(1, 1.0), leaf(2, -1.0))], 1)
    assert model.probability(np.array([[c + 1e-12]]))[0] == model.probability(np.array([[c]]))[0]


def test_case_and_udf_agree(spark):
    model = md.Ensemble.parse(FLOW_TREES, len(FLOW_FEATURES))
    rng = np.random.default_rng(3)
    rows = [tuple(map(float, r)) for r in np.round(rng.uniform(0, 600, (200, 21)) * rng.integers(0, 2, (200, 21)), 2)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in FLOW_FEATURES))
    for zero in (True, False):
        a = md.score(df, model, FLOW_FEATURES, zero).collect()
        b = md.score_case(df, model, FLOW_FEATURES, zero).collect()
        assert [r.probability for r in a] == pytest.approx([r.probability for r in b])


@pytest.mark.parametrize(("name", "value", "text"), [
    ("flow_count", 120, "120"), ("total_bytes", 1536, "1.5KB"), ("total_bytes", 2.5 * 1024 * 1024, "2.5MB"), ("total_bytes", 256, "256B"), ("pct_tcp", 85.5, "85.5%"),
    ("avg_duration", 0.0456, "0.046s"), ("Header_Length", 54.2, "54.2B"), ("Rate", 2304.5, "2304.5 pps"), ("syn_flag_number", 0.458, "45.8%"), ("Protocol Type", 6, "TCP"),
    ("Protocol Type", 99, "99"), ("ip_port_ratio", 1.234, "1.23"),
])
def test_feature_text(name, value, text):
    assert feature_text(name, value) == text


def test_explanations(spark):
    assert md.explanation_text([], FLOW_FEATURES) == "unknown reasons"
    many = [{"index": i, "value": 1.0, "contribution": 9.0 - i} for i in range(6)]
    assert md.explanation_text(many, FLOW_FEATURES).count("(") == 4
    trees = [split(f"f{i}", 1, leaf(1, 0.0), leaf(2, 1.0 + i)) for i in range(5)]
    df = spark.createDataFrame([(2.0,) * 5], ", ".join(f"`{PACKET_FEATURES[i]}` double" for i in range(5)))
    got = md.explain(df, md.Ensemble.parse(trees, 5), PACKET_FEATURES[:5]).first()
    assert [c["index"] for c in got.contributions] == [4, 3, 2, 1, 0]
    assert got.explanation == "Reasons: syn_flag_number (200.0%), fin_flag_number (200.0%), Rate (2.0 pps), Time_To_Live (2)"


def test_threshold_and_best_window(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.8), ("a", 3, 0.3), ("b", 5, 0.8), ("b", 4, 0.8)], "ip string, win long, probability double")
    got = {r.ip: (r.win, r.probability) for r in md.best_window(df).collect()}
    assert got == {"a": (2, 0.8), "b": (4, 0.8)}
    flags = df.select(md.is_botnet(df.probability).alias("x")).collect()
    assert [r.x for r in flags] == [False, True, False, True, True]


def test_load_errors(tmp_path):
    with pytest.raises(ValueError, match="model"):
        md.Ensemble.load(str(tmp_path / "none.json"), 1)
    path = tmp_path / "m.json"
    path.write_text(json.dumps([STUMP]))
    assert md.Ensemble.load(str(path), 1).probability(np.array([[5.0]]))[0] > 0.5


def test_any_scorer_will_do(spark):
    class Half:
        def probability(self, x, zero_as_missing=True, base_margin=0.0):
            return np.full(len(x), 0.25) + x[:, 0]

    df = spark.createDataFrame([(0.25,), (0.5,)], "a double")
    assert [r.probability for r in md.score(df, Half(), ["a"]).collect()] == [0.5, 0.75]
