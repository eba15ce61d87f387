"""Labelled windows, splits, training and evaluation of boosted trees, and export to the model format."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.convert import is_botnet_label
from .flow_features import flow_features, normalize, valid_time


def labelled_windows(flows: DataFrame) -> DataFrame:
    """Features of calling addresses' windows with ``is_botnet``: 1 if any flow of the window is labelled so."""
    normal = valid_time(normalize(flows)).where("src4_addr <> ''")
    label = normal.groupBy(F.col("src4_addr").alias("ip"), "win").agg(F.max(is_botnet_label(F.col("label"))).alias("is_botnet"))
    return flow_features(flows, include_inbound_only=False).join(label, ["ip", "win"])


def class_balance(labelled: DataFrame, label: str = "is_botnet") -> DataFrame:
    """``(positives, negatives, imbalance_ratio, scale_pos_weight)``; ratios are null without positives."""
    counts = labelled.agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))
    ratio = F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives"))
    return counts.select("positives", "negatives", ratio.alias("imbalance_ratio"), ratio.alias("scale_pos_weight"))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def numbered_features(df: DataFrame, names: list[str], label: str = "is_botnet") -> DataFrame:
    """``names`` as f0, f1, ... and the label as ``label``."""
    return require_columns(df, [*names, label]).select(*(F.col(f"`{n}`").cast("double").alias(f"f{i}") for i, n in enumerate(names)), F.col(label).cast("double").alias("label"))


def stratified_split(df: DataFrame, key: list[str], label: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; each class is cut at the same quantile of a hash of the key, so the split is stable."""
    luck = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / float(1 << 30)
    marked = df.withColumn("_luck", luck)
    cuts = marked.groupBy(F.col(label).alias("_label")).agg(F.percentile_approx("_luck", 1 - test_share, 100_000).alias("_cut"))
    met = marked.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_label")))
    return met.where("_luck < _cut").select(*df.columns), met.where("_luck >= _cut").select(*df.columns)


def train(df: DataFrame, features: list[str], label: str = "label", trees: int = 200, rate: float = 0.1, depth: int = 6, pos_weight: float = 1.0):  # noqa: ANN201
    """A gradient-boosted classifier; positives weigh ``pos_weight``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    data = data.withColumn("weight", F.when(F.col(label) == 1, float(pos_weight)).otherwise(1.0))
    return GBTClassifier(labelCol=label, featuresCol="features", weightCol="weight", maxIter=trees, stepSize=rate, maxDepth=depth, seed=42).fit(data)


def predict(model, df: DataFrame, features: list[str]) -> DataFrame:  # noqa: ANN001
    from pyspark.ml.feature import VectorAssembler

    return model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(df)).drop("features", "rawPrediction", "probability")


def confusion(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(tn, fp, fn, tp, precision, recall)``; a ratio without cases is zero."""
    hit = lambda a, p: F.count_if((F.col(label) == a) & (F.col(prediction) == p))
    c = predicted.agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return c.select("tn", "fp", "fn", "tp", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def feature_importance(model, names: list[str], n: int = 10) -> list[tuple[str, float]]:  # noqa: ANN001
    """The ``n`` most important features."""
    return sorted(zip(names, map(float, model.featureImportances), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def export_trees(model) -> list[dict]:  # noqa: ANN001
    """The trained trees in the model format; the margin is twice the weighted sum, as the learner defines it."""

    def node(java, counter: list[int], depth: int, weight: float) -> dict:  # noqa: ANN001
        own = counter[0]
        counter[0] += 1
        if java.subtreeDepth() == 0:
            return {"nodeid": own, "depth": depth, "leaf": 2 * weight * java.prediction()}
        left, right = node(java.leftChild(), counter, depth + 1, weight), node(java.rightChild(), counter, depth + 1, weight)
        split = java.split()
        # the learner goes left at or below its threshold; the format goes to "yes" strictly below
        bound = float(np_next(split.threshold()))
        return {"nodeid": own, "depth": depth, "split": f"f{split.featureIndex()}", "split_condition": bound, "yes": left["nodeid"], "no": right["nodeid"], "missing": left["nodeid"] if 0 < bound else right["nodeid"], "children": [left, right]}

    return [node(tree._call_java("rootNode"), [0], 0, float(w)) for tree, w in zip(model.trees, model.treeWeights, strict=True)]


def np_next(x: float) -> float:
    """The smallest single-precision number above ``x``, so that ``<`` on singles reads as ``<=`` on doubles."""
    import numpy as np

    near = np.float32(x)
    return near if near > x else np.nextafter(near, np.float32(np.inf))


def write_trees(trees: list[dict], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(trees, f, indent=1)


def clean_training_rows(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` added and rows with a null or NaN in any of them dropped."""
    return df.withColumns(columns).dropna(subset=list(columns))
