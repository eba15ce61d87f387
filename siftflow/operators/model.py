"""Boosted-tree scoring and explanation of feature vectors, and results per address.

A model is a JSON list of trees (``nodeid``, ``split`` "fN", ``split_condition``, ``yes``, ``no``,
``missing``, ``leaf``, ``children``). The driver flattens it to arrays; executors walk all rows of a batch
at once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formatting import feature_text

TOP_REASONS = 4
THRESHOLD = 0.5
UNKNOWN = "unknown reasons"

CONTRIBUTION = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("contribution", T.DoubleType())]))


class Scorer(Protocol):
    """What ``score`` asks of a model; anything that pickles will do."""

    def probability(self, x: np.ndarray, zero_as_missing: bool = True, base_margin: float = 0.0) -> np.ndarray: ...


@dataclass
class Ensemble:
    """Flattened trees. Node 0 of each tree is its root; a node without a usable split is where a path ends."""

    trees: list[dict]
    feature: list[np.ndarray]
    condition: list[np.ndarray]
    yes: list[np.ndarray]
    no: list[np.ndarray]
    missing: list[np.ndarray]
    leaf: list[np.ndarray]
    depth: int

    @classmethod
    def parse(cls, trees: list[dict], features: int) -> Ensemble:
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        deepest = 0
        for tree in trees:
            nodes: list[tuple[dict, int]] = [(tree, 0)]
            for node, level in nodes:
                nodes.extend((child, level + 1) for child in node.get("children") or ())
                deepest = max(deepest, level)
            at = {id(node): i for i, (node, _) in enumerate(nodes)}
            rows = []
            for node, _ in nodes:
                named = re.match(r"f(\d+)", str(node.get("split", "")))
                inner = node.get("leaf") is None and named and int(named[1]) < features
                child = {c.get("nodeid"): at[id(c)] for c in node.get("children") or ()} if inner else {}
                way = [child.get(node.get(k), -1) for k in ("yes", "no", "missing")]
                if way[2] < 0:
                    way[2] = way[0]
                rows.append((int(named[1]) if inner else -1, float(node.get("split_condition") or 0), *way, float(node.get("leaf") or 0)))
            for column, values in zip(columns, zip(*rows, strict=True), strict=True):
                column.append(np.array(values))
        return cls(trees, *columns, deepest)

    @classmethod
    def load(cls, path: str, features: int) -> Ensemble:
        try:
            with open(path, encoding="utf-8") as f:
                return cls.parse(json.load(f), features)
        except (OSError, ValueError) as e:
            raise ValueError(f"model {path}: {e}") from e

    def _walk(self, n: int, x: np.ndarray, zero_as_missing: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per level the nodes that rows stand at and the features they split on (-1 where a path has ended)."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth + 1):
            f = np.where(at >= 0, self.feature[n][at], -1)
            yield at, f
            inner = f >= 0
            if not inner.any():
                return
            value = x[rows, np.maximum(f, 0)]
            step = np.where(value < self.condition[n][at].astype(x.dtype), self.yes[n][at], self.no[n][at])
            lost = np.isnan(value) | (value == 0) if zero_as_missing else np.isnan(value)
            if zero_as_missing:
                step = np.where(lost, self.missing[n][at], step)
            # a split without the child it names ends the path with nothing
            at = np.where(inner, step, at)

    def probability(self, x: np.ndarray, zero_as_missing: bool = True, base_margin: float = 0.0) -> np.ndarray:
        """Logistic of the summed leaves, in single precision; zeros take the ``missing`` branch if so asked."""
        x = x.astype(np.float32)
        margin = np.full(len(x), base_margin)
        for n in range(len(self.trees)):
            for at, _ in self._walk(n, x, zero_as_missing):
                last = at
            margin += np.where(last >= 0, self.leaf[n][last], 0)
        return 1 / (1 + np.exp(-margin))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Each leaf's value, split evenly over the splits on its path, summed by feature."""
        x = x.astype(np.float64)
        out = np.zeros(x.shape)
        rows = np.arange(len(x))
        for n in range(len(self.trees)):
            path, last = [], None
            for at, f in self._walk(n, x, False):
                path.append(f)
                last = at
            value = np.where(last >= 0, self.leaf[n][last], 0)
            length = sum((f >= 0).astype(int) for f in path)
            part = np.divide(value, length, out=np.zeros(len(x)), where=length > 0)
            for f in path:
                hit = f >= 0
                np.add.at(out, (rows[hit], f[hit]), part[hit])
        return out

    def margin_sql(self, features: list[str], zero_as_missing: bool = True) -> list[str]:
        """Each tree as nested CASE over named columns, for small models."""

        def sql(node: dict) -> str:
            if node.get("leaf") is not None:
                return repr(float(node["leaf"]))
            child = {c["nodeid"]: c for c in node["children"]}
            column = f"CAST({features[int(node['split'][1:])]} AS FLOAT)"
            condition = f"CAST({float(node['split_condition'])!r} AS FLOAT)"
            yes, no, missing = (sql(child[node[k]]) for k in ("yes", "no", "missing"))
            lost = f"WHEN {column} = 0 THEN {missing} " if zero_as_missing else ""
            return f"CASE {lost}WHEN {column} < {condition} THEN {yes} ELSE {no} END"

        return [sql(t) for t in self.trees]


def _matrix(columns: list[pd.Series]) -> np.ndarray:
    return np.column_stack([c.to_numpy(dtype=float) for c in columns]) if columns else np.empty((0, 0))


def score(features: DataFrame, model: Scorer, names: list[str], zero_as_missing: bool = True, base_margin: float = 0.0) -> DataFrame:
    """``features`` with ``probability``."""

    @F.pandas_udf(T.DoubleType())
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.probability(_matrix(list(columns)), zero_as_missing, base_margin))

    return features.withColumn("probability", run(*(F.col(f"`{n}`") for n in names)))


def score_case(features: DataFrame, model: Ensemble, names: list[str], zero_as_missing: bool = True, base_margin: float = 0.0) -> DataFrame:
    """The same without Python, as CASE expressions; for models of a few trees."""
    quoted = [f"`{n}`" for n in names]
    margin = reduce(lambda a, t: a + F.expr(t), model.margin_sql(quoted, zero_as_missing), F.lit(base_margin))
    return features.withColumn("probability", 1 / (1 + F.exp(-margin)))


def best_window(scored: DataFrame) -> DataFrame:
    """Each address's window of highest probability, the earliest of equals."""
    w = Window.partitionBy("ip").orderBy(F.desc("probability"), "win")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def contributions(features: DataFrame, model: Ensemble, names: list[str], only: Column | None = None) -> DataFrame:
    """``features`` with ``contributions``: non-zero ones, largest first, ties by index.

    Where ``only`` is given, rows for which it is false are not walked through the trees and get none.
    """

    @F.pandas_udf(CONTRIBUTION)
    def run(chosen: pd.Series, *columns: pd.Series) -> pd.Series:
        out: list[list] = [[] for _ in range(len(chosen))]
        at = np.flatnonzero(chosen.fillna(False).to_numpy(bool))
        if len(at):
            x = _matrix([c.iloc[at] for c in columns])
            for row, values, parts in zip(at, x, model.contributions(x), strict=True):
                order = sorted(np.flatnonzero(parts), key=lambda i: (-parts[i], i))
                out[row] = [{"index": int(i), "value": float(values[i]), "contribution": float(parts[i])} for i in order]
        return pd.Series(out, dtype=object)

    return features.withColumn("contributions", run(F.lit(True) if only is None else only, *(F.col(f"`{n}`") for n in names)))


def explanation_text(found: list, names: list[str]) -> str:
    """The largest contributions as a sentence."""
    if not found:
        return UNKNOWN
    return "Reasons: " + ", ".join(f"{names[c['index']]} ({feature_text(names[c['index']], c['value'])})" for c in found[:TOP_REASONS])


def explain(features: DataFrame, model: Ensemble, names: list[str], only: Column | None = None) -> DataFrame:
    """``contributions`` plus their ``explanation`` text."""

    @F.pandas_udf(T.StringType())
    def text(parts: pd.Series) -> pd.Series:
        return pd.Series([explanation_text(list(p), names) for p in parts], dtype=object)

    return contributions(features, model, names, only).withColumn("explanation", text("contributions"))


def is_botnet(probability: Column) -> Column:
    return probability > THRESHOLD


def results(features: DataFrame, model: Ensemble, names: list[str], zero_as_missing: bool = True, base_margin: float = 0.0) -> DataFrame:
    """``(ip, probability, is_botnet, explanation)`` per address; probability in percent, explained if a botnet's."""
    bot = is_botnet(F.col("probability"))
    best = explain(best_window(score(features, model, names, zero_as_missing, base_margin)), model, names, only=bot)
    return best.select("ip", (F.col("probability") * 100).alias("probability"), bot.alias("is_botnet"), F.when(bot, F.col("explanation")).otherwise("").alias("explanation"))
