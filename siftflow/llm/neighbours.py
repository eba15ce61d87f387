"""Approximate nearest neighbours: stable projections, kd-trees over them, and a chi-square stopping test.

Every vector is projected to a few dimensions with Gaussian (2-stable) weights, so the squared projected
distance of a pair is its squared distance times a chi-square variable. A kd-tree over a bounded sample cuts
projected space into cells; each cell gets kd-trees of its own. A query takes projected neighbours in
growing distance, verifies them on the original vectors, and stops when the next projected distance would be
improbably large for anything nearer than its k-th neighbour so far. Cells are visited nearest first, in
rounds, and what a round finds tightens the radius of the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_spilled, spill, table

#: Projected dimensions, and the probability with which a true neighbour passes the stopping test. Fewer dimensions
#: tell near from far too poorly: at 8, a recall of 0.9 takes more than half of all rows of vectors without structure.
DIMENSIONS, CONFIDENCE, SEED = 32, 0.9, 11
#: Rows of a tree and of a leaf; cells at most, and rows of the sample per cell; queries that visit a tree at once.
CELL_ROWS, LEAF_ROWS, MOST_CELLS, SAMPLE_ROWS, QUERY_BLOCK = 8192, 256, 4096, 64, 16_384
#: Rows that are verified before the radius is looked at again, at first.
FIRST_ROWS = 64
#: Each round visits so many times the cells of the one before.
WIDEN = 8

_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("verified", T.LongType())])


def chi_square_quantile(p: float, m: int) -> float:
    """The ``p`` quantile of a chi-square variable with an even number ``m`` of degrees of freedom."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 10.0 * m
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def projection(dim: int, m: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, m))


@dataclass
class Cells:
    """Cells of projected space: split planes in heap order, and each cell's bounds."""

    planes: np.ndarray  # (cells - 1, 2): dimension, value
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int) -> Cells:
        """Median splits of the widest dimension, ``depth`` deep."""
        planes = np.zeros(((1 << depth) - 1, 2))
        m = sample.shape[1]
        low, high = np.full((1 << depth, m), -np.inf), np.full((1 << depth, m), np.inf)
        todo = [(0, 0, sample, np.full(m, -np.inf), np.full(m, np.inf))]
        while todo:
            node, level, points, lo, hi = todo.pop()
            if level == depth:
                low[node - len(planes)], high[node - len(planes)] = lo, hi
                continue
            d = int(np.argmax(np.ptp(points, axis=0))) if len(points) else level % m
            cut = float(np.median(points[:, d])) if len(points) else 0.0
            planes[node] = d, cut
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[d] = right_lo[d] = cut
            todo += [(2 * node + 1, level + 1, points[points[:, d] < cut], lo, left_hi), (2 * node + 2, level + 1, points[points[:, d] >= cut], right_lo, hi)]
        return cls(planes, low, high)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(len(self.low).bit_length() - 1):
            d = self.planes[node, 0].astype(np.int64)
            node = 2 * node + 1 + (points[np.arange(len(points)), d] >= self.planes[node, 1])
        return node - len(self.planes)

    def gap(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a projected point to each cell."""
        out = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (out * out).sum(axis=1)


class Tree:
    """A kd-tree over projected points: rows in leaf order, where leaves begin, and each leaf's bounding box."""

    def __init__(self, points: np.ndarray):
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF_ROWS:
                leaves.append(rows)
                continue
            d = int(np.argmax(np.ptp(points[rows], axis=0)))
            half = len(rows) // 2
            order = np.argpartition(points[rows, d], half)
            todo += [rows[order[half:]], rows[order[:half]]]
        self.rows = np.concatenate(leaves)
        self.begin = np.concatenate([[0], np.cumsum([len(r) for r in leaves])])
        self.points = points[self.rows]
        self.squares = (self.points**2).sum(axis=1)
        self.low = np.array([points[r].min(axis=0) for r in leaves])
        self.high = np.array([points[r].max(axis=0) for r in leaves])

    def incremental(self, q: np.ndarray, bound: float) -> Iterator[tuple[np.ndarray, float, np.ndarray]]:
        """Batches ``(rows, their squared projected distances, distance reached)``, nearest first.

        All rows up to the distance reached have been handed out. Nothing beyond ``bound`` is. Leaves are
        opened nearest first, twice as many each time.
        """
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        gap = (gap * gap).sum(axis=1)
        order = np.argsort(gap, kind="stable")
        order = order[: int(np.searchsorted(gap[order], bound, side="right"))]
        rows, near, at, step = np.empty(0, np.int64), np.empty(0), 0, 1
        while at < len(order):
            opened = np.sort(order[at : at + step])
            at, step = at + step, 2 * step
            new = np.concatenate([np.arange(self.begin[n], self.begin[n + 1]) for n in opened])
            far = np.maximum(self.squares[new] - 2 * (self.points[new] @ q) + q @ q, 0)
            inside = far <= bound
            rows, near = np.concatenate([rows, new[inside]]), np.concatenate([near, far[inside]])
            reach = gap[order[at]] if at < len(order) else np.inf
            ready = near <= reach
            if ready.any():
                mine = np.flatnonzero(ready)
                mine = mine[np.argsort(near[mine], kind="stable")]
                yield self.rows[rows[mine]], near[mine], reach
                rows, near = rows[~ready], near[~ready]


def search(vectors: np.ndarray, ids: np.ndarray, tree: Tree, query: np.ndarray, projected: np.ndarray, own: int, k: int, limit: float, quantile: float) -> tuple[list[tuple[float, int]], int]:
    """Up to ``k`` nearest ``(distance, id)`` of a query within ``limit``, not counting id ``own``; and the rows verified."""
    best_far, best_id = np.empty(0), np.empty(0, np.int64)
    worst, verified = limit, 0

    def radius() -> float:
        # the last factor covers rounding of projected distances
        return worst * worst * quantile * (1 + 1e-9)

    for rows, near, reach in tree.incremental(projected, radius()):
        at, step = 0, FIRST_ROWS
        while at < len(rows) and near[at] <= radius():
            batch = rows[at : at + step][near[at : at + step] <= radius()]
            at, step = at + step, 2 * step
            verified += len(batch)
            far = np.sqrt(((vectors[batch] - query) ** 2).sum(axis=1))
            kept = (far <= worst) & (ids[batch] != own)
            best_far, best_id = np.concatenate([best_far, far[kept]]), np.concatenate([best_id, ids[batch][kept]])
            order = np.lexsort((best_id, best_far))[:k]
            best_far, best_id = best_far[order], best_id[order]
            if len(order) == k:
                worst = min(limit, best_far[-1])
        if reach > radius():
            break
    return list(zip(best_far.tolist(), best_id.tolist(), strict=True)), verified


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, embedding)`` of rows that take part.

    Left out: null ids, vectors that are null, empty or all zero, that hold a null, NaN or infinite
    component, or whose length isn't the most frequent one (of equally frequent ones the larger).
    """
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    common = kept.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.where(F.size("embedding") == (common["n"] if common else 0))


def nearest(points: DataFrame, queries: DataFrame, k: int = 10, confidence: float = CONFIDENCE) -> DataFrame:
    """``(query_id, rank, vec_id, score, verified)``: the nearest rows of ``points`` for each row of ``queries``.

    Both hold ``(vec_id, embedding)`` as ``usable`` returns them. Repeated rows count once; a query's own id
    is no candidate for it; ties go to the smaller id. Of equal vectors only the ``k + 1`` smallest ids can be
    among anyone's ``k`` nearest, so the rest is left out before the index is built, and a group of copies
    fills no cell. Cells, of ``CELL_ROWS`` rows as long as that makes at most ``MOST_CELLS``, are fit to about
    ``SAMPLE_ROWS`` rows a cell, those with the smallest hashes; every row is indexed. A cell of more rows is
    cut into several trees, and rows are repeated only where a cell has more visitors than one task takes.
    ``verified`` counts the original vectors that the query was compared with. Fewer than ``k`` candidates
    give all of them; no points or no queries give no rows.
    """
    spark = points.sparkSession
    same = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = points.withColumn("copy", F.dense_rank().over(same)).where(F.col("copy") <= k + 1)
    distinct = distinct.withColumn("before", F.lag("vec_id").over(same)).where("before is null or before <> vec_id")
    rows = spill(distinct.select("vec_id", "embedding"), "vectors")
    total = rows.count()
    out_schema = "query_id long, rank int, vec_id long, score double, verified long"
    if not total:
        return spark.createDataFrame([], out_schema)
    weights = projection(len(rows.first()["embedding"]))
    depth = max(0, math.ceil(math.log2(min(MOST_CELLS, total / CELL_ROWS))))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def projected(part: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(part.to_list()) @ weights) if len(part) else [], dtype=object)

    wanted = SAMPLE_ROWS << depth
    luck = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(luck <= min(1.0, wanted / total)).select(projected("embedding").alias("p")).limit(2 * wanted).toPandas()["p"]
    cells = Cells.fit(np.stack(sample.to_list()) if len(sample) else np.zeros((1, DIMENSIONS)), depth)
    quantile = chi_square_quantile(confidence, DIMENSIONS)

    @F.pandas_udf(T.LongType())
    def cell_of(part: pd.Series) -> pd.Series:
        return pd.Series(cells.of(np.stack(part.to_list()) @ weights)) if len(part) else pd.Series([], dtype="int64")

    def reached(first: int, last: int):  # noqa: ANN202
        @F.pandas_udf(T.ArrayType(T.LongType()))
        def run(part: pd.Series, limit: pd.Series) -> pd.Series:
            """Of the cells in order of distance, the ``first`` to ``last`` if they are within the radius."""
            out = []
            for v, d in zip(part, limit, strict=True):
                gap = cells.gap(np.asarray(v) @ weights)
                order = np.argsort(gap, kind="stable")[first:last]
                out.append(order[gap[order] <= (np.inf if np.isnan(d) else d * d * quantile * (1 + 1e-9))])
            return pd.Series(out, dtype=object)

        return run

    def visit(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(held) and len(asked):
            vectors, ids = np.stack(held["embedding"].to_list()), held["vec_id"].to_numpy()
            tree = Tree(vectors @ weights)
            for q, v, d in zip(asked["query_id"], asked["embedding"], asked["limit"], strict=True):
                v = np.asarray(v)
                near, verified = search(vectors, ids, tree, v, v @ weights, q, k, math.inf if math.isnan(d) else d, quantile)
                found.append((q, None, None, verified))
                found += [(q, i, s, 0) for s, i in near]
        out = pd.DataFrame(found, columns=["query_id", "vec_id", "score", "verified"])
        return out.astype({"vec_id": "Int64", "score": "Float64"})

    placed = spill(rows.withColumn("cell", cell_of("embedding")), "cells")
    held = placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).alias("trees"))
    asked = spill(queries.select(F.col("vec_id").alias("query_id"), "embedding").distinct(), "queries")

    def visits(going: DataFrame) -> DataFrame:
        """Searches of cells by their visitors; a cell's rows are dealt to its trees, its visitors into blocks, by hash."""
        size = going.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks")).join(held, "cell")
        number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        part = lambda i, n: F.pmod(F.xxhash64(i), F.col(n))
        trees = placed.join(size, "cell").withColumn("tree", part("vec_id", "trees")).withColumn("block", number("blocks"))
        guests = going.join(size.toDF(*size.columns), "cell").withColumn("block", part("query_id", "blocks")).withColumn("tree", number("trees"))
        key = ["cell", "tree", "block"]
        return trees.groupBy(*key).cogroup(guests.groupBy(*key)).applyInPandas(visit, _FOUND)

    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    rounds: list[DataFrame] = []
    first, last = 0, 1
    limits = asked.withColumn("limit", F.lit(float("nan")))
    while first < 1 << depth:
        going = spill(limits.withColumn("cell", F.explode(reached(first, last)("embedding", "limit"))), "visits")
        rounds.append(spill(visits(going), "found"))
        drop_spilled(going)
        found = reduce(DataFrame.unionByName, rounds)
        kth = found.where("vec_id is not null").withColumn("n", F.row_number().over(by_query)).where(F.col("n") == k).select("query_id", F.col("score").alias("limit"))
        limits = asked.join(kth, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("nan"))))
        first, last = last, last * (WIDEN + 1)
    verified = found.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    best = found.where("vec_id is not null").withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    out = spill(best.drop("verified").join(verified, "query_id").select("query_id", "rank", "vec_id", "score", "verified"), "nearest")
    drop_spilled(rows, placed, asked, *rounds)
    return out


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = usable(table(spark, sf_dir, "embeddings"))
    return nearest(points, points.where(F.col("vec_id") % 100 == 0))
