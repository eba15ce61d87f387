import math

import numpy as np
import pytest

from siftflow.llm import neighbours as nn

SCHEMA = "vec_id long, embedding array<float>, rank string, cell long"


def brute(rows, asked, k=10):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for q, v in asked:
        d = np.sqrt(((m - np.array(v)) ** 2).sum(axis=1))
        out[q] = [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


def run(spark, rows, every=100, k=10):
    points = nn.usable(spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "r", 0) for i, v in rows], SCHEMA))
    got = {}
    for r in nn.nearest(points, points.where(f"vec_id % {every} = 0"), k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def vectors(n, dim=16, clusters=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return [(i, [float(np.float32(x)) for x in centres[rng.integers(clusters)] + rng.normal(size=dim) * 0.3]) for i in range(n)]


def test_chi_square():
    assert nn.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert nn.chi_square_quantile(0.99, 2) == pytest.approx(-2 * math.log(0.01))


@pytest.mark.parametrize("cell_rows", [100_000, 200])
def test_recall(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(nn, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(nn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(nn, "MOST_CELLS", 8)
    monkeypatch.setattr(nn, "WIDEN", 2)
    rows = vectors(3000)
    want = brute(rows, [r for r in rows if r[0] % 100 == 0])
    got = run(spark, rows)
    assert set(got) == set(want)
    hit = sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.9
    for q, found in got.items():
        assert len(found) == 10
        exact = dict(brute(rows, [r for r in rows if r[0] == q], 3000)[q])
        assert all(s == pytest.approx(exact[i], abs=1e-12) for i, s in found)
        assert [(s, i) for i, s in found] == sorted((s, i) for i, s in found)


def test_verifies_a_share_of_structureless_rows(spark):
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(4000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(unit)]
    points = nn.usable(spark.createDataFrame([(i, v, "r", 0) for i, v in rows], SCHEMA))
    found = nn.nearest(points, points.where("vec_id % 100 = 0")).toPandas()
    want = brute(rows, [r for r in rows if r[0] % 100 == 0])
    hit = sum(len(set(g.vec_id) & dict(want[q]).keys()) for q, g in found.groupby("query_id"))
    assert hit / (10 * len(want)) >= 0.9
    assert found.groupby("query_id").verified.first().mean() < 0.4 * len(rows)


def test_repeated_ids_with_different_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [9.0, 9.0]), (2, [1.0, 0.2]), (2, [1.0, 0.2])]
    assert [i for i, _ in run(spark, rows)[0]] == [1, 2, 1]


def test_query_whole(spark, tmp_path):
    rows = vectors(250)
    spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<float>, label string").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = nn.op9_nearest_neighbours(spark, str(tmp_path))
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    assert [(r.query_id, r["rank"]) for r in got.orderBy("query_id", "rank").collect()] == [(q, n) for q in (0, 100, 200) for n in range(1, 11)]


def test_copies_and_ties(spark):
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, same) for i in range(0, 400)] + [(i, [float(i), 0.0, 0.0, 1.0]) for i in range(400, 450)] + [(7, same), (7, same)]
    got = run(spark, rows)
    assert [i for i, _ in got[0]] == list(range(1, 11))
    assert [i for i, _ in got[300]] == list(range(0, 10))
    assert [i for i, _ in got[400]][0] == 401


def test_odd_vectors(spark):
    rows = vectors(30, 4) + [(100, None), (200, [0.0] * 4), (300, [1.0, None, 1.0, 1.0]), (400, [math.nan, 1, 1, 1]), (500, [math.inf, 1, 1, 1]), (600, []), (700, [1.0, 2.0]), (None, [1.0] * 4)]
    got = run(spark, rows)
    assert set(got) == {0}
    assert len(got[0]) == 10
    assert len(run(spark, vectors(5, 4))[0]) == 4
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0, 1.0])]) == {}
