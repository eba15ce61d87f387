import random
import zlib

import pytest

from siftflow.llm import sharding


def best_capacity(sizes, shards):
    """The smallest capacity for a contiguous cut, by trying all."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                used, at = used + 1, 0
            at += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["x" * rng.randint(0, 300) + str(rng.randint(0, 40)) for _ in range(150)]
    rows = [(i if rng.random() < 0.9 else None, rng.choice(texts) if rng.random() < 0.8 else rng.choice([None, "", "hot"])) for i in range(400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert len(got) == 400
    shards, where = {}, {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
        where.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    assert set(shards) <= set(range(5))
    for part in shards.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    groups = {}
    for r in got:
        groups[r.size, r.text_crc32] = groups.get((r.size, r.text_crc32), 0) + r.size
    assert max(sum(r.size for r in part) for part in shards.values()) == best_capacity(sorted(groups.values(), reverse=True), 5)


def test_hot_group_leaves_the_rest_even(spark):
    rows = [(i, "hot" * 10) for i in range(200)] + [(i, f"t{i}" + "y" * 50) for i in range(200, 340)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sums = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
    assert sums[0] == 200 * 31
    rest = [v for k, v in sums.items() if k]
    assert len(rest) == 7
    assert max(rest) - min(rest) <= 2 * 55


def test_small_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, size string, shard string")
    assert sharding.shard(empty).count() == 0
    few = spark.createDataFrame([(1, "a", "q", "z"), (1, "a", "q", "z"), (None, None, None, None)], empty.schema)
    got = sharding.shard(few).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == [(-1, 1), (1, 2), (1, 2)]
    assert sorted(r.slot for r in got if r.doc_id) == [0, 1]


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, "t" * i) for i in range(50)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op10_sharding(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {(r.law, r.grown_shard) for r in got.collect()} == {("bytes", None)}
