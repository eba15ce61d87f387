import collections
import math
import random

import pytest
from tokenizers import Tokenizer

from siftflow.llm import lm_scoring as lm
from siftflow.llm.sentencepiece_bpe import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
SIZE = LIB.get_vocab_size()


def brute(rows, good):
    enc = [[SIZE - 1, *LIB.encode(t or "", add_special_tokens=False).ids] for _, t in rows]
    pair = [collections.Counter(), collections.Counter()]
    for (i, _), x in zip(rows, enc, strict=True):
        p = list(zip(x, x[1:], strict=False))
        pair[1].update(p)
        if i in good:
            pair[0].update(p)
    first, second, total = [], [], []
    for c in pair:
        a, b = collections.Counter(), collections.Counter()
        for (x, y), n in c.items():
            a[x] += n
            b[y] += n
        first.append(a)
        second.append(b)
        total.append(sum(c.values()))

    def loss(k, a, b):
        one = (second[k][b] + lm.ADD) / (total[k] + lm.ADD * SIZE)
        return -math.log(lm.WEIGHT * pair[k][a, b] / first[k][a] + (1 - lm.WEIGHT) * one if first[k][a] else one)

    out = []
    for (i, _), x in zip(rows, enc, strict=True):
        n = len(x) - 1
        t, b = (sum(loss(k, *p) for p in zip(x, x[1:], strict=False)) / max(1, n) for k in (0, 1))
        out.append((i if i is not None else -1, n, round(t, 8), round(b, 8), round(t - b, 8)))
    return sorted(out)


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_scores(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_PAIRS", hot)
    monkeypatch.setattr(lm, "HELD_PAIRS", 100)
    rng = random.Random(11)
    vocabulary = [["red", "green", "blue", "fast"], ["north", "south", "red", "slow"]]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 2]) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += [(None, "red green"), (None, None), (3, "red blue"), (3, "red blue"), (7, "x" * 100_000), (500, "never seen zebra")]
    labels = [(i, 1 if i % 2 == 0 else 0, 0) for i in range(0, 100)] + [(2, 1, 0), (None, 1, 0)]
    spark.createDataFrame([(*r, "row", 1.0) for r in rows], "doc_id long, text string, pair string, score double").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, round(r.target_loss, 8), round(r.background_loss, 8), round(r.score, 8)) for r in lm.op2_lm_scoring(spark, str(tmp_path)).collect())
    assert got == brute(rows, {i for i, q, _ in labels if q == 1 and i is not None})
    mean = lambda odd: sum(g[4] for g in got if 0 <= g[0] < 100 and g[0] % 2 == odd) / 50
    assert mean(0) < mean(1)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = lm.fit(docs, docs, PATH)
    assert model.count() == 0
    assert lm.score(docs, model, PATH).count() == 0
    some = spark.createDataFrame([(1, "a b c")], docs.schema)
    assert lm.score(some, lm.fit(some, docs, PATH), PATH).first().n_tokens == 3


def test_a_vocabulary_too_large_for_pairs_raises(spark, monkeypatch):
    monkeypatch.setattr(lm, "_SHIFT", 15)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="fit in pairs"):
        lm.fit(docs, docs.select("doc_id"), lm.tokenizer_path("byte_bpe_50k.json"))
