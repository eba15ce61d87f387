import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from siftflow.llm import language_id as li

WORDS = {"en": "the of and to in that it is was for with thing over".split(), "de": "der die und den von das mit sich auf für ist über".split(), "fr": "le la les des est et dans une pour par été où".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_gradients():
    rng = np.random.default_rng(0)
    net = li.BiGru.fresh(["a", "b", "c"], 5, rng)
    for name in ("x", "u", "b", "o", "c"):
        setattr(net, name, getattr(net, name).astype("f8"))
    windows, used, target = rng.integers(97, 103, (7, 9)), np.array([9] * 5 + [4, 6]), rng.integers(0, 3, 7)
    _, grads = net.loss_and_gradients(windows, used, target)
    for w, g in zip(net.weights(), grads, strict=True):
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in w.shape) if w is not net.x else (rng.integers(2), rng.integers(15), int(windows[0, 2]))
            old = w[at]
            w[at] = old + 1e-2
            up = net.loss_and_gradients(windows, used, target)[0]
            w[at] = old - 1e-2
            down = net.loss_and_gradients(windows, used, target)[0]
            w[at] = old
            assert abs((up - down) / 2e-2 - g[at]) < 2e-4


def test_pooling_is_over_all_bytes():
    net = li.BiGru.fresh(["a", "b"], 4, np.random.default_rng(1))
    data = bytes(range(65, 91)) * 30
    whole = net.document_probabilities([data, b"x", data[:128]])
    cells = [data[i : i + li.WINDOW] for i in range(0, len(data), li.WINDOW)]
    total = np.zeros(2)
    for c in cells:
        padded = np.zeros((1, li.WINDOW), np.uint8)
        padded[0, : len(c)] = np.frombuffer(c, np.uint8)
        total += net.label(padded)[: len(c), :, 0].sum(axis=0)
    assert np.allclose(whole[0], total / len(data), atol=1e-5)
    assert np.allclose(whole.sum(axis=1), 1, atol=1e-5)


def test_forward_pass_is_a_plain_recurrence():
    """Byte by byte, with matrices and logistic functions written out."""
    rng = np.random.default_rng(2)
    net = li.BiGru.fresh(["a", "b", "c"], 6, rng)
    net.b += rng.normal(size=net.b.shape).astype("f4")
    net.c += rng.normal(size=net.c.shape).astype("f4")
    data = rng.integers(0, 256, li.WINDOW).astype(np.uint8)
    logistic = lambda v: 1 / (1 + np.exp(-v))
    logits = np.repeat(net.c.T.astype("f8"), len(data), axis=0)
    for way, order in ((0, range(len(data))), (1, reversed(range(len(data))))):
        h = np.zeros(6)
        for t in order:
            gates, state = net.x[way][:, data[t]], net.u[way] @ h + net.b[way][:, 0]
            z, r = logistic(gates[:6] + state[:6]), logistic(gates[6:12] + state[6:12])
            h = z * h + (1 - z) * np.tanh(gates[12:] + r * state[12:])
            logits[t] += net.o[way] @ h
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    assert np.allclose(net.label(data[None])[:, :, 0], p, atol=1e-4)
    assert np.allclose(net.document_probabilities([data.tobytes()])[0], p.mean(axis=0), atol=1e-4)


def test_strange_texts(spark):
    rng = random.Random(3)
    for langs in (1, 2, 3):
        known = sorted(WORDS)[:langs]
        train = spark.createDataFrame([(i, text(rng, lang, 60), lang) for i in range(300) for lang in [rng.choice(known)]], "doc_id long, text string, lang string")
        net = li.fit(train)
        other = [" ".join(rng.choice("ja on ei että hän se oli kuin mutta niin minä tai kun jos olen ovat".split()) for _ in range(60)), "".join(rng.choice("абвгдежзиклмнопр ") for _ in range(300)), "".join(chr(rng.randint(33, 126)) for _ in range(300))]
        own = [text(rng, lang, n) for lang in known for n in (1, 2, 5, 60, 3000)] + ["of", "x", "Ĳ", "a-1"]
        got = {r.text: r.strange for r in li.predict(spark.createDataFrame([(t, 1) for t in other + own], "text string, strange int"), net).collect()}
        assert [got[t] for t in other] == [True] * 3
        assert not any(got[t] for t in own)


def documents(spark, n=700):
    rng = random.Random(8)
    rows = [(i, text(rng, lang, rng.randint(4, 60)), lang) for i in range(n) for lang in [rng.choice(sorted(WORDS))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_inputs(spark, tmp_path):
    docs = documents(spark)
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", None), (9003, "123 !?", "de"), (None, "the of and to in", "xx"), (9004, "der die und " * 20_000, None), (9001, None, "en")], docs.schema)
    docs = docs.unionByName(odd).withColumn("score", F.lit("clash"))
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = li.op3_language_id(spark, str(tmp_path)).collect()
    assert len(got) == 706
    truth = {r.doc_id: r.lang for r in docs.collect()}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        assert r.lang_pred in (*WORDS, "und")
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert sum(r.lang_pred == truth[r.doc_id] for r in test) / len(test) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (9001, 9002, 9003, 9004)] == ["und", "und", "und", "de"]
    assert by_id[9003].score == 0
    assert by_id[None].lang_pred == "en"  # its odd label was never learned


def test_no_model(spark):
    docs = documents(spark, 5)
    assert li.fit(docs.limit(0)) is None
    assert li.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in li.predict(docs, None).collect()} == {"und"}
    assert li.predict(docs.limit(0), None).count() == 0
