import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftflow.llm import token_records as tr
from siftflow.llm.common import scratch_path
from siftflow.llm.sentencepiece_bpe import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
ENCODER = tr.TokenEncoder(PATH)


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("  abé's12.,\n\t\r🙂\xa0　'<|endoftext|>\x1f\x85​日"), max_size=40))
def test_any_text(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
def test_any_characters(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


def test_records():
    for doc_id in (None, 0, -5, 2**62):
        for wide in (False, True):
            data = np.array([1, 50_000, 2], "<u4").tobytes()
            many = np.array([7, 50_000] * 900, "<u4").tobytes()
            packed = tr.pack(doc_id, many, wide)
            assert len(packed) < 200
            assert tr.unpack(packed[12:-4])[1].tobytes() == many
            record = tr.pack(doc_id, data, wide)
            import io

            got_id, got = tr.unpack(tr.read_record(io.BytesIO(record)))
            assert (got_id, got.tolist()) == (doc_id, [1, 50_000, 2])
            for at in (3, 9, len(record) - 5, len(record) - 1):
                broken = bytearray(record)
                broken[at] ^= 1
                with pytest.raises(ValueError, match="damaged"):
                    tr.read_record(io.BytesIO(bytes(broken)))
            with pytest.raises(ValueError, match="damaged"):
                tr.read_record(io.BytesIO(record[:-2]))


def test_written_and_read_back(spark):
    rng = random.Random(6)
    rows = [(rng.randint(-50, 50) if rng.random() < 0.9 else None, rng.choice(["Hello there.", None, "", "é" * 50_000, f"word{i}"]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long")
    shards = tr.write_records(df, scratch_path(spark, "records"), PATH, 2)
    got = sorted(tr.read_records(spark, shards).collect(), key=lambda r: r.start)
    assert len(got) == 200
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((i if i is not None else -99, len(ids(t)) + 1, zlib.crc32(np.array([*ids(t), 2], "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -99, r.n_tokens, r.ids_crc32) for r in got) == want
    uri = shards[-1][1]
    inorder = list(tr.read_shard(uri))
    order = list(range(len(inorder)))[::-1]
    assert [(i, x.tolist()) for i, x in tr.read_at(uri, order)] == [(i, x.tolist()) for i, x in inorder[::-1]]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    shards = tr.write_records(df, scratch_path(spark, "records"), PATH, 2)
    assert shards == []
    assert tr.read_records(spark, shards).count() == 0


def test_query_whole(spark, tmp_path):
    texts = {5: "one two", 3: None, 9: "", 1: "¡hola! " * 300, 7: "one two"}
    rows = [(i, t, "x") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tr.op6_token_records(spark, str(tmp_path)).collect()}
    want, at = {}, 0
    for i in sorted(texts):
        own = np.array([*ids(texts[i]), 2], "<u4")
        want[i] = (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert got == want
