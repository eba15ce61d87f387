import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from siftflow.llm import sentencepiece_bpe as sp
from siftflow.llm.memo import ChunkMemo

PATH = sp.tokenizer_path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = sp.PieceModel(PATH)


def same(text):
    ids = LIB.encode(text)
    assert MODEL.encode(text).tolist() == ids
    assert MODEL.decode(ids) == LIB.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "  a  b", "a\tb\n\nc", "▁x", "　a", "<s>x</s><0x41>", "\0a", "ﬁ①", "🙂x", "a" * 5000, "中文" * 2000, " " * 1000, "\n" * 99, "aB1" * 999, "�"])
def test_cases(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("  ▁abthe ionr\n\tZ9.é中🙂<0x>"), max_size=40))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
def test_any_characters(text):
    same(text)


def test_joined_pieces():
    rng = random.Random(1)
    for _ in range(3000):
        same(" ".join(rng.choice(MODEL.pieces[260:]) + rng.choice(MODEL.pieces[260:]) for _ in range(4)))


def test_memo_stays_bounded():
    memo = ChunkMemo(MODEL.encode_chunk, 2, 2)
    for w in ["one", "two", "three", "four", "five", "six", "three", "one", "z" * 99]:
        assert MODEL.encode(w, memo).tolist() == LIB.encode(w)
    assert max(len(memo), len(memo.recent), len(memo.older)) <= 2


def test_documents(spark, tmp_path):
    rows = [(1, "Hello world", 7), (1, "Hello world", 7), (None, None, 8), (3, "", 9), (4, "x" * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids long")
    got = sp.encode_documents(df, PATH).collect()
    assert [r.piece_ids for r in got] == [LIB.encode(t or "") for _, t, _ in rows]
    assert [r.decoded for r in got] == [t or "" for _, t, _ in rows]
    assert sp.encode_documents(df.limit(0), PATH).count() == 0
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.n_tokens for r in sp.op4_sentencepiece(spark, str(tmp_path)).collect()] == [len(LIB.encode(t or "")) for _, t, _ in rows]
