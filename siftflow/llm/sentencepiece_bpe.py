"""Exact SentencePiece merge-type encoding by backtracking, and decoding.

The vocabulary is an automaton (Aho-Corasick); a text is covered left to right by longest matches, each
checked against its left neighbour by re-merging the two. On a conflict the match is shortened to the next
shorter piece, or the last piece is taken back, and the position is marked as failed in a bitfield so that
it is never tried again. What comes out is what merging the whole text would give, without a merge queue.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, table
from .memo import ChunkMemo

SPACE = "▁"
#: Chunks whose ids a worker keeps, and pairs of pieces whose compatibility it remembers.
KEPT_CHUNKS, KEPT_PAIRS = 400_000, 1 << 18


class PieceModel:
    """A merge-type model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "Ａ ﬁ  x\u0301"
        if lib.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{path}: only an identity normaliser with a dummy prefix is supported")
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        special = {i for i in range(size) if lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        # a piece with a space mark after another character would tie words together
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.raw: list[bytes] = [b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for value, i in self.byte_ids.items():
            self.raw[i] = bytes([value])
        for i in range(size):
            if lib.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
        joined = "".join(p for p in self.ids if len(p) > 1)
        # characters that no piece holds together with others split a text for good
        self.chunks = re.compile(r" +[^ \n]*|[^ \n]+|\n") if self.words_apart and "\n" not in joined else re.compile("(?s).+")
        # pieces that merging never yields can't be part of an encoding
        self.reachable = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.reachable:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.fits = lru_cache(KEPT_PAIRS)(self._fits)

    def merge(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging: the best-scored adjacent pair first, ties to the left."""
        score, parts = self.score, list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (s := score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-s, i, parts[i] + parts[j], j))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, both, j = heapq.heappop(queue)
            if not parts[i] or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def _fits(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` gives the two back: then they may stand side by side."""
        return self.merge(a + b) == [a, b]

    def cover(self, text: str) -> list[str]:
        """Pieces (or single unknown characters) of a chunk, by backtracking."""
        n, reachable, fits = len(text), self.reachable, self.fits
        longest = [1] * n
        for end, size in self.automaton.iter(text):
            if size > longest[end - size + 1]:
                longest[end - size + 1] = size
        if longest[0] == n:
            return [text]
        open_at = bytearray(b"\x01") * (n + 1)  # 0: known to fail
        out: list[str] = []
        at, size = 0, longest[0]
        while at < n:
            left = out[-1] if out else None
            while size:
                piece = text[at : at + size]
                if open_at[at + size] and (size == 1 or piece in reachable) and (left is None or fits(left, piece)):
                    break
                size -= 1
            if size:
                out.append(piece)
                at += size
                size = longest[at] if at < n else 0
            elif out:
                open_at[at] = 0
                size = len(out[-1]) - 1
                at -= len(out.pop())
            else:
                raise AssertionError("no encoding; every text has one")
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        """Little-endian 32-bit ids of one chunk, space marks still written as spaces."""
        ids, out = self.ids, []
        for p in self.cover(chunk.replace(" ", SPACE)):
            i = ids.get(p)
            out.extend([i] if i is not None else [self.byte_ids[b] for b in p.encode()])
        return np.array(out, dtype="<i4").tobytes()

    def memo(self) -> ChunkMemo:
        return ChunkMemo(self.encode_chunk, KEPT_CHUNKS)

    def encode(self, text: str | None, memo: ChunkMemo | None = None) -> np.ndarray:
        """Ids of a whole text; null counts as empty. A space mark in the text is a space, as everywhere."""
        if not text:
            return np.empty(0, dtype="<i4")
        look = memo.__getitem__ if memo is not None else self.encode_chunk
        return np.frombuffer(b"".join(map(look, self.chunks.findall(" " + text.replace(SPACE, " ")))), dtype="<i4")

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: pieces joined, the dummy prefix's space taken off; broken UTF-8 becomes U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(2)
def _loaded(path: str) -> tuple[PieceModel, ChunkMemo]:
    model = PieceModel(path)
    return model, model.memo()


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """``docs`` with ``piece_ids array<int>`` and, if asked for, ``decoded string``.

    Every row is encoded whole and on its own, without a shuffle. Null and empty texts have no ids and decode
    to the empty text; other columns pass through untouched, nulls included; an empty table stays empty. An
    input column named like a new one is replaced.
    """
    new = ["piece_ids", "decoded"] if decode else ["piece_ids"]
    kept = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*kept, T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False), False)] + [T.StructField("decoded", T.StringType(), False)] * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = _loaded(model_path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                ids = [model.encode(t, memo) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids) if ids else np.empty(0, "<i4")
                cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
                if decode:
                    cols.append(pa.array([model.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in kept] + new)

    return bound_batches(docs).select(*(f.name for f in kept)).mapInArrow(run, schema)


def digest_columns() -> list[Column]:
    """Counts and digests of what ``encode_documents`` returned."""
    ids = F.col("piece_ids")
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    ]


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer file ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", *digest_columns())
