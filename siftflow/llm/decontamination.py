"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

Scores are BM25 impacts divided by an item's score for its own text, so 1 means that a passage holds all of
its terms and one threshold serves every item. Passages fit an item's own length class, whichever items share
an index with it. Every passage of every document is a query: block maxima bound its score for each block of
items (for many passages at once), block-max WAND finds the items above the threshold in the blocks that are
left, and each is verified by how much of the item's question and of its answer the passage holds in order.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, table

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of its question's and answer's words.
THRESHOLD, OVERLAP = 0.7, 0.8
#: Answers of fewer words, of which ``OVERLAP`` is every word, may lack one if all of a question of so many words is held.
SHORT_ANSWER, LEAST_QUESTION = 5, 8
#: Items of a block with one maximum per term, and items of an index; neither changes what is found.
BLOCK_ITEMS, INDEX_ITEMS = 4, 512
#: Words of the items that are searched for in one pass over the corpus; a larger benchmark takes more passes.
PASS_WORDS = 2_000_000
#: Block maxima that are added up at once.
BOUND_CELLS = 1 << 20
#: The shortest class of items.
LEAST_STRIDE = 16
#: What rounding may take off a sum of impacts.
SLACK = 1e-9

_WORDS = re.compile(r"\w+").findall
_SENTENCE = re.compile(r"(?<=[.?!\n])\s*(?=\S)")

LEAK = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("question_overlap", T.DoubleType()),
    T.StructField("answer_overlap", T.DoubleType()),
    T.StructField("word", T.LongType()),
])


def words(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words of an item: its last sentence answers; of a single one, the last third."""
    parts = [w for s in _SENTENCE.split(text) if (w := words(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    flat = parts[0] if parts else []
    cut = len(flat) - max(1, len(flat) // 3)
    return flat[:cut], flat[cut:]


def stride_of(item_words: int) -> int:
    """Half a passage's words for items of that length: the next power of two, so no other item has a say in it."""
    return max(LEAST_STRIDE, 1 << (item_words - 1).bit_length())


def common_run(item: list[str], parts: tuple[int, ...], passage: list[str], least: int = 0) -> list[int] | None:
    """Longest common subsequence with the passage of the item's first ``n`` words, for each ``n`` of ``parts``.

    Bit-parallel: a bit per word of the passage, one addition a word of the item; as many bits have become zero
    as the common subsequence is long. ``None`` as soon as the first part can't reach ``least`` any more.
    """
    where: dict[str, list[int]] = {w: [] for w in item}
    for i, w in enumerate(passage):
        if w in where:
            where[w].append(i)
    masks: dict[str, int] = {}

    def mask(w: str) -> int:
        bits = bytearray(len(passage) // 8 + 1)
        for i in where[w]:
            bits[i >> 3] |= 1 << (i & 7)
        masks[w] = int.from_bytes(bits, "little")
        return masks[w]

    full = (1 << len(passage)) - 1
    v, out = full, []

    def length() -> int:
        return len(passage) - (v & full).bit_count()

    for n, w in enumerate(item):
        if n in parts:
            out.append(length())
        if n < parts[0] and not n % 64 and length() + parts[0] - n < least:
            return None
        if where[w] and (u := v & (masks.get(w) or mask(w))):
            v = v + u | v ^ u
    return out + [length()] * (len(parts) - len(out))


@dataclass
class Index:
    """Inverted index of items of one length class.

    ``local`` turns the benchmark's term numbers into the index's (zero: none). Per term of the index: its
    items (ascending) with their impacts, its greatest impact, and the greatest in each block of items.
    """

    stride: int
    item_ids: list[int]
    items: list[tuple[list[str], list[str]]]
    local: np.ndarray
    postings: list[tuple[list[int], list[float]]]
    top: list[float]
    block_top: np.ndarray

    @classmethod
    def build(cls, stride: int, parts: list[tuple[int, tuple[list[str], list[str]]]], terms: dict[str, int], idf: dict[str, float], mean: float) -> Index:
        """``parts`` are ids with question and answer; the other arguments are those of the whole benchmark."""
        flat = [q + a for _, (q, a) in parts]
        local = np.zeros(len(terms) + 1, np.int64)
        held = np.unique([terms[t] for w in flat for t in w]).astype(np.int64)
        local[held] = np.arange(1, len(held) + 1)
        postings: list[tuple[list[int], list[float]]] = [([], []) for _ in range(len(held) + 1)]
        block_top = np.zeros((len(held) + 1, -(-len(flat) // BLOCK_ITEMS)))
        for n, item in enumerate(flat):
            weight = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(item) / mean)) for t, f in Counter(item).items()}
            whole = math.fsum(weight.values())
            for t, w in weight.items():
                at = local[terms[t]]
                postings[at][0].append(n)
                postings[at][1].append(w / whole)
                block_top[at, n // BLOCK_ITEMS] = max(block_top[at, n // BLOCK_ITEMS], w / whole)
        return cls(stride, [i for i, _ in parts], [p for _, p in parts], local, postings, block_top.max(axis=1).tolist(), block_top)

    def wand(self, terms: list[int], threshold: float, alive: set[int]) -> list[tuple[int, float]]:
        """Items scoring ``threshold`` or more, by block-max WAND; ``alive`` are the blocks that can hold any."""
        cursors = [[self.postings[t][0][0], 0, t] for t in terms]
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for c in cursors:
                bound += self.top[c[2]]
                if bound >= threshold - SLACK:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if pivot // BLOCK_ITEMS not in alive:  # no item of this block can reach the threshold
                goal = (pivot // BLOCK_ITEMS + 1) * BLOCK_ITEMS
            elif cursors[0][0] == pivot:
                # rounded once, so that the order of the terms has no say in what reaches the threshold
                score = math.fsum(self.postings[t][1][at] for doc, at, t in cursors if doc == pivot)
                if score >= threshold:
                    out.append((pivot, score))
                goal = pivot + 1
            else:
                goal = pivot
            for c in cursors:
                if c[0] >= goal:
                    break
                where = self.postings[c[2]][0]
                c[1] = bisect_left(where, goal, c[1])
                c[0] = where[c[1]] if c[1] < len(where) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def overlap(self, item: int, passage: list[str], least: float = 0.0) -> tuple[float, float]:
        """Shares of the item's question, and of its answer after the question, that the passage holds in order.

        Zeros where the question's share is below ``least``.
        """
        question, answer = self.items[item]
        n, m = len(question), len(answer)
        found = common_run(question + answer, (n, n + m), passage, math.ceil(least * n - SLACK))
        if not found or found[0] < least * n - SLACK:
            return 0.0, 0.0
        return (found[0] / n if n else 1.0), ((found[1] - found[0]) / m if m else 1.0)

    def all_but_one(self, item: int, question: float, answer: float) -> bool:
        """Whether the passage holds the whole item but one word of an answer too short for a share of it to say much."""
        n, m = map(len, self.items[item])
        return m < SHORT_ANSWER and n >= LEAST_QUESTION and round(question * n) == n and round(answer * m) >= m - 1

    def search(self, docs: list[list[str]], numbers: list[np.ndarray], threshold: float, overlap: float) -> Iterator[tuple[int, tuple]]:
        """Verified leaks ``(doc, leak)`` of texts given as words and as the benchmark's term numbers.

        Passages are two strides long and overlap by one, so any run of words as long as an item lies in one;
        what is left of a text at its end belongs to the passage before.
        """
        stride, width = self.stride, len(self.postings)
        keys, first = [], [0]
        for ids in numbers:
            own = self.local[ids]
            at = np.flatnonzero(own)
            own, passage, count = own[at], at // stride, max(1, -(-len(ids) // stride) - 1)
            here, back = passage < count, passage > 0
            keys.append(np.concatenate([passage[here] * width + own[here], (passage[back] - 1) * width + own[back]]) + first[-1] * width)
            first.append(first[-1] + count)
        flat = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        if not len(flat):
            return
        flat = flat[np.concatenate([[True], flat[1:] != flat[:-1]])]
        passage, term = np.divmod(flat, width)
        starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        ends = np.append(starts[1:], len(flat))
        hi = 0
        while hi < len(starts):
            lo, hi = hi, max(hi + 1, int(np.searchsorted(ends, starts[hi] + BOUND_CELLS // self.block_top.shape[1], side="right")))
            a, b = starts[lo:hi], ends[lo:hi]
            alive = np.add.reduceat(self.block_top[term[a[0] : b[-1]]], a - a[0], axis=0) >= threshold - SLACK
            for n in np.flatnonzero(alive.any(axis=1)):
                number = int(passage[a[n]])
                d = bisect_left(first, number + 1) - 1
                begin = (number - first[d]) * stride
                held = docs[d][begin : begin + 2 * stride]
                for item, score in self.wand(term[a[n] : b[n]].tolist(), threshold, set(np.flatnonzero(alive[n]).tolist())):
                    question, answer = self.overlap(item, held, overlap)
                    if question >= overlap and (answer >= overlap or self.all_but_one(item, question, answer)):
                        yield d, (self.item_ids[item], min(1.0, score), question, answer, begin)


@dataclass
class Searcher:
    """Indexes that are searched in one pass, and the number of every term of the benchmark, from 1."""

    terms: dict[str, int]
    indexes: list[Index]

    def search(self, texts: list[str | None], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[list[tuple]]:
        """The best leak of each item in each text, by item; texts are split into words and numbered once."""
        docs = [words(t) for t in texts]
        numbers = [np.fromiter(map(self.terms.get, d, [0] * len(d)), np.int64, len(d)) for d in docs]
        best: list[dict[int, tuple]] = [{} for _ in docs]
        for index in self.indexes:
            for d, x in index.search(docs, numbers, threshold, overlap):
                if x[0] not in best[d] or (x[1:4], -x[4]) > (best[d][x[0]][1:4], -best[d][x[0]][4]):
                    best[d][x[0]] = x
        return [[b[k] for k in sorted(b)] for b in best]


def build_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[Searcher]:
    """Searchers of at most about ``PASS_WORDS`` words of items each, with the statistics of the whole benchmark.

    The benchmark is a stated query set: its items pass through the driver and go to the workers in pieces of
    that size, nearly always one. Items stand in indexes of their length class, at most ``INDEX_ITEMS`` in
    each. Items without an id or without words are left out; repeated items stay and are found alike.
    """
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).orderBy(id_col, text_col).toLocalIterator()
    items = [(r[0], split_item(r[1])) for r in rows if words(r[1])]
    lengths = {n: len(q) + len(a) for n, (_, (q, a)) in enumerate(items)}
    df = Counter(t for _, (q, a) in items for t in {*q, *a})
    mean = sum(lengths.values()) / max(1, len(items))
    idf = {t: math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    terms = {t: n for n, t in enumerate(sorted(df), 1)}
    frequent = [t for t, _ in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:12]]

    def likeness(n: int) -> tuple:
        # items of a class that share frequent terms share a block, which keeps its maxima low
        held = {*items[n][1][0], *items[n][1][1]}
        return (stride_of(lengths[n]), *(t not in held for t in frequent), n)

    order = sorted(lengths, key=likeness)
    out: list[Searcher] = []
    room = 0
    while order:
        stride = stride_of(lengths[order[0]])
        taken, size = 0, 0
        while taken < min(len(order), INDEX_ITEMS) and stride_of(lengths[order[taken]]) == stride and (not taken or size < PASS_WORDS):
            size += lengths[order[taken]]
            taken += 1
        if not out or size > room:
            out.append(Searcher(terms, []))
            room = PASS_WORDS
        room -= size
        out[-1].indexes.append(Index.build(stride, [items[n] for n in order[:taken]], terms, idf, mean))
        order = order[taken:]
    return out


def find_leaks(docs: DataFrame, searchers: list[Searcher], text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` with ``leaks``: ``(item_id, score, question_overlap, answer_overlap, word)`` per item, by id.

    Whole texts are searched, row by row, without a shuffle; ``word`` is where the best passage starts. Null
    and empty texts, and an empty benchmark, give empty arrays. Every other column passes through; one that
    is called ``leaks`` already gives way, so set such rows aside in a struct.
    """
    spark = docs.sparkSession

    def column(searcher: Searcher):  # noqa: ANN202
        shared = spark.sparkContext.broadcast(searcher)

        @F.pandas_udf(T.ArrayType(LEAK))
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                texts = list(part)
                yield pd.Series([x for lo in range(0, len(texts), 256) for x in shared.value.search(texts[lo : lo + 256], threshold, overlap)], dtype=object)

        # not to be evaluated again in filters on its result
        return run.asNondeterministic()(F.col(text_col))

    none = F.array().cast(T.ArrayType(LEAK))
    found = [column(s) for s in searchers]
    return bound_batches(docs).withColumn("leaks", F.array_sort(F.concat(*found)) if len(found) > 1 else found[0] if found else none)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexes = build_indexes(table(spark, sf_dir, "benchmark"))
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), indexes)
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")
