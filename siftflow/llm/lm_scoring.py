"""Cross-entropy difference scoring with matched bigram models of a target set and of the whole corpus.

Both models share one vocabulary, the tokens of a public tokenizer, and one smoothing. Counts are gathered
over all documents: partitions count in numpy, a shuffle adds the counts up. A document's score is its mean
loss per token under the target model less that under the background model; lower is closer to the target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, drop_spilled, spill, table
from .sentencepiece_bpe import tokenizer_path
from .token_records import _encoder

#: Weight of the bigram estimate against the unigram's, and what is added to unigram counts.
WEIGHT, ADD = 0.7, 0.5
#: Pairs whose losses go to every worker at most, and pairs that a partition counts before it passes them on.
HOT_PAIRS, HELD_PAIRS = 1 << 20, 1 << 22
_SHIFT = 16


def pairs_of(ids: np.ndarray, start: int) -> np.ndarray:
    """Each token with the one before it as one number; the first follows ``start``."""
    before = np.empty(len(ids), np.int64)
    if len(ids):
        before[0] = start
        before[1:] = ids[:-1]
    return before << _SHIFT | ids


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return (keys[starts], *(np.add.reduceat(c[order], starts) if len(starts) else c for c in counts))


def count_pairs(docs: DataFrame, tokenizer: str, text_col: str = "text", target_col: str = "target") -> DataFrame:
    """``(pair, in_target, in_all)`` over all rows; null and empty texts add nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        start = enc.tokenizer.get_vocab_size() - 1
        none = np.empty(0, np.int64)
        held = (none, none, none)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["pair", "in_target", "in_all"])

        for batch in batches:
            texts, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 512):
                new = [none], [none]
                for text, flag in zip(texts[lo : lo + 512], flags[lo : lo + 512], strict=True):
                    new[bool(flag)].append(pairs_of(np.frombuffer(enc.encode(text), "<u4").astype(np.int64), start))
                parts = [held]
                for kind in (0, 1):
                    keys = np.sort(np.concatenate(new[kind]))
                    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else none
                    n = np.diff(np.append(starts, len(keys)))
                    parts.append((keys[starts], n * kind, n))
                held = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                if len(held[0]) > HELD_PAIRS:
                    yield out()
                    held = (none, none, none)
        if len(held[0]):
            yield out()

    counted = bound_batches(docs).select(F.col(text_col).cast("string"), F.coalesce(F.col(target_col), F.lit(False))).mapInArrow(run, "pair long, in_target long, in_all long")
    return counted.groupBy("pair").agg(F.sum("in_target").alias("in_target"), F.sum("in_all").alias("in_all"))


def losses(counts: DataFrame, vocabulary: int) -> DataFrame:
    """``(pair, in_all, target_loss, background_loss)`` of every counted pair.

    Both models are ``WEIGHT * c(ab)/c(a) + (1 - WEIGHT) * (c(b) + ADD)/(N + ADD * vocabulary)``, or the second
    estimate alone where ``a`` was never seen; ``counts`` is read three times, so pass a written table. The
    tables of single tokens have no more rows than the vocabulary.
    """
    kinds = ("target", "all")
    sums = [F.sum(f"in_{k}").alias(f"n_{k}") for k in kinds]
    first = counts.groupBy(F.shiftright("pair", _SHIFT).alias("a")).agg(*(s.alias(f"a_{k}") for s, k in zip(sums, kinds, strict=True)))
    second = counts.groupBy(F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("b")).agg(*(s.alias(f"b_{k}") for s, k in zip(sums, kinds, strict=True)))
    total = counts.agg(*sums).first()

    def loss(kind: str) -> Column:
        n = total[f"n_{kind}"] or 0
        single = (F.col(f"b_{kind}") + ADD) / (n + ADD * vocabulary)
        mixed = WEIGHT * F.col(f"in_{kind}") / F.col(f"a_{kind}") + (1 - WEIGHT) * single
        return -F.log(F.when(F.col(f"a_{kind}") > 0, mixed).otherwise(single))

    keyed = counts.withColumns({"a": F.shiftright("pair", _SHIFT), "b": F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))})
    met = keyed.join(F.broadcast(first), "a").join(F.broadcast(second), "b")
    return met.select("pair", "in_all", loss("target").alias("target_loss"), loss("all").alias("background_loss"))


def _hot_floor(model: DataFrame) -> int:
    """The smallest count such that no more than ``HOT_PAIRS`` pairs have it; rarer pairs are few rows each."""
    steps = model.groupBy(F.floor(F.log2("in_all") * 8).cast("int").alias("step")).count().collect()
    held, floor = 0, None
    for step, n in sorted(((r[0], r[1]) for r in steps), reverse=True):
        held += n
        if held > HOT_PAIRS:
            break
        floor = step
    return math.ceil(2 ** (floor / 8) - 1e-9) if floor is not None else 1 << 62


def score(docs: DataFrame, model: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, target_loss, background_loss, score)``, one row per input row.

    Losses are means per token, ``score`` their difference. Whole texts are scored; null and empty ones have
    no tokens and score 0. Losses of frequent pairs (at most ``HOT_PAIRS``, so of bounded size) go to the
    workers; occurrences of the others are joined with the model by pair, where no pair can be hot.
    Repeated rows and null ids stay apart; other columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    floor = _hot_floor(model)
    hot = model.where(F.col("in_all") >= floor).select("pair", "target_loss", "background_loss").toPandas().sort_values("pair")
    shared = sc.broadcast(tuple(hot[c].to_numpy() for c in ("pair", "target_loss", "background_loss")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        start = enc.tokenizer.get_vocab_size() - 1
        keys, target, background = shared.value
        for batch in batches:
            rows, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            for lo in range(0, len(rows), 512):
                own: list[tuple] = []
                cold: list[tuple[int, np.ndarray, np.ndarray]] = []
                for row, i, text in zip(rows[lo : lo + 512], ids[lo : lo + 512], texts[lo : lo + 512], strict=True):
                    # sorted, so that looking the pairs up walks through memory in order
                    pairs = np.sort(pairs_of(np.frombuffer(enc.encode(text), "<u4").astype(np.int64), start))
                    at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
                    met = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                    at = at[met]
                    # a row's own entry has a key that no pair has, so it meets nothing and lands anywhere
                    own.append((-row - 1, row, i, len(pairs), float(target[at].sum()), float(background[at].sum())))
                    if not met.all():
                        cold.append((row, *np.unique(pairs[~met], return_counts=True)))
                cols = [list(x) for x in zip(*own, strict=True)]
                for row, pair, n in cold:
                    for col, value in zip(cols, (pair.tolist(), [row] * len(pair), [None] * len(pair), (-n).tolist(), [0.0] * len(pair), [0.0] * len(pair)), strict=True):
                        col.extend(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["pair", "row", "i", "n", "t", "b"])

    numbered = bound_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text"))
    parts = numbered.mapInArrow(run, "pair long, row long, i long, n long, t double, b double")
    rare = model.where(F.col("in_all") < floor).select("pair", "target_loss", "background_loss")
    met = parts.join(rare, "pair", "left")
    # entries of rare pairs carry their number of occurrences below zero
    own, times = F.col("n") >= 0, -F.col("n")
    summed = met.groupBy("row").agg(
        F.max("i").alias(id_col),
        F.sum(F.when(own, F.col("n"))).alias("n_tokens"),
        F.sum(F.when(own, F.col("t")).otherwise(times * F.col("target_loss"))).alias("t"),
        F.sum(F.when(own, F.col("b")).otherwise(times * F.col("background_loss"))).alias("b"),
    )
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")).otherwise(0.0)
    return summed.select(id_col, "n_tokens", mean("t").alias("target_loss"), mean("b").alias("background_loss"), (mean("t") - mean("b")).alias("score"))


def fit(docs: DataFrame, targets: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The losses of all pairs in ``docs``; its rows whose id is in ``targets`` are the target set."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    if vocabulary > 1 << _SHIFT:
        raise ValueError(f"{vocabulary} tokens don't fit in pairs of {_SHIFT} bits")
    chosen = targets.select(F.col(id_col).alias("_t")).where("_t is not null").distinct().withColumn("target", F.lit(True))
    # a merge join at every size: what it moves grows as the input does, and no set of ids is ever broadcast
    flagged = docs.select(F.col(id_col), F.col(text_col)).join(chosen.hint("merge"), F.col(id_col) == F.col("_t"), "left")
    counts = spill(count_pairs(flagged, tokenizer, text_col), "pairs")
    model = spill(losses(counts, vocabulary), "model")
    drop_spilled(counts)
    return model


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    return score(docs, fit(docs, good, tokenizer), tokenizer)
