"""SimHash near-duplicate detection: pigeonhole blocks, a join on shared blocks, Hamming verification."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, spill, table, workspace
from .graph import connected_components

#: Fixed values of the fingerprint.
SHINGLE, SEED, BITS = 3, 42, 64


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a whole text, in order.

    Letters A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are ``shingle``
    consecutive words joined by a space, repeats included; fewer words give one shingle of all of them, no
    words (or null) give none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, "<u8")
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, seed) for g in grams], dtype="<u8")


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a whole text."""
    return fingerprint(shingle_hashes(text, shingle, seed))


def fingerprint(h: np.ndarray) -> int:
    """The signed 64-bit SimHash of shingle hashes: a bit is set if it is set in more than half of them; none give zero."""
    votes = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 65536):
        votes += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """Long keys of all choices of ``blocks - distance`` blocks; close fingerprints agree on one of them at least."""
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    out = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in chosen)
        out.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> 63 else mask).cast("long"))))
    return F.array(*out)


def linked_fingerprints(fps: DataFrame, blocks: int = 4, bucket_cap: int = 64) -> DataFrame:
    """Links ``(a, b)`` that span the graph of distinct fingerprints (column ``fp``) at 2 or fewer differing bits.

    Fingerprints are cut into ``blocks`` blocks; a pair at distance 2 or less agrees on ``blocks - 2`` of them,
    so joining on every such choice (6 keys of 32 bits by default) misses none, and the Hamming distance of
    each pair met is verified. Keys held by more than ``bucket_cap`` distinct fingerprints aren't paired off:
    there each fingerprint is written under itself and its 64 one-bit variants. Two fingerprints are within
    distance 2 exactly if they share such a variant, and at most 65 can share one; each is linked to the
    variant's smallest member. So no pair is lost and no group is expanded into all its pairs.
    """
    keys = fps.select("fp", F.explode(block_keys(F.col("fp"), blocks, 2)).alias("k"))
    sizes = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    met = spill(keys.join(sizes, "k"), "blocks")
    cold = met.where(F.col("n") <= bucket_cap).select("k", F.col("fp").alias("a"))
    near = (
        cold.join(cold.withColumnRenamed("a", "b"), "k")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .select("a", "b")
    )
    flips = [0, *(1 << i for i in range(63)), -(1 << 63)]
    hot = met.where(F.col("n") > bucket_cap).select("fp").distinct()
    stars = hot.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(x).cast("long")) for x in flips))).alias("v"))
    centre = stars.groupBy("v").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1")
    far = stars.join(centre, "v").where("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b"))
    return near.unionByName(far).distinct()


def row_key(row_id: Column, text: Column) -> Column:
    """A hash of id and text; rows that agree on it and on the id are taken for repeated rows."""
    return F.xxhash64(row_id, F.coalesce(text, F.lit("")))


def _classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(i, row_key, fp, component_id)``, one row per input row."""
    row_id, text = F.col(id_col), F.col(text_col)
    with workspace() as keep:
        prints = spill(bound_batches(docs).select(row_id.alias("i"), row_key(row_id, text).alias("row_key"), simhash_udf(text).alias("fp")), "fingerprints")
        fps = prints.groupBy("fp").agg(F.min("i").alias("least"))
        comp = connected_components(linked_fingerprints(fps.select("fp")))
        classes = fps.join(comp, fps.fp == comp.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
        least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
        return keep(spill(prints.join(classes.join(least, "root").select("fp", "component_id"), "fp").select("i", "row_key", "fp", "component_id"), "classes"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fingerprint long, component_id)``, one row per input row.

    Documents whose fingerprints differ in 2 bits or fewer are linked; ``component_id`` is the smallest id
    reachable. Equal fingerprints collapse before any join, so copies cost one row. Null or empty text has
    fingerprint zero and is linked like any other; rows with a null id take part, and a component of such
    rows alone has a null ``component_id``; repeated rows give repeated results; an empty table gives none.
    Other columns are not looked at.
    """
    return _classified(docs, id_col, text_col).select(F.col("i").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the smallest id.

    Of repeated rows with that id and text, one stays. A component whose rows all have a null id keeps one
    row per distinct text. Columns and their order stay as they are. Texts move once: the rows to keep are
    found by their keys, and repeated rows meet in the partitions of that same join.
    """
    return keep_least(docs, _classified(docs, id_col, text_col), id_col, text_col)


def keep_least(docs: DataFrame, classified: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is their ``component_id`` in ``classified``, one of each id and text."""
    found = classified.where(F.col("i").eqNullSafe(F.col("component_id"))).select(F.col("row_key").alias("key")).distinct()
    # the row travels as one column, so that no column of its own clashes with a key
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    kept = rows.join(found, "key", "left_semi").dropDuplicates(["key", "id"])
    return kept.select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
