import pathlib
import random

import pytest

import corpus_pipeline
from siftflow.llm import registry

WORDS = {"en": "the of and to in that it is was for with thing over".split(), "de": "der die und den von das mit sich auf für ist über".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(12)
    docs = []
    for i in range(400):
        lang = rng.choice(sorted(WORDS))
        docs.append([i, " ".join(rng.choice(WORDS[lang]) + (str(rng.randint(0, 99)) if rng.random() < 0.2 else "") for _ in range(60)), lang, "s"])
    leak = "Which quick foxes jump over lazy dogs while seven wizards vex? Twelve jolly giants answered them."
    docs[10][1] += " " + leak
    docs[20][1] += " token=abcdefgh12345678 tail"
    docs += [[1004, "ja on ei että hän se oli kuin mutta niin minä tai kun jos olen ovat sinä nyt vain myös " * 3, "en", "s"], [1005, "of", "en", "s"], [1006, "über", "de", "s"]]
    docs += [[1000, docs[5][1], "en", "s"], [1001, docs[5][1], "en", "s"], [1002, "12 34 !!", "en", "s"], [1003, None, "en", "s"]]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], SCHEMA).coalesce(2).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").coalesce(1).write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    gone = [{1002, 1003, 1004}, {1000, 1001}, {10}, set()]
    for (_, stage), lost in zip(corpus_pipeline.STAGES[:-1], gone, strict=True):
        docs = corpus_pipeline.spill(stage(spark, docs, sf), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids -= lost
        assert {r.doc_id for r in docs.collect()} == ids
    masked = docs.where("doc_id = 20").first()
    assert masked.text.endswith(" [SECRET] tail")
    assert masked.n_chars == len(masked.text)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in last} == ids == {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert all(r.n_tokens == len(r.piece_ids) > 0 for r in last)


def test_clashing_columns(spark, sf):
    """Names that the stages use inside stay as they are through all that keep the columns; the last has its own."""
    extra = ["leaks", "score", "lang_pred", "strange", "_language", "doc", "shard", "_key", "_spans", "_secret_id", "_secret_key", "_row_key", "_keep", "key", "id", "spans", "weak", "found", "clean", "i", "row_key", "content"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", *(f"'kept' AS {c}" for c in extra))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.spill(stage(spark, docs, sf), "test")
        assert docs.columns[5:] == extra
    assert docs.where(" AND ".join(f"{c} = 'kept'" for c in extra)).count() == docs.count() > 0
    assert docs.where("doc_id = 20").first().text.endswith(" [SECRET] tail")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.columns == corpus_pipeline.STAGES[-1][1](spark, docs.drop(*extra), sf).columns
    assert last.count() == docs.count()


def test_odd_rows(spark, sf):
    """Null ids, repeated rows and a very long text in every stage."""
    long = " ".join(WORDS["en"][n * n % 13] + str(n % 89) for n in range(60_000)) + " token=abcdefgh12345678"
    odd = [(None, "the of and to in that it is was", "en", "s", 3), (None, None, None, None, None), (7, long, "en", "s", 1), (8, "of the and", "en", "s", 1), (8, "of the and", "en", "s", 1)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 300 and doc_id not in (7, 8, 10)").unionByName(spark.createDataFrame(odd, SCHEMA))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.spill(stage(spark, docs, sf), "test")
    kept = docs.where("doc_id is null or doc_id in (7, 8)").collect()
    assert sorted((r.doc_id or -1, len(r.text)) for r in kept) == [(-1, 31), (7, len(long) - len("token=abcdefgh12345678") + len("[SECRET]")), (8, 10)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_leaves_no_files(spark, sf):
    from siftflow.llm import common

    folder = pathlib.Path(common.shared_folder(spark).removeprefix("file:")) / "siftflow"
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert left == {"stage-3"}  # what the result reads; it goes when the application ends


def test_empty(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_nothing_to_learn_from(spark, sf):
    docs = spark.createDataFrame([(1, "one", None, "s", 3), (2, None, None, None, None)], SCHEMA)
    assert corpus_pipeline.identify_language(spark, docs, sf).count() == 2


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
