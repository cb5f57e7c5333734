"""Empty tables and odd rows through every query of the subpackage, and the pipeline's stages on rows of their own."""

import random

import pytest

import corpus_pipeline
from axonframe.llm.interleave import sharded_documents
from axonframe.llm.queries import QUERIES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, docs, pages, vectors):
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(0, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty") / "t", [], [], [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_take_effect_and_keep_clean_rows(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    base = text()
    docs = [(i, text(), "en", "s", 1) for i in range(30)] + [(100, base, "en", "s", 1), (101, base, "en", "s", 1), (102, base.replace(base.split()[60], "new"), "en", None, 1)]
    docs += [(200, text() + " one two three four five six seven eight nine ten eleven twelve " + text(), "en", "s", 1)]
    folder = tables(spark, tmp_path / "t", docs, [], [])
    stages = dict(corpus_pipeline.STAGES)
    df = spark.read.parquet(f"{folder}/documents.parquet")
    kept = stages["near_duplicates"](spark, df, folder)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(30), 100, 200]
    clean = stages["decontamination"](spark, kept, folder)
    assert sorted(r.doc_id for r in clean.collect()) == [*range(30), 100]
    mixed = stages["mixing"](spark, df, folder)
    assert mixed.columns == df.columns and {r.doc_id for r in mixed.collect()} <= {r[0] for r in docs}
    assert stages["sharding"](spark, mixed, folder).count() == mixed.count()


def test_rows_that_differ_only_in_which_column_is_null(spark):
    rows = [(1, "t", "en", None, 1, {"a": None}, ["x", None]), (1, "t", None, "en", 1, {"a": None}, ["x", None]), (1, "t", None, "en", 1, {"a": None}, [None, "x"]), (1, "t", None, "en", 1, {"b": None}, ["x", None]), (1, "t", None, "en", 1, None, ["x", None])]
    docs = spark.createDataFrame(rows + rows[:2], f"{DOCUMENTS}, m map<string,string>, l array<string>")
    got = sorted((str(tuple(r)[:7]) for r in sharded_documents(docs, 3).collect()))
    assert got == sorted(str(r) for r in rows + rows[:2])
