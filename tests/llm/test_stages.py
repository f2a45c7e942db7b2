"""Pipeline stages with extra columns, nulls and repeated rows, and with an empty table in the chain."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_operators import WORDS

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, row string, block int, size int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with labels for the toxicity stage."""
    path = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows():
    r = random.Random(3)
    text = lambda i: " ".join(r.choice(WORDS) + r.choice("abc") for _ in range(r.randrange(0, 60))) + (" awful nasty" if i % 5 == 0 else "")
    out = [(i, text(i), "en", r.choice(["a", None]), 1, 7, "r", 3, 4) for i in range(200)]
    return out + [(None, None, None, None, None, None, None, None, None), (None, "", "x", "a", 0, 0, "", 0, 0)] + out[:5]


def test_stages_keep_extra_columns(spark, folder):
    docs = spark.createDataFrame(rows(), EXTRA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.mode("overwrite").parquet(f"{folder}/{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == before.columns and 0 < docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_tables_stay_empty(spark, folder, name, stage):
    docs = spark.createDataFrame([], EXTRA)
    assert stage(spark, docs, folder).count() == 0
