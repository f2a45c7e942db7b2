"""Corpus pipeline: five stages, each working on what its predecessor kept.

Toxic documents go, one document of each group of near duplicates stays, passages that repeat across documents go,
sources are mixed to target weights, and what the mix takes is packed into sequences of tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushpage.llm.blocks import cut
from hushpage.llm.jaccard_join import keep_one_of_each
from hushpage.llm.mixing import mixed_documents
from hushpage.llm.packing import pack_documents
from hushpage.llm.substrings import remove_repeats
from hushpage.llm.toxicity import without_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.7 or more.

    Null texts count as empty and stay unless most labelled documents are toxic; repeated rows share their score. All columns stay; an
    empty table stays empty.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group linked by five-word shingles at a similarity of 0.8.

    Null and empty texts and null ids are in no group and stay; rows that share an id stay or go together. All columns
    stay; an empty table stays empty.
    """
    return keep_one_of_each(docs, k=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words covered by 13-word windows that also start in a document of smaller id; every document stays.

    Null texts stay null, and rows of one id or of null ids do not remove from each other; an empty table stays empty. All
    columns stay; n_chars, where there is one, follows the text.
    """
    kept = remove_repeats(docs, k=13, report=False)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents to the sources' target weights, a row for each copy.

    Null sources form one source, listed last; documents without words belong to complete epochs only. Ties in keys are broken by
    id and size. All columns stay; an empty table stays empty.
    """
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of at most 4096 tokens.

    A null text is its end token alone; repeated rows are packed each, and null ids pass through. Columns other than doc_id
    and text are not returned; an empty table gives no rows.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: Tokenizer ids and learnt scores are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; lineage is cut after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
