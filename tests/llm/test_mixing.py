"""Mixing: even buckets for low weights, null ids, and the join beyond the broadcast."""

from collections import Counter

from pyspark.sql import functions as F

from hushpage.llm import mixing
from hushpage.llm.mixing import id_or_text, mix_sources, mixing_plan, sampling_key


def test_buckets_are_even_for_any_weights(spark, monkeypatch):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.125).alias("w"))
    seen = []
    ahead = mixing._ahead
    monkeypatch.setattr(mixing, "_ahead", lambda units, value, name: (seen.append(units), ahead(units, value, name))[1])
    mixing_plan(docs, F.lit(7).cast("long"), F.col("w"), bucket_docs=200)
    sizes = [r["count"] for r in seen[0].groupBy("bucket").count().collect()]
    assert len(sizes) == 200 and max(sizes) < 320 and min(sizes) > 100


def test_null_ids_and_many_sources(spark, monkeypatch):
    rows = [(None if i % 2 else i, f"s{i % 3}" if i % 3 else None, f"text {i} " * 30, "x", 1) for i in range(400)] + [(None, "s1", None, "x", 1), (None, "s1", "", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, key string, rate int")
    size = mixing.word_count(F.col("text"))
    make = lambda: mix_sources(docs, size, mixing.quality_weight(F.col("text"), size), identity=id_or_text(F.col("doc_id"), F.col("text"))).collect()
    few = Counter(map(str, make()))
    got = make()
    assert len(got) == len(rows)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter(map(str, make())) == few


def test_targets_are_met_with_null_ids_only(spark):
    rows = [(None, "a", f"word{i} " * 60) for i in range(300)] + [(None, None, f"other{i} " * 60) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size = mixing.word_count(F.col("text"))
    got = mix_sources(docs, size, mixing.quality_weight(F.col("text"), size), identity=id_or_text(F.col("doc_id"), F.col("text")))
    for r in got.groupBy("target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 60


def test_keys_are_exponential(spark):
    keys = [r.k for r in spark.range(4000).select(sampling_key(F.col("id").cast("string"), F.lit(0.5)).alias("k")).collect()]
    assert 1.85 < sum(keys) / len(keys) < 2.15 and min(keys) > 0
