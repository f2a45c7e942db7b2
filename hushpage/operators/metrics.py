"""Evaluation: precision and recall of detections, success of tasks, rows by stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 6)


def precision_recall(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """By type: tp, fp, fn, precision, recall and f1 of rows (snapshot_id, id, type); ratios of nothing are null."""
    keys = ["snapshot_id", "id", "type"]
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(True))
    t = truth.select(*keys).distinct().withColumn("t", F.lit(True))
    both = p.join(t, keys, "full_outer")
    tp, fp, fn = F.count_if(F.col("p") & F.col("t")), F.count_if(F.col("p") & F.col("t").isNull()), F.count_if(F.col("t") & F.col("p").isNull())
    sums = both.groupBy("type").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return sums.select(
        "*", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def success_rate(results: DataFrame, by: str) -> DataFrame:
    """Rows and share of successes of results (status) by a column."""
    ok = F.col("status") == "success"
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok.cast("int")), 6).alias("success"))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows of each named stage."""
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("stage"), "rows") for n, d in stages.items()])
