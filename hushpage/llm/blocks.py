"""Dealing rows into blocks, and the shared folder for checkpoints."""

from __future__ import annotations

import gc
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's ``spark.checkpoint.dir``; only in local mode, as in tests, set a folder where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="hushpage-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows with lineage cut by a reliable checkpoint, so that a lost executor costs one stage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_unused(spark: SparkSession, after: DataFrame | None = None) -> None:
    """Lets Spark delete the shuffles of jobs that are done, and those that led to a checkpoint ``after``.

    It does so once nothing refers to them: when a job has read the checkpoint and the driver's JVM has collected its
    garbage, which a small driver may not do for minutes while gigabytes pile up on the executors' disks.
    """
    if after is not None:
        after.count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame, rows_per_block: int = 16_384) -> int:
    """As many blocks as shuffle partitions, more if a block would exceed rows_per_block rows."""
    return max(partitions(docs.sparkSession), -(-docs.count() // rows_per_block), 1)


def range_cuts(docs: DataFrame, id_col: str, n: int, text_col: str | None = None, grain: int = 4_096) -> np.ndarray:
    """n - 1 approximate quantiles of an integer id, ascending: the lower ends of blocks 1 to n - 1.

    With a text column a row weighs as its text does, in units of ``grain`` bytes and one for the row. An id of more weight
    than a block stands there several times.
    """
    if n < 2:
        return np.zeros(0)
    probs = [i / n for i in range(1, n)]
    ids = F.col(id_col).cast("double").alias("x")
    if text_col:
        weight = F.coalesce(F.floor(F.octet_length(text_col) / grain), F.lit(0)) + 1
        rows = docs.where(F.col(id_col).isNotNull()).select(ids, F.explode(F.array_repeat(F.lit(1), weight.cast("int"))))
    else:
        rows = docs.select(ids)
    return np.asarray(rows.approxQuantile("x", probs, 1 / (8 * n)), dtype=np.float64)


def range_block(id_col: str, cuts: np.ndarray, null: float = -np.inf):
    """Column: the block of an integer id; monotone in the id, so equal ids share a block. Null ids count as ``null``."""
    cuts = np.unique(cuts)

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy(dtype=np.float64, na_value=null)
        return pd.Series(np.searchsorted(cuts, x, side="right").astype(np.int32))

    return block(F.col(id_col).cast("double"))


def spread_block(id_col: str, spread: Column, cuts: np.ndarray, nulls: int = 1) -> tuple[Column, np.ndarray]:
    """(Column: the block of an integer id, rank by block). Blocks of smaller rank hold smaller ids only.

    An id that several cuts name has blocks of one rank for its own, and null ids have the last ``nulls`` blocks, of the highest rank: rows
    are dealt to them by ``spread``.
    """
    last = len(cuts) + 1
    ranks = np.concatenate((np.arange(last), np.full(max(nulls, 1), last)))
    value, first, times = np.unique(cuts, return_index=True, return_counts=True)
    for at, n in zip(first[times > 2].tolist(), times[times > 2].tolist(), strict=True):
        ranks[at + 1 : at + n] = at + 1

    @F.pandas_udf("int")
    def block(ids: pd.Series, spread: pd.Series) -> pd.Series:
        x = ids.to_numpy(dtype=np.float64, na_value=np.nan)
        turn = spread.to_numpy(dtype=np.int64)
        low, high = np.searchsorted(cuts, x, side="left"), np.searchsorted(cuts, x, side="right")
        own = high - low - 1
        out = np.where(own > 1, low + 1 + turn % np.maximum(own, 1), high)
        return pd.Series(np.where(np.isnan(x), last + turn % max(nulls, 1), out).astype(np.int32))

    return block(F.col(id_col).cast("double"), F.pmod(spread, F.lit(1 << 30))), ranks
