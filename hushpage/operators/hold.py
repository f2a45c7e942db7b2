"""Keeping what several branches of a plan read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def hold(rows: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: worked out once, and there for every task that a lost executor makes run again.

    The folder is the cluster's ``spark.checkpoint.dir``; only in local mode, as in tests, one is made where none is set.
    """
    sc = rows.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="hushpage-checkpoint-"))
    return rows.checkpoint(eager=True)
