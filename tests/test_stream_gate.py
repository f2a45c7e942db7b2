"""Pages whose parts arrive apart: the stream equals the batch, replays change nothing, what stays incomplete is blocked."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from hushpage.operators import guard
from hushpage.sources.png import data_url, decode_screenshots, encode
from hushpage.streaming import gate
from tests.test_gate import parts


def write(spark, rows, folder, n):
    spark.createDataFrame(rows, gate.PART).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")


def run(spark, folder, out, timeout=3_600_000):
    stream = spark.readStream.schema(gate.PART).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    gate.guard_stream(stream, str(out), f"{out}-state", timeout).awaitTermination(300)
    return {r.snapshot_id: r.code for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/verdicts").collect()}


def test_shuffled_and_replayed_parts_give_the_batch_verdicts(spark, tmp_path):
    pages, _, elements, found = parts(spark, range(6), texts=("plain", "note", "call hunter2"))
    pages = pages.withColumn("url", F.when(F.col("snapshot_id") == 2, "https://x.example?token=1").otherwise(F.col("url")))
    found = found.where("snapshot_id <> 4").unionAll(found.where("snapshot_id = 1").withColumns({"ord": F.lit(1), "type": F.lit("")}))
    elements = elements.where("ord < 2 OR snapshot_id = 3").withColumn("value", F.lit(None).cast("string"))
    shots = spark.createDataFrame([(p, data_url(encode(np.full((2, 3, 4), p, dtype=np.uint8))) if p != 5 else "data:image/png;base64,AAAA") for p in range(6)], "snapshot_id long, data_url string")
    done = guard.sanitize(pages, decode_screenshots(shots), elements, found)
    want = {r.snapshot_id: r.code for r in guard.verdicts(pages, done.violations).collect()}
    assert want == {0: None, 1: "INVALID_DETECTION_TYPE", 2: "LEAKED_METADATA", 3: "LEAKED_SECRET_IN_DOM", 4: None, 5: "INVALID_SCREENSHOT"}
    rows = [tuple(r) for r in gate.parts_of(pages, shots, elements, found).collect()]
    r = random.Random(3)
    r.shuffle(rows)
    for n in range(3):
        write(spark, rows[n::3] + r.sample(rows, 4), tmp_path / "in", n)
    assert run(spark, tmp_path / "in", tmp_path / "out") == want
    contexts = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out/contexts"))
    assert sorted(x.snapshot_id for x in contexts.collect()) == [0, 4]
    write(spark, r.sample(rows, 8), tmp_path / "in", 9)  # after the pages have left
    assert run(spark, tmp_path / "in", tmp_path / "out") == want
    assert spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out/verdicts")).count() == 6


def test_incomplete_pages_are_blocked_when_their_time_is_over(spark, tmp_path):
    pages, _, elements, found = parts(spark, range(3))
    shots = spark.createDataFrame([(p, data_url(encode(np.zeros((2, 2, 4), dtype=np.uint8)))) for p in range(3)], "snapshot_id long, data_url string")
    rows = [tuple(r) for r in gate.parts_of(pages, shots, elements, found).collect()]
    write(spark, [x for x in rows if x[0] == 0 or (x[0] == 1 and x[1] != "screen")] + [(None, "page", 0, "{}"), (1, None, 0, "x")], tmp_path / "in", 0)
    assert run(spark, tmp_path / "in", tmp_path / "out", 1) == {0: None}
    time.sleep(0.1)
    write(spark, [x for x in rows if x[0] == 2], tmp_path / "in", 1)
    got = run(spark, tmp_path / "in", tmp_path / "out", 1)
    write(spark, [x for x in rows if x[0] == 1], tmp_path / "in", 2)  # too late
    assert got | run(spark, tmp_path / "in", tmp_path / "out", 1) == {0: None, 1: guard.DEFAULT_CODE, 2: None}
    contexts = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out/contexts"))
    assert sorted(x.snapshot_id for x in contexts.collect()) == [0, 2]
