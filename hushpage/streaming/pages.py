"""The batch transforms on streams of pages.

Row-wise rules run unchanged on ``readStream``; what works page by page runs in ``foreachBatch``, where a page
arrives whole. Nothing here keeps state between batches; pages whose parts come apart go through streaming.gate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hushpage.operators import detect, guard, sanitize
from hushpage.operators.fuse import FuseOptions, fuse_detections
from hushpage.operators.requests import split_requests


def read_element_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """Element rows from parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def detect_stream(elements: DataFrame) -> DataFrame:
    """Form-field detections of a stream of elements."""
    return detect.dom_detections(elements)


def write_by_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies a page-wise transform to each micro-batch and writes it, numbered, so that a replayed batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sanitize_batch(elements: DataFrame, pages: DataFrame | None = None, screens: DataFrame | None = None) -> DataFrame:
    """Sanitised elements of those of the batch's pages that pass all phases of the guard, over detections of the batch's own.

    pages (snapshot_id, url, title, has_elements) and screens (snapshot_id, data, width, height) come from where the stream has
    them; a page without its row or its screenshot does not pass, so without them nothing does.
    """
    if pages is None or screens is None:
        return sanitize.sanitize_elements(elements, detect.dom_detections(elements)).limit(0)
    done = guard.sanitize(pages, screens, elements, detect.dom_detections(elements))
    return done.clean.join(done.contexts.select("snapshot_id"), "snapshot_id", "left_semi")


def fuse_batch(detections: DataFrame, options: FuseOptions = FuseOptions()) -> DataFrame:
    return fuse_detections(detections, options)


def ingest_requests(stream: DataFrame, accepted: str, refused: str, checkpoint: str) -> StreamingQuery:
    """Plan requests (column body): those that the closed schema accepts, and the rest with their codes."""

    def each(batch: DataFrame, number: int) -> None:
        good, bad = split_requests(batch)
        good.write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        bad.select("code", F.sha2("body", 256).alias("body_sha256")).write.mode("overwrite").parquet(f"{refused}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
