"""Reading page snapshots: JSON files of elements, raw HTML, dictionaries and screenshots."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushpage.sources.html_scan import scan

BOX = "struct<x: double, y: double, width: double, height: double>"
#: Inference would read geometry as integers and drop absent fields, so the schema is given.
SNAPSHOT_SCHEMA = f"""
elements array<struct<id: string, type: string, tagName: string, role: string, text: string, ariaLabel: string,
  placeholder: string, value: string, inputType: string, autocomplete: string, name: string, bbox: {BOX},
  visible: boolean, enabled: boolean, sensitive: boolean>>,
documentWidth double, documentHeight double
"""


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """JSON snapshots, one file a page, as element rows in order; ``source`` is the file."""
    return element_rows(spark.read.schema(SNAPSHOT_SCHEMA).json(path, multiLine=True).withColumn("source", F.col("_metadata.file_name")))


def element_rows(pages: DataFrame) -> DataFrame:
    """Element rows of pages in SNAPSHOT_SCHEMA with their ``source``."""
    rows = pages.select("source", "documentWidth", "documentHeight", F.posexplode("elements").alias("ord", "e"))
    return rows.select(
        "source", "ord", "documentWidth", "documentHeight",
        F.col("e.id"), F.col("e.type"), F.col("e.tagName").alias("tag_name"), F.col("e.role"), F.col("e.text"),
        F.col("e.ariaLabel").alias("aria_label"), F.col("e.placeholder"), F.col("e.value"), F.col("e.value").isNotNull().alias("has_value"),
        F.col("e.inputType").alias("input_type"), F.col("e.autocomplete"), F.col("e.name"),
        F.col("e.bbox.x"), F.col("e.bbox.y"), F.col("e.bbox.width"), F.col("e.bbox.height"),
        F.col("e.visible"), F.col("e.enabled"), F.col("e.sensitive"),
    )


def read_dictionary(spark: SparkSession, path: str) -> list[str]:
    """Lines of a recognition dictionary, in order; empty lines go, a lone space stays. It must not be empty."""
    lines = [x for x in spark.read.text(path, wholetext=True).first()[0].replace("\r\n", "\n").split("\n") if x]
    if not lines:
        raise ValueError("the dictionary has no entries")
    return lines


def read_screenshots(spark: SparkSession, path: str) -> DataFrame:
    """Image files as (path, content, sha256)."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))


def data_url_bytes(url: Column) -> Column:
    """The bytes of a base64 data URL, or null."""
    return F.when(url.startswith("data:"), F.try_to_binary(F.split_part(url, F.lit(","), F.lit(2)), F.lit("base64")))


_FIELDS = ("tag_name", "role", "raw_type", "dom_id", "raw_name", "autocomplete", "raw_aria", "raw_placeholder", "alt", "content")


#: Elements that a worker gathers before it sends them on, or those of one page.
ROWS = 4_096


def scan_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", strict: bool = False) -> DataFrame:
    """Candidate elements of raw HTML, in document order. Without layout there are no boxes; null pages have none.

    ``hidden`` is the element's own attribute; ``display``, ``visibility`` and ``opacity`` are those that come of its ancestors, too.
    ``paint`` is its place in paint order, null where no pointer can hit it. ``strict``: only character references with a semicolon are read.
    """
    names = [*_FIELDS, "has_href", "hidden", "disabled", "aria_disabled", "fieldset_disabled", "in_first_legend", "display", "visibility", "opacity", "readonly", "contenteditable", "paint"]
    kinds = [pa.string()] * 10 + [pa.bool_()] * 3 + [pa.string()] + [pa.bool_()] * 2 + [pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.int32()]
    types = {pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double", pa.int32(): "int"}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, order, rows = [], [], []
            for i, html in enumerate(batch.column(1)):
                found = scan(html.as_py(), strict)
                owner += [i] * len(found)
                order += range(len(found))
                rows += found
                if len(rows) >= ROWS or i + 1 == batch.num_rows:  # what a worker holds does not grow with the batch
                    columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(order, pa.int32()), *columns], names=["snapshot_id", "ord", *names])
                    owner, order, rows = [], [], []

    kind = pages.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{n} {types[k]}" for n, k in zip(names, kinds, strict=True))
    return pages.select(id_col, html_col).mapInArrow(parse, f"snapshot_id {kind}, ord int, {fields}")
