"""Detection of personal data: rules over recognised text and over form fields, and the merging of detectors.

Detections are rows (snapshot_id, ord, id, type, x, y, width, height, confidence, sources, text); rule
detections never carry text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hushpage.functions import classify
from hushpage.functions.text import is_email, is_phone
from hushpage.operators.hold import hold as keep

COLUMNS = ["snapshot_id", "ord", "id", "type", "x", "y", "width", "height", "confidence", "sources", "text"]


class Detector(Protocol):
    """A named plug-in: page elements in, detections out."""

    name: str

    def detect(self, elements: DataFrame) -> DataFrame: ...


def text_detections(texts: DataFrame) -> DataFrame:
    """E-mail addresses and else phone numbers in recognised text; the given confidence or 0.95 / 0.90."""
    kind = F.when(is_email(F.col("text")), "email").when(is_phone(F.col("text")), "phone")
    default = F.when(F.col("type") == "email", 0.95).otherwise(0.90)
    found = texts.withColumn("type", kind).where("type IS NOT NULL").withColumn("confidence", F.coalesce("confidence", default))
    return found.withColumns({"sources": F.array(F.lit("regex")), "text": F.lit(None).cast("string")}).select(COLUMNS)


def password_detections(elements: DataFrame) -> DataFrame:
    """Password fields by their metadata, visible or not."""
    found = elements.where(classify.is_password_element())
    return found.withColumns(
        {"type": F.lit("password"), "confidence": F.lit(1.0), "sources": F.array(F.lit("dom")), "text": F.lit(None).cast("string")}
    ).select(COLUMNS)


def detect_pii(texts: DataFrame, elements: DataFrame) -> DataFrame:
    """Password fields, then text detections; ``group_no`` keeps that order."""
    first = password_detections(elements).withColumn("group_no", F.lit(0))
    return first.unionByName(text_detections(texts).withColumn("group_no", F.lit(1)))


def dom_detections(elements: DataFrame) -> DataFrame:
    """The strongest signal of every visible element with a size, as id det_{id}_{type}."""
    seen = elements.where("visible IS DISTINCT FROM FALSE AND width > 0 AND height > 0")
    found = seen.withColumn("signal", classify.element_signal()).where("signal IS NOT NULL")
    return found.withColumns(
        {
            "type": F.col("signal.type"),
            "confidence": F.col("signal.confidence"),
            "id": F.concat(F.lit("det_"), F.coalesce("id", F.lit("")), F.lit("_"), F.col("signal.type")),
            "sources": F.array(F.lit("dom")),
            "text": F.lit(None).cast("string"),
        }
    ).select(COLUMNS)


def run_detectors(elements: DataFrame, detectors: list[Callable[[DataFrame], DataFrame]], on_error=None) -> DataFrame:
    """All detectors' rows in order of the list (``group_no``); one that fails while its plan is built is skipped."""
    parts = []
    for i, detector in enumerate(detectors):
        try:
            parts.append(detector(elements).select(COLUMNS).withColumn("group_no", F.lit(i)))
        except Exception as error:  # isolation is the contract: other detectors must still run
            if on_error is not None:
                on_error(i, error)
    if not parts:
        return dom_detections(elements.limit(0)).withColumn("group_no", F.lit(0))
    return reduce(DataFrame.unionByName, parts)


#: What a row's detector is given of each element, where the table has it.
SEEN = ("snapshot_id", "ord", "id", "type", "tag_name", "role", "text", "aria_label", "placeholder", "input_type", "autocomplete", "name", "x", "y", "width", "height", "visible", "enabled", "sensitive")


@dataclass(frozen=True)
class RowDetector:
    """A detector from a Python function of one element (a dict of SEEN; values are never in it) to dicts of type, confidence, sources and
    whatever else differs from the element: id, box, text.

    What the function raises on a row is that row's error; its other rows, and other detectors, go on.
    """

    name: str
    one: Callable[[dict], Iterable[dict] | None]

    def __call__(self, elements: DataFrame) -> DataFrame:
        return self.detect(elements)

    def detect(self, elements: DataFrame) -> DataFrame:
        """Detections (COLUMNS) and errors: a row with ``error``, the class of what was raised, has no type."""
        given = [c for c in SEEN if c in elements.columns]
        rows = elements.select(*given)
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"confidence": "double", "sources": "array<string>", "error": "string"} | {"type": "string", "id": "string", "text": "string"}
        schema = ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in (*COLUMNS, "error"))
        arrow = to_arrow_schema(StructType.fromDDL(schema))
        one = self.one

        def found(element: dict) -> list[dict]:
            base = {c: element.get(c) for c in ("snapshot_id", "ord", "id", "x", "y", "width", "height")}
            try:
                out = [base | d for d in one(dict(element)) or ()]
                pa.Table.from_pylist(out, schema=arrow)  # what does not fit is this row's error, too
                if any(d.get("type") is None for d in out):
                    raise ValueError("a detection without a type")
                return out
            except Exception as error:  # this row's failure; the others go on
                return [{"snapshot_id": element["snapshot_id"], "ord": element["ord"], "error": type(error).__name__}]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                out = [d for element in batch.to_pylist() for d in found(element)]
                yield from pa.Table.from_pylist(out, schema=arrow).to_batches()

        return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class DetectorRun:
    """detections: COLUMNS and group_no. errors: (snapshot_id, ord, group_no, error), without a page where a detector failed as a whole."""

    detections: DataFrame
    errors: DataFrame


def run_isolated(elements: DataFrame, detectors: list[Callable[[DataFrame], DataFrame]], hold: Callable[[DataFrame], DataFrame] = keep) -> DetectorRun:
    """All detectors' rows in order of the list, and what failed.

    A RowDetector loses only rows that it fails on. Another one that fails while its plan is built is one error. ``hold`` keeps the rows, so that
    detectors run once for both results.
    """
    key = ", ".join(f"{c} {elements.schema[c].dataType.simpleString()}" for c in ("snapshot_id", "ord"))
    parts, failed = [], []
    for i, detector in enumerate(detectors):
        try:
            rows = detector(elements)
            error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string").alias("error")
            parts.append(rows.select(*COLUMNS, error).withColumn("group_no", F.lit(i)))
        except Exception as error:  # isolation is the contract: other detectors must still run
            failed.append((None, None, i, type(error).__name__))
    whole = elements.sparkSession.createDataFrame(failed, f"{key}, group_no int, error string")
    if not parts:
        return DetectorRun(dom_detections(elements.limit(0)).withColumn("group_no", F.lit(0)), whole)
    rows = hold(reduce(DataFrame.unionByName, parts))
    return DetectorRun(rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("snapshot_id", "ord", "group_no", "error").union(whole))


def deduplicate(detections: DataFrame) -> DataFrame:
    """One row for each exact box of a page: the kind of highest priority, earliest first on ties.

    Its id is that of the first row of the winning kind, its confidence the highest among them; sources are
    joined in order. One aggregation on (snapshot_id, box), without a fold.
    """
    turn = F.struct("group_no", "ord")
    at = detections.withColumn("turn", turn).withColumn("rank", classify.priority(F.col("type")))
    late = F.struct(F.col("rank"), -F.col("group_no"), -F.col("ord"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "type", "id", "confidence", "sources")))
    merged = at.groupBy("snapshot_id", "x", "y", "width", "height").agg(F.max_by("type", late).alias("type"), rows.alias("rows"))
    own = F.filter("rows", lambda r: r["type"] == F.col("type"))
    return merged.select(
        "snapshot_id",
        F.col("rows")[0]["turn"]["group_no"].alias("group_no"),
        F.col("rows")[0]["turn"]["ord"].alias("ord"),
        own[0]["id"].alias("id"),
        "type", "x", "y", "width", "height",
        F.array_max(F.transform(own, lambda r: r["confidence"])).alias("confidence"),
        F.array_distinct(F.flatten(F.transform("rows", lambda r: r["sources"]))).alias("sources"),
    )
