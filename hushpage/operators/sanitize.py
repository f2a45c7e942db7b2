"""Redaction of page elements: which are sensitive, and what is left of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hushpage.functions.classify import is_password_element, is_sensitive_type
from hushpage.functions.geometry import Box, covers, is_valid_box
from hushpage.functions.text import js_trim
from hushpage.operators.spatial import BOX, overlapping

KEY = ["snapshot_id", "ord"]


@dataclass(frozen=True)
class SanitizeOptions:
    token: str = "[REDACTED]"
    strip_value: bool = False


def id_matches(elements: DataFrame, detections: DataFrame) -> DataFrame:
    """Keys of elements that a sensitive detection names: {id}, det_{id}, det_{id}_{type} or {id}_{type}.

    An element is looked up under two keys and a detection under two of its own, so this is an equi-join.
    """
    named = elements.where(F.length(js_trim(F.col("id"))) > 0)
    mine = named.select(*KEY, F.explode(F.array("id", F.concat(F.lit("det_"), "id"))).alias("name"))
    seen = detections.where(is_sensitive_type(F.col("type")) & F.col("id").isNotNull())
    tail = F.concat(F.lit("_"), F.col("type"))
    stem = F.when(F.endswith("id", tail), F.expr("left(id, length(id) - length(type) - 1)"))
    theirs = seen.select("snapshot_id", F.explode(F.array(F.col("id"), stem)).alias("name")).where("name IS NOT NULL").distinct()
    return mine.join(theirs, ["snapshot_id", "name"], "left_semi").select(*KEY).distinct()


def spatial_matches(elements: DataFrame, detections: DataFrame) -> DataFrame:
    """Keys of elements other than containers that coincide with a sensitive detection of the same page."""
    container = (F.col("type") == "container") | F.lower("tag_name").isin("form", "nav") | (F.col("role") == "form")
    held = elements.where(~F.coalesce(container, F.lit(False)) & is_valid_box(Box.of()))
    seen = detections.where(is_sensitive_type(F.col("type")) & is_valid_box(Box.of()))
    pairs = overlapping(held.select(*KEY, *BOX), seen.select("snapshot_id", *BOX))  # nothing coincides without sharing some area
    return pairs.where(covers(Box.of("b."), Box.of("a."), shared=F.col("shared"))).select(*[F.col(f"a.{c}") for c in KEY]).distinct()


def mark_sensitive(elements: DataFrame, detections: DataFrame) -> DataFrame:
    """Adds is_sensitive: by the element's own metadata, or by a detection through its id or its place."""
    own = is_password_element() | F.coalesce("sensitive", F.lit(False)) | F.lower(F.coalesce("input_type", F.lit(""))).isin("password", "email", "tel")
    found = id_matches(elements, detections).union(spatial_matches(elements, detections)).distinct().withColumn("matched", F.lit(True))
    marked = elements.join(found, KEY, "left")
    return marked.withColumn("is_sensitive", F.coalesce(own, F.lit(True)) | F.coalesce("matched", F.lit(False))).drop("matched")


def _clean_value(o: SanitizeOptions) -> Column:
    token = F.lit(None).cast("string") if o.strip_value else F.lit(o.token)
    secret = F.when(F.col("has_value"), token)  # a password's value is never read
    return F.when(is_password_element(), secret).when(
        F.col("has_value") & F.col("value").isNotNull(), F.when(F.col("is_sensitive"), token).otherwise(F.col("value"))
    )


def sanitize_elements(elements: DataFrame, detections: DataFrame, options: SanitizeOptions = SanitizeOptions()) -> DataFrame:
    """Elements with text and value replaced where they are sensitive; labels, placeholders and ids stay.

    Elements without an id are dropped, as nothing could refer to them. Whatever cannot be decided counts as sensitive.
    """
    marked = mark_sensitive(elements.where("id IS NOT NULL"), detections)
    text = F.when(F.col("is_sensitive") & F.col("text").isNotNull(), F.lit(options.token)).otherwise(F.col("text"))
    return marked.withColumn("clean_value", _clean_value(options)).select(
        *KEY, "id", "type", "tag_name", "role", text.alias("text"), "aria_label", "placeholder",
        F.col("clean_value").alias("value"), "input_type", "x", "y", "width", "height", "visible", "enabled",
        F.col("is_sensitive").alias("sensitive"),
    )


#: What a sanitiser gives.
CLEAN = (
    "ord int, id string, type string, tag_name string, role string, text string, aria_label string, placeholder string, value string, input_type string, "
    "x double, y double, width double, height double, visible boolean, enabled boolean, sensitive boolean"
)


#: Pages whose rows a worker holds as one frame.
PAGES = 512


def each_page(cleaner: Callable[[pd.DataFrame, pd.DataFrame, SanitizeOptions], pd.DataFrame]) -> Callable[[DataFrame, DataFrame, SanitizeOptions], DataFrame]:
    """A sanitiser from a function of one page's elements and detections, a row each, to its sanitised elements.

    ``failed`` names the class of what the function raised: such a page has one row with nothing else. Other pages are not touched by that.
    Pages come many to a batch, as a group, or a frame built from nothing, for each costs more than most pages' work.
    """

    names = [f.split()[0] for f in CLEAN.split(", ")]

    def run(elements: DataFrame, detections: DataFrame, options: SanitizeOptions) -> DataFrame:
        key = elements.schema["snapshot_id"].dataType
        schema = f"snapshot_id {key.simpleString()}, {CLEAN}, failed string"
        arrow = to_arrow_schema(StructType.fromDDL(schema))
        plain = [f for f in arrow if f.name in ("snapshot_id", *names)]

        def frames_of(arrays: pa.ListArray) -> Iterator[pd.DataFrame]:
            """A frame for each page, cut from one of all pages of the run; whole numbers and flags have their own type where the page has no null."""
            flat = arrays.flatten()
            table = pa.Table.from_arrays(flat.flatten(), names=[f.name for f in flat.type])
            rows, start = table.to_pandas(), 0
            mixed = {f.name: f.type.to_pandas_dtype() for f in table.schema if (pa.types.is_boolean(f.type) or pa.types.is_integer(f.type)) and table[f.name].null_count}
            for n in arrays.value_lengths().fill_null(0).to_pylist():
                page, start = rows.iloc[start : start + n].reset_index(drop=True), start + n
                whole = {c: kind for c, kind in mixed.items() if page[c].notna().all()}
                yield page.astype(whole) if whole else page

        def sent(frame: pd.DataFrame) -> pa.RecordBatch:
            out = frame.reindex(columns=["snapshot_id", *names])
            arrays = [pa.array(out[f.name].astype(object), f.type, from_pandas=True, safe=False) for f in plain]
            return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(out), pa.string())], schema=arrow)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, PAGES):
                    part = batch.slice(first, PAGES)
                    done, failed = [], []
                    for page, rows, seen in zip(part.column(0).to_pylist(), frames_of(part.column(1)), frames_of(part.column(2)), strict=True):
                        try:
                            done.append(cleaner(rows, seen, options).assign(snapshot_id=page))
                        except Exception as error:  # this page's failure; the others go on
                            failed.append((page, type(error).__name__))
                    try:
                        if done:
                            yield sent(pd.concat(done, ignore_index=True))
                    except Exception:  # what does not fit is the failure of a page or two: each by itself
                        for frame in done:
                            try:
                                yield sent(frame)
                            except Exception as error:
                                failed.append((frame["snapshot_id"].iloc[0], type(error).__name__))
                    if failed:
                        yield pa.RecordBatch.from_pylist([{"snapshot_id": page, "failed": name} for page, name in failed], schema=arrow)

        def held(side: DataFrame, name: str) -> DataFrame:
            return side.groupBy("snapshot_id").agg(F.collect_list(F.struct(*[F.col(c) for c in side.columns])).alias(name))

        mine, theirs = held(elements, "mine"), held(detections, "theirs").withColumnRenamed("snapshot_id", "of")
        both = mine.join(theirs, F.col("snapshot_id").eqNullSafe(F.col("of")), "left")
        none = F.array().cast(theirs.schema["theirs"].dataType)
        return both.select("snapshot_id", "mine", F.coalesce("theirs", none).alias("theirs")).mapInArrow(clean, schema)

    return run
