"""From what a page scan finds to the elements that detection, redaction and verification take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushpage.functions import elements as E
from hushpage.operators.ids import element_ids

#: Height of a line and width of a character in the stand-in layout.
LINE, GLYPH = 20.0, 8.0


def elements_of_scan(found: DataFrame) -> DataFrame:
    """Elements (snapshot_id, ord, id, type, ..., x, y, width, height) of the rows that sources.pages.scan_html gives.

    Raw HTML has no layout, so each kept element gets a line of its own, as wide as its text and at least one glyph: boxes that are
    valid and do not overlap. Values are never read. Elements of no kept kind are dropped. ``visible`` counts hidden ancestors and
    styles; ``paint``, ``readonly`` and ``contenteditable`` are for dry runs.
    """
    kind = E.element_type(F.col("tag_name"), F.col("role"), F.col("raw_type"), F.col("has_href"))
    rows = found.withColumn("type", kind).where("type IS NOT NULL")
    rows = rows.withColumn("label", E.element_text(F.col("type"), F.col("content"), F.col("alt")))
    on = E.is_enabled(*[F.col(c) for c in ("aria_disabled", "disabled", "fieldset_disabled", "in_first_legend")])
    made = rows.join(element_ids(rows), ["snapshot_id", "ord"])
    width = F.greatest(F.length(F.coalesce("label", F.lit(""))), F.lit(1)) * GLYPH
    seen = E.is_visible(*[F.col(c) for c in ("hidden", "display", "visibility", "opacity")], width, F.lit(LINE))
    return made.select(
        "snapshot_id", "ord", "id", "type", "tag_name", E.element_role(F.col("role"), F.col("tag_name")).alias("role"), F.col("label").alias("text"),
        E.trimmed_label(F.col("raw_aria")).alias("aria_label"), E.trimmed_label(F.col("raw_placeholder")).alias("placeholder"),
        F.lit(None).cast("string").alias("value"), F.lit(False).alias("has_value"), E.effective_input_type(F.col("tag_name"), F.col("raw_type")).alias("input_type"),
        "autocomplete", F.col("raw_name").alias("name"), F.lit(0.0).alias("x"), (F.col("ord") * LINE).alias("y"),
        width.alias("width"), F.lit(LINE).alias("height"), seen.alias("visible"), on.alias("enabled"),
        E.is_sensitive_element(F.col("raw_type"), F.col("raw_name"), F.col("autocomplete"), F.col("dom_id")).alias("sensitive"),
        "paint", "readonly", "contenteditable",
    )
