"""Dry runs of page actions: what would happen on the page, without touching it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushpage.functions import actions as A
from hushpage.functions.text import is_restricted_url, js_trim

#: Inputs that take no text.
NOT_TEXT = ("button", "submit", "reset", "hidden", "image", "checkbox", "radio", "file")


def parse_actions(actions: DataFrame) -> DataFrame:
    """Adds valid and the fields of actions (action_id, snapshot_id, action_json)."""
    v = F.col("v")
    rows = actions.withColumn("v", A.parsed(F.col("action_json")))
    return rows.select(
        *actions.columns, A.client_valid(v).alias("valid"), A.text_at(v, "$.type").alias("action_type"),
        A.text_at(v, "$.target.elementId").alias("element_id"), A.number_at(v, "$.target.x").alias("at_x"), A.number_at(v, "$.target.y").alias("at_y"),
        A.text_at(v, "$.value").alias("value"), A.text_at(v, "$.url").alias("url"), A.text_at(v, "$.direction").alias("direction"), A.number_at(v, "$.amount").alias("amount"),
    )


def _targets(acts: DataFrame, elements: DataFrame) -> DataFrame:
    """The element each action names or points at: the first with that id, or the topmost under the point.

    Topmost is the highest ``paint``, where a page scan gives it, and elements without one cannot be pointed at; else the last in order.
    """
    missing = {"readonly": F.lit(False), "contenteditable": F.lit(None).cast("string")}
    elements = elements.withColumns({c: v for c, v in missing.items() if c not in elements.columns})
    seen = F.struct("ord", "tag_name", "input_type", "enabled", "visible", "options", "readonly", "contenteditable")
    depth = "paint" if "paint" in elements.columns else "ord"
    named = elements.groupBy("snapshot_id", F.col("id").alias("element_id")).agg(F.min_by(seen, "ord").alias("named"))
    out = acts.join(named, ["snapshot_id", "element_id"], "left")
    points = acts.where("element_id IS NULL AND at_x IS NOT NULL AND at_y IS NOT NULL").select("action_id", "snapshot_id", "at_x", "at_y")
    under = (F.col("p.snapshot_id") == F.col("e.snapshot_id")) & F.expr("p.at_x >= e.x AND p.at_x < e.x + e.width AND p.at_y >= e.y AND p.at_y < e.y + e.height")
    hits = points.alias("p").join(elements.where(F.col(depth).isNotNull()).alias("e"), under).groupBy("action_id").agg(F.max_by(seen, depth).alias("pointed"))
    out = out.join(hits, "action_id", "left").withColumn("t", F.coalesce("named", "pointed"))
    return out.drop("named", "pointed")


def simulate_actions(actions: DataFrame, elements: DataFrame, viewport: tuple[float, float] = (1280.0, 720.0)) -> DataFrame:
    """(action_id, status, action_type, error_code, delta) of a dry run; ``delta`` is how far down a scroll would go, negative for up.

    elements need id, ord, tag_name, input_type, enabled, visible, options and a box; readonly, contenteditable and paint count where they
    are given. Checks come in the order in which the page would make them, and the first that fails names the error.
    """
    out = _targets(parse_actions(actions), elements)
    t, kind = F.col("t"), F.col("action_type")
    placed = F.col("element_id").isNull()
    outside = placed & ((F.col("at_x") < 0) | (F.col("at_x") > viewport[0]) | (F.col("at_y") < 0) | (F.col("at_y") > viewport[1]))
    missing, barred, unseen = t.isNull(), ~t["enabled"], ~t["visible"]
    no, found = "TARGET_NOT_INTERACTABLE", "TARGET_NOT_FOUND"
    click = F.when(outside, no).when(missing, found).when(barred, no).when(~placed & unseen, no)
    tag, sort = F.lower(t["tag_name"]), F.lower(F.coalesce(F.nullif(t["input_type"], F.lit("")), F.lit("text")))
    editable = (tag == "textarea") | ((tag == "input") & ~sort.isin(*NOT_TEXT)) | F.coalesce(F.lower(t["contenteditable"]) == "true", F.lit(False))
    fixed = F.coalesce(t["readonly"], F.lit(False))
    typing = F.when(missing & placed, no).when(missing, found).when(~editable, no).when(barred | fixed, no).when(unseen, no)
    offered = F.exists(t["options"], lambda o: (o == F.col("value")) | (js_trim(o) == js_trim(F.col("value"))))
    choosing = F.when(missing, found).when(tag != "select", no).when(barred, no).when(~F.coalesce(offered, F.lit(False)), no)
    going = F.when(is_restricted_url(F.col("url")), "NAVIGATION_BLOCKED")
    code = (
        F.when(~F.col("valid"), "INVALID_ACTION").when(kind == "click", click).when(kind == "type", typing)
        .when(kind == "select", choosing).when(kind == "navigate", going)
    )
    shown = F.when(F.col("valid"), kind).otherwise(F.lit("unknown"))
    far = F.when(code.isNull() & (kind == "scroll"), F.when(F.col("direction") == "down", F.col("amount")).otherwise(-F.col("amount")))
    status = F.when(code.isNull(), "success").otherwise("failure")
    return out.select("action_id", status.alias("status"), shown.alias("action_type"), code.alias("error_code"), far.alias("delta"))
