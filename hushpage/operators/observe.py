"""Observing a tab: what can fail, in the order in which it is tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushpage.functions.text import is_restricted_url


def observation_code(available: Column, tab_id: Column, url: Column, data_url: Column, answered: Column, state_given: Column) -> Column:
    """The code of the first step that fails, or null. What is not known counts as failed.

    available: the browser offers tabs at all; tab_id: the active tab; data_url: the captured viewport; answered: the page's script
    replied; state_given: with a state.
    """
    failed = lambda ok: ~F.coalesce(ok, F.lit(False))
    return (
        F.when(failed(available), "UNKNOWN_ERROR").when(tab_id.isNull(), "NO_ACTIVE_TAB")
        .when(F.coalesce(is_restricted_url(url), F.lit(True)), "RESTRICTED_URL").when(F.coalesce(data_url, F.lit("")) == "", "CAPTURE_FAILED")
        .when(failed(answered), "CONTENT_SCRIPT_UNAVAILABLE").when(failed(state_given), "DOM_EXTRACTION_FAILED")
    )


def observe_tabs(tabs: DataFrame) -> DataFrame:
    """Adds success, code, width, height and ratio to tabs (available, tab_id, url, data_url, answered, state_given, tab_width, tab_height,
    viewport: struct of width, height, devicePixelRatio).

    Sizes are the viewport's, else the tab's, else 0, the ratio 1 where none is given; all null if the observation failed.
    """
    code = observation_code(*[F.col(c) for c in ("available", "tab_id", "url", "data_url", "answered", "state_given")])
    seen = tabs.withColumn("code", code)
    size = lambda side: F.when(F.col("code").isNull(), F.coalesce(F.nullif(F.col(f"viewport.{side}"), F.lit(0.0)), F.nullif(F.col(f"tab_{side}"), F.lit(0.0)), F.lit(0.0)))
    ratio = F.when(F.col("code").isNull(), F.coalesce("viewport.devicePixelRatio", F.lit(1.0)))
    return seen.withColumns({"success": F.col("code").isNull(), "width": size("width"), "height": size("height"), "ratio": ratio})
