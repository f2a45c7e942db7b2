"""Fail-closed verification: violations are rows (snapshot_id, phase, ord, code) that carry codes and never content.

A page passes only without violations; its verdict is the first code in order of phase and position. Phases: 0 screenshot,
1 page elements, 2 detections, 3 metadata, 4 redaction, 5 sanitising, 6 masked pixels, 7 structure of the sanitised page,
8 values, 9 secrets. ``sanitize`` runs them all. Silence is no pass: each phase that speaks for whole pages answers for every page,
with a null code where it finds nothing, and a page that one of them does not answer for is blocked.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushpage.operators import redact
from hushpage.operators.hold import hold as keep
from hushpage.operators.sanitize import SanitizeOptions, sanitize_elements

from hushpage.functions.classify import is_password_element, is_sensitive_type
from hushpage.functions.geometry import Box, is_valid_box
from hushpage.functions.text import leaks_metadata

_log = logging.getLogger(__name__)
#: The code of a violation that names none.
DEFAULT_CODE = "PRIVACY_GUARD_VERIFICATION_FAILURE"
#: Phases that answer for whole pages; 8 and 9 speak of single elements, all of which phase 7 has counted.
ANSWERING = (0, 1, 2, 3, 4, 5, 6, 7)


def _violation(phase: int, order: Column, code: Column | str) -> list[Column]:
    return [F.col("snapshot_id"), F.lit(phase).alias("phase"), order.cast("long").alias("ord"), (F.lit(code) if isinstance(code, str) else code).alias("code")]


def input_violations(screens: DataFrame, detections: DataFrame, pages: DataFrame) -> DataFrame:
    """What input_answers finds."""
    return input_answers(screens, detections, pages).where("code IS NOT NULL")


def input_answers(screens: DataFrame, detections: DataFrame, pages: DataFrame) -> DataFrame:
    """Phases 0 to 3, code null where nothing is wrong: checks of screenshots (has_data, width, height, data_length), detections and page metadata (url, title, has_elements).

    A page whose detections are no list at all has has_detections false; without that column all have lists. A detection without any
    field is malformed.
    """
    sized = F.col("width").isNotNull() & F.col("height").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0)
    image = (
        F.when(~F.coalesce("has_data", F.lit(False)), "INVALID_SCREENSHOT")
        .when(~sized, "INVALID_SCREENSHOT_DIMENSIONS")
        .when(~F.coalesce(F.col("data_length") == F.col("width") * F.col("height") * 4, F.lit(False)), "CORRUPTED_SCREENSHOT_BUFFER")
    )
    nothing = F.coalesce(F.col("id"), F.col("type"), *[F.col(c).cast("string") for c in ("x", "y", "width", "height")]).isNull()
    typed = F.when(nothing, "INVALID_DETECTION").when(F.coalesce("type", F.lit("")) == "", "INVALID_DETECTION_TYPE").when(~is_valid_box(Box.of()), "INVALID_DETECTION_GEOMETRY")
    found = screens.select(_violation(0, F.lit(0), image))
    found = found.union(pages.select(_violation(1, F.lit(0), F.when(~F.coalesce("has_elements", F.lit(False)), "INVALID_DOM_SNAPSHOT"))))
    listed = F.coalesce("has_detections", F.lit(False)) if "has_detections" in pages.columns else F.lit(True)
    found = found.union(pages.select(_violation(2, F.lit(-1), F.when(~listed, "INVALID_DETECTIONS"))))
    found = found.union(detections.select(_violation(2, F.col("ord"), typed)).where("code IS NOT NULL"))
    return found.union(pages.select(_violation(3, F.lit(0), F.when(leaks_metadata(F.col("url"), F.col("title")), "LEAKED_METADATA"))))


def value_leaks(raw: DataFrame, clean: DataFrame, token: str = "[REDACTED]") -> DataFrame:
    """Sanitised password or sensitive elements whose value is not the token; an unknown flag counts as sensitive. Of raw elements that share an
    id the last counts."""
    last = raw.where("coalesce(id, '') <> ''").withColumn("is_password", is_password_element())
    last = last.groupBy("snapshot_id", "id").agg(F.max_by("is_password", "ord").alias("raw_password"))
    rows = clean.withColumn("own_password", is_password_element()).join(last, ["snapshot_id", "id"], "left")
    shown = F.col("value").isNotNull() & (F.col("value") != token)
    code = F.when(F.coalesce("raw_password", "own_password") & shown, "PASSWORD_VALUE_LEAKAGE").when(F.coalesce("sensitive", F.lit(True)) & shown, "SENSITIVE_VALUE_LEAKAGE")
    return rows.select(_violation(8, F.col("ord"), code)).where("code IS NOT NULL")


def secret_leaks(clean: DataFrame, detections: DataFrame, chunk: int = 4_096) -> DataFrame:
    """Sanitised elements whose value or text contains the text of a sensitive detection of the page.

    A page's secrets become one automaton (Aho and Corasick) that reads each text once, however many secrets there are. Its elements
    come in chunks of positions, so that no page has to be one row.
    """
    secrets = detections.where(is_sensitive_type(F.col("type")) & (F.length("text") > 0)).groupBy("snapshot_id").agg(F.collect_set("text").alias("secrets"))
    texts = clean.where("value IS NOT NULL OR text IS NOT NULL").groupBy("snapshot_id", F.floor(F.col("ord") / chunk).alias("chunk"))
    texts = texts.agg(F.collect_list("ord").alias("ords"), F.collect_list(F.coalesce("value", F.lit(""))).alias("held"), F.collect_list(F.coalesce("text", F.lit(""))).alias("shown"))
    kind = clean.schema["snapshot_id"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            owner, at = [], []
            for i, (secrets, ords, held, shown) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                leaks = containment(secrets)
                hits = [o for o, a, b in zip(ords, held, shown, strict=True) if leaks(a) or leaks(b)]
                owner += [i] * len(hits)
                at += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(at, pa.int64())], names=["snapshot_id", "ord"])

    both = texts.join(secrets, "snapshot_id").select("snapshot_id", "secrets", F.col("ords").cast("array<long>"), "held", "shown")
    found = both.mapInArrow(scan, f"snapshot_id {kind}, ord long")
    return found.select(_violation(9, F.col("ord"), "LEAKED_SECRET_IN_DOM"))


def containment(secrets: list[str]) -> Callable[[str], bool]:
    """A function that tells whether a text contains one of the secrets."""
    if len(secrets) < 8:  # too few to be worth an automaton
        return lambda text: any(s in text for s in secrets)
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for secret in secrets:
        automaton.add_word(secret)
    automaton.make_automaton()
    return lambda text: next(automaton.iter(text), None) is not None


def screenshot_answers(images: DataFrame, masked: DataFrame, verified: bool = True) -> DataFrame:
    """Phases 4 and 6 for each of ``images`` (snapshot_id, data, width, height, regions).

    masked: (snapshot_id, data, error) of a redactor, with ``code`` if its own check of the pixels counts (``verified``); else
    the masked pixels are checked here. A page without exactly one masked screenshot fails phase 6 whatever the redactor says.
    """
    if not (verified and "code" in masked.columns):
        held = masked.select("snapshot_id", F.col("data").alias("masked"), "error")
        both = images.join(held, "snapshot_id", "left")
        codes = redact.verify_masks(both.withColumn("snapshot_id", F.struct("snapshot_id", "error", F.col("masked").isNotNull().alias("has"))))
        masked = codes.select("snapshot_id.*", "code").withColumn("data", F.when(F.col("has"), F.lit(1)))
    said = masked.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("error").alias("error"),
        F.max(F.when(F.col("data").isNull(), F.coalesce("code", F.lit("SCREENSHOT_VERIFICATION_FAILURE"))).otherwise(F.col("code"))).alias("code"),
    )
    failed = F.when(F.col("error").isNotNull(), "REDACTION_EXECUTION_FAILURE")
    unsure = F.when(F.coalesce("n", F.lit(0)) != 1, "SCREENSHOT_VERIFICATION_FAILURE").otherwise(F.col("code"))
    rows = images.select("snapshot_id").distinct().join(said, "snapshot_id", "left")
    both = F.array(F.struct(F.lit(4).alias("phase"), failed.alias("code")), F.struct(F.lit(6).alias("phase"), unsure.alias("code")))
    return rows.select("snapshot_id", F.explode(both).alias("a")).select("snapshot_id", "a.phase", F.lit(0).cast("long").alias("ord"), "a.code")


def structure_answers(ids: DataFrame, raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Phases 5 and 7 for each page of ``ids``: whether the sanitiser failed on it (``failed`` of ``clean``, where it has one), and whether its
    sanitised elements are exactly the raw ones that have an id, each as often, by snapshot_id and ord."""
    failed = F.col("failed") if "failed" in clean.columns else F.lit(None).cast("string")
    mine = raw.where("id IS NOT NULL").select("snapshot_id", "ord", F.lit(1).alias("n"), F.lit(None).cast("string").alias("failed"))
    theirs = clean.select("snapshot_id", "ord", F.lit(-1).alias("n"), failed.alias("failed"))
    keys = mine.union(theirs).groupBy("snapshot_id", "ord").agg(F.sum("n").alias("n"), F.max("failed").alias("failed"))
    said = keys.groupBy("snapshot_id").agg(F.max(F.col("n") != 0).alias("broken"), F.max("failed").alias("failed"))
    rows = ids.join(said, "snapshot_id", "left")
    ran = F.when(F.col("failed").isNotNull(), "DOM_SANITIZATION_EXECUTION_FAILURE")
    same = F.when(F.col("broken") | F.col("failed").isNotNull(), "DOM_VERIFICATION_FAILURE")
    both = F.array(F.struct(F.lit(5).alias("phase"), ran.alias("code")), F.struct(F.lit(7).alias("phase"), same.alias("code")))
    return rows.select("snapshot_id", F.explode(both).alias("a")).select("snapshot_id", "a.phase", F.lit(0).cast("long").alias("ord"), "a.code")


def complete(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Violations of all phases, and one for each page that an answering phase is silent on, that is given twice, or that has no id."""
    first = pages.select("snapshot_id", F.lit(-1).alias("phase"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast("string").alias("code"))
    said = answers.union(first).groupBy("snapshot_id").agg(
        F.collect_set(F.when(F.col("phase") >= 0, F.col("phase"))).alias("phases"), F.count_if(F.col("phase") == -1).alias("times"),
        F.collect_set(F.when(F.col("code").isNotNull(), F.struct("phase", "ord", "code"))).alias("found"),
    )
    silent = F.array_except(F.array(*[F.lit(p) for p in ANSWERING]), "phases")
    asked = F.transform(silent, lambda p: F.struct(p.alias("phase"), F.lit(0).cast("long").alias("ord"), F.lit(DEFAULT_CODE).alias("code")))
    unclear = F.when((F.col("times") != 1) | F.col("snapshot_id").isNull(), F.array(F.struct(F.lit(0).alias("phase"), F.lit(-1).cast("long").alias("ord"), F.lit(DEFAULT_CODE).alias("code"))))
    every = F.concat("found", asked, F.coalesce(unclear, F.array().cast("array<struct<phase:int,ord:bigint,code:string>>")))
    return said.where("times > 0").select("snapshot_id", F.explode(every).alias("v")).select("snapshot_id", "v.*")


@dataclass(frozen=True)
class GuardResult:
    """contexts: what may leave. violations: why the other pages may not. masked and clean: screenshots and elements of all pages, for
    inspection on the trusted side."""

    contexts: DataFrame
    violations: DataFrame
    masked: DataFrame
    clean: DataFrame


def sanitize(
    pages: DataFrame,
    screens: DataFrame,
    elements: DataFrame,
    detections: DataFrame,
    options: SanitizeOptions = SanitizeOptions(),
    mask: Callable[[DataFrame], DataFrame] = redact.redact_and_verify,
    clean_up: Callable[[DataFrame, DataFrame, SanitizeOptions], DataFrame] = sanitize_elements,
    hold: Callable[[DataFrame], DataFrame] = keep,
) -> GuardResult:
    """All phases over pages (snapshot_id, url, title, has_elements), screens (snapshot_id, data, width, height), elements and
    detections (with an array ``sources``).

    A page without a screenshot row counts as one without a screenshot. ``mask`` and ``clean_up`` can be replaced: redact.each_page and
    sanitize.each_page make them from functions of one page, and what these raise blocks that page alone. If one cannot be planned, or
    if its job fails, every page gets its failure code and none passes. A page that they leave out, or give twice, is blocked. ``hold``
    keeps what several phases read: elements, detections, sanitised elements and violations.
    """
    ids = pages.select("snapshot_id").distinct()
    elements, detections = (hold(rows.join(ids, "snapshot_id", "left_semi")) for rows in (elements, detections))  # nobody asks about other pages
    seen = ids.join(screens.select("snapshot_id", "data", "width", "height"), "snapshot_id", "left")
    shapes = seen.select("snapshot_id", F.col("data").isNotNull().alias("has_data"), "width", "height", F.length("data").alias("data_length"))
    boxes = detections.where(is_sensitive_type(F.col("type"))).groupBy("snapshot_id").agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("regions"))
    images = seen.join(boxes, "snapshot_id", "left")
    everyone = lambda phase, code: ids.select(_violation(phase, F.lit(0), code))
    parts = [input_answers(shapes, detections, pages)]
    try:
        masked = mask(images)
        parts.append(hold(screenshot_answers(images, masked, getattr(mask, "verified", False))))
    except (PySparkException, ValueError, TypeError) as error:
        _log.warning("no page passes, as the redactor failed: %s", type(error).__name__)
        masked = seen.select("snapshot_id", F.lit(None).cast("binary").alias("data"), F.lit(0).alias("redacted"), F.lit("FAILED").alias("error"), F.lit(None).cast("string").alias("code"))
        parts += [everyone(4, "REDACTION_EXECUTION_FAILURE"), everyone(6, "SCREENSHOT_VERIFICATION_FAILURE")]
    try:
        clean = hold(clean_up(elements, detections, options))
        parts.append(structure_answers(ids, elements, clean))
        if "failed" in clean.columns:
            clean = clean.where("failed IS NULL").drop("failed")
        parts += [value_leaks(elements, clean, options.token), secret_leaks(clean, detections)]
    except (PySparkException, ValueError, TypeError) as error:
        _log.warning("no page passes, as the sanitiser failed: %s", type(error).__name__)
        clean = sanitize_elements(elements.limit(0), detections, options)
        parts += [everyone(5, "DOM_SANITIZATION_EXECUTION_FAILURE"), everyone(7, "DOM_VERIFICATION_FAILURE")]
    found = hold(complete(pages, reduce(DataFrame.union, parts)))
    return GuardResult(contexts(pages, clean, detections, found), found, masked, clean)


def verdicts(pages: DataFrame, violations: DataFrame) -> DataFrame:
    """(snapshot_id, passed, code): the first violation of each page; pages without one pass."""
    first = violations.groupBy("snapshot_id").agg(F.coalesce(F.min_by("code", F.struct("phase", "ord", "code")), F.lit(DEFAULT_CODE)).alias("code"))
    code = F.when(F.col("snapshot_id").isNull(), DEFAULT_CODE).otherwise(F.col("code"))  # a page without an id never passes
    return pages.select("snapshot_id").distinct().join(first, "snapshot_id", "left").select("snapshot_id", code.isNull().alias("passed"), code.alias("code"))


def passing(rows: DataFrame, violations: DataFrame) -> DataFrame:
    """Rows of pages without violations: what may leave. Rows without a page stay."""
    return rows.where("snapshot_id IS NOT NULL").join(violations.select("snapshot_id").distinct(), "snapshot_id", "left_anti")


def privacy_statistics(detections: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    """Detections, sensitive ones and redacted regions of each page."""
    sensitive = is_sensitive_type(F.col("type"))
    return detections.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("total_detections"), F.count_if(sensitive).alias("sensitive_detections"), F.count_if(sensitive).alias("redacted_regions")
    )


def regions(detections: DataFrame) -> DataFrame:
    """Sensitive detections as regions to mask; confidence 1 and source fusion where none is given."""
    return detections.where(is_sensitive_type(F.col("type"))).select(
        "snapshot_id", "id", "type", "x", "y", "width", "height",
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("sources", F.array(F.lit("fusion"))).alias("sources"), F.lit("mask").alias("redaction"),
    )


def contexts(pages: DataFrame, clean: DataFrame, detections: DataFrame, violations: DataFrame) -> DataFrame:
    """One nested row a passing page: browser state with defaults, elements without values, regions, statistics."""
    safe = ["id", "type", "tag_name", "role", "text", "aria_label", "placeholder", "input_type", "x", "y", "width", "height", "visible", "enabled", "sensitive"]
    held = clean.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("ord", *safe))).alias("elements"))
    seen = regions(detections).groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("id", "type", "x", "y", "width", "height", "confidence", "sources", "redaction"))).alias("regions"))
    counts = privacy_statistics(detections)
    out = passing(pages, violations).join(held, "snapshot_id", "left").join(seen, "snapshot_id", "left").join(counts, "snapshot_id", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "snapshot_id", F.coalesce("url", F.lit("about:blank")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), "elements", "regions",
        *[F.coalesce(c, zero).alias(c) for c in ("total_detections", "sensitive_detections", "redacted_regions")],
    )
