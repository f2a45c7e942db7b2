"""Queries over geometry, fusion, redaction of elements and verification, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushpage.functions import geometry as G
from hushpage.functions.classify import SENSITIVE_TYPES, compatible
from hushpage.operators import guard, redact, sanitize
from hushpage.operators.fuse import FuseOptions, fuse_detections
from hushpage.operators.spatial import overlapping
from hushpage.plans.element_queries import IS_PASSWORD, low
from hushpage.sources import views

BOX = ("x", "y", "width", "height")
EL, DET, BX = f"({views.ELEMENTS})", f"({views.DETECTIONS})", f"({views.BOXES})"
SENS = "('" + "', '".join(SENSITIVE_TYPES) + "')"
REST = "('" + "', '".join(t for t in SENSITIVE_TYPES if t != "face") + "')"


def _odd_boxes(spark, sf_dir):
    b = views.boxes(spark, sf_dir)
    odd = F.when(F.col("snapshot_id") % 9 == 0, F.lit(float("nan"))).when(F.col("snapshot_id") % 9 == 1, F.lit(float("inf"))).when(F.col("snapshot_id") % 9 == 2, -F.col("width"))
    return b.withColumn("width", F.coalesce(odd, F.when(F.col("snapshot_id") % 9 != 3, F.col("width"))))


def valid_boxes(spark, sf_dir):
    return _odd_boxes(spark, sf_dir).select("snapshot_id", "ord", G.is_valid_box(G.Box.of()).alias("valid"))


def _pairs(spark, sf_dir):
    """Pairs (a, b) of boxes of a page, a before b: a page's boxes are collected once and paired inside their row."""
    box = F.struct("snapshot_id", "ord", "type", *BOX, "confidence")
    held = views.boxes(spark, sf_dir).groupBy("snapshot_id").agg(F.collect_list(box).alias("boxes"))
    first = held.select("boxes", F.explode("boxes").alias("a"))
    return first.select("a", F.explode(F.filter("boxes", lambda x: x["ord"] > F.col("a.ord"))).alias("b"))


def _overlapping(spark, sf_dir):
    """As _pairs, of boxes that share some area, by the grid of each page."""
    rows = views.boxes(spark, sf_dir).select("snapshot_id", "ord", *BOX)
    return overlapping(rows, rows, F.col("a.ord") < F.col("b.ord"))


def _pair_keys():
    return [F.col("a.snapshot_id"), F.col("a.ord").alias("a"), F.col("b.ord").alias("b")]


def box_overlaps(spark, sf_dir):
    a, b, shared = G.Box.of("a."), G.Box.of("b."), F.col("shared")  # the shared area is worked out once, which keeps the generated code small
    measures = {"iou": G.iou(a, b, shared), "overlap": G.max_overlap(a, b, shared), "covers": G.covers(a, b, shared=shared), "inside": G.share_inside(a, b, shared)}
    return _overlapping(spark, sf_dir).select(*_pair_keys(), *[m.alias(name) for name, m in measures.items()])


def box_unions(spark, sf_dir):
    a, b = G.Box.of("a."), G.Box.of("b.")
    third = G.Box(a.x / 3 - 5, a.y / 3 - 5, a.width / 3, a.height / 3)
    return _pairs(spark, sf_dir).select(*_pair_keys(), *[v.alias(n) for n, v in zip(BOX, G.union_box(third, b, 60.0, 40.0), strict=True)])


def pixel_extents(spark, sf_dir):
    b = G.Box.of()
    third = G.Box(b.x / 3 - 4, b.y / 3 - 2, b.width / 3, b.height / 3)
    e = G.pixel_extent(third, F.lit(20), F.lit(15))
    return views.boxes(spark, sf_dir).select("snapshot_id", "ord", e.alias("e")).select("snapshot_id", "ord", "e.*")


def compatible_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).where(compatible(F.col("a.type"), F.col("b.type"))).select(*_pair_keys())


def _box_detections(spark, sf_dir):
    b = views.boxes(spark, sf_dir)
    return b.select("snapshot_id", F.lit(0).alias("group_no"), "ord", F.col("ord").cast("string").alias("id"), "type", *BOX, "confidence", F.array("type").alias("sources"), F.when(F.col("ord") % 2 == 0, F.concat(F.lit("t"), F.col("ord").cast("string"))).alias("text"))


def _fused(spark, sf_dir, options):
    return fuse_detections(_box_detections(spark, sf_dir), options).withColumn("sources", F.array_join("sources", ","))


def fused(spark, sf_dir):
    return _fused(spark, sf_dir, FuseOptions())


def fused_keep_generic(spark, sf_dir):
    return _fused(spark, sf_dir, FuseOptions(keep_generic=True))


def fused_clamped(spark, sf_dir):
    return _fused(spark, sf_dir, FuseOptions(image_width=45.0, image_height=30.0))


def id_matches(spark, sf_dir):
    return sanitize.id_matches(views.elements(spark, sf_dir), views.detections(spark, sf_dir))


def spatial_matches(spark, sf_dir):
    return sanitize.spatial_matches(views.elements(spark, sf_dir), views.detections(spark, sf_dir))


_CLEAN = ("snapshot_id", "ord", "id", "type", "text", "value", "aria_label", "sensitive")


def sanitized_elements(spark, sf_dir):
    return sanitize.sanitize_elements(views.elements(spark, sf_dir), views.detections(spark, sf_dir)).select(*_CLEAN)


def sanitized_stripped(spark, sf_dir):
    options = sanitize.SanitizeOptions(token="***", strip_value=True)
    return sanitize.sanitize_elements(views.elements(spark, sf_dir), views.detections(spark, sf_dir), options).select(*_CLEAN)


def _pages(spark, sf_dir):
    at = F.col("page_id")
    secret = F.when(at % 9 == 2, F.concat("url", F.lit("?secret=1"))).otherwise(F.col("url"))
    return views.table(spark, sf_dir, "pages").select(at.alias("snapshot_id"), secret.alias("url"), F.when(at % 14 == 5, "pwd=1").otherwise("Home").alias("title"), (at % 21 != 4).alias("has_elements"), (at % 25 != 7).alias("has_detections"))


def _screens(spark, sf_dir):
    at = F.col("page_id")
    return views.table(spark, sf_dir, "pages").select(
        at.alias("snapshot_id"), (at % 23 != 1).alias("has_data"), F.when(at % 15 == 3, 0).otherwise(40).alias("width"), F.lit(30).alias("height"), F.when(at % 12 == 6, 10).otherwise(4800).alias("data_length")
    )


def input_violations(spark, sf_dir):
    return guard.input_violations(_screens(spark, sf_dir), views.detections(spark, sf_dir), _pages(spark, sf_dir))


def _careless(spark, sf_dir):
    """A sanitiser that forgot some elements: every third one keeps its text and value."""
    clean = sanitize.sanitize_elements(views.elements(spark, sf_dir), views.detections(spark, sf_dir))
    raw = views.elements(spark, sf_dir).select("snapshot_id", "ord", F.col("text").alias("t"), F.col("value").alias("v"))
    kept = F.col("ord") % 3 == 1
    both = clean.join(raw, ["snapshot_id", "ord"])
    return both.withColumns({"text": F.when(kept, F.col("t")).otherwise(F.col("text")), "value": F.when(kept, F.col("v")).otherwise(F.col("value"))}).drop("t", "v")


def value_leaks(spark, sf_dir):
    return guard.value_leaks(views.elements(spark, sf_dir), _careless(spark, sf_dir))


def secret_leaks(spark, sf_dir):
    return guard.secret_leaks(_careless(spark, sf_dir), views.detections(spark, sf_dir))


def _buffers(spark, sf_dir):
    """Screenshots whose faults are those of _screens."""
    flags = _screens(spark, sf_dir)
    data = F.expr("substring(unhex(repeat('0A141EFF', 1200)), 1, data_length)")
    return flags.select("snapshot_id", F.when(F.col("has_data"), data).alias("data"), "width", "height")


def _half_masked(images):
    """A redactor that forgot every tenth page."""
    done = redact.redact_images(images, {"data": "before"})
    return done.withColumn("data", F.when(F.col("snapshot_id") % 10 == 7, F.col("before")).otherwise(F.col("data"))).drop("before")


def _sanitized(spark, sf_dir, **options):
    found = views.detections(spark, sf_dir).withColumn("sources", F.array("source"))
    return guard.sanitize(_pages(spark, sf_dir), _buffers(spark, sf_dir), views.elements(spark, sf_dir), found, **options)


def guard_verdicts(spark, sf_dir):
    """All phases, with a redactor and a sanitiser that forget some."""
    done = _sanitized(spark, sf_dir, mask=_half_masked, clean_up=lambda elements, detections, options: _careless(spark, sf_dir).where("snapshot_id % 33 <> 8 OR ord <> 0"))
    return guard.verdicts(_pages(spark, sf_dir), done.violations)


def _broken_redactor(images):
    """A redactor that raises on some images, leaves pages out and gives pages twice."""

    def painter(pixels, extents):
        if pixels[0, 0, 0] == 3:
            raise RuntimeError("broken")
        return redact.black_out(pixels, extents)

    done = redact.each_page(painter)(images).where("snapshot_id % 10 <> 5")
    return done.withColumn("times", F.explode(F.sequence(F.lit(1), F.when(F.col("snapshot_id") % 10 == 7, 2).otherwise(1)))).drop("times")


def _broken_cleaner(rows, seen, options):
    """A sanitiser that raises on some pages, loses an element and gives an element twice."""
    page, rows = rows["snapshot_id"].iloc[0], rows.sort_values("ord")
    if page % 11 == 2:
        raise KeyError("broken")
    rows = rows.iloc[1:] if page % 11 == 4 else rows.iloc[[0, *range(len(rows))]] if page % 11 == 6 else rows
    return rows.assign(text=options.token, value=options.token, sensitive=True)


def guard_failures(spark, sf_dir):
    """Parts of the guard that fail while the job runs: just the pages that they fail on are blocked."""
    pages = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("snapshot_id"), "url", F.lit("").alias("title"), F.lit(True).alias("has_elements"))
    pages = pages.unionAll(pages.where("snapshot_id % 13 = 6"))  # some are given twice
    dot = F.concat(F.lpad(F.hex(F.col("snapshot_id") % 10), 2, "0"), F.lit("141EFF"))  # the first pixel tells a page's last digit
    screens = pages.distinct().select("snapshot_id", F.unhex(F.concat(dot, F.repeat(F.lit("0A141EFF"), 1199))).alias("data"), F.lit(40).alias("width"), F.lit(30).alias("height"))
    found = views.detections(spark, sf_dir).where("width > 0").withColumn("sources", F.array("source"))
    done = guard.sanitize(pages, screens, views.elements(spark, sf_dir), found, mask=_broken_redactor, clean_up=sanitize.each_page(_broken_cleaner))
    return guard.verdicts(pages, done.violations)


def passing_contexts(spark, sf_dir):
    """What may leave: pages without a violation of any phase, over screenshots as masked and elements as sanitised."""
    out = _sanitized(spark, sf_dir).contexts
    return out.select("snapshot_id", "url", "title", F.coalesce(F.size("elements"), F.lit(0)).alias("elements"), F.coalesce(F.size("regions"), F.lit(0)).alias("regions"), "total_detections", "sensitive_detections", "redacted_regions")


def privacy_statistics(spark, sf_dir):
    return guard.privacy_statistics(views.detections(spark, sf_dir))


def redaction_counts(spark, sf_dir):
    """Regions that touch a 100 by 80 image, and the pixels of their boxes, by page."""
    e = G.pixel_extent(G.Box.of(), F.lit(100), F.lit(80))
    rows = guard.regions(views.detections(spark, sf_dir).withColumn("sources", F.array("source"))).where(G.is_valid_box(G.Box.of())).withColumn("e", e)
    rows = rows.where("e.x0 < e.x1 AND e.y0 < e.y1")
    return rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("redacted"), F.sum((F.col("e.x1") - F.col("e.x0")) * (F.col("e.y1") - F.col("e.y0"))).alias("pixels"))


_QUERIES = (
    valid_boxes, box_overlaps, box_unions, pixel_extents, compatible_pairs, fused, fused_keep_generic, fused_clamped, id_matches, spatial_matches,
    sanitized_elements, sanitized_stripped, input_violations, value_leaks, secret_leaks, guard_verdicts, guard_failures, passing_contexts, privacy_statistics, redaction_counts,
)
QUERIES = {f.__name__: f for f in _QUERIES}


def sql_inter(a: str, b: str) -> str:
    w = f"(least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x))"
    h = f"(least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y))"
    return f"(CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} ELSE 0 END)"


def sql_iou(a: str, b: str) -> str:
    return f"({sql_inter(a, b)} / ({a}.width * {a}.height + {b}.width * {b}.height - {sql_inter(a, b)}))"


def sql_overlap(a: str, b: str) -> str:
    return f"({sql_inter(a, b)} / least({a}.width * {a}.height, {b}.width * {b}.height))"


def sql_covers(d: str, e: str) -> str:
    return f"({sql_iou(d, e)} >= 0.2 OR ({sql_inter(d, e)} / ({d}.width * {d}.height) >= 0.5 AND {sql_inter(d, e)} / ({e}.width * {e}.height) >= 0.25))"


def sql_compatible(a: str, b: str) -> str:
    return f"({a} = {b} OR ({a} = 'text' AND {b} IN {REST}) OR ({b} = 'text' AND {a} IN {REST}))"


_PAIRS = f"WITH x AS (SELECT * FROM {BX}) SELECT {{}} FROM x AS a JOIN x AS b ON a.snapshot_id = b.snapshot_id AND a.ord < b.ord"
_KEYS = "a.snapshot_id, a.ord AS a, b.ord AS b"


def _rounded(x: str, y: str, w: str, h: str, iw: float | None, ih: float | None) -> tuple[str, str, str, str]:
    x, y = f"greatest(0::DOUBLE, floor({x} + 0.5))", f"greatest(0::DOUBLE, floor({y} + 0.5))"
    w, h = f"greatest(1::DOUBLE, floor({w} + 0.5))", f"greatest(1::DOUBLE, floor({h} + 0.5))"
    if iw:
        x = f"least({x}, {iw}::DOUBLE)"
        w = f"least({w}, {iw}::DOUBLE - {x})"
    if ih:
        y = f"least({y}, {ih}::DOUBLE)"
        h = f"least({h}, {ih}::DOUBLE - {y})"
    return x, y, w, h


def _fold_sql(keep: bool, iw: float | None = None, ih: float | None = None) -> str:
    """The fold as a recursive query: one row a page and step, carrying its clusters as a list."""
    ax, ay, aw, ah = _rounded("d.x", "d.y", "d.width", "d.height", iw, ih)
    left, top = "least(c.x, d.x)", "least(c.y, d.y)"
    mx, my, mw, mh = _rounded(left, top, f"(greatest(c.x + c.width, d.x + d.width) - {left})", f"(greatest(c.y + c.height, d.y + d.height) - {top})", iw, ih)
    score = f"CASE WHEN {sql_compatible('c.type', 'd.type')} AND ({sql_iou('c', 'd')} >= 0.3 OR {sql_overlap('c', 'd')} >= 0.5) THEN greatest({sql_iou('c', 'd')}, {sql_overlap('c', 'd')}) ELSE 0 END"
    alone = f"{{'type': d.type, 'x': {ax}, 'y': {ay}, 'width': {aw}, 'height': {ah}, 'confidence': d.confidence, 'sources': [d.type], 'id': d.id, 'text': d.text}}"
    grown = (
        f"{{'type': CASE WHEN c.type = 'text' THEN d.type ELSE c.type END, 'x': {mx}, 'y': {my}, 'width': {mw}, 'height': {mh}, 'confidence': greatest(c.confidence, d.confidence), "
        f"'sources': CASE WHEN list_contains(c.sources, d.type) THEN c.sources ELSE list_append(c.sources, d.type) END, 'id': CASE WHEN c.type <> 'text' THEN c.id ELSE d.id END, 'text': coalesce(c.text, d.text)}}"
    )
    begin = alone if keep else f"CASE WHEN d.phase = 0 THEN {alone} END"
    fresh = f"CASE WHEN {'TRUE' if keep else 'd.phase = 0'} THEN list_append(f.clusters, {alone}) ELSE f.clusters END"
    return f"""
    WITH RECURSIVE d AS (
      SELECT snapshot_id, type, x, y, width, height, confidence, CAST(ord AS VARCHAR) AS id, CASE WHEN ord % 2 = 0 THEN 't' || ord END AS text,
        CASE WHEN type IN {SENS} THEN 0 ELSE 1 END AS phase,
        row_number() OVER (PARTITION BY snapshot_id ORDER BY CASE WHEN type IN {SENS} THEN 0 ELSE 1 END, ord) AS k FROM {BX}),
    f AS (
      SELECT snapshot_id, k, list_filter([{begin}], lambda c: c IS NOT NULL) AS clusters FROM d WHERE k = 1
      UNION ALL
      SELECT snapshot_id, k, CASE WHEN coalesce(list_max(scores), 0) > 0
          THEN list_transform(clusters, lambda c, i: CASE WHEN i = list_position(scores, list_max(scores)) THEN {grown} ELSE c END) ELSE fresh END
      FROM (SELECT d.snapshot_id, d.k, d AS d, f.clusters, list_transform(f.clusters, lambda c: {score}) AS scores, {fresh} AS fresh
            FROM f JOIN d ON d.snapshot_id = f.snapshot_id AND d.k = f.k + 1)),
    l AS (SELECT snapshot_id, arg_max(clusters, k) AS clusters FROM f GROUP BY snapshot_id),
    u AS (SELECT snapshot_id, unnest(range(len(clusters)))::INT AS cluster, unnest(clusters) AS c FROM l)
    SELECT snapshot_id, cluster, c.type, c.x, c.y, c.width, c.height, c.confidence, array_to_string(c.sources, ',') AS sources, c.id, c.text FROM u
    """


_ID = f"""
SELECT DISTINCT e.snapshot_id, e.ord FROM {EL} AS e JOIN {DET} AS d ON d.snapshot_id = e.snapshot_id
WHERE d.type IN {SENS} AND trim(e.id) <> '' AND d.id IN (e.id, 'det_' || e.id, 'det_' || e.id || '_' || d.type, e.id || '_' || d.type)
"""
_VALID = "{0}.width > 0 AND {0}.height > 0"
_SPACE = f"""
SELECT DISTINCT e.snapshot_id, e.ord FROM {EL} AS e JOIN {DET} AS d ON d.snapshot_id = e.snapshot_id
WHERE d.type IN {SENS} AND NOT (coalesce(e.type, '') = 'container' OR {low("e.tag_name")} IN ('form', 'nav') OR coalesce(e.role, '') = 'form')
  AND {_VALID.format("e")} AND {_VALID.format("d")} AND {sql_inter("d", "e")} > 0 AND {sql_covers("d", "e")}
"""


def _clean_sql(token: str = "'[REDACTED]'", value: str = "'[REDACTED]'") -> str:
    return f"""
    WITH m AS ({_ID} UNION {_SPACE}),
    s AS (SELECT e.*, {IS_PASSWORD} AS pw, {IS_PASSWORD} OR coalesce(sensitive, FALSE) OR {low("input_type")} IN ('password', 'email', 'tel') OR m.ord IS NOT NULL AS sens
          FROM {EL} AS e LEFT JOIN m USING (snapshot_id, ord))
    SELECT snapshot_id, ord, id, type, CASE WHEN sens AND text IS NOT NULL THEN {token} ELSE text END AS text,
      CASE WHEN pw THEN CASE WHEN has_value THEN {value} END WHEN has_value AND value IS NOT NULL THEN CASE WHEN sens THEN {value} ELSE value END END AS value,
      aria_label, sens AS sensitive FROM s"""


_CARELESS = f"""
SELECT c.snapshot_id, c.ord, c.id, CASE WHEN c.ord % 3 = 1 THEN e.text ELSE c.text END AS text, CASE WHEN c.ord % 3 = 1 THEN e.value ELSE c.value END AS value, c.sensitive
FROM ({_clean_sql()}) AS c JOIN {EL} AS e USING (snapshot_id, ord)
"""
_PAGES = "SELECT page_id AS snapshot_id, CASE WHEN page_id % 9 = 2 THEN url || '?secret=1' ELSE url END AS url, CASE WHEN page_id % 14 = 5 THEN 'pwd=1' ELSE 'Home' END AS title FROM pages"
_INPUT = f"""
SELECT page_id AS snapshot_id, 0 AS phase, 0::BIGINT AS ord, CASE WHEN page_id % 23 = 1 THEN 'INVALID_SCREENSHOT' WHEN page_id % 15 = 3 THEN 'INVALID_SCREENSHOT_DIMENSIONS' ELSE 'CORRUPTED_SCREENSHOT_BUFFER' END AS code
FROM pages WHERE page_id % 23 = 1 OR page_id % 15 = 3 OR page_id % 12 = 6
UNION ALL SELECT page_id, 1, 0, 'INVALID_DOM_SNAPSHOT' FROM pages WHERE page_id % 21 = 4
UNION ALL SELECT page_id, 2, -1, 'INVALID_DETECTIONS' FROM pages WHERE page_id % 25 = 7
UNION ALL SELECT snapshot_id, 2, ord, 'INVALID_DETECTION_GEOMETRY' FROM {DET} AS d WHERE NOT ({_VALID.format("d")})
UNION ALL SELECT snapshot_id, 3, 0, 'LEAKED_METADATA' FROM ({_PAGES})
  WHERE regexp_matches(url, '(password|pwd|secret|api_key|token)=[^&]+', 'i') OR regexp_matches(title, '(password|pwd|secret)=', 'i')
"""


def _values_sql(clean: str) -> str:
    return f"""
SELECT c.snapshot_id, 8 AS phase, c.ord::BIGINT AS ord, CASE WHEN r.pw THEN 'PASSWORD_VALUE_LEAKAGE' ELSE 'SENSITIVE_VALUE_LEAKAGE' END AS code
FROM ({clean}) AS c JOIN (SELECT snapshot_id, id, arg_max({IS_PASSWORD}, ord) AS pw FROM {EL} GROUP BY ALL) AS r USING (snapshot_id, id)
WHERE c.value IS NOT NULL AND c.value <> '[REDACTED]' AND (r.pw OR c.sensitive)
"""


def _secrets_sql(clean: str) -> str:
    return f"""
SELECT DISTINCT c.snapshot_id, 9 AS phase, c.ord::BIGINT AS ord, 'LEAKED_SECRET_IN_DOM' AS code FROM ({clean}) AS c JOIN {DET} AS d ON d.snapshot_id = c.snapshot_id
WHERE d.type IN {SENS} AND length(d.text) > 0 AND (coalesce(contains(c.value, d.text), FALSE) OR coalesce(contains(c.text, d.text), FALSE))
"""


#: Pages whose image cannot be masked, and those whose forgotten regions touch it.
_BAD_IMAGE = "page_id % 23 = 1 OR page_id % 15 = 3 OR page_id % 12 = 6"
_MASKS = f"""
SELECT page_id AS snapshot_id, 4 AS phase, 0::BIGINT AS ord, 'REDACTION_EXECUTION_FAILURE' AS code FROM pages WHERE {_BAD_IMAGE}
UNION ALL SELECT page_id, 6, 0, 'SCREENSHOT_VERIFICATION_FAILURE' FROM pages WHERE {_BAD_IMAGE}
UNION ALL SELECT DISTINCT page_id, 6, 0, 'SCREENSHOT_UNMASKED_PIXELS' FROM pages JOIN {DET} AS d ON d.snapshot_id = page_id
  WHERE NOT ({_BAD_IMAGE}) AND page_id % 10 = 7 AND d.type IN {SENS} AND d.width > 0 AND d.height > 0 AND d.x < 40 AND d.y < 30 AND d.x + d.width > 0 AND d.y + d.height > 0
"""
_VALUES, _SECRETS = _values_sql(_CARELESS), _secrets_sql(_CARELESS)
_DROPPED = f"SELECT * FROM ({_CARELESS}) WHERE snapshot_id % 33 <> 8 OR ord <> 0"
_ALL = f"""({_INPUT}) UNION ALL ({_MASKS}) UNION ALL SELECT DISTINCT snapshot_id, 7, 0, 'DOM_VERIFICATION_FAILURE' FROM {EL} WHERE snapshot_id % 33 = 8 AND ord = 0
  UNION ALL ({_values_sql(_DROPPED)}) UNION ALL ({_secrets_sql(_DROPPED)})"""
_COUNTS = f"SELECT snapshot_id, count(*) AS total_detections, count(*) FILTER (WHERE type IN {SENS}) AS sensitive_detections, count(*) FILTER (WHERE type IN {SENS}) AS redacted_regions FROM {DET} GROUP BY snapshot_id"

_U = _rounded("least(a.x / 3 - 5, b.x)", "least(a.y / 3 - 5, b.y)", "(greatest(a.x / 3 - 5 + a.width / 3, b.x + b.width) - least(a.x / 3 - 5, b.x))", "(greatest(a.y / 3 - 5 + a.height / 3, b.y + b.height) - least(a.y / 3 - 5, b.y))", 60.0, 40.0)

ORACLES = {
    "valid_boxes": f"SELECT snapshot_id, ord, snapshot_id % 9 > 3 AS valid FROM {BX}",
    "box_overlaps": f"SELECT * FROM ({_PAIRS.format(f'{_KEYS}, {sql_iou("a", "b")} AS iou, {sql_overlap("a", "b")} AS overlap, {sql_covers("a", "b")} AS covers, {sql_inter("a", "b")} / (a.width * a.height) AS inside')}) WHERE iou > 0",
    "box_unions": _PAIRS.format(_KEYS + ", " + ", ".join(f"{e} AS {n}" for n, e in zip(BOX, _U, strict=True))),
    "pixel_extents": f"""
        SELECT snapshot_id, ord, greatest(0, floor(x / 3 - 4))::BIGINT AS x0, greatest(0, floor(y / 3 - 2))::BIGINT AS y0,
          least(20, ceil(x / 3 - 4 + width / 3))::BIGINT AS x1, least(15, ceil(y / 3 - 2 + height / 3))::BIGINT AS y1 FROM {BX}""",
    "compatible_pairs": _PAIRS.format(_KEYS) + f" WHERE {sql_compatible('a.type', 'b.type')}",
    "fused": _fold_sql(False),
    "fused_keep_generic": _fold_sql(True),
    "fused_clamped": _fold_sql(False, 45.0, 30.0),
    "id_matches": _ID,
    "spatial_matches": _SPACE,
    "sanitized_elements": _clean_sql(),
    "sanitized_stripped": _clean_sql("'***'", "NULL"),
    "input_violations": _INPUT,
    "value_leaks": _VALUES,
    "secret_leaks": _SECRETS,
    "guard_verdicts": f"""
        SELECT p.page_id AS snapshot_id, v.code IS NULL AS passed, v.code FROM pages AS p
        LEFT JOIN (SELECT snapshot_id, arg_min(code, phase * 1000000 + ord) AS code FROM ({_ALL}) GROUP BY snapshot_id) AS v ON v.snapshot_id = p.page_id""",
    "guard_failures": f"""
        SELECT snapshot_id, code IS NULL AS passed, code FROM (
          SELECT p.page_id AS snapshot_id, CASE WHEN p.page_id % 13 = 6 THEN 'PRIVACY_GUARD_VERIFICATION_FAILURE' WHEN coalesce(regexp_matches(url, '(password|pwd|secret|api_key|token)=[^&]+', 'i'), FALSE) THEN 'LEAKED_METADATA'
            WHEN p.page_id % 10 = 3 THEN 'REDACTION_EXECUTION_FAILURE' WHEN p.page_id % 11 = 2 AND n > 0 THEN 'DOM_SANITIZATION_EXECUTION_FAILURE'
            WHEN p.page_id % 10 IN (5, 7) THEN 'SCREENSHOT_VERIFICATION_FAILURE' WHEN p.page_id % 11 IN (4, 6) AND n > 0 THEN 'DOM_VERIFICATION_FAILURE' END AS code
          FROM pages AS p LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM {EL} GROUP BY 1) AS e ON e.snapshot_id = p.page_id)""",
    "passing_contexts": f"""
        SELECT p.snapshot_id, p.url, p.title, coalesce(e.n, 0)::INT AS elements, coalesce(c.sensitive_detections, 0)::INT AS regions, coalesce(total_detections, 0) AS total_detections,
          coalesce(sensitive_detections, 0) AS sensitive_detections, coalesce(redacted_regions, 0) AS redacted_regions
        FROM ({_PAGES}) AS p LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM {EL} WHERE id IS NOT NULL GROUP BY 1) AS e USING (snapshot_id)
        LEFT JOIN ({_COUNTS}) AS c USING (snapshot_id) WHERE p.snapshot_id NOT IN (
          SELECT snapshot_id FROM ({_INPUT}) UNION SELECT snapshot_id FROM ({_values_sql(_clean_sql())}) UNION SELECT snapshot_id FROM ({_secrets_sql(_clean_sql())}))""",
    "privacy_statistics": _COUNTS,
    "redaction_counts": f"""
        SELECT snapshot_id, count(*) AS redacted, sum((x1 - x0) * (y1 - y0))::BIGINT AS pixels FROM (
          SELECT snapshot_id, greatest(0, floor(x))::BIGINT AS x0, greatest(0, floor(y))::BIGINT AS y0, least(100, ceil(x + width))::BIGINT AS x1, least(80, ceil(y + height))::BIGINT AS y1
          FROM {DET} AS d WHERE type IN {SENS} AND {_VALID.format("d")}) WHERE x0 < x1 AND y0 < y1 GROUP BY snapshot_id""",
}
