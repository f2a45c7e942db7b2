"""Queries over page elements and their classification, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushpage.functions import classify as C
from hushpage.functions import elements as E
from hushpage.functions.geometry import snapped
from hushpage.operators import detect
from hushpage.operators.ids import element_ids as assign_ids
from hushpage.operators.ids import resolve_elements
from hushpage.operators.observe import observe_tabs
from hushpage.plans.text_queries import URLS, page_urls, sql_email, sql_normalize, sql_phone, sql_restricted, sql_trim
from hushpage.sources import views
from hushpage.sources.pages import SNAPSHOT_SCHEMA, element_rows

KEY = ["snapshot_id", "ord"]
R = f"({views.RAW_ELEMENTS}) AS r"
EL = f"({views.ELEMENTS})"
BOX = ["x", "y", "width", "height"]


def _typed(spark, sf_dir):
    raw = views.raw_elements(spark, sf_dir)
    kind = E.element_type(F.col("tag_name"), F.col("role"), F.col("raw_type"), F.col("has_href"))
    return raw.withColumn("type", kind)


def element_types(spark, sf_dir):
    return _typed(spark, sf_dir).select(*KEY, "type")


def extracted_elements(spark, sf_dir):
    """The page scan over element tables: kept kinds with a size, labels, types and roles, boxes to a tenth."""
    rows = _typed(spark, sf_dir).where("type IS NOT NULL AND width > 0 AND height > 0")
    third = {c: snapped(F.col(c) / 3) for c in BOX}
    return rows.select(
        *KEY, "type", E.element_role(F.col("role"), F.col("tag_name")).alias("role"),
        E.trimmed_label(F.col("raw_aria")).alias("aria_label"), E.trimmed_label(F.col("raw_placeholder")).alias("placeholder"),
        E.effective_input_type(F.col("tag_name"), F.col("raw_type")).alias("input_type"), *[v.alias(c) for c, v in third.items()],
    )


def json_snapshots(spark, sf_dir):
    """Pages as JSON snapshots and read again: optional fields may be absent, order is kept."""
    e = views.elements(spark, sf_dir)
    names = {"id": "id", "type": "type", "tagName": "tag_name", "role": "role", "text": "text", "ariaLabel": "aria_label", "value": "value", "inputType": "input_type", "name": "name", "visible": "visible", "enabled": "enabled", "sensitive": "sensitive"}
    element = F.struct("ord", *[F.col(c).alias(k) for k, c in names.items()], F.struct(*BOX).alias("bbox"))
    pages = e.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(element)).alias("elements"))
    texts = pages.select(F.col("snapshot_id").alias("source"), F.to_json(F.struct("elements")).alias("body"))
    read = texts.select("source", F.from_json("body", SNAPSHOT_SCHEMA).alias("page")).select("source", "page.*")
    return element_rows(read).select(F.col("source").alias("snapshot_id"), "ord", "id", "tag_name", "text", "value", "has_value", *BOX, "visible", "sensitive")


def sensitive_flags(spark, sf_dir):
    flag = E.is_sensitive_element(F.col("raw_type"), F.col("raw_name"), F.col("autocomplete"), F.col("dom_id"))
    return views.raw_elements(spark, sf_dir).select(*KEY, flag.alias("sensitive"))


def element_texts(spark, sf_dir):
    return _typed(spark, sf_dir).select(*KEY, E.element_text(F.col("type"), F.col("content"), F.col("alt")).alias("text"))


def visible_enabled(spark, sf_dir):
    seen = E.is_visible(*[F.col(c) for c in ("hidden", "display", "visibility", "opacity", "width", "height")])
    on = E.is_enabled(*[F.col(c) for c in ("aria_disabled", "disabled", "fieldset_disabled", "in_first_legend")])
    return views.raw_elements(spark, sf_dir).select(*KEY, seen.alias("visible"), on.alias("enabled"))


def element_ids(spark, sf_dir):
    return assign_ids(_typed(spark, sf_dir).where("type IS NOT NULL"))


def resolved_ids(spark, sf_dir):
    raw = views.raw_elements(spark, sf_dir).join(views.elements(spark, sf_dir).select(*KEY, "id"), KEY)
    wanted = raw.select("snapshot_id", F.col("ord").alias("ask"), F.when(F.col("ord") % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("x_"), F.col("dom_id"))).alias("element_id"))
    return resolve_elements(wanted, raw.select("snapshot_id", "ord", "id", "dom_id")).select("snapshot_id", "ask", "ord")


def observed_tabs(spark, sf_dir):
    """Observing each page's tab, where steps fail on some pages."""
    at, n = F.col("page_id"), lambda x: F.lit(float(x))
    tabs = page_urls(spark, sf_dir).select(
        "page_id", "url", (at % 23 != 5).alias("available"), F.when(at % 17 != 0, at).alias("tab_id"), F.when(at % 13 != 0, F.lit("data:image/png;base64,")).alias("data_url"),
        (at % 29 != 3).alias("answered"), F.when(at % 19 != 0, at % 31 != 4).alias("state_given"), n(800).alias("tab_width"), n(600).alias("tab_height"),
        F.struct(F.when(at % 7 == 1, n(0)).otherwise(n(1280)).alias("width"), F.when(at % 7 != 2, n(720)).alias("height"), F.when(at % 2 == 0, n(2)).alias("devicePixelRatio")).alias("viewport"),
    )
    return observe_tabs(tabs).select("page_id", "success", "code", "width", "height", "ratio")


def password_fields(spark, sf_dir):
    return views.elements(spark, sf_dir).where(C.is_password_element()).select(*KEY)


def dom_signals(spark, sf_dir):
    signals = {"password": C.password_signal(), "email": C.email_signal(), "phone": C.phone_signal(), "name": C.name_signal()}
    return views.elements(spark, sf_dir).select(*KEY, *[v.alias(k) for k, v in signals.items()])


def _flat(detections):
    return detections.withColumn("sources", F.array_join("sources", ",")).drop("text")


def dom_detections(spark, sf_dir):
    return _flat(detect.dom_detections(views.elements(spark, sf_dir)))


def _texts(spark, sf_dir):
    rows = views.elements(spark, sf_dir).where("text IS NOT NULL")
    return rows.select(*KEY, "id", "text", *BOX, F.when(F.col("ord") % 3 == 0, F.lit(0.5)).alias("confidence"))


def text_detections(spark, sf_dir):
    return _flat(detect.text_detections(_texts(spark, sf_dir)))


def pii_detections(spark, sf_dir):
    return _flat(detect.detect_pii(_texts(spark, sf_dir), views.elements(spark, sf_dir)))


def _failing(elements):
    raise ValueError("a detector that is broken")


def all_detections(spark, sf_dir):
    """Three detectors in order; the broken one is skipped."""
    rows = views.elements(spark, sf_dir)
    return _flat(detect.run_detectors(rows, [detect.dom_detections, _failing, detect.password_detections]))


def _flaky(element):
    """A detector of one element that cannot cope with every tenth page, and finds the word Login elsewhere."""
    if element["snapshot_id"] % 10 == 3:
        raise KeyError(element["id"])
    if "Login" in (element["text"] or ""):
        yield {"type": "username", "confidence": 0.5, "sources": ["flaky"]}


def isolated_detections(spark, sf_dir):
    """Detectors of which one fails on some rows: it loses these rows only, and each is told."""
    run = detect.run_isolated(views.elements(spark, sf_dir), [detect.dom_detections, detect.RowDetector("flaky", _flaky), _failing])
    found = run.detections.select(*KEY, "type", "group_no", F.lit(None).cast("string").alias("error"))
    return found.unionByName(run.errors.select(*KEY, F.lit(None).cast("string").alias("type"), "group_no", "error"))


def deduped_detections(spark, sf_dir):
    rows = views.detections(spark, sf_dir).withColumns({"x": F.col("x") % 60, "y": F.lit(0.0), "width": F.lit(50.0), "height": F.lit(20.0)})
    merged = detect.deduplicate(rows.withColumn("sources", F.array("source")))
    return merged.withColumn("sources", F.array_join("sources", ","))


_QUERIES = (
    element_types, extracted_elements, json_snapshots, sensitive_flags, element_texts, visible_enabled, element_ids, resolved_ids,
    observed_tabs, password_fields, dom_signals, dom_detections, text_detections, pii_detections, all_detections, isolated_detections, deduped_detections,
)
QUERIES = {f.__name__: f for f in _QUERIES}


def low(c: str) -> str:
    return f"lower(coalesce({c}, ''))"


_STEMS = "password|passwd|secret|token|auth|cookie|cvv|credit|card|ssn|pin"
_TYPE = f"""
CASE WHEN {low("tag_name")} = 'input' THEN
    CASE WHEN lower(coalesce(nullif(raw_type, ''), 'text')) IN ('checkbox', 'radio', 'image') THEN lower(raw_type)
         WHEN lower(coalesce(nullif(raw_type, ''), 'text')) IN ('button', 'submit', 'reset') THEN 'button'
         WHEN lower(coalesce(nullif(raw_type, ''), 'text')) <> 'hidden' THEN 'input' END
  WHEN {low("tag_name")} IN ('button', 'textarea', 'select') THEN lower(tag_name)
  WHEN {low("tag_name")} = 'a' AND has_href THEN 'link'
  WHEN {low("tag_name")} = 'img' THEN 'image'
  WHEN regexp_matches({low("tag_name")}, '^h[1-6]$') THEN 'text'
  WHEN {low("role")} IN ('button', 'checkbox', 'radio', 'link') THEN lower(role)
  WHEN {low("role")} IN ('textbox', 'searchbox') THEN 'input' WHEN {low("role")} IN ('combobox', 'listbox') THEN 'select'
  WHEN {low("role")} = 'img' THEN 'image' WHEN {low("role")} = 'heading' THEN 'text' WHEN {low("tag_name")} = 'a' THEN 'link' END
"""
TYPED = f"(SELECT *, {_TYPE} AS type FROM {R})"
_META = " || ' ' || ".join(low(c) for c in ("id", "placeholder", "aria_label", "name", "autocomplete"))


def _delim(words: str, x: str = _META) -> str:
    return f"regexp_matches({x}, '(^|[^A-Za-z0-9])({words})([^A-Za-z0-9]|$)', 'i')"


_OTHER = "('" + "', '".join(C.OTHER_INPUT_TYPES) + "')"
IS_PASSWORD = f"""
({low("input_type")} = 'password' OR ((coalesce(type, '') = 'input' OR {low("tag_name")} = 'input')
  AND {low("input_type")} NOT IN {_OTHER} AND NOT (coalesce(type, '') <> 'input' AND {low("type")} IN {_OTHER})
  AND {low("role")} NOT IN ('search', 'searchbox') AND NOT starts_with({low("placeholder")}, 'search') AND NOT starts_with({low("aria_label")}, 'search')
  AND NOT contains({low("id")}, 'search') AND NOT contains({low("placeholder")}, 'email') AND NOT contains({low("aria_label")}, 'email') AND NOT contains({low("id")}, 'email')
  AND NOT contains({low("placeholder")}, 'username') AND NOT contains({low("aria_label")}, 'username') AND NOT contains({low("aria_label")}, 'user name')
  AND NOT (contains({low("id")}, 'username') AND NOT contains({low("id")}, 'password'))
  AND ({low("role")} = 'password' OR contains({low("aria_label")}, 'password') OR contains({low("placeholder")}, 'password') OR regexp_matches({low("id")}, 'password|passwd|pwd'))))
"""
_PHRASES = "|".join(C.NAME_PHRASES)
_NAMES = "(full|first|last|sur|given|family)_?name"
SIGNALS = f"""
SELECT *, CASE WHEN {low("input_type")} = 'password' OR coalesce(sensitive, FALSE) OR {low("autocomplete")} IN ('current-password', 'new-password') THEN 1.0::DOUBLE
    WHEN regexp_matches({_META}, 'password|passwd|passphrase|pwd') THEN 0.9::DOUBLE END AS s_password,
  CASE WHEN {low("input_type")} = 'email' OR {low("autocomplete")} = 'email' THEN 1.0::DOUBLE
    WHEN {_delim("email|e-mail|mail_?address")} OR contains({low("placeholder")}, 'email') OR contains({low("aria_label")}, 'email') THEN 0.85::DOUBLE END AS s_email,
  CASE WHEN {low("input_type")} = 'tel' OR {low("autocomplete")} = 'tel' OR starts_with({low("autocomplete")}, 'tel-') THEN 1.0::DOUBLE
    WHEN {_delim("phone|mobile|cell|telephone|tel_?no")} OR contains({low("placeholder")}, 'phone') OR contains({low("aria_label")}, 'phone') THEN 0.85::DOUBLE END AS s_phone,
  CASE WHEN type IN ('input', 'textarea') OR tag_name IN ('INPUT', 'TEXTAREA') THEN
    CASE WHEN {low("autocomplete")} IN ('name', 'given-name', 'family-name', 'additional-name') THEN 0.95::DOUBLE
      WHEN NOT regexp_matches({_META}, '{"|".join(C.NOT_A_NAME)}') AND ({_delim(_NAMES, low("id"))} OR {_delim(_NAMES, low("name"))}
        OR regexp_matches({low("placeholder")}, '{_PHRASES}') OR regexp_matches({low("aria_label")}, '{_PHRASES}')) THEN 0.85::DOUBLE END END AS s_name
FROM {EL}
"""
_ARB = "CASE WHEN s_password IS NOT NULL THEN 'password' WHEN s_email IS NOT NULL THEN 'email' WHEN s_phone IS NOT NULL THEN 'phone' WHEN s_name IS NOT NULL THEN 'name' END"
DOM_DETECTIONS = f"""
SELECT snapshot_id, ord, 'det_' || coalesce(id, '') || '_' || {_ARB} AS id, {_ARB} AS type, x, y, width, height,
  coalesce(s_password, s_email, s_phone, s_name) AS confidence, 'dom' AS sources
FROM ({SIGNALS}) WHERE visible IS DISTINCT FROM FALSE AND width > 0 AND height > 0 AND {_ARB} IS NOT NULL
"""
PASSWORD_DETECTIONS = f"SELECT snapshot_id, ord, id, 'password' AS type, x, y, width, height, 1.0::DOUBLE AS confidence, 'dom' AS sources FROM {EL} WHERE {IS_PASSWORD}"
TEXT_DETECTIONS = f"""
SELECT snapshot_id, ord, id, kind AS type, x, y, width, height,
  CASE WHEN ord % 3 = 0 THEN 0.5::DOUBLE WHEN kind = 'email' THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS confidence, 'regex' AS sources
FROM (SELECT *, CASE WHEN {sql_email("text")} THEN 'email' WHEN {sql_phone("text")} THEN 'phone' END AS kind FROM {EL}) WHERE kind IS NOT NULL
"""


def _clean_id(x: str) -> str:
    t = f"nullif({sql_trim(x)}, '')"
    safe = f"nullif(substr(regexp_replace(regexp_replace({t}, '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g'), 1, 32), '')"
    return f"CASE WHEN NOT regexp_matches(lower(coalesce({t}, '')), '{_STEMS}|key') THEN {safe} END"


def _r10(c: str) -> str:
    return f"floor({c} / 3 * 10 + 0.5) / 10 AS {c}"


_PRIO = "CASE type WHEN 'password' THEN 4 WHEN 'email' THEN 3 WHEN 'phone' THEN 2 WHEN 'name' THEN 1 ELSE 0 END"

ORACLES = {
    "element_types": f"SELECT snapshot_id, ord, type FROM {TYPED}",
    "extracted_elements": f"""
        SELECT snapshot_id, ord, type, coalesce(nullif(role, ''), CASE WHEN starts_with(upper(tag_name), 'H') THEN 'heading' END) AS role,
          nullif({sql_trim("raw_aria")}, '') AS aria_label, nullif({sql_trim("raw_placeholder")}, '') AS placeholder,
          coalesce(lower(nullif(raw_type, '')), CASE WHEN {low("tag_name")} = 'input' THEN 'text' END) AS input_type,
          {", ".join(_r10(c) for c in BOX)}
        FROM {TYPED} WHERE type IS NOT NULL AND width > 0 AND height > 0""",
    "sensitive_flags": f"""
        SELECT snapshot_id, ord, {low("raw_type")} = 'password' OR regexp_matches({low("raw_name")}, '{_STEMS}')
          OR regexp_matches({low("autocomplete")}, '{_STEMS}') OR regexp_matches({low("dom_id")}, '{_STEMS}') AS sensitive FROM {R}""",
    "element_texts": f"""
        SELECT snapshot_id, ord, CASE WHEN type = 'image' THEN {sql_normalize("alt")} WHEN type IN ('button', 'link', 'text') THEN {sql_normalize("content")} END AS text
        FROM {TYPED}""",
    "visible_enabled": f"""
        SELECT snapshot_id, ord, NOT coalesce(hidden, FALSE) AND {low("display")} <> 'none' AND {low("visibility")} NOT IN ('hidden', 'collapse')
          AND coalesce(opacity, 1) <> 0 AND width > 0 AND height > 0 AS visible,
          {low("aria_disabled")} <> 'true' AND NOT coalesce(disabled, FALSE) AND NOT (coalesce(fieldset_disabled, FALSE) AND NOT coalesce(in_first_legend, FALSE)) AS enabled
        FROM {R}""",
    "element_ids": f"""
        WITH RECURSIVE c AS (
          SELECT snapshot_id, ord, row_number() OVER (PARTITION BY snapshot_id ORDER BY ord) AS k,
            CASE WHEN i IS NOT NULL THEN type || '_' || i WHEN n IS NOT NULL THEN type || '_name_' || n
              ELSE type || '_' || row_number() OVER (PARTITION BY snapshot_id, type ORDER BY ord) END AS cand
          FROM (SELECT *, {_clean_id("dom_id")} AS i, {_clean_id("raw_name")} AS n FROM {TYPED} WHERE type IS NOT NULL)),
        f AS (
          SELECT snapshot_id, k, ord, cand AS id, [cand] AS used FROM c WHERE k = 1
          UNION ALL
          SELECT c.snapshot_id, c.k, c.ord, list_filter(list_concat([c.cand], list_transform(range(2, 20), lambda i: c.cand || '_' || i)), lambda x: NOT list_contains(f.used, x))[1],
            list_append(f.used, list_filter(list_concat([c.cand], list_transform(range(2, 20), lambda i: c.cand || '_' || i)), lambda x: NOT list_contains(f.used, x))[1])
          FROM f JOIN c ON c.snapshot_id = f.snapshot_id AND c.k = f.k + 1)
        SELECT snapshot_id, ord, id FROM f""",
    "resolved_ids": f"""
        WITH w AS (SELECT r.snapshot_id, r.ord, r.dom_id, e.id FROM {R} JOIN {EL} AS e USING (snapshot_id, ord)),
        a AS (SELECT snapshot_id, ord AS ask, CASE WHEN ord % 2 = 0 THEN id ELSE 'x_' || dom_id END AS k FROM w)
        SELECT snapshot_id, ask, coalesce((SELECT min(ord) FROM w WHERE w.snapshot_id = a.snapshot_id AND w.id = a.k),
          (SELECT min(ord) FROM w WHERE w.snapshot_id = a.snapshot_id AND w.dom_id = CASE WHEN contains(a.k, '_') THEN substr(a.k, strpos(a.k, '_') + 1) END)) AS ord FROM a""",
    "json_snapshots": f"SELECT snapshot_id, ord, id, tag_name, text, value, value IS NOT NULL AS has_value, x, y, width, height, visible, sensitive FROM {EL}",
    "observed_tabs": f"""
        WITH c AS (SELECT page_id, CASE WHEN page_id % 23 = 5 THEN 'UNKNOWN_ERROR' WHEN page_id % 17 = 0 THEN 'NO_ACTIVE_TAB' WHEN {sql_restricted("url")} THEN 'RESTRICTED_URL'
          WHEN page_id % 13 = 0 THEN 'CAPTURE_FAILED' WHEN page_id % 29 = 3 THEN 'CONTENT_SCRIPT_UNAVAILABLE' WHEN page_id % 19 = 0 OR page_id % 31 = 4 THEN 'DOM_EXTRACTION_FAILED' END AS code FROM ({URLS}))
        SELECT page_id, code IS NULL AS success, code, CASE WHEN code IS NULL THEN CASE WHEN page_id % 7 = 1 THEN 800 ELSE 1280 END::DOUBLE END AS width,
          CASE WHEN code IS NULL THEN CASE WHEN page_id % 7 = 2 THEN 600 ELSE 720 END::DOUBLE END AS height, CASE WHEN code IS NULL THEN CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END::DOUBLE END AS ratio FROM c""",
    "password_fields": f"SELECT snapshot_id, ord FROM {EL} WHERE {IS_PASSWORD}",
    "dom_signals": f"SELECT snapshot_id, ord, s_password AS password, s_email AS email, s_phone AS phone, s_name AS name FROM ({SIGNALS})",
    "dom_detections": DOM_DETECTIONS,
    "text_detections": TEXT_DETECTIONS,
    "isolated_detections": f"""
        SELECT snapshot_id, ord, type, 0::INT AS group_no, NULL AS error FROM ({DOM_DETECTIONS})
        UNION ALL SELECT snapshot_id, ord, 'username', 1, NULL FROM {EL} WHERE snapshot_id % 10 <> 3 AND contains(text, 'Login')
        UNION ALL SELECT snapshot_id, ord, NULL, 1, 'KeyError' FROM {EL} WHERE snapshot_id % 10 = 3
        UNION ALL SELECT NULL, NULL, NULL, 2, 'ValueError'""",
    "pii_detections": f"SELECT *, 0::INT AS group_no FROM ({PASSWORD_DETECTIONS}) UNION ALL SELECT *, 1::INT AS group_no FROM ({TEXT_DETECTIONS})",
    "all_detections": f"SELECT *, 0::INT AS group_no FROM ({DOM_DETECTIONS}) UNION ALL SELECT *, 2::INT AS group_no FROM ({PASSWORD_DETECTIONS})",
    "deduped_detections": f"""
        WITH d AS (SELECT snapshot_id, group_no, ord, id, type, x % 60 AS x, 0::DOUBLE AS y, 50::DOUBLE AS width, 20::DOUBLE AS height, confidence, source, {_PRIO} AS p FROM ({views.DETECTIONS})),
        w AS (SELECT *, first_value(type) OVER (PARTITION BY snapshot_id, x ORDER BY p DESC, group_no, ord) AS won FROM d)
        SELECT snapshot_id, min_by(group_no, group_no * 1000 + ord) AS group_no, min_by(ord, group_no * 1000 + ord) AS ord,
          arg_min(id, group_no * 1000 + ord) FILTER (WHERE type = won) AS id, won AS type, x, y, width, height, max(confidence) FILTER (WHERE type = won) AS confidence,
          array_to_string(list_distinct_ordered, ',') AS sources
        FROM (SELECT w.*, l.list_distinct_ordered FROM w JOIN (
            SELECT snapshot_id, x, list(source ORDER BY k) AS list_distinct_ordered FROM (SELECT snapshot_id, x, source, min(group_no * 1000 + ord) AS k FROM w GROUP BY ALL) GROUP BY ALL) l USING (snapshot_id, x))
        GROUP BY snapshot_id, won, x, y, width, height, list_distinct_ordered""",
}

