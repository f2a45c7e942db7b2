"""Queries over actions, planning, requests and metrics, with their DuckDB SQL."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import functions as F

from hushpage.functions import actions as A
from hushpage.functions.text import let
from hushpage.operators import detect, metrics, planning, registry, requests
from hushpage.operators.actions import simulate_actions
from hushpage.plans.element_queries import DOM_DETECTIONS, EL, PASSWORD_DETECTIONS, low
from hushpage.plans.text_queries import SPACE, sql_trim
from hushpage.sources import views

ACT, TASKS = f"({views.ACTIONS})", f"({views.TASKS})"


def _validity(spark, sf_dir):
    """(action_id, valid): both rules over an action that is parsed once, and whether they differ."""

    def both(client, server):
        return F.struct(client.alias("client"), server.alias("server"), (client != server).alias("differ"))

    raw = F.col("action_json")
    valid = let(A.parsed(raw), lambda v: let(A.client_valid(v), lambda client: let(A.server_valid(v, raw), lambda server: both(client, server))))
    return views.actions(spark, sf_dir).select("action_id", valid.alias("valid"))


def client_valid(spark, sf_dir):
    return _validity(spark, sf_dir).select("action_id", F.col("valid.client").alias("valid"))


def server_valid(spark, sf_dir):
    return _validity(spark, sf_dir).select("action_id", F.col("valid.server").alias("valid"))


def contract_disagreements(spark, sf_dir):
    return _validity(spark, sf_dir).where(F.coalesce("valid.differ", F.lit(False))).select("action_id", "valid.client", "valid.server")


def planned_codes(spark, sf_dir):
    v = F.col("v")
    rows = views.actions(spark, sf_dir).withColumn("v", A.parsed(F.col("action_json")))
    code = A.planned_code(A.text_at(v, "$.type"), A.text_at(v, "$.url"), A.text_at(v, "$.direction"), A.number_at(v, "$.amount"))
    return rows.select("action_id", code.alias("code"))


def dry_run(spark, sf_dir):
    page = views.elements(spark, sf_dir).withColumn("options", F.array(F.lit("IN"), F.lit(" Norway ")))
    at = F.col("snapshot_id") + F.col("ord")
    page = page.withColumns({"readonly": at % 5 == 0, "contenteditable": F.when(at % 3 == 0, F.lit("True")).when(at % 3 == 1, F.lit("inherit"))})
    return simulate_actions(views.actions(spark, sf_dir), page)


def intents(spark, sf_dir):
    return planning.read_intents(views.tasks(spark, sf_dir)).select("task_id", "intent", "arg1", "arg2")


def model_intents(spark, sf_dir):
    return planning.read_intents(views.tasks(spark, sf_dir), model=True).select("task_id", "intent", "arg1", "arg2")


def _plans(spark, sf_dir, model=False):
    return planning.plan_actions(views.tasks(spark, sf_dir), views.elements(spark, sf_dir), model)


def click_plans(spark, sf_dir):
    return _plans(spark, sf_dir).where(F.col("intent").isin("login", "signup", "label"))


def registered_plans(spark, sf_dir):
    """Scrolling as the planner that goes by the name of rules plans it."""
    return registry.get_planner("rules")(views.tasks(spark, sf_dir), views.elements(spark, sf_dir)).where("intent = 'scroll'")


def select_plans(spark, sf_dir):
    return _plans(spark, sf_dir).where("intent = 'select'")


def type_plans(spark, sf_dir):
    return _plans(spark, sf_dir).where("intent = 'type'")


def vlm_plans(spark, sf_dir):
    return planning.with_confidence(_plans(spark, sf_dir, model=True))


def plan_responses(spark, sf_dir):
    return planning.to_action_json(_plans(spark, sf_dir)).groupBy("action_json").agg(F.count(F.lit(1)).alias("n"))


#: The keys of request bodies.
_ELEMENT = {"id": "a", "type": "input", "tagName": "INPUT", "bbox": {"x": 0, "y": 0, "width": 1, "height": 1}, "visible": True, "enabled": True}
_REGION = {"id": "r", "type": "email", "bbox": {"x": 0, "y": 0, "width": 1, "height": 1}, "confidence": 0.5, "sources": ["dom"], "redaction": "mask"}
_BROWSER = {"url": "https://example.org", "title": "t", "viewport": {"width": 1280, "height": 720}, "scrollX": 0, "scrollY": 0}
_STATS = {"totalDetections": 1, "sensitiveDetections": 1, "redactedRegions": 1}


def _body(task="go", browser=_BROWSER, statistics=_STATS, regions=(), more=None, **context) -> str:
    rest = {"browser": browser, "sensitiveRegions": list(regions) if isinstance(regions, tuple) else regions, "statistics": statistics, **context}
    return json.dumps({"task": task, "context": rest, **(more or {})})


def _without(record: dict, *keys: str) -> dict:
    return {k: v for k, v in record.items() if k not in keys}


def _page(*elements: dict) -> dict:
    return {"elements": list(elements)}


#: Request bodies and the code that each must get.
BODIES = [
    (_body(), None),
    (_body(sanitizedDom=_page(_ELEMENT)), None),
    (_body(sanitizedDom=None), None),
    (_body(sanitizedDom={**_page(_ELEMENT, {**_ELEMENT, "role": None, "sensitive": False}), "documentWidth": 10.5}, regions=(_REGION,)), None),
    (_body(browser={**_BROWSER, "viewport": {"width": "1280", "height": 720, "devicePixelRatio": 2}}), None),
    (json.dumps({"task": "go", "context": {"browser": _BROWSER, "statistics": _STATS}}), None),
    (_body(sanitizedDom=_page({**_ELEMENT, "value": "x"})), "BAD_DOM"),
    (_body(sanitizedDom=_page({**_ELEMENT, "bbox": {**_ELEMENT["bbox"], "value": "x"}})), "BAD_DOM"),
    (_body(sanitizedDom={"elements": {"value": "x"}}), "BAD_DOM"),
    (_body(sanitizedDom={"elements": "x"}), "BAD_DOM"),
    (_body(sanitizedDom="x"), "BAD_DOM"),
    (_body(sanitizedDom=_page(_without(_ELEMENT, "visible"))), "BAD_DOM"),
    (_body(sanitizedDom=_page({**_ELEMENT, "type": "secret"})), "BAD_DOM"),
    (_body(sanitizedDom=_page({**_ELEMENT, "id": ""})), "BAD_DOM"),
    (_body(sanitizedDom=_page({**_ELEMENT, "visible": "yes"})), "BAD_DOM"),
    (_body(sanitizedDom=_page(_ELEMENT, None)), "BAD_DOM"),
    (_body(sanitizedDom={**_page(), "screenshot": "x"}), "BAD_DOM"),
    (_body(more={"screenshot": "x"}), "UNKNOWN_KEY"),
    (_body(sanitizedScreenshot={"data": "x"}), "UNKNOWN_KEY"),
    (json.dumps({"task": "go", "context": "x"}), "UNKNOWN_KEY"),
    (_body(task="  "), "BAD_TASK"),
    (_body(task=5), "BAD_TASK"),
    (_body(task=None), "BAD_TASK"),
    (json.dumps({"context": {"browser": _BROWSER, "statistics": _STATS}}), "BAD_TASK"),
    (_body(browser={**_BROWSER, "viewport": {"width": 0, "height": 720}}), "BAD_BROWSER"),
    (_body(browser={**_BROWSER, "viewport": {"width": 1280, "height": 720, "image": "x"}}), "BAD_BROWSER"),
    (_body(browser=_without(_BROWSER, "url", "title", "scrollX")), "BAD_BROWSER"),
    (_body(browser={**_BROWSER, "url": None}), "BAD_BROWSER"),
    (_body(browser={**_BROWSER, "scrollX": "far"}), "BAD_BROWSER"),
    (_body(regions=({**_REGION, "confidence": 1.5},)), "BAD_REGIONS"),
    (_body(regions=(_without(_REGION, "bbox"),)), "BAD_REGIONS"),
    (_body(regions=({**_REGION, "text": "x"},)), "BAD_REGIONS"),
    (_body(regions=({**_REGION, "redaction": "none"},)), "BAD_REGIONS"),
    (_body(regions=({**_REGION, "sources": "dom"},)), "BAD_REGIONS"),
    (_body(regions=None), "BAD_REGIONS"),
    (_body(statistics={**_STATS, "totalDetections": -1}), "BAD_STATISTICS"),
    (_body(statistics={**_STATS, "totalDetections": 1.5}), "BAD_STATISTICS"),
    (_body(statistics=_without(_STATS, "redactedRegions")), "BAD_STATISTICS"),
    (_body(statistics=None), "BAD_STATISTICS"),
    ("[1, 2]", "NOT_AN_OBJECT"),
    ("{", "NOT_AN_OBJECT"),
    ("", "NOT_AN_OBJECT"),
]


def closed_schema(spark, sf_dir):
    bodies = F.array(*[F.lit(b) for b, _ in BODIES])
    made = views.table(spark, sf_dir, "pages").select("page_id", F.get(bodies, (F.col("page_id") % len(BODIES)).cast("int")).alias("body"))
    return made.select("page_id", requests.request_code(F.col("body")).alias("code"))


def browser_states(spark, sf_dir):
    at = F.col("page_id")
    half = lambda n, v: F.when(at % n != 0, v)
    pages = views.table(spark, sf_dir, "pages").select(
        at.alias("snapshot_id"), half(3, F.col("url")).alias("url"), half(4, F.lit("Home")).alias("title"), half(5, F.lit(1280.0)).alias("width"), half(6, F.lit(720.0)).alias("height"),
        half(7, F.lit(2.0)).alias("ratio"), half(2, F.lit(10.0)).alias("scroll_x"), half(9, F.lit(20.0)).alias("scroll_y"),
    )
    return requests.browser_state(pages).select("snapshot_id", "url", "title", "viewport.*", "scroll_x", "scroll_y")


OUTPUTS = [
    ('{"action":{"type":"click"},"confidence":0.5}', None), ('{"action":{"type":"click"},"explanation":"x"}', None), ('{"action":{"type":"click"},"confidence":1.5}', "BAD_CONFIDENCE"),
    ('{"action":{},"more":1}', "UNKNOWN_KEY"), ('{"confidence":1}', "NO_ACTION"), ("7", "NOT_AN_OBJECT"), ('{"action":"click"}', "NO_ACTION"), ('{"action":{},"confidence":null}', None),
    ('{"action":{},"confidence":"high"}', "BAD_CONFIDENCE"), ('{"action":{},"explanation":5}', "BAD_EXPLANATION"), ("{", "NOT_AN_OBJECT"),
]


def model_outputs(spark, sf_dir):
    bodies = F.array(*[F.lit(b) for b, _ in OUTPUTS])
    made = views.table(spark, sf_dir, "pages").select("page_id", F.get(bodies, (F.col("page_id") % len(OUTPUTS)).cast("int")).alias("body"))
    return made.select("page_id", requests.model_output_code(F.col("body")).alias("code"))


_KINDS = ["observe", "detect", "execute"]


def dispatched_messages(spark, sf_dir):
    """Messages by kind; those of no known kind go nowhere."""
    kind = F.get(F.array(*map(F.lit, [*_KINDS, "other"]), F.lit(None)), (F.col("event_id") % 5).cast("int"))
    parts = requests.dispatch(views.table(spark, sf_dir, "events").select("event_id", kind.alias("type")), _KINDS)
    rows = [part.select(F.lit(name).alias("handler"), "event_id") for name, part in parts.items()]
    return reduce(lambda a, b: a.union(b), rows)


def pii_prf(spark, sf_dir):
    """Form rules judged against the first detection rule's password fields and the page's own types."""
    page = views.elements(spark, sf_dir)
    predicted = detect.dom_detections(page).withColumn("id", F.col("ord").cast("string"))
    truth = page.select("snapshot_id", F.col("ord").cast("string").alias("id"), F.when(F.col("input_type") == "tel", "phone").otherwise(F.col("input_type")).alias("type"))
    return metrics.precision_recall(predicted, truth.where("type IN ('password', 'email', 'phone')"))


def task_success(spark, sf_dir):
    return metrics.success_rate(dry_run(spark, sf_dir), "action_type")


def stage_counts(spark, sf_dir):
    page = views.elements(spark, sf_dir)
    return metrics.stage_counts({"elements": page, "dom_detections": detect.dom_detections(page), "password_fields": detect.password_detections(page)})


_QUERIES = (
    client_valid, server_valid, contract_disagreements, planned_codes, dry_run, intents, model_intents, click_plans, select_plans, type_plans, vlm_plans,
    registered_plans, plan_responses, closed_schema, browser_states, model_outputs, dispatched_messages, pii_prf, task_success, stage_counts,
)
QUERIES = {f.__name__: f for f in _QUERIES}


def _type(path: str) -> str:
    return f"json_type(action_json, '{path}')"


def _text(path: str) -> str:
    return f"CASE WHEN {_type(path)} = 'VARCHAR' THEN json_extract_string(action_json, '{path}') END"


def _num(path: str) -> str:
    return f"CASE WHEN {_type(path)} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract_string(action_json, '{path}')::DOUBLE END"


def _loose(path: str) -> str:
    return f"TRY_CAST(json_extract_string(action_json, '{path}') AS DOUBLE)"


_URL_OK = rf"regexp_matches(url, '^[{SPACE}]*https?:[/\\]*[^/\\?#{SPACE}:@]', 'i')"
PARSED = f"""
SELECT *, coalesce(CASE WHEN kind = 'click' THEN tgt WHEN kind = 'scroll' THEN direction IN ('up', 'down') AND amount > 0 AND amount <= 1000
  WHEN kind IN ('type', 'select') THEN tgt AND length(value) <= 10000 WHEN kind = 'navigate' THEN {_URL_OK} END, FALSE) AS client
FROM (SELECT *, {_text("$.type")} AS kind, {_text("$.target.elementId")} AS element_id, {_num("$.target.x")} AS at_x, {_num("$.target.y")} AS at_y, {_text("$.value")} AS value,
  {_text("$.url")} AS url, {_text("$.direction")} AS direction, {_num("$.amount")} AS amount,
  coalesce({_type("$.target")} = 'OBJECT', FALSE) AND CASE WHEN {_type("$.target.elementId")} IS NOT NULL THEN coalesce({_type("$.target.elementId")} = 'VARCHAR' AND trim({_text("$.target.elementId")}) <> '', FALSE)
    ELSE coalesce({_num("$.target.x")} IS NOT NULL AND {_num("$.target.y")} IS NOT NULL, FALSE) END AS tgt
  FROM {ACT})
"""


def _only(keys: str, path: str = "$") -> str:
    return f"len(list_filter(coalesce(CASE WHEN {_type(path)} = 'OBJECT' THEN json_keys(action_json, '{path}') END, []), lambda k: k NOT IN {keys})) = 0"


_SERVER_TARGET = f"""(coalesce({_only("('elementId')", "$.target")} AND length(element_id) > 0, FALSE)
  OR coalesce({_only("('x', 'y')", "$.target")} AND {_loose("$.target.x")} IS NOT NULL AND {_loose("$.target.y")} IS NOT NULL, FALSE))"""
SERVER = f"""
SELECT *, coalesce(CASE WHEN kind = 'click' THEN {_only("('type', 'target')")} AND {_SERVER_TARGET}
  WHEN kind = 'scroll' THEN {_only("('type', 'direction', 'amount')")} AND direction IN ('up', 'down') AND {_loose("$.amount")} > 0 AND {_loose("$.amount")} <= 1000
  WHEN kind IN ('type', 'select') THEN {_only("('type', 'target', 'value')")} AND {_SERVER_TARGET} AND length(value) <= 10000
  WHEN kind = 'navigate' THEN {_only("('type', 'url')")} AND regexp_matches({sql_trim("url")}, '^https?://[^/?#]', 'i') END, FALSE) AS server
FROM ({PARSED})
"""
DRY = f"""
WITH p AS ({PARSED}), el AS (SELECT *, (snapshot_id + ord) % 5 = 0 AS fixed, (snapshot_id + ord) % 3 = 0 AS free FROM {EL}),
named AS (SELECT snapshot_id, id, arg_min(el, ord) AS t FROM el GROUP BY snapshot_id, id),
pointed AS (SELECT p.action_id, arg_max(el, el.ord) AS t FROM p JOIN el ON el.snapshot_id = p.snapshot_id AND p.element_id IS NULL
  AND p.at_x >= el.x AND p.at_x < el.x + el.width AND p.at_y >= el.y AND p.at_y < el.y + el.height GROUP BY p.action_id),
j AS (SELECT p.*, coalesce(named.t, pointed.t) AS t FROM p LEFT JOIN named ON named.snapshot_id = p.snapshot_id AND named.id = p.element_id LEFT JOIN pointed ON pointed.action_id = p.action_id),
c AS (SELECT action_id, client, kind, direction, amount, CASE WHEN NOT client THEN 'INVALID_ACTION'
  WHEN kind = 'click' THEN CASE WHEN element_id IS NULL AND (at_x < 0 OR at_x > 1280 OR at_y < 0 OR at_y > 720) THEN 'TARGET_NOT_INTERACTABLE' WHEN t IS NULL THEN 'TARGET_NOT_FOUND'
    WHEN NOT t.enabled OR (element_id IS NOT NULL AND NOT t.visible) THEN 'TARGET_NOT_INTERACTABLE' END
  WHEN kind = 'type' THEN CASE WHEN t IS NULL AND element_id IS NULL THEN 'TARGET_NOT_INTERACTABLE' WHEN t IS NULL THEN 'TARGET_NOT_FOUND'
    WHEN t.fixed OR NOT (t.free OR lower(t.tag_name) = 'textarea' OR (lower(t.tag_name) = 'input' AND lower(coalesce(nullif(t.input_type, ''), 'text')) NOT IN ('button', 'submit', 'reset', 'hidden', 'image', 'checkbox', 'radio', 'file')))
      OR NOT t.enabled OR NOT t.visible THEN 'TARGET_NOT_INTERACTABLE' END
  WHEN kind = 'select' THEN CASE WHEN t IS NULL THEN 'TARGET_NOT_FOUND' WHEN lower(t.tag_name) <> 'select' OR NOT t.enabled OR NOT (value = 'IN' OR trim(value) IN ('IN', 'Norway') OR value = ' Norway ') THEN 'TARGET_NOT_INTERACTABLE' END
  END AS error_code FROM j)
SELECT action_id, CASE WHEN error_code IS NULL THEN 'success' ELSE 'failure' END AS status, CASE WHEN client THEN kind ELSE 'unknown' END AS action_type, error_code,
  CASE WHEN error_code IS NULL AND kind = 'scroll' THEN CASE WHEN direction = 'down' THEN amount ELSE -amount END END AS delta FROM c
"""
_VERB = "regexp_matches(l, 'click|find|press|tap')"


def _intents_sql(model: bool) -> str:
    down = "contains(l, 'scroll down')" if model else "starts_with(l, 'scroll down')"
    up = "contains(l, 'scroll up')" if model else "starts_with(l, 'scroll up')"
    terms = "signup|sign up|register" + ("" if model else "|create account")
    sel, typ = r"^select\s+(?:option\s+)?(.+)$", r"""^type\s+(?:[''"]?)(.+?)(?:[''"]?)\s+(?:into|in)\s+(?:the\s+)?(.+)$"""
    into = r"^type\s+into\s+(?:the\s+)?(.+?)(?:\s+field|\s+input|\s+box)?$"
    lab = r"trim(regexp_extract(l, '^(?:click|find|press|tap)\s+(?:the\s+)?(.+?)(?:\s+button)?(?:\s+and\s+click\s+it)?$', 1))"
    tail = f"WHEN regexp_matches(c, '{into}', 'i') THEN 'type_into'" if model else ""
    return f"""
    SELECT task_id, snapshot_id, intent,
      CASE WHEN intent = 'scroll' THEN CASE WHEN {down} THEN 'down' ELSE 'up' END WHEN intent = 'label' THEN {lab} WHEN intent = 'select' THEN trim(regexp_extract(c, '{sel}', 1, 'i'))
        WHEN intent = 'type' THEN regexp_extract(c, '{typ}', 1, 'i') WHEN intent = 'type_into' THEN CASE WHEN contains(lower(regexp_extract(c, '{into}', 1, 'i')), 'name') THEN 'Jane Doe' ELSE 'synthetic_query' END END AS arg1,
      CASE WHEN intent = 'type' THEN trim(regexp_extract(c, '{typ}', 2, 'i')) WHEN intent = 'type_into' THEN trim(regexp_extract(c, '{into}', 1, 'i')) END AS arg2
    FROM (SELECT *, CASE WHEN {down} OR {up} THEN 'scroll' WHEN contains(l, 'login') AND {_VERB} THEN 'login' WHEN regexp_matches(l, '{terms}') AND {_VERB} THEN 'signup'
        WHEN {lab} NOT IN ('', 'it', 'button', 'link') THEN 'label' WHEN regexp_matches(c, '{sel}', 'i') THEN 'select' WHEN regexp_matches(c, '{typ}', 'i') THEN 'type' {tail} ELSE 'unsupported' END AS intent
      FROM (SELECT *, {sql_trim("task")} AS c, lower({sql_trim("task")}) AS l FROM {TASKS}))"""


def _has(term: str, *columns: str) -> str:
    return "(" + " OR ".join(f"contains({low(c)}, {term})" for c in columns) + ")"


def _shape(kinds: str, tags: str, roles: str) -> str:
    return f"({low('type')} IN ({kinds}) OR {low('tag_name')} IN ({tags}) OR {low('role')} IN ({roles}))"


def _plans_sql(model: bool) -> str:
    labels = ("text", "aria_label", "id")
    usable = "TRUE" if model else "visible AND enabled AND NOT coalesce(sensitive, FALSE)"
    typing = "intent IN ('type', 'type_into')"
    generic = "TRUE" if model else "regexp_matches(lower(arg2), 'input|field|textbox')"
    fields = _shape("'input', 'textarea'", "'input', 'textarea'", "'textbox', 'searchbox'")
    sensitive = f"coalesce(t.sensitive, FALSE) AND ({typing}{' OR intent = ' + chr(39) + 'select' + chr(39) if model else ''})"
    secret = f"{typing} AND ({low('t.input_type')} = 'password' OR contains(lower(t.id), 'password'))"
    state = "WHEN NOT t.visible THEN 'NOT_VISIBLE' WHEN NOT t.enabled THEN 'DISABLED'"
    refusals = f"WHEN {sensitive} THEN 'SENSITIVE' WHEN {secret} THEN 'PASSWORD'"
    checks = f"{state} {refusals}" if model else f"{refusals} {state}"
    owner = "LEFT JOIN (SELECT snapshot_id, id, arg_min(e, ord) AS o FROM el AS e GROUP BY snapshot_id, id) AS w ON w.snapshot_id = i.snapshot_id AND w.id = f.t.id" if model else ""
    return f"""
    WITH i AS (SELECT *, CASE WHEN trim(regexp_replace(arg2, '\\b(the|field|input|box)\\b', '', 'gi')) = '' THEN lower(arg2)
        ELSE lower(trim(regexp_replace(arg2, '\\b(the|field|input|box)\\b', '', 'gi'))) END AS wanted FROM ({_intents_sql(model)})),
    el AS (SELECT * FROM {EL}),
    b AS (SELECT i.task_id, i.intent, i.arg1, i.arg2, i.wanted, el.*, el AS e FROM i JOIN el ON el.snapshot_id = i.snapshot_id),
    n AS (SELECT *, coalesce({_has("wanted", "id", "placeholder", "aria_label", "input_type")}, FALSE) AS named FROM b),
    k AS (SELECT * FROM n WHERE CASE
        WHEN intent = 'login' THEN {_has("'login'", *labels)} OR {_has("'log in'", "text", "aria_label")}
        WHEN intent = 'signup' THEN {_has("'signup'", *labels)} OR {_has("'sign up'", *labels)} OR {_has("'register'", *labels)}
        WHEN intent = 'label' THEN {_shape("'button', 'link'", "'button', 'a'", "'button', 'link'")} AND {_has("arg1", *labels)}
        WHEN intent = 'select' THEN {_shape("'select'", "'select'", "'combobox', 'listbox', 'select'")} AND {usable}
        WHEN {typing} THEN {fields} AND (named OR {generic}) END),
    f AS (SELECT task_id, arg_min(e, CASE WHEN {typing} AND NOT named THEN 1000 ELSE 0 END + ord) AS t FROM k GROUP BY task_id),
    q AS (SELECT i.task_id, i.intent, i.arg1, {"w.o" if model else "f.t"} AS t FROM i LEFT JOIN f USING (task_id) {owner}),
    z AS (SELECT *, CASE WHEN intent = 'unsupported' THEN 'UNSUPPORTED' WHEN intent = 'scroll' THEN NULL WHEN t IS NULL THEN 'NOT_FOUND' {checks} END AS error FROM q)
    SELECT task_id, intent, CASE WHEN error IS NULL THEN CASE WHEN intent IN ('login', 'signup', 'label') THEN 'click' WHEN {typing} THEN 'type' ELSE intent END END AS action_type,
      CASE WHEN error IS NULL THEN t.id END AS element_id, CASE WHEN error IS NULL AND intent IN ('scroll', 'select', 'type', 'type_into') THEN arg1 END AS value, error FROM z"""


_RULES, _MODEL = _plans_sql(False), _plans_sql(True)
_CONF = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in planning.CONFIDENCE.items())
_CODES = " ".join(f"WHEN {i} THEN {'NULL' if c is None else chr(39) + c + chr(39)}" for i, (_, c) in enumerate(BODIES))

_OUT = " ".join(f"WHEN {i} THEN {'NULL' if c is None else chr(39) + c + chr(39)}" for i, (_, c) in enumerate(OUTPUTS))

ORACLES = {
    "dispatched_messages": "SELECT ['observe', 'detect', 'execute'][event_id % 5 + 1] AS handler, event_id FROM events WHERE event_id % 5 < 3",
    "browser_states": """
        SELECT page_id AS snapshot_id, CASE WHEN page_id % 3 <> 0 THEN url ELSE 'about:blank' END AS url, CASE WHEN page_id % 4 <> 0 THEN 'Home' ELSE '' END AS title,
          CASE WHEN page_id % 5 <> 0 THEN 1280 ELSE 0 END::DOUBLE AS width, CASE WHEN page_id % 6 <> 0 THEN 720 ELSE 0 END::DOUBLE AS height, CASE WHEN page_id % 7 <> 0 THEN 2 ELSE 1 END::DOUBLE AS devicePixelRatio,
          CASE WHEN page_id % 2 <> 0 THEN 10 ELSE 0 END::DOUBLE AS scroll_x, CASE WHEN page_id % 9 <> 0 THEN 20 ELSE 0 END::DOUBLE AS scroll_y FROM pages""",
    "model_outputs": f"SELECT page_id, CASE page_id % {len(OUTPUTS)} {_OUT} END AS code FROM pages",
    "client_valid": f"SELECT action_id, client AS valid FROM ({PARSED})",
    "server_valid": f"SELECT action_id, server AS valid FROM ({SERVER})",
    "contract_disagreements": f"SELECT action_id, client, server FROM ({SERVER}) WHERE client <> server",
    "planned_codes": f"""
        SELECT action_id, CASE WHEN lower(kind) IN ('executescript', 'javascript', 'eval', 'shell', 'command', 'exec', 'css_selector', 'xpath') THEN 'DENIED'
          WHEN lower(kind) NOT IN ('click', 'scroll', 'type', 'select', 'navigate') THEN 'UNKNOWN_ACTION'
          WHEN kind = 'navigate' AND NOT coalesce(regexp_matches(url, '^https?://[^/?#]', 'i'), FALSE) THEN 'INVALID_URL'
          WHEN kind = 'scroll' AND NOT coalesce(direction IN ('up', 'down') AND amount > 0 AND amount <= 1000, FALSE) THEN 'INVALID_SCROLL' END AS code FROM ({PARSED})""",
    "dry_run": DRY,
    "intents": f"SELECT task_id, intent, arg1, arg2 FROM ({_intents_sql(False)})",
    "model_intents": f"SELECT task_id, intent, arg1, arg2 FROM ({_intents_sql(True)})",
    "click_plans": f"SELECT * FROM ({_RULES}) WHERE intent IN ('login', 'signup', 'label')",
    "registered_plans": f"SELECT * FROM ({_RULES}) WHERE intent = 'scroll'",
    "select_plans": f"SELECT * FROM ({_RULES}) WHERE intent = 'select'",
    "type_plans": f"SELECT * FROM ({_RULES}) WHERE intent = 'type'",
    "vlm_plans": f"SELECT *, CASE WHEN error IS NULL THEN CASE intent {_CONF} END END AS confidence FROM ({_MODEL})",
    "plan_responses": f"""
        SELECT '{{"type":"' || action_type || '"' || CASE WHEN element_id IS NOT NULL THEN ',"target":{{"elementId":"' || element_id || '"}}' ELSE '' END
          || CASE WHEN action_type = 'scroll' THEN ',"direction":"' || value || '","amount":500.0' WHEN action_type IN ('type', 'select') THEN ',"value":"' || value || '"' ELSE '' END || '}}' AS action_json,
          count(*) AS n FROM ({_RULES}) WHERE error IS NULL GROUP BY 1""",
    "closed_schema": f"SELECT page_id, CASE page_id % {len(BODIES)} {_CODES} END AS code FROM pages",
    "pii_prf": f"""
        WITH p AS (SELECT DISTINCT snapshot_id, ord, type FROM ({DOM_DETECTIONS})),
        t AS (SELECT DISTINCT snapshot_id, ord, CASE WHEN input_type = 'tel' THEN 'phone' ELSE input_type END AS type FROM {EL} WHERE input_type IN ('tel', 'password', 'email')),
        c AS (SELECT coalesce(p.type, t.type) AS type, count(*) FILTER (WHERE p.type IS NOT NULL AND t.type IS NOT NULL) AS tp, count(*) FILTER (WHERE t.type IS NULL) AS fp, count(*) FILTER (WHERE p.type IS NULL) AS fn
              FROM p FULL JOIN t ON p.snapshot_id = t.snapshot_id AND p.ord = t.ord AND p.type = t.type GROUP BY 1)
        SELECT type, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END, 6) AS recall,
          round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) END, 6) AS f1 FROM c""",
    "task_success": f"SELECT action_type, count(*) AS n, round(avg(CASE WHEN status = 'success' THEN 1 ELSE 0 END), 6) AS success FROM ({DRY}) GROUP BY 1",
    "stage_counts": f"""
        SELECT 'elements' AS stage, count(*) AS rows FROM {EL} UNION ALL SELECT 'dom_detections', count(*) FROM ({DOM_DETECTIONS})
        UNION ALL SELECT 'password_fields', count(*) FROM ({PASSWORD_DETECTIONS})""",
}
