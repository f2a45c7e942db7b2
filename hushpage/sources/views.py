"""Deterministic page tables derived from star-schema tables, as SQL text that Spark and DuckDB read alike.

Raw web pages carry no layout, so page elements, detections, tasks and actions are laid over ``events`` and
boxes over ``lineitem``: each attribute is picked from a short list by the row's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


#: The same choice for Spark: an array of constants, which folds into one literal of the generated code.
_AS_ARRAY: dict[str, str] = {}


def pick(values: list, times: int = 1, plus: int = 0, key: str = "event_id") -> str:
    """SQL: the entry of ``values`` at (key * times + plus) modulo their number."""
    at = f"({key} * {times} + {plus}) % {len(values)}"
    whens = " ".join(f"WHEN {i} THEN {_literal(v)}" for i, v in enumerate(values))
    case = f"CASE {at} {whens} END"
    _AS_ARRAY[case] = f"array({', '.join(_literal(v) for v in values)})[CAST({at} AS INT)]"
    return case


_ELEMENTS = {
    "snapshot_id": "CAST(floor(event_id / 8.0) AS BIGINT)",
    "ord": "CAST(event_id % 8 AS INT)",
    "tag_name": pick(["INPUT", "BUTTON", "A", "input", "SELECT", "TEXTAREA", "IMG", "H2", "DIV", "FORM", "SPAN", "nav", "HEADER"]),
    "role": pick([None, "button", "searchbox", "", "heading", "combobox", "checkbox", "search", "form", None, "Link", "img"], 5, 1),
    "raw_type": pick(["text", "PASSWORD", None, "email", "tel", "hidden", "checkbox", "search", "", "submit", "image", "radio", "date", "url"], 3),
    "dom_id": pick(["user_email", "login-password", None, " shipping box! ", "author", "q", "continue", "key_1", "x_2", "full_name", "submit__go", "", "pwd"], 7, 2),
    "raw_name": pick(["email", None, "first_name", "csrf_token", "phone", "company_name", "card-number", "", "surname", "tel_no", "x"], 2, 3),
    "autocomplete": pick([None, "current-password", "email", "tel-national", "given-name", "off", "", "name", "cc-number"], 11, 1),
    "raw_aria": pick([None, " Look for goods ", "Password", "Your phone", "log in", "", "User name", "Legal name", "Sign up", "Continue"], 3, 4),
    "raw_placeholder": pick([None, "Email address", "Full name", "Search", "Your password here", "", "mobile number", "Username", "Surname"], 13, 2),
    "content": pick(["Login", "  Sign\t up\n now ", "Continue", None, "", "Contact mia@mail.example.org", "+91 98765 43210", "Search", "Pay 4111111111111111", "Submit order"], 7, 5),
    "alt": pick([None, "Portrait  of  Mia", "", "logo"], 3, 1),
    "raw_value": pick([None, "hunter2", "mia@mail.example.org", "Jane Doe", "[REDACTED]", ""], 5, 2),
    "has_value": pick([True, False, True, True], 3, 1),
    "has_href": pick([True, False, True], 2, 1),
    "hidden": pick([False, False, True, None, False, False, False], 3, 2),
    "display": pick(["block", "none", None, "inline", "flex", "block"], 5, 1),
    "visibility": pick(["visible", "hidden", None, "visible", "collapse", "visible", "visible"], 2, 3),
    "opacity": "CASE event_id % 9 WHEN 4 THEN CAST(0 AS DOUBLE) WHEN 7 THEN NULL ELSE CAST(1 AS DOUBLE) END",
    "aria_disabled": pick([None, "true", "false", None, None], 3, 1),
    "disabled": pick([False, False, None, True, False, False], 5, 1),
    "fieldset_disabled": pick([False, True, None, False, False], 2, 2),
    "in_first_legend": pick([False, True, None], 1, 1),
    "x": "CAST(event_id * 37 % 11 * 30 AS DOUBLE)",
    "y": "CAST(event_id * 53 % 7 * 24 AS DOUBLE)",
    "width": "CAST(event_id * 17 % 9 * 15 AS DOUBLE)",
    "height": "CAST(event_id * 29 % 5 * 12 + 6 AS DOUBLE)",
}

#: SQL of raw elements over ``events``: what an extractor finds before classification.
RAW_ELEMENTS = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _ELEMENTS.items()) + " FROM events"

_KIND = pick(["input", "button", "link", "input", "select", "textarea", "image", "text", "container", "checkbox", "unknown"], key="(snapshot_id * 8 + ord)")
#: SQL of extracted elements: classified, with an id, visible and enabled flags.
ELEMENTS = f"""
SELECT snapshot_id, ord, concat({_KIND}, '_', CAST(CASE WHEN ord = 6 THEN 2 ELSE ord END AS STRING)) AS id,
  {_KIND} AS type, tag_name, role, content AS text, raw_aria AS aria_label,
  raw_placeholder AS placeholder, CASE WHEN has_value THEN raw_value END AS value, has_value,
  lower(raw_type) AS input_type, autocomplete, raw_name AS name, x, y, width, height,
  coalesce(NOT hidden, TRUE) AS visible, coalesce(NOT disabled, TRUE) AS enabled,
  CASE WHEN (snapshot_id * 8 + ord) % 10 = 3 THEN TRUE WHEN (snapshot_id * 8 + ord) % 10 = 5 THEN NULL ELSE FALSE END AS sensitive
FROM ({RAW_ELEMENTS}) AS raw
"""

_DET_TYPE = pick(["email", "text", "phone", "password", "face", "text", "name", "ui", "email", "username"], 3, 1)
#: SQL of detections over the same pages as the elements.
DETECTIONS = f"""
SELECT CAST(floor(event_id / 8.0) AS BIGINT) AS snapshot_id, CAST(event_id % 2 AS INT) AS group_no, CAST(event_id % 8 AS INT) AS ord,
  CASE event_id % 5 WHEN 0 THEN concat('det_input_', CAST(event_id % 8 AS STRING)) WHEN 1 THEN concat('input_', CAST(event_id % 8 AS STRING), '_', {_DET_TYPE})
    WHEN 2 THEN concat('det_select_', CAST(event_id % 8 AS STRING), '_', {_DET_TYPE}) ELSE concat('ocr_', CAST(event_id % 8 AS STRING)) END AS id,
  {_DET_TYPE} AS type, CAST(event_id * 37 % 11 * 28 AS DOUBLE) AS x, CAST(event_id * 53 % 7 * 23 AS DOUBLE) AS y,
  CAST(CASE WHEN event_id % 41 = 7 THEN -5 ELSE event_id * 19 % 6 * 20 + 10 END AS DOUBLE) AS width, CAST(event_id * 31 % 4 * 14 + 8 AS DOUBLE) AS height,
  CAST(50 + event_id % 50 AS DOUBLE) / 100 AS confidence, {pick(["ocr", "dom", "face", "ui_model"], 3)} AS source,
  {pick([None, "mia@mail.example.org", "Jane", "hunter2", "", "Login"], 5, 1)} AS text
FROM events
"""

#: SQL of boxes over ``lineitem``: one page an order, dense enough to overlap.
BOXES = """
SELECT l_orderkey AS snapshot_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS ord,
  CASE l_returnflag WHEN 'A' THEN 'email' WHEN 'N' THEN 'phone' ELSE 'text' END AS type,
  CAST(l_partkey % 5 * 8 AS DOUBLE) AS x, CAST(l_suppkey % 3 * 12 AS DOUBLE) AS y,
  CAST(10 + l_quantity AS DOUBLE) AS width, CAST(10 + l_linenumber * 4 AS DOUBLE) AS height,
  CAST(50 + l_linenumber * 5 + l_partkey % 5 AS DOUBLE) / 100 AS confidence
FROM lineitem
"""

#: SQL of tasks: one a page, in the words of the planner's grammar.
TASKS = f"""
SELECT event_id AS task_id, CAST(event_id AS BIGINT) AS snapshot_id, {pick([
    "Scroll down to the end", "  scroll up a bit ", "Tap the login link", "Find where to sign up now", "Press the Continue button",
    "tap submit order and click it", "Find it", "Select Norway", "select option IN", "Type good morning into the search field",
    "Type 'nora' in username", "type y into the field", "Sing", "Type into the name field", "please scroll down once more", "Press create account",
    "find the search button", "Type open sesame into password", "Tap button", "Type c d in the email box"])} AS task
FROM events
"""

#: SQL of raw actions as JSON, valid and invalid ones.
ACTIONS = f"""
SELECT event_id AS action_id, CAST(floor(event_id / 3.0) AS BIGINT) AS snapshot_id, {pick([
    '{"type":"click","target":{"elementId":"button_1"}}', '{"type":"click","target":{"elementId":"  "}}', '{"type":"click","target":{"x":40,"y":30.5}}',
    '{"type":"click","target":{"x":"1","y":2}}', '{"type":"click"}', '{"type":"scroll","direction":"down","amount":500}',
    '{"type":"scroll","direction":"left","amount":5}', '{"type":"scroll","direction":"up","amount":1001}', '{"type":"scroll","direction":"up","amount":"7"}',
    '{"type":"type","target":{"elementId":"input_0"},"value":"hi"}', '{"type":"type","target":{"elementId":"input_3"},"value":5}',
    '{"type":"select","target":{"elementId":"select_4"},"value":"Norway"}', '{"type":"navigate","url":"https://example.org/a b"}',
    '{"type":"navigate","url":"javascript:alert(1)"}', '{"type":"navigate","url":"http://"}', '{"type":"eval","code":"1"}', '[1]', '{"type":"click","target":null}',
    '{"type":"click","target":{"elementId":"link_2"},"extra":1}', '{"type":"type","target":{"x":10,"y":12},"value":"q"}', '{"type":"navigate","url":" https://x.example "}',
    '{"type":"type","target":{"elementId":"missing_9"},"value":"z"}', '{"type":"click","target":{"elementId":7}}'])} AS action_json
FROM events
"""


#: SQL of pictures over ``part``, a row a byte: RGBA of a few pixels each.
PIXELS = """
SELECT snapshot_id, width, height, i, i % 4 AS c, (i // 4) % width AS x, i // 4 // width AS y, CASE WHEN i % 4 = 3 THEN 255 ELSE (snapshot_id * 7 + i * 31 + i * i * 3) % 256 END AS v
FROM (SELECT p_partkey AS snapshot_id, (4 + p_partkey % 5)::INT AS width, (3 + p_partkey % 4)::INT AS height, unnest(range((4 + p_partkey % 5) * (3 + p_partkey % 4) * 4)) AS i FROM part)
"""


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The same rows over all shuffle partitions: a table of a few narrow columns is read by a task or two, however much work its rows are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot_id, data, width, height): the pictures of PIXELS as RGBA buffers."""
    at, x = F.col("p_partkey"), lambda i: i.cast("long")
    keys = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    rows = keys.select(at.alias("snapshot_id"), (4 + at % 5).cast("int").alias("width"), (3 + at % 4).cast("int").alias("height"))
    place = F.sequence(F.lit(0), F.col("width") * F.col("height") * 4 - 1)
    value = F.transform(place, lambda i: F.when(i % 4 == 3, F.lit(255)).otherwise((F.col("snapshot_id") * 7 + x(i) * 31 + x(i) * x(i) * 3) % 256))
    data = F.unhex(F.array_join(F.transform(value, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return rows.select("snapshot_id", data.alias("data"), "width", "height")


def view(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    """Runs a view's SQL with its source table bound, without touching the session's catalog."""
    for case, array in _AS_ARRAY.items():
        sql = sql.replace(case, array)
    sql = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))


def raw_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RAW_ELEMENTS, "events")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ELEMENTS, "events")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DETECTIONS, "events")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, BOXES, "lineitem")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TASKS, "events")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ACTIONS, "events")
