"""Validity of page actions given as JSON text, as Columns: the browser's rule and the server's stricter one.

Actions stay raw, because validation must see wrong JSON types. An action is parsed once into a variant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushpage.functions.text import is_navigable_url, js_trim

#: Limits of the action schema.
MOST_SCROLL, MOST_TEXT = 1000, 10_000
ALLOWED = ("click", "scroll", "type", "select", "navigate")
DENIED = ("executescript", "javascript", "eval", "shell", "command", "exec", "css_selector", "xpath")


def parsed(action_json: Column) -> Column:
    return F.try_parse_json(action_json)


def _kind(v: Column, path: str) -> Column:
    """Type of the value at a path: STRING, BIGINT, DOUBLE, OBJECT<...>, VOID ...; null if there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is_text(v: Column, path: str) -> Column:
    return F.coalesce(_kind(v, path) == "STRING", F.lit(False))


def _is_number(v: Column, path: str) -> Column:
    return F.coalesce(_kind(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def text_at(v: Column, path: str) -> Column:
    return F.when(_is_text(v, path), F.try_variant_get(v, path, "string"))


def number_at(v: Column, path: str) -> Column:
    return F.when(_is_number(v, path), F.try_variant_get(v, path, "double"))


def _has(v: Column, path: str) -> Column:
    return _kind(v, path).isNotNull()


def _keys(action_json: Column, path: str) -> Column:
    return F.coalesce(F.json_object_keys(F.get_json_object(action_json, path)), F.array().cast("array<string>"))


def valid_target(v: Column) -> Column:
    """An element id that is not blank, if one is given at all; else two finite coordinates."""
    by_id = F.coalesce(F.length(js_trim(text_at(v, "$.target.elementId"))) > 0, F.lit(False))
    by_place = _is_number(v, "$.target.x") & _is_number(v, "$.target.y")
    is_object = F.coalesce(_kind(v, "$.target").startswith("OBJECT"), F.lit(False))
    return is_object & F.when(_has(v, "$.target.elementId"), by_id).otherwise(by_place)


def _valid_scroll(v: Column) -> Column:
    amount = number_at(v, "$.amount")
    return text_at(v, "$.direction").isin("up", "down") & (amount > 0) & (amount <= MOST_SCROLL)


def client_valid(v: Column) -> Column:
    """Whether the browser accepts the action; keys it does not know are ignored."""
    kind = text_at(v, "$.type")
    value = F.length(text_at(v, "$.value")) <= MOST_TEXT
    ok = (
        F.when(kind == "click", valid_target(v))
        .when(kind == "scroll", _valid_scroll(v))
        .when(kind.isin("type", "select"), valid_target(v) & value)
        .when(kind == "navigate", is_navigable_url(text_at(v, "$.url")))
    )
    return F.coalesce(ok, F.lit(False))


def server_valid(v: Column, action_json: Column) -> Column:
    """Whether the server's closed schema accepts the action.

    Unknown keys are refused, an address needs a host, a blank element id passes, and numbers may be given as text.
    """
    kind = text_at(v, "$.type")

    def number(path: str) -> Column:
        return F.coalesce(number_at(v, path), F.try_variant_get(v, path, "string").try_cast("double"))

    fields = {"click": ["type", "target"], "scroll": ["type", "direction", "amount"], "type": ["type", "target", "value"], "select": ["type", "target", "value"], "navigate": ["type", "url"]}
    allowed = F.array().cast("array<string>")
    for name, keys in fields.items():
        allowed = F.when(kind == name, F.array(*map(F.lit, keys))).otherwise(allowed)
    closed = F.size(F.array_except(_keys(action_json, "$"), allowed)) == 0
    inside = _keys(action_json, "$.target")
    by_id = (F.size(F.array_except(inside, F.array(F.lit("elementId")))) == 0) & (F.length(text_at(v, "$.target.elementId")) > 0)
    by_place = (F.size(F.array_except(inside, F.array(F.lit("x"), F.lit("y")))) == 0) & number("$.target.x").isNotNull() & number("$.target.y").isNotNull()
    target = F.coalesce(by_id, F.lit(False)) | F.coalesce(by_place, F.lit(False))
    amount = number("$.amount")
    ok = (
        F.when(kind == "click", target)
        .when(kind == "scroll", text_at(v, "$.direction").isin("up", "down") & (amount > 0) & (amount <= MOST_SCROLL))
        .when(kind.isin("type", "select"), target & (F.length(text_at(v, "$.value")) <= MOST_TEXT))
        .when(kind == "navigate", js_trim(text_at(v, "$.url")).rlike("(?i)^https?://[^/?#]"))
    )
    return F.coalesce(closed & ok, F.lit(False))


def planned_code(kind: Column, url: Column, direction: Column, amount: Column) -> Column:
    """Null for a planned action that may be sent; else why not: denied, unknown, address or scroll bounds."""
    low = F.lower(kind)
    return (
        F.when(low.isin(*DENIED), "DENIED").when(~low.isin(*ALLOWED), "UNKNOWN_ACTION")
        .when((low == "navigate") & ~F.coalesce(url.rlike("(?i)^https?://[^/?#]"), F.lit(False)), "INVALID_URL")
        .when((low == "scroll") & ~F.coalesce(direction.isin("up", "down") & (amount > 0) & (amount <= MOST_SCROLL), F.lit(False)), "INVALID_SCROLL")
    )
