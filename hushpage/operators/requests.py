"""Plan requests: the closed schema that lets no value and no screenshot through."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushpage.functions.text import js_trim


@dataclass(frozen=True)
class Text:
    """A string of at least ``least`` characters, one of ``among`` if that is given."""

    least: int = 0
    among: tuple[str, ...] = ()


@dataclass(frozen=True)
class Number:
    """A finite number, or a string of one, within bounds; ``above`` itself is outside."""

    least: float | None = None
    most: float | None = None
    above: float | None = None
    whole: bool = False


@dataclass(frozen=True)
class Flag:
    """true or false."""


@dataclass(frozen=True)
class Items:
    """An array of one kind of value."""

    of: object


@dataclass(frozen=True)
class Record:
    """An object that has all of ``must``, maybe some of ``may`` (null counts as left out), and no other key."""

    must: dict = field(default_factory=dict)
    may: dict = field(default_factory=dict)


#: The request schema, level by level.
BBOX = Record({"x": Number(), "y": Number(), "width": Number(), "height": Number()})
ELEMENT = Record(
    {
        "id": Text(1),
        "type": Text(among=("button", "input", "textarea", "select", "checkbox", "radio", "link", "image", "text", "container", "unknown")),
        "tagName": Text(1), "bbox": BBOX, "visible": Flag(), "enabled": Flag(),
    },
    {"role": Text(), "text": Text(), "ariaLabel": Text(), "placeholder": Text(), "inputType": Text(), "sensitive": Flag()},
)
REGION = Record({"id": Text(1), "type": Text(), "bbox": BBOX, "confidence": Number(0, 1), "sources": Items(Text()), "redaction": Text(among=("blur", "mask", "remove"))})
VIEWPORT = Record({"width": Number(above=0), "height": Number(above=0)}, {"devicePixelRatio": Number(above=0)})
BROWSER = Record({"url": Text(), "title": Text(), "viewport": VIEWPORT, "scrollX": Number(), "scrollY": Number()})
STATISTICS = Record({name: Number(0, whole=True) for name in ("totalDetections", "sensitiveDetections", "redactedRegions")})
SNAPSHOT = Record({"elements": Items(ELEMENT)}, {"documentWidth": Number(), "documentHeight": Number()})
REST = Record({"browser": BROWSER, "statistics": STATISTICS}, {"sanitizedDom": SNAPSHOT, "sensitiveRegions": Items(REGION)})
REQUEST = Record({"task": Text(1), "context": REST})


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def fits(v: Column, schema) -> Column:
    """Whether a variant follows a schema; false, never null, where it is missing or of another type."""
    kind = _kind(v)
    if isinstance(schema, Text):
        text = F.try_variant_get(v, "$", "string")
        good = F.length(text) >= schema.least
        return F.coalesce((kind == "STRING") & (text.isin(*schema.among) if schema.among else good), F.lit(False))
    if isinstance(schema, Number):
        x = F.try_variant_get(v, "$", "double")
        good = kind.rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL|STRING)") & ~F.isnan(x) & (F.abs(x) < float("inf"))
        for bound, test in ((schema.least, x >= F.lit(schema.least)), (schema.most, x <= F.lit(schema.most)), (schema.above, x > F.lit(schema.above))):
            good = good & test if bound is not None else good
        return F.coalesce(good & (x == F.floor(x)) if schema.whole else good, F.lit(False))
    if isinstance(schema, Flag):
        return kind == "BOOLEAN"
    if isinstance(schema, Items):
        items = F.try_variant_get(v, "$", "array<variant>")
        return F.coalesce(kind.startswith("ARRAY") & F.forall(items, lambda item: fits(item, schema.of)), F.lit(False))
    at = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    allowed = F.array(*map(F.lit, (*schema.must, *schema.may)))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
    good = kind.startswith("OBJECT") & (F.size(F.array_except(keys, allowed)) == 0)
    for name, inner in schema.must.items():
        good = good & fits(at(name), inner)
    for name, inner in schema.may.items():
        good = good & (at(name).isNull() | (_kind(at(name)) == "VOID") | fits(at(name), inner))
    return F.coalesce(good, F.lit(False))


def request_code(body: Column) -> Column:
    """Null for a request that the schema accepts, else the first level that it breaks.

    Whatever cannot be read or has another type than it should is refused: NOT_AN_OBJECT, BAD_TASK (missing, blank or no
    string), BAD_BROWSER, BAD_DOM, BAD_REGIONS, BAD_STATISTICS, or UNKNOWN_KEY for a key beside these.
    """
    v = F.try_parse_json(body)
    at = lambda path: F.try_variant_get(v, path, "variant")
    task = at("$.task")
    blank = F.length(js_trim(F.try_variant_get(task, "$", "string"))) == 0
    absent = lambda path: at(path).isNull()
    empty = lambda path: absent(path) | (_kind(at(path)) == "VOID")
    keys = lambda path, schema: F.size(F.array_except(F.map_keys(F.try_variant_get(v, path, "map<string, variant>")), F.array(*map(F.lit, (*schema.must, *schema.may))))) == 0
    return (
        F.when(~_kind(v).startswith("OBJECT"), "NOT_AN_OBJECT")
        .when(~fits(task, Text(1)) | F.coalesce(blank, F.lit(True)), "BAD_TASK")
        .when(~F.coalesce(keys("$", REQUEST) & _kind(at("$.context")).startswith("OBJECT") & keys("$.context", REST), F.lit(False)), "UNKNOWN_KEY")
        .when(~fits(at("$.context.browser"), BROWSER), "BAD_BROWSER")
        .when(~empty("$.context.sanitizedDom") & ~fits(at("$.context.sanitizedDom"), SNAPSHOT), "BAD_DOM")
        .when(~absent("$.context.sensitiveRegions") & ~fits(at("$.context.sensitiveRegions"), Items(REGION)), "BAD_REGIONS")
        .when(~fits(at("$.context.statistics"), STATISTICS), "BAD_STATISTICS")
    )


def split_requests(requests: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with code) rows of requests with a JSON body."""
    rows = requests.withColumn("code", request_code(F.col(body)))
    return rows.where("code IS NULL").drop("code"), rows.where("code IS NOT NULL")


def dispatch(messages: DataFrame, kinds: list[str]) -> dict[str, DataFrame]:
    """Messages by their type, one DataFrame a kind."""
    return {k: messages.where(F.col("type") == k) for k in kinds}


def model_output_code(body: Column) -> Column:
    """Null for a model's plan that the closed schema accepts: an action, and maybe an explanation and a confidence within 0 and 1."""
    v = F.try_parse_json(body)
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
    at = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    given = lambda name: ~(at(name).isNull() | (_kind(at(name)) == "VOID"))
    known = F.size(F.array_except(keys, F.array(*map(F.lit, ("action", "explanation", "confidence"))))) == 0
    return (
        F.when(~_kind(v).startswith("OBJECT"), "NOT_AN_OBJECT")
        .when(~F.coalesce(known, F.lit(False)), "UNKNOWN_KEY")
        .when(~_kind(at("action")).startswith("OBJECT"), "NO_ACTION")
        .when(given("explanation") & ~fits(at("explanation"), Text()), "BAD_EXPLANATION")
        .when(given("confidence") & ~fits(at("confidence"), Number(0, 1)), "BAD_CONFIDENCE")
    )


def browser_state(pages: DataFrame) -> DataFrame:
    """url, title, viewport and scroll position of pages, with the values that a page without them has."""
    zero = F.lit(0.0)
    view = F.struct(*[F.coalesce(c, zero).alias(c) for c in ("width", "height")], F.coalesce("ratio", F.lit(1.0)).alias("devicePixelRatio"))
    return pages.select(
        "snapshot_id", F.coalesce("url", F.lit("about:blank")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), view.alias("viewport"),
        *[F.coalesce(c, zero).alias(c) for c in ("scroll_x", "scroll_y")],
    )
