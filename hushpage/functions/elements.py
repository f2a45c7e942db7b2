"""Rules on page elements as Columns: kind, sensitivity, text, visibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushpage.functions.text import js_trim, normalize_text

#: Substrings that mark a credential attribute, and those that may not enter an identifier.
CREDENTIAL_STEMS = ("password", "passwd", "secret", "token", "auth", "cookie", "cvv", "credit", "card", "ssn", "pin")
IDENTIFIER_STEMS = (*CREDENTIAL_STEMS, "key")


def _text(value: Column) -> Column:
    return F.lower(F.coalesce(value, F.lit("")))


def contains_any(value: Column, stems: tuple[str, ...]) -> Column:
    """Whether the lower-cased value contains one of the stems; null contains none."""
    return _text(value).rlike("|".join(stems))


def element_type(tag: Column, role: Column, input_type: Column, has_href: Column) -> Column:
    """The kind of an element, or null for those that are not kept. Tags come before roles."""
    t, r, i = _text(tag), _text(role), F.lower(F.coalesce(F.nullif(input_type, F.lit("")), F.lit("text")))
    by_input = (
        F.when(i.isin("checkbox", "radio", "image"), i).when(i.isin("button", "submit", "reset"), "button").when(i != "hidden", "input")
    )
    by_role = (
        F.when(r.isin("button", "checkbox", "radio", "link"), r)
        .when(r.isin("textbox", "searchbox"), "input")
        .when(r.isin("combobox", "listbox"), "select")
        .when(r == "img", "image")
        .when(r == "heading", "text")
        .when(t == "a", "link")
    )
    return (
        F.when(t == "input", by_input)
        .when(t.isin("button", "textarea", "select"), t)
        .when((t == "a") & has_href, "link")
        .when(t == "img", "image")
        .when(t.rlike("^h[1-6]\\z"), "text")
        .otherwise(by_role)
    )


def is_sensitive_element(input_type: Column, name: Column, autocomplete: Column, dom_id: Column) -> Column:
    hit = _text(input_type) == "password"
    for value in (name, autocomplete, dom_id):
        hit = hit | contains_any(value, CREDENTIAL_STEMS)
    return hit


def element_text(kind: Column, content: Column, alt: Column, most: int = 200) -> Column:
    """Visible text of buttons, links and headings, the alternative text of images, nothing for fields."""
    return F.when(kind == "image", normalize_text(alt, most)).when(kind.isin("button", "link", "text"), normalize_text(content, most))


def element_role(role: Column, tag: Column) -> Column:
    return F.coalesce(F.nullif(role, F.lit("")), F.when(F.upper(tag).startswith("H"), F.lit("heading")))


def trimmed_label(label: Column) -> Column:
    return F.nullif(js_trim(label), F.lit(""))


def effective_input_type(tag: Column, input_type: Column) -> Column:
    """Lower-cased type; an input without one is a text field."""
    given = F.lower(F.nullif(input_type, F.lit("")))
    return F.coalesce(given, F.when(_text(tag) == "input", F.lit("text")))


def is_visible(hidden: Column, display: Column, visibility: Column, opacity: Column, width: Column, height: Column) -> Column:
    shown = ~F.coalesce(hidden, F.lit(False)) & (_text(display) != "none") & ~_text(visibility).isin("hidden", "collapse")
    return F.coalesce(shown & (F.coalesce(opacity, F.lit(1.0)) != 0) & (width > 0) & (height > 0), F.lit(False))


def is_enabled(aria_disabled: Column, disabled: Column, fieldset_disabled: Column, in_first_legend: Column) -> Column:
    barred = F.coalesce(fieldset_disabled, F.lit(False)) & ~F.coalesce(in_first_legend, F.lit(False))
    return (_text(aria_disabled) != "true") & ~F.coalesce(disabled, F.lit(False)) & ~barred
