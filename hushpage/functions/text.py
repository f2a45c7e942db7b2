"""Scalar text rules as Columns: trimming, e-mail and phone grammar, identifiers, addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers trim it. Fixed values of the trimming rule.
JS_SPACE = "\\s\\x{00A0}\\x{FEFF}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
#: A word boundary between ASCII word characters; Java's own is Unicode-aware.
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

#: Fixed grammar of addresses and numbers: which alternative comes first decides which text is the first hit. Character classes
#: are spelt out in ASCII, as Java's own are wider than those of browsers.
_SEP = f"[-.{JS_SPACE}]"
EMAIL = f"{EDGE}[A-Za-z0-9._%+-]++@[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*\\.[A-Za-z]{{2,}}{EDGE}"
PHONE = "|".join(
    [
        f"(?:\\+?[0-9]{{1,3}}{_SEP}?)?(?:\\(?[0-9]{{3,5}}\\)?{_SEP}?)?[0-9]{{3,5}}{_SEP}?[0-9]{{4,5}}{EDGE}",
        f"(?:\\+[0-9]{{1,3}}{_SEP}?)?[0-9]{{5}}{_SEP}[0-9]{{5}}{EDGE}",
        f"{EDGE}[0-9]{{10}}{EDGE}",
    ]
)
#: Whatever the phone grammar finds has this in it; far cheaper to search for.
PHONE_CORE = f"[0-9]{{3}}{_SEP}?[0-9]{{4}}"
DATE = "^(?:[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})\\z"

#: Address prefixes of pages that may not be observed.
RESTRICTED_PREFIXES = ("chrome://", "chrome-extension://", "devtools://", "edge://", "about:", "view-source:")


def js_trim(text: Column) -> Column:
    """Both ends without white space, Unicode's included."""
    return F.regexp_replace(text, f"^[{JS_SPACE}]+|[{JS_SPACE}]+\\z", "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often it is used, in filters that Spark moves below it, too."""
    return F.get(F.transform(F.array(value), then), 0)


def normalize_text(text: Column, most: int = 200) -> Column:
    """White space runs become one space; trimmed, cut to ``most`` characters, null if nothing is left."""
    return F.nullif(F.substring(js_trim(F.regexp_replace(text, f"[{JS_SPACE}]+", " ")), 1, most), F.lit(""))


def _present(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_email(text: Column) -> Column:
    """Whether an e-mail address occurs in the text."""
    return _present(text.contains("@") & text.rlike(EMAIL))


def is_date(text: Column) -> Column:
    """Whether the trimmed text is a calendar date and nothing else."""
    return _present(js_trim(text).rlike(DATE))


def first_phone(text: Column) -> Column:
    """The first hit of the phone grammar, which white space at the ends cannot change; empty if there is none."""
    return F.regexp_extract(text, f"(?=[+(0-9])({PHONE})", 1)


def is_phone(text: Column) -> Column:
    """Whether the first hit of the phone grammar has 10 to 15 digits and the text is not a date."""
    digits = F.length(F.regexp_replace(first_phone(text), "[^0-9]", ""))
    return _present(text.rlike(PHONE_CORE) & digits.between(10, 15) & ~is_date(text))


def safe_identifier(text: Column, most: int = 32) -> Column:
    """Trimmed; other characters than letters, digits, _ and - become one underscore; cut to ``most``."""
    plain = F.regexp_replace(js_trim(text), "[^A-Za-z0-9_-]", "_")
    return F.substring(F.regexp_replace(plain, "_+", "_"), 1, most)


def is_restricted_url(url: Column) -> Column:
    """Whether an address is missing or belongs to the browser itself."""
    lowered = F.lower(js_trim(url))
    hit = F.lit(False)
    for prefix in RESTRICTED_PREFIXES:
        hit = hit | lowered.startswith(prefix)
    return url.isNull() | (url == "") | _present(hit)


#: Characters that a host may not have once the address is parsed, and those around it.
_HOST = "[^\\x00-\\x20\\x7F/\\\\?#:@<>\\[\\]^|%]"
_PORT = "(?::(?:[0-9]{0,4}|[0-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5]))?"
_IPV6 = "\\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\\]"
_AUTHORITY = f"(?i)^https?:[/\\\\]*(?:[^/\\\\?#]*@)?(?:{_HOST}+|{_IPV6}){_PORT}(?:[/\\\\?#]|\\z)"


def is_navigable_url(url: Column) -> Column:
    """Whether an address parses, as browsers do it, with the scheme http or https and a host.

    Controls and spaces at the ends, and tabs and line breaks anywhere, are dropped first. The host has no space or other forbidden
    character, the port is a number up to 65535. A host that ends in a number must be four decimal parts of an IPv4 address; escapes in hosts are refused, too.
    """
    plain = F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+|[\\x00-\\x20]+\\z", ""), "[\\t\\n\\r]", "")
    host = F.regexp_extract(plain, f"(?i)^https?:[/\\\\]*(?:[^/\\\\?#]*@)?({_HOST}+)", 1)
    last = F.regexp_extract(host, "([^.]*)\\.?\\z", 1)
    part = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    address = host.rlike(f"^(?:{part}\\.){{3}}{part}\\.?\\z")
    return _present(plain.rlike(_AUTHORITY) & (~last.rlike("^(?:[0-9]+|0[xX][0-9A-Fa-f]*)\\z") | address))


def leaks_metadata(url: Column, title: Column) -> Column:
    """Whether the address carries a credential parameter with a value, or the title names one with an equals sign."""
    in_url = url.rlike("(?i)(?:password|pwd|secret|api_key|token)=[^&]+")
    in_title = title.rlike("(?i)(?:password|pwd|secret)=")
    return _present(in_url) | _present(in_title)
