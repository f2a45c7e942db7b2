"""Queries over text rules, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushpage.functions import text as T
from hushpage.sources.views import table

# RE2 has no look-around and an ASCII \b; white space is spelt out.
SPACE = r"\t\n\x0b\f\r \x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SEP = f"[-.{SPACE}]"
PHONE = (
    rf"(?:\+?[0-9]{{1,3}}{SEP}?)?(?:\(?[0-9]{{3,5}}\)?{SEP}?)?[0-9]{{3,5}}{SEP}?[0-9]{{4,5}}\b"
    rf"|(?:\+[0-9]{{1,3}}{SEP}?)?[0-9]{{5}}{SEP}[0-9]{{5}}\b|\b[0-9]{{10}}\b"
)


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_email(x: str) -> str:
    return rf"coalesce(regexp_matches({x}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9]+([.-][A-Za-z0-9]+)*\.[A-Za-z]{{2,}}\b'), FALSE)"


def sql_date(x: str) -> str:
    return f"coalesce(regexp_matches({sql_trim(x)}, '^([0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}|[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{4}})$'), FALSE)"


def sql_phone(x: str) -> str:
    hit = f"regexp_extract({sql_trim(x)}, '{PHONE}')"
    return f"coalesce(NOT {sql_date(x)} AND length(regexp_replace({hit}, '[^0-9]', '', 'g')) BETWEEN 10 AND 15, FALSE)"


def sql_normalize(x: str) -> str:
    return f"nullif(substr({sql_trim(f"regexp_replace({x}, '[{SPACE}]+', ' ', 'g')")}, 1, 200), '')"


def sql_restricted(x: str) -> str:
    return f"({x} IS NULL OR {x} = '' OR regexp_matches(lower({sql_trim(x)}), '^(chrome://|chrome-extension://|devtools://|edge://|about:|view-source:)'))"


def doc_privacy_summary(spark, sf_dir):
    """Each document as a page of one element: detect, redact, look for leaks, and count by language."""
    token = F.lit("[REDACTED]")
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    docs = docs.withColumn("kind", F.when(T.is_email(F.col("text")), "email").when(T.is_phone(F.col("text")), "phone"))
    docs = docs.withColumn("clean", F.when(F.col("kind").isNotNull(), token).otherwise(F.col("text")))
    leaked = F.col("kind").isNotNull() & (T.is_email(F.col("clean")) | T.is_phone(F.col("clean")))
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("kind") == "email").alias("emails"),
        F.count_if(F.col("kind") == "phone").alias("phones"),
        F.count_if(F.col("clean") == token).alias("redacted"),
        F.count_if(leaked).alias("leaks"),
    )


def email_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.is_email(F.col("text"))).select("doc_id", "lang")


def phone_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.is_phone(F.col("text"))).select("doc_id", T.first_phone(F.col("text")).alias("first_hit"))


def date_shape(spark, sf_dir):
    shown = F.date_format("o_orderdate", "yyyy-MM-dd")
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" on "), shown)).otherwise(shown).alias("t"))
    return texts.select("o_orderkey", T.is_date(F.col("t")).alias("is_date"), T.is_phone(F.col("t")).alias("is_phone"))


def normalized_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.normalize_text(F.col("text")).alias("label"))


def safe_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.safe_identifier(F.concat(F.lit(" "), F.col("p_name"), F.lit("!?"), F.col("p_type"))).alias("ident"))


def page_urls(spark, sf_dir):
    forms = [("", ""), ("chrome://", ""), ("  EDGE://", ""), ("view-source:", ""), ("", "?token=abc&x=1"), ("https:", "#password="), ("ftp://", "")]
    kind = F.col("page_id") % (len(forms) + 1)
    made = F.lit(None).cast("string")
    for i, (before, after) in enumerate(forms):
        made = F.when(kind == i, F.concat(F.lit(before), F.col("url"), F.lit(after))).otherwise(made)
    return table(spark, sf_dir, "pages").select("page_id", made.alias("url"), F.when(F.col("page_id") % 11 == 3, "My secret=1").otherwise("Home").alias("title"))


URLS = """
SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'chrome://' || url WHEN 2 THEN '  EDGE://' || url WHEN 3 THEN 'view-source:' || url
  WHEN 4 THEN url || '?token=abc&x=1' WHEN 5 THEN 'https:' || url || '#password=' WHEN 6 THEN 'ftp://' || url END AS url,
  CASE WHEN page_id % 11 = 3 THEN 'My secret=1' ELSE 'Home' END AS title FROM pages
"""


def restricted_urls(spark, sf_dir):
    return page_urls(spark, sf_dir).select("page_id", T.is_restricted_url(F.col("url")).alias("restricted"))


def metadata_leaks(spark, sf_dir):
    return page_urls(spark, sf_dir).where(T.leaks_metadata(F.col("url"), F.col("title"))).select("page_id")


#: Addresses and whether a browser could navigate to them, decided by hand.
NAVIGABLE = [
    ("https://example.org/a b?c d#e f", True), ("HTTP://x", True), (" https://x.example \t", True), ("https:example.org", True), ("https:\\\\back.example\\y", True),
    ("http://user:pw@host.example:8080/p", True), ("http://x:", True), ("http://x:65535", True), ("http://[2001:db8::1]:80/", True), ("http://10.0.0.1/", True),
    ("https://exa\tmple.org", True), ("https://b\u00fccher.example", True), ("http://x:99999", False), ("http://a:port", False), ("https://exa mple.org", False),
    ("http://[bad", False), ("http://[bad]", False), ("http://300.1.1.1", False), ("http://", False), ("https://?q", False), ("http://@/", False), ("http://:80", False), ("http://a<b", False),
    ("javascript:alert(1)", False), ("ftp://x", False), ("example.org", False), ("//example.org", False), ("", False), ("   ", False), (None, False),
]


def navigable_urls(spark, sf_dir):
    """Each page's own address, and one of a list."""
    own = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = F.get(F.array(*[F.lit(u) for u, _ in NAVIGABLE]), (F.col("page_id") % len(NAVIGABLE)).cast("int"))
    return own.select("page_id", T.is_navigable_url(F.col("url")).alias("own"), T.is_navigable_url(listed).alias("navigable"))


QUERIES = {
    f.__name__: f
    for f in (doc_privacy_summary, email_docs, phone_docs, date_shape, normalized_text, safe_identifiers, restricted_urls, metadata_leaks, navigable_urls)
}

ORACLES = {
    "doc_privacy_summary": f"""
        WITH d AS (SELECT lang, text, CASE WHEN {sql_email("text")} THEN 'email' WHEN {sql_phone("text")} THEN 'phone' END AS kind FROM documents)
        SELECT lang, count(*) AS documents, count(*) FILTER (WHERE kind = 'email') AS emails, count(*) FILTER (WHERE kind = 'phone') AS phones,
          count(*) FILTER (WHERE kind IS NOT NULL OR text = '[REDACTED]') AS redacted, 0::BIGINT AS leaks FROM d GROUP BY lang""",
    "email_docs": f"SELECT doc_id, lang FROM documents WHERE {sql_email('text')}",
    "phone_docs": f"SELECT doc_id, regexp_extract({sql_trim('text')}, '{PHONE}') AS first_hit FROM documents WHERE {sql_phone('text')}",
    "date_shape": f"""
        WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ' on ' ELSE '' END || strftime(o_orderdate, '%Y-%m-%d') AS t FROM orders)
        SELECT o_orderkey, {sql_date("t")} AS is_date, {sql_phone("t")} AS is_phone FROM t""",
    "normalized_text": f"SELECT doc_id, {sql_normalize('text')} AS label FROM documents",
    "safe_identifiers": f"""
        SELECT p_partkey, substr(regexp_replace(regexp_replace({sql_trim("' ' || p_name || '!?' || p_type")}, '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g'), 1, 32) AS ident
        FROM part""",
    "restricted_urls": f"SELECT page_id, {sql_restricted('url')} AS restricted FROM ({URLS})",
    "metadata_leaks": f"""
        SELECT page_id FROM ({URLS}) WHERE coalesce(regexp_matches(url, '(password|pwd|secret|api_key|token)=[^&]+', 'i'), FALSE)
          OR coalesce(regexp_matches(title, '(password|pwd|secret)=', 'i'), FALSE)""",
    "navigable_urls": f"""
        SELECT page_id, coalesce(starts_with(url, 'https://') OR starts_with(url, 'http://'), FALSE) AS own, page_id % {len(NAVIGABLE)} IN ({", ".join(str(i) for i, (_, good) in enumerate(NAVIGABLE) if good)}) AS navigable
        FROM pages""",
}
