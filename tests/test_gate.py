"""The fail-closed gate over all its phases, against SQL written from the contract of verifySanitizedDom."""

from pathlib import Path

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from hushpage.operators import guard, redact, sanitize
from hushpage.plans import page_queries as q

SF = "/root/testdata/sf0.001"


def test_passing_contexts_blocks_leaks_of_sanitised_elements(spark):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    con.execute(f"CREATE TABLE clean AS {q._clean_sql()}")
    leaking = f"""
        SELECT c.snapshot_id FROM clean AS c JOIN {q.DET} AS d USING (snapshot_id)
        WHERE d.type IN {q.SENS} AND length(d.text) > 0 AND (coalesce(contains(c.value, d.text), FALSE) OR coalesce(contains(c.text, d.text), FALSE))
        UNION SELECT c.snapshot_id FROM clean AS c JOIN (SELECT snapshot_id, id, arg_max({q.IS_PASSWORD}, ord) AS pw FROM {q.EL} GROUP BY ALL) AS r USING (snapshot_id, id)
        WHERE c.value <> '[REDACTED]' AND (r.pw OR c.sensitive)"""
    entered = {r[0] for r in con.execute(f"SELECT page_id FROM pages WHERE page_id NOT IN (SELECT snapshot_id FROM ({q._INPUT}))").fetchall()}
    blocked = {r[0] for r in con.execute(leaking).fetchall()}
    assert entered & blocked and entered - blocked
    assert {r.snapshot_id for r in q.passing_contexts(spark, SF).collect()} == entered - blocked


ELEMENT = "snapshot_id long, ord int, id string, type string, tag_name string, role string, text string, aria_label string, placeholder string, value string, has_value boolean, input_type string, autocomplete string, name string, x double, y double, width double, height double, visible boolean, enabled boolean, sensitive boolean"
DETECTION = "snapshot_id long, ord int, id string, type string, x double, y double, width double, height double, confidence double, sources array<string>, text string"


def parts(spark, pages, texts=("plain", "note"), secret="hunter2"):
    """Pages, screenshots, elements and detections; nothing wrong with any page."""
    element = lambda p, i, t: (p, i, f"text_{i}", "text", "H2", None, t, None, None, None, False, None, None, None, 0.0, 40.0 * i, 9.0, 9.0, True, True, False)
    return (
        spark.createDataFrame([(p, "https://x.example", "t", True) for p in pages], "snapshot_id long, url string, title string, has_elements boolean"),
        spark.createDataFrame([(p, bytes([p or 0, 1, 1, 255] * 16), 4, 4) for p in pages], "snapshot_id long, data binary, width int, height int"),
        spark.createDataFrame([element(p, i, t) for p in pages for i, t in enumerate(texts)], ELEMENT),
        spark.createDataFrame([(p, 0, "d", "password", 500.0, 500.0, 2.0, 2.0, 1.0, ["dom"], secret) for p in pages], DETECTION),
    )


def codes(pages, result):
    return {r.snapshot_id: r.code for r in guard.verdicts(pages, result.violations).collect()}


def test_silence_doubles_and_failures_block_their_pages_only(spark):
    given = parts(spark, range(8))
    assert codes(given[0], guard.sanitize(*given)) == dict.fromkeys(range(8))
    mask = lambda images: redact.redact_and_verify(images).where("snapshot_id <> 1").unionAll(redact.redact_and_verify(images).where("snapshot_id = 2"))
    twice = lambda e, d, o: sanitize.sanitize_elements(e, d, o).withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("snapshot_id") == 3).cast("int")))).where("snapshot_id <> 4 OR ord <> 0").drop("k")
    got = guard.sanitize(*given, mask=mask, clean_up=twice)
    want = dict.fromkeys(range(8)) | dict.fromkeys((1, 2), "SCREENSHOT_VERIFICATION_FAILURE") | dict.fromkeys((3, 4), "DOM_VERIFICATION_FAILURE")
    assert codes(given[0], got) == want
    assert {r.snapshot_id for r in got.contexts.collect()} == {0, 5, 6, 7}


def test_what_one_page_raises_blocks_that_page(spark):
    def painter(pixels, extents):
        assert pixels[0, 0, 0] != 2
        return pixels if pixels[0, 0, 0] != 3 else pixels[:1]

    def cleaner(rows, seen, options):
        if rows["snapshot_id"].iloc[0] == 4:
            raise ValueError
        return rows

    given = parts(spark, range(6))
    got = guard.sanitize(*given, mask=redact.each_page(painter), clean_up=sanitize.each_page(cleaner))
    want = {2: "REDACTION_EXECUTION_FAILURE", 3: "SCREENSHOT_VERIFICATION_FAILURE", 4: "DOM_SANITIZATION_EXECUTION_FAILURE"}
    assert codes(given[0], got) == dict.fromkeys(range(6)) | want


def test_a_failing_job_and_a_redactor_without_rows_block_every_page(spark):
    given = parts(spark, range(3))
    broken = lambda images: images.select("snapshot_id", F.raise_error(F.lit("x")).cast("binary").alias("data"), F.lit(0).alias("redacted"), F.lit(None).cast("string").alias("error"))
    assert set(codes(given[0], guard.sanitize(*given, mask=broken)).values()) == {"REDACTION_EXECUTION_FAILURE"}
    none = lambda images: redact.redact_and_verify(images).limit(0)
    got = guard.sanitize(*given, mask=none)
    assert set(codes(given[0], got).values()) == {"SCREENSHOT_VERIFICATION_FAILURE"} and got.contexts.count() == 0


def test_a_redactor_is_not_taken_at_its_word(spark):
    given = parts(spark, range(2))
    boxes = given[3].withColumns({c: F.lit(1.0) for c in ("x", "y", "width", "height")})
    lies = lambda images: images.select("snapshot_id", "data", F.lit(1).alias("redacted"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("code"))
    assert set(codes(given[0], guard.sanitize(*given[:3], boxes, mask=lies)).values()) == {"SCREENSHOT_UNMASKED_PIXELS"}


def test_pages_twice_without_id_or_without_screenshot(spark):
    given = parts(spark, [1, 2, None])
    pages = given[0].unionAll(given[0].where("snapshot_id = 1"))
    got = guard.sanitize(pages, *given[1:])
    assert codes(pages, got) == {1: guard.DEFAULT_CODE, 2: None, None: guard.DEFAULT_CODE}
    assert [r.snapshot_id for r in got.contexts.collect()] == [2]
    assert codes(given[0], guard.sanitize(given[0], given[1].limit(0), *given[2:]))[2] == "INVALID_SCREENSHOT"


def test_malformed_lists_and_unknown_flags(spark):
    pages, screens, elements, found = parts(spark, [1, 2])
    listed = pages.withColumn("has_detections", F.col("snapshot_id") == 2)
    assert codes(listed, guard.sanitize(listed, screens, elements, found)) == {1: "INVALID_DETECTIONS", 2: None}
    unknown = lambda e, d, o: sanitize.sanitize_elements(e, d, o).withColumns({"sensitive": F.lit(None).cast("boolean"), "value": F.lit("v")})
    assert set(codes(pages, guard.sanitize(pages, screens, elements, found, clean_up=unknown)).values()) == {"SENSITIVE_VALUE_LEAKAGE"}


@pytest.mark.parametrize("n_secrets", [3, 400])
def test_the_automaton_equals_pairs(spark, n_secrets):
    r = random.Random(n_secrets)
    word = lambda n: "".join(r.choices("abé", k=n))
    secrets = [word(r.randrange(5, 9)) for _ in range(n_secrets)]
    texts = [(p, i, r.choice([None, word(60)]), r.choice([None, word(30)])) for p in range(3) for i in range(200)]
    clean = spark.createDataFrame(texts, "snapshot_id long, ord int, value string, text string")
    seen = spark.createDataFrame([(i % 2, "email", s) for i, s in enumerate(secrets)] + [(2, "ui", "a"), (0, "email", ""), (0, "email", None)], "snapshot_id long, type string, text string")
    mine = {p: [s for i, s in enumerate(secrets) if i % 2 == p] for p in range(3)}
    want = sorted((p, i) for p, i, a, b in texts if any(s in (a or "") or s in (b or "") for s in mine[p]))
    for chunk in (7, 4096):
        assert sorted((x.snapshot_id, x.ord) for x in guard.secret_leaks(clean, seen, chunk).collect()) == want and want
