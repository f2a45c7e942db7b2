"""Scalar rules against hand-computed vectors."""

import math

import pytest
from pyspark.sql import functions as F

from hushpage.functions import actions as A
from hushpage.functions import geometry as G
from hushpage.functions import text as T
from hushpage.functions.elements import element_type
from hushpage.plans.text_queries import NAVIGABLE


def values(spark, rows, column, name="t"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(column(F.col(name))).collect()]


EMAILS = {
    "mia@mail.example.org": True, "Write to m.k+tag@a-b.example.co.uk now": True, "übob@x.com": True, "bob@x.comü": True,
    "mia@intranet": False, "@example.org": False, "mia@.org": False, "mia@@x.org": False, "": False, None: False,
}
PHONES = {
    "+49 30120 45678": True, "61234-87650": True, "(040) 2277-4410": True, "+44-207-946-0018": True, "069-1234567": True,
    "2024-02-29": False, "29/02/2024": False, "Born 1987-11-30 ok": False, "10.0.0.1": False, "12345": False, "4111111111111111": False,
    "378282246310005": True, "20240229 1200": True, "ref 1234567 call 9876543210": False, "98765 43210": True, None: False,
}


def test_email_and_phone(spark):
    assert values(spark, list(EMAILS), T.is_email) == list(EMAILS.values())
    assert values(spark, list(PHONES), T.is_phone) == list(PHONES.values())


def test_trim_and_normalize(spark):
    assert values(spark, ["  a\t b ﻿", "  ", None, "x" * 300], T.normalize_text) == ["a b", None, None, "x" * 200]
    assert values(spark, [" My id!! 9 ", "a__b-c"], T.safe_identifier) == ["My_id_9", "a_b-c"]


def test_urls(spark):
    restricted = {None: True, "": True, " Chrome://x": True, "about:blank": True, "https://chrome.example": False}
    assert values(spark, list(restricted), T.is_restricted_url) == list(restricted.values())
    assert values(spark, [u for u, _ in NAVIGABLE], T.is_navigable_url) == [good for _, good in NAVIGABLE]


def boxes(spark, rows):
    names = ", ".join(f"{p}{c} double" for p in "ab" for c in ("x", "y", "width", "height"))
    return spark.createDataFrame(rows, names)


def box(p):
    return G.Box(*(F.col(p + c) for c in ("x", "y", "width", "height")))


def test_geometry(spark):
    rows = [(0.0, 0.0, 100.0, 100.0, 50.0, 0.0, 100.0, 100.0), (0.0, 0.0, 10.0, 10.0, 20.0, 20.0, 5.0, 5.0), (0.0, 0.0, 10.0, 10.0, 2.0, 2.0, 4.0, 4.0)]
    got = boxes(spark, rows).select(G.iou(box("a"), box("b")), G.max_overlap(box("a"), box("b"))).collect()
    assert [round(r[0], 6) for r in got] == [0.333333, 0.0, 0.16] and [r[1] for r in got] == [0.5, 0.0, 1.0]
    bad = [math.nan, math.inf, -1.0, 0.0]
    rows = [(0.0, 0.0, w, 1.0) * 2 for w in bad] + [(math.nan, 0.0, 1.0, 1.0) * 2, (1.0, 1.0, 1.0, 1.0) * 2]
    assert [r[0] for r in boxes(spark, rows).select(G.is_valid_box(box("a"))).collect()] == [False] * 5 + [True]
    halves = spark.createDataFrame([(-2.5,), (2.5,), (-0.4,)], "v double").select(G.js_round(F.col("v"))).collect()
    assert [r[0] for r in halves] == [-2.0, 3.0, 0.0]


@pytest.mark.parametrize(
    ("action", "client", "server"),
    [
        ('{"type":"click","target":{"elementId":"b"}}', True, True), ('{"type":"click","target":{"elementId":" "}}', False, True),
        ('{"type":"click","target":{"x":1,"y":2.5}}', True, True), ('{"type":"click","target":{"x":"1","y":2}}', False, True),
        ('{"type":"scroll","direction":"down","amount":1000}', True, True), ('{"type":"scroll","direction":"down","amount":0}', False, False),
        ('{"type":"type","target":{"elementId":"b"},"value":3}', False, False), ('{"type":"navigate","url":"https://x.org"}', True, True),
        ('{"type":"navigate","url":"javascript:1"}', False, False), ('{"type":"click","target":{"elementId":"b"},"more":1}', True, False),
        ("[]", False, False), ("not json", False, False), ("null", False, False), ('{"target":{"elementId":"b"}}', False, False),
    ],
)
def test_actions(spark, action, client, server):
    df = spark.createDataFrame([(action,)], "j string").withColumn("v", A.parsed(F.col("j")))
    assert tuple(df.select(A.client_valid(F.col("v")), A.server_valid(F.col("v"), F.col("j"))).first()) == (client, server)


def test_element_types(spark):
    rows = [
        ("INPUT", None, None, False, "input"), ("input", "button", "hidden", False, None), ("A", None, None, True, "link"), ("A", "button", None, False, "button"),
        ("H3", None, None, False, "text"), ("DIV", "Heading", None, False, "text"), ("DIV", None, None, False, None), ("input", None, "SUBMIT", False, "button"),
    ]
    df = spark.createDataFrame(rows, "tag string, role string, kind string, href boolean, want string")
    got = df.select(element_type(F.col("tag"), F.col("role"), F.col("kind"), F.col("href")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
