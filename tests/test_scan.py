"""The HTML scan: inherited visibility, paint order, left-out end tags; what points and keys can reach in dry runs; labels of winding lines."""

import json
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hushpage.operators.actions import simulate_actions
from hushpage.operators.extract import elements_of_scan
from hushpage.operators.ids import element_ids
from hushpage.operators.observe import observe_tabs
from hushpage.operators.spatial import overlapping
from hushpage.operators.vision import _label
from hushpage.plans import html_queries
from hushpage.sources.html_scan import scan, style_of
from hushpage.sources.pages import scan_html

HIDDEN = [
    "<div hidden><a href=x>T</a></div>",
    "<h2 style='display:none'>T</h2>",
    "<div style='Display : NONE ;'><p><a href=x>T</a></div>",
    "<h2 style='display:none !important; display:block'>T</h2>",
    "<div style='visibility:hidden'><b><a href=x>T</a></b></div>",
    "<h1 style='visibility: collapse'>T</h1>",
    "<div style='opacity:0'><h2 style='opacity:1'>T</h2></div>",
    "<h2 style='opacity: 0%'>T</h2>",
    "<details><summary>s</summary><a href=x>T</a></details>",
    "<dialog><a href=x>T</a></dialog>",
    "<noscript><a href=x>T</a></noscript>",
    "<template><a href=x>T</a></template>",
    "<div hidden style='display:none'><h2 style='display:block'>T</h2></div>",
    "<h2 hidden style='display:block'>T</h2>",
    "<ul><li hidden><a href=x>T</a></ul>",
]
SHOWN = [
    "<div hidden>x</div><a href=x>T</a>",
    "<div style='visibility:hidden'><h2 style='visibility:visible'>T</h2></div>",
    "<div hidden style='display:flex'><a href=x>T</a></div>",
    "<details open><summary>s</summary><a href=x>T</a></details>",
    "<details><summary><a href=x>T</a></summary>r</details>",
    "<dialog open><a href=x>T</a></dialog>",
    "<p hidden>gone<h2>T</h2>",
    "<ul><li hidden>gone<li><a href=x>T</a></ul>",
    "<table><tr><td hidden>gone<td><a href=x>T</a></table>",
    "<div style='opacity:.5'><a href=x>T</a></div>",
    "<h2 style='display:none; display:block'>T</h2>",
    "<input hidden><a href=x>T</a>",
]


@pytest.fixture(scope="module")
def vectors(spark):
    pages = spark.createDataFrame(list(enumerate(HIDDEN + SHOWN)), "page_id long, html string")
    rows = elements_of_scan(scan_html(pages)).where("text = 'T'").collect()
    return {r.snapshot_id: r.visible for r in rows}


@pytest.mark.parametrize("n", range(len(HIDDEN) + len(SHOWN)))
def test_visibility(vectors, n):
    assert vectors[n] is (n >= len(HIDDEN))


def test_styles():
    assert style_of("a:1;b : 2 ! important; b:3; c; :4; d:") == {"a": "1", "b": "2"}
    assert style_of(None) == {}


def order(html):
    """Ids of the candidates from the lowest to the topmost."""
    rows = [r for r in scan(html) if r[-1] is not None]
    return [r[3] for r in sorted(rows, key=lambda r: r[-1])]


A = "<a href=x id={} style='{}'>"


def a(name, style="", inside=""):
    return A.format(name, style) + inside + "</a>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (a("p") + a("q"), "p q"),
        (a("p", "position:relative") + a("q"), "q p"),
        (a("p", "position:absolute;z-index:2") + a("q", "position:absolute;z-index:1"), "q p"),
        (a("p") + a("q", "position:relative;z-index:-1"), "q p"),
        (a("p", "z-index:9") + a("q"), "p q"),
        (a("p", "position:relative;z-index:1", "<div>" + a("r", "position:absolute;z-index:99") + "</div>") + a("q", "position:relative;z-index:2"), "p r q"),
        (a("p", "position:relative", a("r", "position:absolute;z-index:5")) + a("q", "position:relative;z-index:1"), "p q r"),
        (a("p", "opacity:.9", a("r", "position:relative;z-index:5")) + a("q", "position:relative"), "p r q"),
        (a("p", "transform:scale(2)") + a("q"), "q p"),
        (a("p", "position:fixed") + a("q", "position:relative"), "p q"),
        (a("p", "pointer-events:none") + a("q") + a("r", "visibility:hidden") + a("s", "opacity:0"), "q s"),
        ("<div style='position:relative;z-index:-1'>" + a("p") + a("q", "position:relative;z-index:3") + "</div>" + a("r"), "p q r"),
    ],
)
def test_paint_order(html, want):
    assert order(html) == want.split()


def test_points_hit_what_is_on_top_and_fixed_fields_take_no_text(spark):
    fields = "snapshot_id long, ord int, id string, tag_name string, input_type string, enabled boolean, visible boolean, options array<string>, x double, y double, width double, height double, paint int, readonly boolean, contenteditable string"
    row = lambda i, tag, kind, paint, readonly=False, free=None: (1, i, f"e{i}", tag, kind, True, True, [], 0.0, 0.0, 50.0, 50.0, paint, readonly, free)
    page = spark.createDataFrame([row(0, "INPUT", "text", 5), row(1, "DIV", None, 2), row(2, "DIV", None, None), row(3, "INPUT", "text", 1, True), row(4, "DIV", None, 0, False, "TRUE"), row(5, "TEXTAREA", None, 3, None, "false")], fields)
    asked = [{"type": "type", "target": {"x": 9, "y": 9}, "value": "v"}, *({"type": "type", "target": {"elementId": f"e{i}"}, "value": "v"} for i in (1, 3, 4, 5)), {"type": "scroll", "direction": "up", "amount": 70}, {"type": "scroll", "direction": "down", "amount": 5}, {"type": "scroll", "direction": "down", "amount": 5000}]
    acts = spark.createDataFrame([(i, 1, json.dumps(x)) for i, x in enumerate(asked)], "action_id long, snapshot_id long, action_json string")
    got = {r.action_id: (r.error_code, r.delta) for r in simulate_actions(acts, page).collect()}
    no = "TARGET_NOT_INTERACTABLE"
    assert [got[i] for i in range(8)] == [(None, None), (no, None), (no, None), (None, None), (None, None), (None, -70.0), (None, 5.0), ("INVALID_ACTION", None)]


def plain_label(above):
    """Flood fill, pixel by pixel."""
    out = np.full(above.shape, -1)
    for y, x in zip(*np.nonzero(above)):
        if out[y, x] < 0:
            name, todo = y * above.shape[1] + x, [(y, x)]
            while todo:
                j, i = todo.pop()
                if 0 <= j < above.shape[0] and 0 <= i < above.shape[1] and above[j, i] and out[j, i] < 0:
                    out[j, i] = name
                    todo += [(j - 1, i), (j + 1, i), (j, i - 1), (j, i + 1)]
    return out


def test_labels():
    r = np.random.default_rng(4)
    for shape in ((1, 1), (1, 9), (9, 1), (13, 17), (30, 30)):
        for share in (0.0, 0.4, 0.6, 1.0):
            above = r.random(shape) < share
            assert np.array_equal(_label(above), plain_label(above))
    winding = np.zeros((512, 512), dtype=bool)
    winding[::2] = True
    winding[1::4, -1] = winding[3::4, 0] = True
    began = time.process_time()
    assert set(np.unique(_label(winding)).tolist()) == {-1, 0}
    comb = np.zeros((512, 512), dtype=bool)
    comb[:, ::2] = comb[-1] = True
    assert set(np.unique(_label(comb)).tolist()) == {-1, 0} and time.process_time() - began < 3


def test_many_equal_candidates_take_time_in_proportion(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("snapshot_id"), F.col("id").cast("int").alias("ord"), F.lit("input").alias("type"), F.lit("x").alias("dom_id"), F.lit(None).cast("string").alias("raw_name"))
    began = time.time()
    got = element_ids(rows).orderBy("ord").collect()
    assert [got[0].id, got[1].id, got[-1].id] == ["input_x", "input_x_2", "input_x_20000"] and time.time() - began < 30


def test_grid_pairs_equal_all_pairs_and_stay_few(spark):
    r = np.random.default_rng(7)
    def box(p, i, size):
        return p, i, *(float(v) for v in (*r.integers(-200, 200, 2), *r.integers(1, size, 2)))
    rows = [box(1, i, 30) for i in range(150)] + [box(2, i, 200) for i in range(90)] + [box(3, i, 9) for i in range(20)] + [(1, 500, -500.0, -500.0, 2000.0, 2000.0), (1, 501, 0.0, 0.0, 0.0, 5.0), (2, 502, float("nan"), 0.0, 5.0, 5.0), (None, 1, 0.0, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "snapshot_id long, ord int, x double, y double, width double, height double")
    good = [b for b in rows if b[0] and b[4] > 0 and b[2] == b[2]]
    want = sorted((p[0], p[1], q[1]) for p in good for q in good if p[0] == q[0] and p[1] < q[1] and min(p[2] + p[4], q[2] + q[4]) > max(p[2], q[2]) and min(p[3] + p[5], q[3] + q[5]) > max(p[3], q[3]))
    for few in (0, 64, 10_000):
        got = overlapping(df, df, F.col("a.ord") < F.col("b.ord"), few).select("a.snapshot_id", "a.ord", F.col("b.ord").alias("other"))
        assert sorted(map(tuple, got.collect())) == want
    apart = spark.range(60_000).select(F.lit(1).alias("snapshot_id"), F.col("id").alias("ord"), (F.col("id") % 300 * 10.0).alias("x"), (F.floor(F.col("id") / 300) * 10.0).alias("y"), F.lit(11.0).alias("width"), F.lit(9.0).alias("height"))
    began = time.time()
    assert overlapping(apart, apart, F.col("a.ord") < F.col("b.ord")).count() == 200 * 299 and time.time() - began < 60


def test_observation_codes(spark):
    state = "available boolean, tab_id long, url string, data_url string, answered boolean, state_given boolean, tab_width double, tab_height double, viewport struct<width: double, height: double, devicePixelRatio: double>"
    good = (True, 1, "https://x.example", "data:", True, True, 5.0, 6.0, (7.0, 0.0, None))
    rows = [good, *[(*good[:i], v, *good[i + 1 :]) for i, v in enumerate((False, None, "about:blank", "", None, False))], (*good[:2], None, *good[3:]), (None,) * 9]
    got = observe_tabs(spark.createDataFrame(rows, state)).collect()
    assert [r.code for r in got] == [None, "UNKNOWN_ERROR", "NO_ACTIVE_TAB", "RESTRICTED_URL", "CAPTURE_FAILED", "CONTENT_SCRIPT_UNAVAILABLE", "DOM_EXTRACTION_FAILED", "RESTRICTED_URL", "UNKNOWN_ERROR"]
    assert (got[0].width, got[0].height, got[0].ratio) == (7.0, 6.0, 1.0) and got[1].width is None


def test_strict_scan_leaves_references_without_a_semicolon(spark):
    html = "<h1>a &amp;&lt; b &amp</h1><h1>&#65;&#65 &am</h1><a href='?a=1&amp;b=2'>x &lt</a>"
    assert [r[9] for r in scan(html)] == ["a &< b &", "AA &am", "x <"]
    assert [r[9] for r in scan(html, strict=True)] == ["a &< b &amp", "A&#65 &am", "x &lt"]


def test_html_elements_of_cut_titles_equal_the_sql(spark, tmp_path):
    rows = [(1, "https://x.example", "<h1>one &amp;&amp</h1><a href=\"/a\">two &lt;&lt</a>"), (2, "https://x.example", "<h1>three &quot;&am</h1>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(f"SELECT snapshot_id, ord, text, width FROM ({html_queries.ORACLES['html_elements']}) ORDER BY 1, 2").fetchall()
    got = html_queries.html_elements(spark, str(tmp_path)).select("snapshot_id", "ord", "text", "width").orderBy("snapshot_id", "ord").collect()
    assert [tuple(r) for r in got] == want and len(want) == 3
