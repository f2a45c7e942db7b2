"""Order-dependent operators against plain sequential models, and streams against batches."""

import hashlib
import random

from pyspark.sql import functions as F

from hushpage.operators import detect, registry, sanitize
from hushpage.operators.fuse import FuseOptions, fuse_detections
from hushpage.operators.ids import element_ids
from hushpage.operators.vision import ctc_decode, suppress
from hushpage.sources import views
from hushpage.sources.pages import data_url_bytes, read_dictionary, read_screenshots, read_snapshots, scan_html
from hushpage.streaming import pages as streaming

SF = "/root/testdata/sf0.001"
SENSITIVE = {"email", "phone", "password", "name", "face"}


def overlap(a, b):
    w = min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
    shared = w * h if w > 0 and h > 0 else 0
    one, two = a["width"] * a["height"], b["width"] * b["height"]
    return shared / (one + two - shared), shared / min(one, two)


def test_fusion_equals_a_sequential_model(spark):
    r, rows = random.Random(4), []
    for page in range(60):
        for i in range(r.randrange(1, 12)):
            kind = r.choice(["email", "phone", "text", "password", "face", "ui"])
            rows.append((page, i % 2, i, f"d{i}", kind, float(r.randrange(60)), float(r.randrange(40)), float(r.randrange(5, 60)), float(r.randrange(5, 40)), r.random(), [r.choice(["ocr", "dom"])], r.choice([None, f"t{i}"])))
    schema = "snapshot_id long, group_no int, ord int, id string, type string, x double, y double, width double, height double, confidence double, sources array<string>, text string"
    df = spark.createDataFrame(rows, schema)
    names = [f.split()[0] for f in schema.split(", ")]
    for keep in (False, True):
        want = []
        for page in range(60):
            mine = sorted((dict(zip(names, x)) for x in rows if x[0] == page), key=lambda d: (d["type"] not in SENSITIVE, d["group_no"], d["ord"]))
            clusters = []
            for d in mine:
                best, at = 0, None
                for i, c in enumerate(clusters):
                    kinds = {c["type"], d["type"]}
                    fits = len(kinds) == 1 or ("text" in kinds and (kinds - {"text"}) <= SENSITIVE - {"face"})
                    iou, ioa = overlap(c, d)
                    if fits and (iou >= 0.3 or ioa >= 0.5) and max(iou, ioa) > best:
                        best, at = max(iou, ioa), i
                if at is None:
                    if d["type"] in SENSITIVE or keep:
                        clusters.append({**d, "text": None if d["type"] == "password" else d["text"]})
                    continue
                c = clusters[at]
                kind = d["type"] if c["type"] == "text" else c["type"]
                x, y = min(c["x"], d["x"]), min(c["y"], d["y"])
                clusters[at] = {
                    "type": kind, "x": x, "y": y, "width": max(c["x"] + c["width"], d["x"] + d["width"]) - x, "height": max(c["y"] + c["height"], d["y"] + d["height"]) - y,
                    "confidence": max(c["confidence"], d["confidence"]), "sources": list(dict.fromkeys(c["sources"] + d["sources"])),
                    "id": c["id"] if c["type"] != "text" else d["id"], "text": None if kind == "password" else (c["text"] if c["text"] is not None else d["text"]),
                }
            want += [(page, i, *(c[k] for k in ("type", "x", "y", "width", "height", "confidence", "sources", "id", "text"))) for i, c in enumerate(clusters)]
        got = fuse_detections(df.repartition(3), FuseOptions(keep_generic=keep)).collect()
        assert sorted(map(tuple, got), key=lambda t: t[:2]) == sorted(want, key=lambda t: t[:2])


def test_suppression_boundary(spark):
    rows = [(1, 0, 0.0, 0.0, 100.0, 100.0, 0.9), (1, 1, 50.0, 0.0, 100.0, 100.0, 0.8)]
    df = spark.createDataFrame(rows, "snapshot_id long, ord int, x double, y double, width double, height double, confidence double")
    assert suppress(df, 0.30).count() == 1 and suppress(df, 0.40).count() == 2


def test_ctc(spark):
    steps = [1, 1, 0, 1, 2, 2, 9, 4]  # class 9 is beyond the dictionary
    logits = [0.9 if c == s else 0.0 for s in steps for c in range(10)]
    got = spark.createDataFrame([(logits,)], "l array<double>").select(ctc_decode(F.col("l"), 8, 10, ["", "a", "b", "c", " "]).alias("d")).first().d
    assert got.text == "aab" and abs(got.confidence - 0.9) < 1e-9


def test_element_ids_probe(spark):
    rows = [(1, 0, "input", "x", None), (1, 1, "input", "x_2", None), (1, 2, "input", "x", None), (1, 3, "input", "x", None), (2, 0, "link", None, "api_key"), (2, 1, "link", None, "n")]
    got = element_ids(spark.createDataFrame(rows, "snapshot_id long, ord int, type string, dom_id string, raw_name string")).orderBy("snapshot_id", "ord").collect()
    assert [r.id for r in got] == ["input_x", "input_x_2", "input_x_3", "input_x_4", "link_1", "link_name_n"]


def test_sanitised_pages_hold_no_values_of_sensitive_elements(spark):
    page, seen = views.elements(spark, SF), views.detections(spark, SF)
    clean = sanitize.sanitize_elements(page, seen)
    assert clean.where("sensitive AND (value <> '[REDACTED]' OR text <> '[REDACTED]')").count() == 0
    again = sanitize.sanitize_elements(clean.withColumns({"has_value": F.col("value").isNotNull(), "autocomplete": F.lit(None).cast("string"), "name": F.lit(None).cast("string")}), seen)
    assert sorted(map(str, again.collect())) == sorted(map(str, clean.collect()))


def test_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"elements": [{"id": "a", "type": "input", "bbox": {"x": 1, "y": 2, "width": 3, "height": 4}, "value": ""}, {"id": "b"}], "documentWidth": 10}')
    rows = read_snapshots(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.id, r.ord, r.width, r.has_value) for r in rows] == [("a", 0, 3.0, True), ("b", 1, None, False)]
    html = "<h1>Hi <b>there</b></h1><a href=x>go</a><a>no</a><input type=password id=pw><div role=button>ok</div><img alt=z>"
    found = scan_html(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("ord").collect()
    assert [(r.tag_name, r.content) for r in found] == [("H1", "Hi there"), ("A", "go"), ("INPUT", ""), ("DIV", "ok"), ("IMG", "")]
    url = spark.createDataFrame([("data:image/png;base64,AAE=",), ("x",)], "u string").select(data_url_bytes(F.col("u"))).collect()
    assert [r[0] for r in url] == [bytearray(b"\x00\x01"), None]


def test_dictionary_and_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("-\na\n\nb\n ")
    assert read_dictionary(spark, str(tmp_path / "d.txt")) == ["-", "a", "b", " "]
    shot = read_screenshots(spark, str(tmp_path / "d.txt")).first()
    assert shot.sha256 == hashlib.sha256(b"-\na\n\nb\n ").hexdigest()


def test_registry():
    registry.set_planner("mine", lambda tasks, elements: tasks)
    assert registry.get_planner("mine")(1, 2) == 1
    registry.reset_planners()
    try:
        registry.get_planner("mine")
    except KeyError as error:
        assert "rules" in str(error)
    else:
        raise AssertionError("an unknown planner was found")


def test_stream_equals_batch(spark, tmp_path):
    page = views.elements(spark, SF).where("snapshot_id < 40")
    page.repartition(4, "snapshot_id").write.parquet(str(tmp_path / "in"))
    stream = streaming.read_element_stream(spark, str(tmp_path / "in"), page.schema, 1)
    pages = spark.range(40).select(F.col("id").alias("snapshot_id"), F.lit("https://x.example").alias("url"), F.lit("t").alias("title"), F.lit(True).alias("has_elements"))
    screens = pages.where("snapshot_id % 4 <> 1").select("snapshot_id", F.unhex(F.repeat(F.lit("FFFFFFFF"), 6)).alias("data"), F.lit(3).alias("width"), F.lit(2).alias("height"))
    gate = lambda batch: streaming.sanitize_batch(batch, pages, screens)
    query = streaming.write_by_batch(stream, gate, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert got.count() > 0 and got.where("snapshot_id % 4 = 1").count() == 0 and streaming.sanitize_batch(page).count() == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, gate(page).select(got.columns).collect()))
    seen = streaming.detect_stream(stream).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    seen.awaitTermination(120)
    assert spark.table("seen").count() == detect.dom_detections(page).count()
