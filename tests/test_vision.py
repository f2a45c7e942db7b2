"""Pixel arithmetic, masks, and the recognition pipelines with toy models."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hushpage.operators import models, redact, vision
from hushpage.operators.requests import dispatch

IMAGE = (np.arange(40 * 64 * 4) % 251).astype(np.uint8).reshape(40, 64, 4)


def test_resize_extrapolates_at_the_first_edge_and_wraps():
    flat = np.full((2, 2, 4), 7, np.uint8)
    assert (vision.resize(flat, 5, 3) == 7).all()
    step = np.zeros((1, 2, 4), np.uint8)
    step[0, 1] = 200
    assert vision.resize(step, 4, 1)[0, :, 0].tolist() == [206, 50, 150, 200]  # -50 wraps to 206


def test_crop_and_inputs():
    assert vision.crop(IMAGE, -3, 2.5, 10, 4).shape == (5, 7, 4)
    assert vision.recognition_input(IMAGE, 0, 0, 10, 20).shape == (3, 48, 24) and vision.face_input(IMAGE).shape == (3, 240, 320)
    assert np.isclose(vision.planes(IMAGE)[0, 0, 1], (4 / 255 - 0.485) / 0.229)


def images(spark, n=3):
    rows = [(i, IMAGE.tobytes() if i != 1 else b"xx", 64, 40) for i in range(n)]
    return spark.createDataFrame(rows, "image_id long, data binary, width int, height int")


def test_masks(spark):
    boxes = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("x", "y", "width", "height"), b, strict=True)]) for b in ((1, 1, 3, 2), (60, 38, 9, 9), (-9, 0, 5, 5), (2, 2, -1, 4))])
    rows = images(spark).withColumnRenamed("image_id", "snapshot_id").withColumn("regions", boxes)
    out = {r.snapshot_id: r for r in redact.redact_images(rows).collect()}
    assert out[0].redacted == 2 and out[1].error == "INVALID_IMAGE"
    masked = np.frombuffer(out[0].data, np.uint8).reshape(40, 64, 4)
    assert (masked[1:3, 1:4] == [0, 0, 0, 255]).all() and np.array_equal(masked[10:30], IMAGE[10:30])
    both = rows.join(redact.redact_images(rows).select("snapshot_id", F.col("data").alias("masked")), "snapshot_id")
    assert [r.code for r in redact.verify_masks(both).orderBy("snapshot_id").collect()] == [None, "SCREENSHOT_VERIFICATION_FAILURE", None]
    assert redact.verify_masks(both.withColumn("masked", F.col("data"))).where("code = 'SCREENSHOT_UNMASKED_PIXELS'").count() == 2
    assert redact.masked_area(rows).first().area == 6 + 4 * 2


def broken():
    raise OSError("no such provider")


def detector():
    def run(planes):
        prob = np.zeros(planes.shape[1:])
        prob[4:12, 6:30] = 0.9
        return prob

    return run


def recogniser():
    return lambda planes: np.eye(5)[[1, 1, 0, 2, 4, 3]]


def faces():
    scores = np.array([[0.1, 0.9], [0.2, 0.8], [0.9, 0.1]])
    boxes = np.array([[0.1, 0.1, 0.5, 0.5], [0.12, 0.1, 0.52, 0.5], [0, 0, 1, 1]])
    return lambda planes: (boxes, scores)


def test_a_worker_keeps_few_models_and_finds_them_again():
    assert models._key([broken, detector]) == models._key([broken, detector]) != models._key([detector])
    models._loaded.clear()
    for i in range(9):
        assert models._model(str(i), [broken, lambda i=i: i]) == i
    assert list(models._loaded) == ["5", "6", "7", "8"] and models._model("6", [broken]) == 6
    models._loaded.clear()


def test_buffers_go_in_bounded_groups(monkeypatch):
    monkeypatch.setattr(redact, "BATCH_BYTES", 100)
    sizes = [40, 50, 20, 300, None, 10, 90]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([None if n is None else bytes(n) for n in sizes], pa.binary())], names=["i", "data"])
    assert [(g.start, g.stop) for g in redact._groups(batch)] == [(0, 2), (2, 3), (3, 4), (4, 7)]
    assert list(redact._groups(batch.slice(0, 0))) == []


def test_recognition_with_toy_models(spark):
    got = models.recognise_text(images(spark), [broken, detector], [recogniser], ["", "a", "b", "c", " "]).collect()
    assert sorted(r.image_id for r in got) == [0, 2] and {r.text for r in got} == {"ab c"} and {r.sources[0] for r in got} == {"ocr"}
    assert all(r.width >= 24 and abs(r.confidence - 0.9487) < 1e-9 for r in got) and len({r.id for r in got}) == 2


def test_faces_with_a_toy_model(spark):
    got = models.find_faces(images(spark), [faces]).collect()
    assert sorted((r.image_id, r.ord, r.x, r.confidence) for r in got) == [(0, 0, 6.0, 0.9), (2, 0, 6.0, 0.9)]


def test_dispatch(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "type string, n int")
    assert {k: d.count() for k, d in dispatch(rows, ["a", "b", "c"]).items()} == {"a": 2, "b": 1, "c": 0}
