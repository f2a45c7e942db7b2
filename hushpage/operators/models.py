"""Text and face recognition around models that the caller supplies.

A model is given as a list of loaders, tried in order once a worker; the first that succeeds is used. Images are rows
(image_id, data, width, height) of RGBA bytes. Stages between the models are DataFrame operations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushpage.operators import vision

Model = Callable[[np.ndarray], np.ndarray]
Loader = Callable[[], Model]


def load_first(loaders: list[Loader]) -> Model:
    """The first model that loads; if none does, the last error."""
    error: Exception = ValueError("no loader was given")
    for loader in loaders:
        try:
            return loader()
        except Exception as e:  # the next provider may work
            error = e
    raise error


#: Models that a worker keeps; the one that was loaded first goes.
MOST_LOADED = 4
_loaded: dict[str, Model] = {}


def _key(loaders: list[Loader]) -> str:
    """Names loaders by what they are, so that every call with the same ones finds the model that it left in a worker."""
    return hashlib.sha256(cloudpickle.dumps(loaders)).hexdigest()


def _model(key: str, loaders: list[Loader]) -> Model:
    """The model of these loaders, loaded once a worker and kept across its tasks."""
    if key not in _loaded:
        while len(_loaded) >= MOST_LOADED:
            del _loaded[next(iter(_loaded))]
        _loaded[key] = load_first(loaders)
    return _loaded[key]


def _map_images(images: DataFrame, extra: tuple[str, ...], loaders: list[Loader], one: Callable, names: list[str], kinds: list[pa.DataType], ddl: str) -> DataFrame:
    """Runs one(model, image, *extra) for each row with a sound buffer; each gives a list of output rows."""

    key = _key(loaders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = _model(key, loaders)
            owner, rows = [], []
            for i, (data, w, h, *more) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 4 + len(extra))), strict=True)):
                if data is None or not w or not h or len(data) != w * h * 4:
                    continue
                found = one(model, np.frombuffer(data, np.uint8).reshape(h, w, 4), *more)
                owner += [i] * len(found)
                rows += found
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], names=["image_id", *names])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "data", "width", "height", *extra).mapInArrow(run, f"image_id {kind}, {ddl}")


def heat_maps(images: DataFrame, loaders: list[Loader]) -> DataFrame:
    """Text heatmaps with the size and scale of the model's input; a model takes (3, h, w) and gives (h, w)."""

    def one(model: Model, image: np.ndarray) -> list[tuple]:
        h, w = image.shape[:2]
        ratio = min(1.0, 960 / max(w, h))
        tw, th = (max(32, int(np.floor(v * ratio / 32 + 0.5)) * 32) for v in (w, h))
        prob = np.asarray(model(vision.planes(vision.resize(image, tw, th))), dtype=np.float64)
        return [(tw, th, prob.ravel().tolist(), tw / w, th / h, float(w), float(h))]

    names = ["width", "height", "prob", "scale_x", "scale_y", "image_width", "image_height"]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), *[pa.float64()] * 4]
    return _map_images(images, (), loaders, one, names, kinds, "width int, height int, prob array<double>, scale_x double, scale_y double, image_width double, image_height double")


def reading_order(regions: DataFrame) -> DataFrame:
    """Adds ord: top to bottom, then left to right, in each image.

    A rule that takes boxes within ten pixels as one line is not transitive, so its result depends on the sort that applies it; this
    order does not.
    """
    return regions.withColumn("ord", F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x", "width", "height")) - 1)


def recognise_text(images: DataFrame, detectors: list[Loader], recognisers: list[Loader], dictionary: list[str], least: float = 0.2, least_side: int = 4) -> DataFrame:
    """Text detections (image_id, ord, id, type, x, y, width, height, confidence, sources, text) of images.

    A recogniser takes (3, 48, w) and gives (steps, classes). The confidence is the geometric mean of both models' scores; ids
    are hashes of image and box, so reruns agree.
    """
    maps = heat_maps(images, detectors)
    found = vision.heat_components(maps).join(maps.drop("prob"), "image_id")
    regions = reading_order(vision.text_regions(found)).where((F.col("width") >= least_side) & (F.col("height") >= least_side))
    box = ("x", "y", "w", "h")
    at = regions.select("image_id", "ord", "score", "x", "y", F.col("width").alias("w"), F.col("height").alias("h"))

    def one(model: Model, image: np.ndarray, x, y, w, h, order, score) -> list[tuple]:
        logits = np.asarray(model(vision.recognition_input(image, x, y, w, h)), dtype=np.float64)
        return [(order, x, y, w, h, score, *logits.shape, logits.ravel().tolist())]

    names = ["ord", *box, "score", "steps", "classes", "logits"]
    kinds = [pa.int32(), *[pa.float64()] * 5, pa.int32(), pa.int32(), pa.list_(pa.float64())]
    read = _map_images(images.join(at, "image_id"), (*box, "ord", "score"), recognisers, one, names, kinds, "ord int, x double, y double, w double, h double, score double, steps int, classes int, logits array<double>")
    out = read.withColumn("d", vision.ctc_decode(F.col("logits"), F.col("steps"), F.col("classes"), dictionary))
    out = out.where((F.length("d.text") > 0) & (F.col("d.confidence") >= least))
    return out.select(
        "image_id", "ord", F.sha2(F.concat_ws("|", F.lit("text"), "image_id", *box), 256).alias("id"), F.lit("text").alias("type"), "x", "y",
        F.col("w").alias("width"), F.col("h").alias("height"), vision.recognition_score(F.col("score"), F.col("d.confidence")).alias("confidence"),
        F.array(F.lit("ocr")).alias("sources"), F.col("d.text").alias("text"),
    )


def find_faces(images: DataFrame, loaders: list[Loader], least: float = 0.7, most_iou: float = 0.3) -> DataFrame:
    """Face detections of images. A model takes (3, 240, 320) and gives scores (n, 2) and boxes (n, 4), in either order."""

    def one(model: Model, image: np.ndarray) -> list[tuple]:
        outputs = [np.asarray(o, dtype=np.float64) for o in model(vision.face_input(image))]
        scores, boxes = sorted(outputs, key=lambda o: o.shape[1])
        return [(scores.ravel().tolist(), boxes.ravel().tolist(), float(image.shape[1]), float(image.shape[0]))]

    kinds = [pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64()]
    anchors = _map_images(images, (), loaders, one, ["scores", "boxes", "image_width", "image_height"], kinds, "scores array<double>, boxes array<double>, image_width double, image_height double")
    kept = vision.suppress(vision.face_candidates(anchors, least).withColumnsRenamed({"image_id": "snapshot_id", "anchor": "ord"}), most_iou)
    return kept.select(
        F.col("snapshot_id").alias("image_id"), "ord", F.sha2(F.concat_ws("|", F.lit("face"), "snapshot_id", "x", "y", "width", "height"), 256).alias("id"),
        F.lit("face").alias("type"), "x", "y", "width", "height", F.round("confidence", 4).alias("confidence"), F.array(F.lit("face")).alias("sources"),
        F.lit(None).cast("string").alias("text"),
    )
