"""Arithmetic around text and face models: input sizes, heatmap components, decoding, candidates, suppression.

Models themselves are optional (none ships here); these are the steps before and after them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushpage.functions.geometry import Box, iou, js_round

#: Fixed values of the models' inputs.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
FACE_SIZE = (320, 240)


def detection_size(width: Column, height: Column, longest: int = 960) -> Column:
    """Struct (width, height, scale_x, scale_y): capped at the longest side, in multiples of 32."""
    side = F.greatest(width, height)
    ratio = F.when(side > longest, F.lit(float(longest)) / side).otherwise(F.lit(1.0))
    w, h = (F.greatest(F.lit(32.0), js_round(v * ratio / 32) * 32) for v in (width, height))
    return F.struct(w.alias("width"), h.alias("height"), (w / width).alias("scale_x"), (h / height).alias("scale_y"))


def recognition_width(width: Column, height: Column, target: int = 48) -> Column:
    """Width of a text crop scaled to the target height, at least 16."""
    return F.greatest(F.lit(16.0), js_round(F.lit(float(target)) * (width / height)))


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres at halves. Weights are not clamped at the first row and column, and bytes wrap."""
    rows, cols = image.shape[:2]

    def axis(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(size) + 0.5) * (n / size) - 0.5
        low = np.maximum(0, np.floor(at)).astype(int)
        return low, np.minimum(n - 1, low + 1), at - low

    y0, y1, wy = axis(rows, height)
    x0, x1, wx = axis(cols, width)
    src, wx, wy = image.astype(np.float64), wx[None, :, None], wy[:, None, None]
    top = src[y0][:, x0] * (1 - wx) + src[y0][:, x1] * wx
    bottom = src[y1][:, x0] * (1 - wx) + src[y1][:, x1] * wx
    return (np.floor(top * (1 - wy) + bottom * wy + 0.5).astype(np.int64) & 0xFF).astype(np.uint8)


def crop(image: np.ndarray, x: float, y: float, width: float, height: float) -> np.ndarray:
    """The pixels that a box touches, at least one."""
    y0, x0 = max(0, int(np.floor(y))), max(0, int(np.floor(x)))
    y1, x1 = min(image.shape[0], int(np.ceil(y + height))), min(image.shape[1], int(np.ceil(x + width)))
    return image[y0 : max(y1, y0 + 1), x0 : max(x1, x0 + 1)]


def planes(image: np.ndarray, mean=MEAN, deviation=DEVIATION, scale: float = 255.0) -> np.ndarray:
    """RGB planes as float32, (value / scale - mean) / deviation."""
    return ((image[..., :3] / scale - np.asarray(mean)) / np.asarray(deviation)).astype(np.float32).transpose(2, 0, 1)


def recognition_input(image: np.ndarray, x: float, y: float, width: float, height: float, target: int = 48) -> np.ndarray:
    part = crop(image, x, y, width, height)
    wide = max(16, int(np.floor(target * part.shape[1] / part.shape[0] + 0.5)))
    return planes(resize(part, wide, target), (0.5,) * 3, (0.5,) * 3)


def face_input(image: np.ndarray) -> np.ndarray:
    return planes(resize(image, *FACE_SIZE), (127.0,) * 3, (128.0,) * 3, 1.0)


def pixel_sums(images: DataFrame, one: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(image_id, shape, total, weighted) of what ``one`` makes of each RGBA image (image_id, data, width, height): its numbers added up, plainly and
    each times 1 to 97 in turn. Null for images whose buffer is not what their size says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, w, h in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if data is None or not w or not h or len(data) != w * h * 4:
                    rows.append((None, None, None))
                    continue
                out = np.asarray(one(np.frombuffer(data, dtype=np.uint8).reshape(h, w, 4)))
                flat = out.ravel().astype(np.float64)
                rows.append((list(out.shape), float(flat.sum()), float(flat @ (1 + np.arange(len(flat)) % 97))))
            kinds = (pa.list_(pa.int32()), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["image_id", "shape", "total", "weighted"])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "data", "width", "height").mapInArrow(run, f"image_id {kind}, shape array<int>, total double, weighted double")


def _label(above: np.ndarray) -> np.ndarray:
    """Least pixel number of each 4-connected component; -1 elsewhere.

    Two passes over the runs of each line: runs that touch across lines are united in a forest, then each takes its root's first
    pixel. Time goes with pixels, whatever the shapes.
    """
    height, width = above.shape
    held = np.zeros((height, width + 2), dtype=bool)  # lines end in a pixel of their own, so that runs end with them
    held[:, 1:-1] = above
    flat = held.ravel()
    edge = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    # Of the line above, a run touches those that end after its start and start before its end: a range, as runs are in order.
    first, last = np.searchsorted(end, start - (width + 2), side="right"), np.searchsorted(start, end - (width + 2), side="left")
    touching = np.maximum(last - first, 0)
    mine = np.repeat(np.arange(len(start)), touching)
    other = np.arange(len(mine)) - np.repeat(np.cumsum(touching) - touching, touching) + np.repeat(first, touching)
    root = list(range(len(start)))

    def find(run: int) -> int:
        while root[run] != run:
            root[run] = root[root[run]]
            run = root[run]
        return run

    for a, b in zip(mine.tolist(), other.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    top = np.asarray([find(run) for run in range(len(start))], dtype=np.int64)
    label, size = np.full(len(flat), -1, dtype=np.int64), end - start
    pixel = start // (width + 2) * width + start % (width + 2) - 1
    label[flat] = np.repeat(pixel[top] if len(top) else top, size)
    return label.reshape(height, width + 2)[:, 1:-1]


def heat_components(maps: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(image_id, component, min_x, min_y, max_x, max_y, mean, pixels) of maps (image_id, width, height, prob)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for image, w, h, prob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                p = np.asarray(prob, dtype=np.float64).reshape(h, w)
                label = _label(p >= threshold)
                ys, xs = np.nonzero(label >= 0)
                if not len(ys):
                    continue
                order = np.argsort(label[ys, xs], kind="stable")  # pixels by component, each in order of the image
                ys, xs = ys[order], xs[order]
                name = label[ys, xs]
                first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
                pixels = np.diff(np.append(first, len(name)))
                sides = [f.reduceat(v, first).tolist() for f, v in ((np.minimum, xs), (np.minimum, ys), (np.maximum, xs), (np.maximum, ys))]
                means = np.add.reduceat(p[ys, xs], first) / pixels
                out += zip([image] * len(first), range(len(first)), *sides, means.tolist(), pixels.tolist(), strict=True)
            names = ["image_id", "component", "min_x", "min_y", "max_x", "max_y", "mean", "pixels"]
            kinds = [batch.schema.field(0).type, *[pa.int32()] * 5, pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    kind = maps.schema["image_id"].dataType.simpleString()
    schema = f"image_id {kind}, component int, min_x int, min_y int, max_x int, max_y int, mean double, pixels long"
    return maps.select("image_id", "width", "height", "prob").mapInArrow(find, schema)


def text_regions(components: DataFrame, least_mean=0.5, least_pixels=16, unclip=1.5, least_side=3) -> DataFrame:
    """Boxes in image coordinates of components (with width, height, scale_x, scale_y, image_width, image_height)."""
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    out = w * h * unclip / F.greatest(F.lit(1), 2 * (w + h))
    x0, y0 = F.greatest(F.lit(0.0), F.floor(F.col("min_x") - out)), F.greatest(F.lit(0.0), F.floor(F.col("min_y") - out))
    x1, y1 = F.least(F.col("width"), F.ceil(F.col("max_x") + 1 + out)), F.least(F.col("height"), F.ceil(F.col("max_y") + 1 + out))
    iw, ih = F.col("image_width"), F.col("image_height")
    zero = F.lit(0.0)
    ox, oy = F.greatest(zero, F.least(iw, x0 / F.col("scale_x"))), F.greatest(zero, F.least(ih, y0 / F.col("scale_y")))
    x, y = F.greatest(zero, F.least(iw, js_round(ox))), F.greatest(zero, F.least(ih, js_round(oy)))
    width = F.greatest(zero, F.least(iw - x, js_round(F.least(iw - ox, (x1 - x0) / F.col("scale_x")))))
    height = F.greatest(zero, F.least(ih - y, js_round(F.least(ih - oy, (y1 - y0) / F.col("scale_y")))))
    kept = components.where((F.col("mean") >= least_mean) & (F.col("pixels") >= least_pixels))
    kept = kept.select("image_id", "component", x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"), F.least(F.lit(1.0), F.greatest(zero, F.col("mean"))).alias("score"))
    return kept.where((F.col("width") >= least_side) & (F.col("height") >= least_side))


def ctc_decode(logits: Column, steps: Column | int, classes: Column | int, dictionary: list[str]) -> Column:
    """Struct (text, confidence) of greedy decoding: first maximum of a step, class 0 blank, repeats collapsed."""
    steps, classes = (F.lit(v) if isinstance(v, int) else v for v in (steps, classes))
    rows = F.transform(F.sequence(F.lit(0), steps - 1), lambda t: F.slice(logits, t * classes + 1, classes))
    best = F.transform(rows, lambda r: F.struct((F.array_position(r, F.array_max(r)) - 1).cast("int").alias("c"), F.array_max(r).cast("double").alias("v")))
    marked = F.transform(best, lambda b, i: F.struct(b["c"].alias("c"), b["v"].alias("v"), F.when(i > 0, F.get(best, i - 1)["c"]).otherwise(F.lit(-1)).alias("before")))
    kept = F.filter(marked, lambda m: (m["c"] != 0) & (m["c"] != m["before"]) & (m["c"] < len(dictionary)))
    names = F.array(*[F.lit(x) for x in dictionary])
    text = F.trim(F.array_join(F.transform(kept, lambda m: names[m["c"]]), ""))
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    total = F.aggregate(kept, F.lit(0.0), lambda s, m: s + clamp(m["v"]))
    confidence = F.when(F.length(text) > 0, clamp(total / F.size(kept))).otherwise(F.lit(0.0))
    return F.struct(text.alias("text"), confidence.alias("confidence"))


def recognition_score(detected: Column, decoded: Column) -> Column:
    """Geometric mean of both scores, within 0 and 1, to four places."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sqrt(detected * decoded))), 4)


def face_candidates(anchors: DataFrame, least: float = 0.7) -> DataFrame:
    """(image_id, anchor, x, y, width, height, confidence) of anchors whose face score reaches ``least``.

    anchors: image_id, scores (two a box), boxes (four a box, as shares of the image), image_width, image_height.
    """
    n = F.sequence(F.lit(0), (F.size("scores") / 2).cast("int") - 1)
    each = anchors.select("*", F.explode(n).alias("anchor")).withColumn("s", F.get("scores", F.col("anchor") * 2 + 1).cast("double")).where(F.col("s") >= least)
    iw, ih, zero = F.col("image_width"), F.col("image_height"), F.lit(0.0)
    edge = lambda k, size: F.greatest(zero, F.least(size, F.get("boxes", F.col("anchor") * 4 + k).cast("double") * size))
    x0, y0, x1, y1 = edge(0, iw), edge(1, ih), edge(2, iw), edge(3, ih)
    x, y = F.greatest(zero, F.least(iw, js_round(x0))), F.greatest(zero, F.least(ih, js_round(y0)))
    w, h = F.greatest(zero, F.least(iw - x, js_round(x1 - x0))), F.greatest(zero, F.least(ih - y, js_round(y1 - y0)))
    out = each.select("image_id", "anchor", x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"), F.least(F.lit(1.0), F.greatest(zero, F.col("s"))).alias("confidence"))
    return out.where("width > 0 AND height > 0")


def suppress(boxes: DataFrame, most_iou: float = 0.3) -> DataFrame:
    """Boxes (snapshot_id, ord, x, y, width, height, confidence) that survive non-maximum suppression.

    By falling confidence, then order; a box goes if it overlaps a kept one by more than ``most_iou``. A fold within a page.
    """
    row = F.struct((-F.col("confidence")).alias("turn"), "ord", "x", "y", "width", "height", "confidence")
    pages = boxes.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(row)).alias("bs"))
    start = F.array().cast("array<struct<turn: double, ord: int, x: double, y: double, width: double, height: double, confidence: double>>")

    def step(kept: Column, b: Column) -> Column:
        hit = F.exists(kept, lambda k: iou(Box.field(k), Box.field(b)) > most_iou)
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(b)))

    kept = pages.select("snapshot_id", F.inline(F.aggregate("bs", start, step)))
    return kept.drop("turn")
