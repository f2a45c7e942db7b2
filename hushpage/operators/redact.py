"""Masking of screenshots: regions are blacked out in RGBA buffers and checked pixel by pixel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_BLACK = np.array([0, 0, 0, 255], dtype=np.uint8)
#: Images with their regions: snapshot_id, data, width, height, regions (x, y, width, height).
#: Bytes of pixels that are worked on and sent on together.
BATCH_BYTES = 1 << 22
_FIELDS = ("snapshot_id", "data", "width", "height", "regions")


def _extents(width: int, height: int, boxes: list[dict] | None) -> Iterator[tuple[slice, slice]]:
    """Rows and columns of the pixels that valid boxes touch inside an image."""
    for b in boxes or []:
        v = [b[k] if b is not None and b[k] is not None else np.nan for k in ("x", "y", "width", "height")]
        if not np.all(np.isfinite(v)) or v[2] <= 0 or v[3] <= 0:
            continue
        x0, y0 = max(0, int(np.floor(v[0]))), max(0, int(np.floor(v[1])))
        x1, y1 = min(width, int(np.ceil(v[0] + v[2]))), min(height, int(np.ceil(v[1] + v[3])))
        if x0 < x1 and y0 < y1:
            yield slice(y0, y1), slice(x0, x1)


def _pixels(data: bytes | None, width: int | None, height: int | None) -> np.ndarray | None:
    if data is None or not width or not height or width < 0 or height < 0 or len(data) != width * height * 4:
        return None
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, 4)


def _groups(batch: pa.RecordBatch) -> Iterator[slice]:
    """Runs of rows whose buffers have at most BATCH_BYTES together, or one row."""
    first = total = 0
    for i in range(batch.num_rows):
        size = sum(len(c[i].as_buffer()) for c in batch.columns if pa.types.is_binary(c.type) and c[i].is_valid)
        if total and total + size > BATCH_BYTES:
            yield slice(first, i)
            first, total = i, 0
        total += size
    if batch.num_rows:
        yield slice(first, batch.num_rows)


def _map(images: DataFrame, fields: tuple[str, ...], one: Callable, out: list[tuple[str, str, pa.DataType]], keep: dict[str, str] | None = None) -> DataFrame:
    """one(*fields) of each row as the columns of ``out``, after the row's snapshot_id and its columns ``keep``, by their new names."""
    keep = keep or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _groups(batch):
                part = batch.slice(at.start, at.stop - at.start)
                rows = [one(*r) for r in zip(*(part.column(i).to_pylist() for i in range(1, len(fields))), strict=True)]
                arrays = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(out)]
                kept = [part.column(fields.index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([part.column(0), *kept, *arrays], names=["snapshot_id", *keep.values(), *(n for n, _, _ in out)])

    kinds = {c: images.schema[c].dataType.simpleString() for c in ("snapshot_id", *keep)}
    schema = [f"snapshot_id {kinds['snapshot_id']}", *(f"`{name}` {kinds[c]}" for c, name in keep.items()), *(f"{n} {t}" for n, t, _ in out)]
    return images.select(*fields).mapInArrow(run, ", ".join(schema))


def redact_images(images: DataFrame, keep: dict[str, str] | None = None) -> DataFrame:
    """(snapshot_id, data, redacted, error): a masked copy and how many regions touch it; a bad buffer gives an error.

    ``keep``: columns data, width, height and regions of the given row that go along, by the names that they get, so that no join on
    pictures has to bring them back.
    """

    def one(data, width, height, boxes):
        pixels = _pixels(data, width, height)
        if pixels is None:
            return None, 0, "INVALID_IMAGE"
        pixels, n = pixels.copy(), 0
        for at in _extents(width, height, boxes):
            pixels[at] = _BLACK
            n += 1
        return pixels.tobytes(), n, None

    return _map(images, _FIELDS, one, [("data", "binary", pa.binary()), ("redacted", "int", pa.int32()), ("error", "string", pa.string())], keep)


def verify_masks(images: DataFrame) -> DataFrame:
    """(snapshot_id, code): null where every pixel of every region of the masked image (``masked``) is opaque black."""

    def one(data, width, height, boxes, masked):
        if _pixels(data, width, height) is None or masked is None or len(masked) != len(data):
            return ("SCREENSHOT_VERIFICATION_FAILURE",)
        pixels = _pixels(masked, width, height)
        ok = all((pixels[at] == _BLACK).all() for at in _extents(width, height, boxes))
        return (None if ok else "SCREENSHOT_UNMASKED_PIXELS",)

    return _map(images, (*_FIELDS, "masked"), one, [("code", "string", pa.string())])


def each_page(painter: Callable[[np.ndarray, list[tuple[slice, slice]]], np.ndarray]) -> Callable[[DataFrame], DataFrame]:
    """A redactor, (snapshot_id, data, redacted, error, code) of images, from a function of one image.

    ``painter`` gets a writable copy of the pixels, (height, width, 4), and the rows and columns of each region, and returns masked
    pixels. ``error`` says why an image could not be masked: INVALID_IMAGE, or the class of what the painter raised on it; other
    images are not touched by that. ``code`` is what verify_masks finds in the masked copy, in the same pass over the buffers.
    """

    def one(data, width, height, boxes):
        pixels = _pixels(data, width, height)
        if pixels is None:
            return None, 0, "INVALID_IMAGE", "SCREENSHOT_VERIFICATION_FAILURE"
        extents = list(_extents(width, height, boxes))
        try:
            masked = np.asarray(painter(pixels.copy(), extents), dtype=np.uint8)
        except Exception as error:  # this page's failure; the others go on
            return None, 0, type(error).__name__, "SCREENSHOT_VERIFICATION_FAILURE"
        if masked.shape != pixels.shape:
            return None, 0, None, "SCREENSHOT_VERIFICATION_FAILURE"
        clean = all((masked[at] == _BLACK).all() for at in extents)
        return masked.tobytes(), len(extents), None, None if clean else "SCREENSHOT_UNMASKED_PIXELS"

    def run(images: DataFrame, keep: dict[str, str] | None = None) -> DataFrame:
        text = [(n, "string", pa.string()) for n in ("error", "code")]
        return _map(images, _FIELDS, one, [("data", "binary", pa.binary()), ("redacted", "int", pa.int32()), *text], keep)

    run.verified = True  # the guard need not look at the pixels again
    return run


def black_out(pixels: np.ndarray, extents: list[tuple[slice, slice]]) -> np.ndarray:
    """Opaque black over every region."""
    for at in extents:
        pixels[at] = _BLACK
    return pixels


#: (snapshot_id, data, redacted, error, code): the masked copy and its check.
redact_and_verify = each_page(black_out)


def masked_area(images: DataFrame) -> DataFrame:
    """(snapshot_id, area): pixels under at least one region, overlaps counted once; needs width, height, regions."""

    def one(width, height, boxes):
        mask = np.zeros((height, width), dtype=bool)
        for at in _extents(width, height, boxes):
            mask[at] = True
        return (int(mask.sum()),)

    return _map(images, ("snapshot_id", "width", "height", "regions"), one, [("area", "long", pa.int64())])


def redaction_quality(images: DataFrame) -> DataFrame:
    """(snapshot_id, masked, due, both): pixels that were masked (``regions``), those that should be (``truth``), and both; overlaps
    count once. Needs width and height."""

    def one(width, height, boxes, truth):
        masks = []
        for held in (boxes, truth):
            mask = np.zeros((height, width), dtype=bool)
            for at in _extents(width, height, held):
                mask[at] = True
            masks.append(mask)
        return int(masks[0].sum()), int(masks[1].sum()), int((masks[0] & masks[1]).sum())

    return _map(images, ("snapshot_id", "width", "height", "regions", "truth"), one, [(n, "long", pa.int64()) for n in ("masked", "due", "both")])
