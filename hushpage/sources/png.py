"""Screenshots as they are captured: PNG images in data URLs to RGBA pixels and back, in Arrow batches of bounded size."""

from __future__ import annotations

import base64
import binascii
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the format: its signature, and the samples of a pixel by colour type (grey, RGB, palette, grey + alpha, RGBA).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Pixels of the largest image that is decoded, and bytes of pixels that are sent on together.
MOST_PIXELS, BATCH_BYTES = 1 << 26, 1 << 22


class BadImage(ValueError):
    """Names what is wrong with an image: a code, never its content."""


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if not data.startswith(SIGNATURE):
        raise BadImage("NOT_PNG")
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or len(data) < at + 12 + size:
            raise BadImage("TRUNCATED")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise BadImage("BAD_CHECKSUM")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise BadImage("TRUNCATED")


def _inflate(packed: bytes, size: int) -> bytes:
    """Exactly ``size`` bytes; a stream that holds more is refused before it fills the memory."""
    unpacker = zlib.decompressobj()
    try:
        out = unpacker.decompress(packed, size + 1)
    except zlib.error:
        raise BadImage("BAD_STREAM") from None
    if len(out) != size:
        raise BadImage("BAD_SIZE")
    return out


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Whichever neighbour is nearest to left + up - corner; left before up before corner."""
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """The bytes of rows (height, bytes) whose filters are undone; ``step`` bytes lie between a byte and the one left of it.

    Rows without a filter, or with those that look left or up only, take one pass each. Runs of rows whose filters look both ways are undone along
    diagonals, on which no byte needs another.
    """
    if (kinds > 4).any():
        raise BadImage("BAD_FILTER")
    height, size = rows.shape
    out, above = np.empty_like(rows), np.zeros(size, dtype=np.uint8)
    at = 0
    while at < height:
        kind = kinds[at]
        if kind < 3:
            out[at] = rows[at]
            if kind == 1:
                out[at] = np.cumsum(rows[at].reshape(-1, step), axis=0, dtype=np.uint8).ravel()
            elif kind == 2:
                out[at] += above
            above, at = out[at], at + 1
            continue
        end = at + 1
        while end < height and kinds[end] > 2 and end - at < 256:
            end += 1
        if (end - at) * size <= FEW_BYTES:
            out[at:end] = _one_by_one(kinds[at:end], rows[at:end], above, step)
        else:
            out[at:end] = _diagonals(kinds[at:end], rows[at:end].reshape(end - at, -1, step), above.reshape(-1, step)).reshape(end - at, -1)
        above, at = out[end - 1], end
    return out


#: Bytes up to which filters are undone one byte at a time, which costs less than the arrays of diagonals.
FEW_BYTES = 512


def _one_by_one(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """As _diagonals."""
    out, up = [], above.tolist()
    for kind, row in zip(kinds.tolist(), rows.tolist(), strict=True):
        line = []
        for i, v in enumerate(row):
            left, corner = (line[i - step], up[i - step]) if i >= step else (0, 0)
            guess = (left + up[i]) >> 1
            if kind == 4:
                a, b, c = abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)
                guess = left if a <= b and a <= c else up[i] if b <= c else corner
            line.append((v + guess) & 0xFF)
        out.append(line)
        up = line
    return np.asarray(out, dtype=np.uint8)


def _diagonals(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undoes filters of kinds 3 and 4. ``held[d + 2, i + 1]`` is the pixel of row i on diagonal d, row -1 being the one above; so a pixel's
    neighbours are on the two diagonals before, next to each other for all rows."""
    height, width, step = rows.shape
    packed = np.zeros((height + width - 1, height, step), dtype=np.int16)
    for i in range(height):
        packed[i : i + width, i] = rows[i]
    held = np.zeros((height + width + 1, height + 1, step), dtype=np.int16)
    held[1 : 1 + width, 0] = above
    paeth = (kinds == 4)[:, None]
    for d in range(height + width - 1):
        a, b = max(0, d - width + 1), min(height, d + 1)
        left, up, corner = held[d + 1, a + 1 : b + 1], held[d + 1, a:b], held[d, a:b]
        guess = np.where(paeth[a:b], _paeth(left, up, corner), (left + up) >> 1)
        held[d + 2, a + 1 : b + 1] = (packed[d, a:b] + guess) & 0xFF
    return np.stack([held[i + 2 : i + 2 + width, i + 1] for i in range(height)]).astype(np.uint8)


def _samples(rows: np.ndarray, width: int, depth: int, count: int) -> np.ndarray:
    """(height, width, count) samples of 8 bits, or of the depth's own range below that; 16-bit samples keep their high byte."""
    if depth == 16:
        return rows.reshape(len(rows), width, count, 2)[..., 0]
    if depth == 8:
        return rows.reshape(len(rows), width, count)
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)[:, : width * count]
    return (bits * (1 << np.arange(depth)[::-1])).sum(axis=2, dtype=np.uint8).reshape(len(rows), width, count)


def decode(data: bytes, most: int = MOST_PIXELS) -> np.ndarray:
    """RGBA pixels (height, width, 4) of a PNG of any colour type and depth; BadImage says why there are none. Interlaced images are refused."""
    head, palette, clear, packed = None, None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR" and len(body) == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], dtype=np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise BadImage("NO_HEADER")
    width, height, depth, colour, compression, filtering, interlaced = head
    if not width or not height or depth not in DEPTHS.get(colour, ()) or compression or filtering:
        raise BadImage("BAD_HEADER")
    if interlaced:
        raise BadImage("INTERLACED")
    if width * height > most:
        raise BadImage("TOO_LARGE")
    count = SAMPLES[colour]
    size, step = -(-width * count * depth // 8), max(1, count * depth // 8)
    raw = np.frombuffer(_inflate(b"".join(packed), height * (size + 1)), dtype=np.uint8).reshape(height, size + 1)
    rows = unfilter(raw[:, 0], raw[:, 1:], step)
    held = _samples(rows, width, depth, count)
    out = np.full((height, width, 4), 255, dtype=np.uint8)
    if colour == 3:
        if palette is None or int(held.max()) >= len(palette):
            raise BadImage("BAD_PALETTE")
        out[..., :3] = palette[held[..., 0]]
        if clear:
            alpha = np.full(len(palette), 255, dtype=np.uint8)
            given = np.frombuffer(clear, dtype=np.uint8)[: len(palette)]
            alpha[: len(given)] = given
            out[..., 3] = alpha[held[..., 0]]
        return out
    if clear and colour in (0, 2) and len(clear) >= 2 * count:  # one colour of the image's own depth is transparent
        whole = rows.reshape(height, width, count, 2).astype(np.uint16) @ np.asarray([256, 1], dtype=np.uint16) if depth == 16 else held
        out[..., 3] = np.where((whole == np.asarray(struct.unpack_from(f">{count}H", clear))).all(axis=2), 0, 255)
    shades = held if depth >= 8 else (held * (255 // ((1 << depth) - 1)))
    out[..., :3] = shades[..., :3] if colour in (2, 6) else shades[..., :1]
    if colour in (4, 6):
        out[..., 3] = shades[..., -1]
    return out


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray, level: int = 6) -> bytes:
    """A PNG of RGBA pixels (height, width, 4). Each row takes the filter that leaves the least sum of differences."""
    height, width = pixels.shape[:2]
    x = pixels.reshape(height, width, 4).astype(np.int16)
    left, up, corner = (np.zeros_like(x) for _ in range(3))
    left[:, 1:], up[1:], corner[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    guesses = (0, left, up, (left + up) >> 1, _paeth(left, up, corner))
    rows = np.stack([((x - g) & 0xFF).astype(np.uint8).reshape(height, -1) for g in guesses])
    costs = np.abs(rows.astype(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = costs.argmin(axis=0)
    lines = np.concatenate((best[:, None].astype(np.uint8), rows[best, np.arange(height)]), axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def data_url(png: bytes) -> str:
    return "data:image/png;base64," + base64.b64encode(png).decode()


def _url_bytes(url: str) -> bytes:
    head, comma, body = url.partition(",")
    if not comma or not head.startswith("data:image/png") or not head.endswith(";base64"):
        raise BadImage("NOT_PNG")
    try:
        return base64.b64decode(body, validate=True)
    except (binascii.Error, ValueError):
        raise BadImage("BAD_BASE64") from None


def _groups(sizes: list[int]) -> Iterator[slice]:
    first = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > BATCH_BYTES:
            yield slice(first, i)
            first, total = i, 0
        total += size
    if sizes:
        yield slice(first, len(sizes))


def _declared(url: str | None) -> int:
    """Bytes of pixels that an image says it has; what it really has is checked when it is decoded."""
    try:
        width, height = struct.unpack(">II", base64.b64decode((url or "").partition(",")[2][:44])[16:24])
        return min(width * height * 4, MOST_PIXELS * 4)
    except (ValueError, struct.error):
        return 0


def decode_screenshots(shots: DataFrame, url_col: str = "data_url") -> DataFrame:
    """(snapshot_id, data, width, height, error) of screenshots (snapshot_id, data_url): RGBA bytes, or a code that says why there are none.

    A null address gives NO_DATA. A bad image is its row's error and touches no other; rows go on in groups of at most BATCH_BYTES of
    pixels, or one image.
    """
    kind = shots.schema["snapshot_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [_declared(u.as_py()) for u in batch.column(1)]
            for at in _groups(sizes):
                rows = []
                for url in batch.column(1)[at]:
                    try:
                        if not url.is_valid:
                            raise BadImage("NO_DATA")
                        pixels = decode(_url_bytes(url.as_py()))
                        rows.append((pixels.tobytes(), pixels.shape[1], pixels.shape[0], None))
                    except BadImage as error:
                        rows.append((None, None, None, str(error)))
                kinds = (pa.binary(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[at], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["snapshot_id", "data", "width", "height", "error"])

    return shots.select("snapshot_id", url_col).mapInArrow(run, f"snapshot_id {kind}, data binary, width int, height int, error string")


def encode_screenshots(images: DataFrame) -> DataFrame:
    """(snapshot_id, data_url) of RGBA images (snapshot_id, data, width, height); null where the buffer is not what its size says."""
    kind = images.schema["snapshot_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(d.as_buffer()) if d.is_valid else 0 for d in batch.column(1)]
            for at in _groups(sizes):
                urls = []
                for data, width, height in zip(*(batch.column(i)[at] for i in (1, 2, 3)), strict=True):
                    w, h, buffer = width.as_py() or 0, height.as_py() or 0, data.as_buffer() if data.is_valid else b""
                    good = w > 0 and h > 0 and len(buffer) == w * h * 4
                    urls.append(data_url(encode(np.frombuffer(buffer, dtype=np.uint8).reshape(h, w, 4))) if good else None)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at], pa.array(urls, pa.string())], names=["snapshot_id", "data_url"])

    return images.select("snapshot_id", "data", "width", "height").mapInArrow(run, f"snapshot_id {kind}, data_url string")
