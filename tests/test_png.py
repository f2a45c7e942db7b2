"""PNG images: every colour type, depth and filter against a plain reading of the format, broken images, and whole screenshots."""

import random
import struct
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from hushpage.operators import redact
from hushpage.sources import png
from hushpage.sources.png import BadImage, data_url, decode, decode_screenshots, encode, encode_screenshots, unfilter


def plain_filter(kind, row, above, step):
    """A row of bytes as the format says that it is filtered."""
    out = []
    for i, x in enumerate(row):
        a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
        p = a + b - c
        near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out.append((x - (0, a, b, (a + b) // 2, near)[kind]) % 256)
    return out


def image(width, height, depth, colour, rows, kinds, extra=(), level=6):
    """A PNG of raw rows of bytes."""
    step = max(1, png.SAMPLES[colour] * depth // 8)
    above, lines = [0] * len(rows[0]), b""
    for kind, row in zip(kinds, rows):
        lines += bytes([kind, *plain_filter(kind, row, above, step)])
        above = row
    body = [(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)), *extra, (b"IDAT", zlib.compress(lines, level)), (b"IEND", b"")]
    return png.SIGNATURE + b"".join(png._chunk(k, b) for k, b in body)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 2, 3, 4, 6, 8]), st.randoms(use_true_random=False))
def test_filters(width, height, step, r):
    rows = [[r.randrange(256) for _ in range(width * step)] for _ in range(height)]
    kinds = [r.randrange(5) for _ in rows]
    filtered = [plain_filter(k, row, rows[i - 1] if i else [0] * len(row), step) for i, (k, row) in enumerate(zip(kinds, rows))]
    assert unfilter(np.asarray(kinds, dtype=np.uint8), np.asarray(filtered, dtype=np.uint8), step).tolist() == rows


@settings(max_examples=100, deadline=None)
@given(arrays(np.uint8, st.tuples(st.integers(1, 12), st.integers(1, 12), st.just(4))))
def test_encoded_pixels_come_back(pixels):
    assert np.array_equal(decode(encode(pixels)), pixels)


@pytest.mark.parametrize(("colour", "depth"), [(c, d) for c, ds in png.DEPTHS.items() for d in ds])
def test_colour_types_and_depths(colour, depth):
    r, width, height, n = random.Random(colour * 20 + depth), 5, 4, png.SAMPLES[colour]
    palette = [[r.randrange(256) for _ in range(3)] for _ in range(1 << depth)] if colour == 3 else []
    top = (1 << depth) - 1
    shown = [[[r.randint(0, top) for _ in range(n)] for _ in range(width)] for _ in range(height)]
    bits = ["".join(f"{v:0{depth}b}" for p in row for v in p) for row in shown]
    rows = [[int(b[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(b), 8)] for b in bits]
    extra = [(b"PLTE", bytes(v for p in palette for v in p)), (b"tRNS", bytes([7, 0]))] if colour == 3 else []
    key = shown[0][0]
    if colour in (0, 2):
        extra = [(b"tRNS", struct.pack(f">{n}H", *key))]

    def want(p):
        if colour == 3:
            return [*palette[p[0]], (7, 0)[p[0]] if p[0] < 2 else 255]
        v = [x >> 8 if depth == 16 else x * 255 // top for x in p]
        rgb = v[:3] if colour in (2, 6) else v[:1] * 3
        return [*rgb, v[-1] if colour in (4, 6) else 0 if p == key else 255]

    kinds = [r.randrange(5) for _ in rows]
    assert decode(image(width, height, depth, colour, rows, kinds, extra)).tolist() == [[want(p) for p in row] for row in shown]


def built(head, packed):
    """A PNG of one header and one chunk of data."""
    return png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", *head)) + png._chunk(b"IDAT", packed) + png._chunk(b"IEND", b"")


def test_broken_images_are_named():
    good, one = encode(np.zeros((3, 3, 4), dtype=np.uint8)), (1, 1, 8, 6, 0, 0, 0)
    broken = {
        "NOT_PNG": b"GIF89a",
        "TRUNCATED": good[:-5],
        "BAD_CHECKSUM": good[:20] + b"\x09" + good[21:],
        "NO_HEADER": png.SIGNATURE + png._chunk(b"IEND", b""),
        "BAD_SIZE": built((1, 2, 8, 6, 0, 0, 0), zlib.compress(b"\x00abcd")),
        "BAD_FILTER": built(one, zlib.compress(b"\x09abcd")),
        "BAD_PALETTE": image(1, 1, 8, 3, [[3]], [0], [(b"PLTE", b"abc")]),
        "BAD_HEADER": built((1, 1, 5, 6, 0, 0, 0), b""),
        "BAD_STREAM": built(one, b"xx"),
        "INTERLACED": built((1, 1, 8, 6, 0, 0, 1), b""),
    }
    for code, data in broken.items():
        with pytest.raises(BadImage, match=code):
            decode(data)
    bomb = built((2, 2, 8, 6, 0, 0, 0), zlib.compress(bytes(50_000_000)))
    with pytest.raises(BadImage, match="BAD_SIZE"):
        decode(bomb)
    with pytest.raises(BadImage, match="TOO_LARGE"):
        decode(encode(np.zeros((3, 3, 4), dtype=np.uint8)), most=8)


def test_a_whole_screen_takes_about_a_second():
    r = np.random.default_rng(1)
    pixels = np.repeat(np.repeat(r.integers(0, 256, (96, 172, 4), dtype=np.uint8), 8, axis=0), 8, axis=1)
    pixels[::3] += r.integers(0, 4, pixels[::3].shape, dtype=np.uint8)
    data = encode(pixels)
    began = time.process_time()
    assert np.array_equal(decode(data), pixels)
    assert time.process_time() - began < 5


def test_screenshots_to_pixels_to_masks_and_back(spark, monkeypatch):
    monkeypatch.setattr(png, "BATCH_BYTES", 500)
    pictures = [np.random.default_rng(i).integers(0, 256, (4 + i % 3, 5, 4), dtype=np.uint8) for i in range(12)]
    rows = [(i, data_url(encode(p))) for i, p in enumerate(pictures)] + [(90, None), (91, "https://x"), (92, "data:image/png;base64,%%"), (93, data_url(b"x"))]
    shots = decode_screenshots(spark.createDataFrame(rows, "snapshot_id long, data_url string")).repartition(2)
    got = {r.snapshot_id: r for r in shots.collect()}
    assert all(got[i].data == p.tobytes() and (got[i].height, got[i].width) == p.shape[:2] for i, p in enumerate(pictures))
    assert [got[i].error for i in (90, 91, 92, 93)] == ["NO_DATA", "NOT_PNG", "BAD_BASE64", "NOT_PNG"]
    boxes = spark.createDataFrame([(i, [(1.0, 1.0, 2.0, 2.0)]) for i in range(12)], "snapshot_id long, regions array<struct<x: double, y: double, width: double, height: double>>")
    sized = shots.join(boxes, "snapshot_id", "left")
    masked = redact.redact_and_verify(sized).join(shots.select("snapshot_id", "width", "height"), "snapshot_id")
    back = {r.snapshot_id: r.data_url for r in encode_screenshots(masked).collect()}
    for i, p in enumerate(pictures):
        p[1:3, 1:3] = [0, 0, 0, 255]
        assert np.array_equal(decode(png._url_bytes(back[i])), p)
    assert back[90] is None
