"""Vectorised word hashing shared by the text operators.

Texts travel as UTF-8 bytes. Words are runs of bytes other than space and
\\x09-\\x0D, which is what ``bytes.split()`` splits on, and ``bytes.lower()``
lower-cases A-Z only. A batch of texts is hashed with a handful of numpy passes.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_BATCH_BYTES = 1 << 20

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 2 * _BATCH_BYTES)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _BASE_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        tables = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n > 4 * _BATCH_BYTES:  # one giant text: do not keep its tables
            return tables
        _powers = tables
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` for arrays of starts and ends."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(data * up[: len(data)], out=total[1:])
    hashes = (total[end] - total[start]) * down[start]
    hashes += (end - start).astype(np.uint64) * _ROLL
    return mix(hashes)


def _endings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The last three bytes of each word packed in an integer."""
    out = data[end - 1].astype(np.uint32)
    for i in (2, 3):
        out |= np.where(end - i >= start, data[np.maximum(end - i, 0)], 0).astype(np.uint32) << np.uint32(8 * i - 8)
    return out


def _stems(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the first five bytes of each longer word; 0 for others."""
    return np.where(end - start > 5, span_hashes(data, start, np.minimum(start + 5, end)) ^ np.uint64(0x51), np.uint64(0))


def _each_batch(texts: list[bytes], more) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, offsets of the texts, and what ``more(data, start, end)`` gives for each word."""
    hashes, offsets, found = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)], []
    i = done = 0
    while i < len(texts) or not found:
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < _BATCH_BYTES):
            size += len(texts[j]) + 1
            j += 1
        lengths = np.fromiter(map(len, texts[i:j]), dtype=np.int64, count=j - i)
        data = np.frombuffer(b"\n".join(texts[i:j]) + b"\n", dtype=np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate((np.zeros(1, dtype=edge.dtype), edge))
        start, end = edge[0::2], edge[1::2]
        hashes.append(span_hashes(data, start, end))
        found.append(more(data, start, end))
        offsets.append(np.searchsorted(start, np.cumsum(lengths + 1)) + done)
        done += len(start)
        i = j
    return np.concatenate(hashes), np.concatenate(offsets), np.concatenate(found)


def word_hashes_and_endings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, with the last three bytes of each word packed in an integer."""
    return _each_batch(texts, _endings)


def word_hashes_and_stems(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, with a hash of the first five bytes of each longer word, 0 for others."""
    return _each_batch(texts, _stems)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and offsets: text i owns ``hashes[off[i]:off[i + 1]]``."""
    return _each_batch(texts, lambda data, start, end: start)[:2]


def gram_hashes(words: np.ndarray, k: int, roll: np.uint64 = _ROLL) -> np.ndarray:
    """Rabin-Karp hashes of every run of k words; runs across texts are the caller's to skip."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    rolled = words[:n].copy()
    for i in range(1, k):
        rolled *= roll
        rolled += words[i : i + n]
    return mix(rolled)


def as_bytes(values) -> list[bytes]:
    """A pandas column of binary values as bytes, null as empty."""
    return [b"" if v is None else bytes(v) for v in values]


def release_memory() -> None:
    """Gives free memory back to the system. A Python worker lives on into later stages, beside what these need."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def tidy(group):
    """A function of one group of rows that gives its memory back when it is done."""

    def run(rows: pa.Table) -> pa.Table:
        out = group(rows)
        release_memory()
        return out

    return run


def tidy_pair(group):
    """As tidy, for a function of two groups."""

    def run(rows: pa.Table, other: pa.Table) -> pa.Table:
        out = group(rows, other)
        release_memory()
        return out

    return run
