"""Compact sets of hashed keys, dealt to buckets of the key space and answered back to their blocks.

A block of documents sends each distinct key once, in one blob for each bucket that it has keys of; a bucket sees the blobs of all
blocks and answers each with one value a key, in the same order. Texts stay where they are.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushpage.llm.blocks import partitions


def encode_sorted(keys: np.ndarray) -> bytes:
    """Ascending distinct uint64 keys as differences: random low bytes raw, the rest in as few bytes as it needs."""
    if not len(keys):
        return struct.pack("<IBB", 0, 0, 1)
    steps = np.diff(keys, prepend=np.uint64(0))
    mean = max(int(keys[-1] - keys[0]) // len(keys), 1)
    low = min((mean.bit_length() + 3) // 8, 7)
    high = steps >> np.uint64(8 * low)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(high[1:].max(initial=0)) < 1 << (8 * w))
    head = struct.pack("<IBBQ", len(keys), low, width, int(keys[0]))
    high[0] = 0
    return head + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes() + high.astype(f"<u{width}").tobytes()


def decode_sorted(blob: bytes) -> np.ndarray:
    n, low, width = struct.unpack_from("<IBB", blob)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    (first,) = struct.unpack_from("<Q", blob, 6)
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :low] = np.frombuffer(blob, dtype=np.uint8, count=n * low, offset=14).reshape(n, low)
    out = steps.view("<u8").ravel()
    out += np.frombuffer(blob, dtype=f"<u{width}", count=n, offset=14 + n * low).astype(np.uint64) << np.uint64(8 * low)
    out[0] = first
    return np.cumsum(out, dtype=np.uint64)


def bucket_edges(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Offsets that cut ascending keys below 2**bits into equal ranges of the key space."""
    ends = np.asarray([((i << bits) // buckets) for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, ends), [len(keys)]))


def key_blobs(block: int, keys: np.ndarray, counts: np.ndarray | None, buckets: int, bits: int) -> pa.Table:
    """One row a bucket in which the block has keys: block, bucket, keys, counts."""
    edges = bucket_edges(keys, buckets, bits)
    spans = [(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if a < b]
    return pa.table(
        {
            "block": pa.array([block] * len(spans), pa.int32()),
            "bucket": pa.array([i for i, _, _ in spans], pa.int32()),
            "keys": pa.array([encode_sorted(keys[a:b]) for _, a, b in spans], pa.binary()),
            "counts": pa.array([b"" if counts is None else counts[a:b].tobytes() for _, a, b in spans], pa.binary()),
        }
    )


BLOBS = "block int, bucket int, keys binary, counts binary"
ANSWERS = "block int, bucket int, answer binary"


def answers(rows: pa.Table, values: list[bytes]) -> pa.Table:
    return pa.table({"block": rows["block"], "bucket": rows["bucket"], "answer": pa.array(values, pa.binary())})


def in_order(answer: pa.Table, column: str = "answer") -> list[bytes]:
    """The answers of one block by bucket."""
    return answer.take(pc.sort_indices(answer["bucket"]))[column].to_pylist()


def text_blocks(docs: DataFrame, block: Column, n: int, columns: list) -> DataFrame:
    """Documents dealt by block, as ``columns`` plus block: the one exchange of texts, used by both passes."""
    return docs.select(*columns, block.alias("block")).repartition(max(n, partitions(docs.sparkSession)), "block")


def text_block_count(docs: DataFrame, text_col: str, least: int = 8 << 20, most: int = 256 << 20, spread: bool = True) -> int:
    """As many blocks as shuffle partitions, more if a block would hold too much text for a task's memory.

    Without ``spread`` the number depends on the text alone and not on the cluster.

    A block sends one blob to each bucket, so blocks grow with the square root of all text, from ``least`` bytes for up to 8 GiB
    to ``most``: fewer and larger blobs, and a bounded block.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    size = min(max(least * (total / (8 << 30)) ** 0.5, least), most)
    return max(partitions(docs.sparkSession) if spread else 1, math.ceil(total / size), 1)
