"""Homomorphic multiset fingerprints of documents.

A fingerprint is a wide vector, the sum of the vectors of a text's paragraphs
(lines). Lanes are summed modulo powers of two, so the order of paragraphs does
not matter, and a paragraph can be inserted or deleted by adding or subtracting
its vector. The first lanes hold a 256-bit hash of each paragraph, modulo 2**64:
they decide equality. The others, modulo 2**32, hold +1 or -1 at a hashed place for
each run of three words: their angle estimates how much two texts share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushpage.llm.blocks import block_count, partitions, range_block, range_cuts
from hushpage.llm.textblocks import gram_hashes, word_hashes

EXACT_LANES, LIKE_LANES, RUN = 4, 256, 3


def paragraphs(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the equality lanes (uint64) and the likeness lanes (int32, wrapping)."""
    parts = [paragraphs(t) for t in texts]
    lines = [p for ps in parts for p in ps]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    exact = np.zeros((len(texts), EXACT_LANES), dtype=np.uint64)
    if not lines:
        return exact, np.zeros((len(texts), LIKE_LANES), dtype=np.int32)
    digests = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=8 * EXACT_LANES).digest() for p in lines), dtype="<u8")
    np.add.at(exact, owner, digests.reshape(-1, EXACT_LANES))
    words, off = word_hashes(lines)
    first, n = off[:-1], np.diff(off)
    grams = gram_hashes(words, RUN)
    line_of = np.repeat(np.arange(len(lines)), n)
    at = np.arange(len(grams))
    inside = at + RUN <= off[1:][line_of[: len(grams)]]
    short = (n > 0) & (n < RUN)
    second = np.where(n[short] > 1, words[np.minimum(first[short] + 1, len(words) - 1)], np.uint64(1))
    found = np.concatenate((grams[inside], words[first[short]] * np.uint64(3) + second))
    who = np.concatenate((owner[line_of[at[inside]]], owner[short]))
    place = who * LIKE_LANES + ((found >> np.uint64(9)) % np.uint64(LIKE_LANES)).astype(np.int64)
    sign = np.where(found & np.uint64(256), 1.0, -1.0)
    like = np.bincount(place, weights=sign, minlength=len(texts) * LIKE_LANES).reshape(len(texts), LIKE_LANES)
    return exact, like.astype(np.int64).astype(np.int32)


def render(exact: np.ndarray, like: np.ndarray) -> str:
    return base64.b64encode(exact.astype("<u8").tobytes() + like.astype("<i4").tobytes()).decode()


def parse(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    cut = 8 * EXACT_LANES
    return np.frombuffer(raw[:cut], dtype="<u8").copy(), np.frombuffer(raw[cut:], dtype="<i4").copy()


def combine(fingerprint: str, other: str, sign: int = 1) -> str:
    """The fingerprint after inserting (sign 1) or deleting (sign -1) the paragraphs of another."""
    (a, b), (c, d) = parse(fingerprint), parse(other)
    return render(a + c, b + d) if sign > 0 else render(a - c, b - d)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal fingerprints, else the cosine of the likeness lanes, at least 0; 0 if only one has words."""
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    size = float(np.sqrt((x @ x) * (y @ y)))
    return min(max(float(x @ y) / size, 0.0), 1.0) if size else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the first of the following text, or all it has."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _rounds(n_texts: list[str], most_chars: int = 1 << 20) -> Iterator[slice]:
    at = 0
    while at < len(n_texts):
        end, size = at, 0
        while end < len(n_texts) and (end == at or size + len(n_texts[end]) < most_chars):
            size += len(n_texts[end])
            end += 1
        yield slice(at, end)
        at = end


_FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], nexts: list[str], id_col: str, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for part in _rounds(texts):
        own, after = texts[part], nexts[part]
        changed = [edited(t, u) for t, u in zip(own, after, strict=True)]
        chain = own + [u for i, u in enumerate(after) if i + 1 == len(own) or own[i + 1] is not u]
        place = {id(t): i for i, t in enumerate(chain)}
        fp = list(zip(*vectors(chain), strict=True))
        fe = list(zip(*vectors(changed), strict=True))
        rows = [
            (
                i, len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(),
                render(*f), render(*e), likeness(f, e), likeness(f, fp[place[id(u)]]),
            )
            for i, t, u, c, f, e in zip(ids[part], own, after, changed, fp, fe, strict=False)
        ]
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edit with the next document's text, by descending id.

    Texts are dealt once into blocks of descending id ranges; the head of each block is also sent
    to the block before it, so a document always meets its successor. A null text is empty. Equal ids are
    ordered by text; null ids come last. Equal ids share a block, as their texts follow each other: many rows of one id, or of null ids, make
    one long task, which streams them and holds two texts at a time. A lone document is its own successor; an empty table gives no
    rows. Only the two named columns are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = block_count(docs)
    cuts = range_cuts(rows, "id", n)
    blocks = rows.select("id", range_block("id", cuts).alias("block"))
    heads = blocks.groupBy("block").agg(F.max("id").alias("head")).orderBy(F.desc("block")).collect()  # one row a block
    if not heads:
        heads = [(0, None)]
    turn = [(b, h, heads[i - 1][0]) for i, (b, h) in enumerate(heads)]  # the last block closes with the first head
    turns = spark.createDataFrame(turn, f"own int, head {docs.schema[id_col].dataType.simpleString()}, before int")
    dealt = rows.withColumn("own", range_block("id", cuts)).join(F.broadcast(turns), "own")
    is_head = F.col("id").eqNullSafe(F.col("head"))
    targets = F.when(is_head, F.array("own", "before")).otherwise(F.array("own"))
    dealt = (
        dealt.select("id", "text", F.posexplode(targets).alias("sent", "block"))
        .repartition(max(n, partitions(spark)), "block")
        .sortWithinPartitions("block", "sent", F.desc("id"), "text")
    )
    id_type = docs.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (block, id, text) that still waits for its successor
        closed = None
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, texts, nexts = [], [], []
            for i, text, sent, block in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if sent and closed == block:
                    continue
                if last is not None:
                    ids.append(last[1])
                    texts.append(last[2])
                    nexts.append(text)
                last, closed = (None, block) if sent else ((block, i, text), None)
            yield from _compare(ids, texts, nexts, id_col, kind)

    return dealt.mapInArrow(walk, f"`{id_col}` {id_type}, {_FIELDS}")
