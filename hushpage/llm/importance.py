"""Importance resampling of documents towards a target distribution, by external sort-count.

Every feature of a text (a run of words) falls in one of at most 65,536 buckets. One pass over the texts writes the buckets as packed streams of
16-bit numbers with the documents' offsets to the shared folder. Counting sorts runs of these streams and adds up
their run lengths; nothing but a count for each bucket is shuffled. The buckets' gains, a bounded table, then meet the streams again:
gathered by bucket and summed between offsets by ``np.add.reduceat``. Texts are read once and never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushpage.llm.blocks import cut
from hushpage.llm.textblocks import release_memory

#: A-Z lower-cased; bytes that belong to no word are spaces. Words are 0-9, a-z and whatever is not ASCII.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of a text that are cut into words at a time, and features in a row of streams.
_PART, _ROW = 1 << 20, 1 << 20
STREAM = "ends array<long>, words array<long>, stream binary"


class Buckets(dict):
    """The bucket of a feature's bytes: crc32 modulo their number. Forgets all when it holds ``most``."""

    def __init__(self, buckets: int, most: int = 1 << 18):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(feature) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[feature] = bucket
        return bucket


def word_parts(text: bytes, size: int = _PART) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    text, at = text.translate(_WORDS), 0
    while len(text) - at > 2 * size:
        end = text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def feature_stream(text: bytes, longest: int, buckets: Buckets, size: int = _PART) -> tuple[int, np.ndarray]:
    """(words, buckets of all runs of 1 to ``longest`` words) of a text."""
    total, parts, before = 0, [np.zeros(0, dtype=np.uint16)], []
    for words in word_parts(text, size):
        total += len(words)
        parts.append(np.fromiter(map(buckets.__getitem__, words), dtype=np.uint16, count=len(words)))
        if longest > 1:
            held, first = before + words, len(before)
            for n in range(2, longest + 1):
                grams = [b" ".join(held[i : i + n]) for i in range(max(0, first - n + 1), len(held) - n + 1)]
                parts.append(np.fromiter(map(buckets.__getitem__, grams), dtype=np.uint16, count=len(grams)))
            before = held[-(longest - 1) :]
    return total, np.concatenate(parts)


def bucket_streams(docs: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(ids, ends, words, stream): packed streams of about a million features, the end of each document in them and its number of words."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in batches:
            streams, words, first, size = [], [], 0, 0
            for i in range(batch.num_rows):
                n, stream = feature_stream(batch.column(1)[i].as_py() or b"", longest, known)
                words.append(n)
                streams.append(stream)
                size += len(stream)
                if size >= _ROW or i == batch.num_rows - 1:
                    ids = pa.ListArray.from_arrays(pa.array([0, i + 1 - first], pa.int32()), batch.column(0).slice(first, i + 1 - first))
                    ends = np.cumsum([len(s) for s in streams])
                    packed = np.concatenate(streams).astype("<u2").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int64())), pa.array([packed], pa.binary())],
                        names=["ids", "ends", "words", "stream"],
                    )
                    streams, words, first, size = [], [], i + 1, 0
        release_memory()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(write, f"ids array<{kind}>, {STREAM}")


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of the runs of the sorted stream."""
    run = np.sort(stream)
    first = np.flatnonzero(np.concatenate((np.ones(min(len(run), 1), dtype=bool), run[1:] != run[:-1])))
    return run[first], np.diff(np.append(first, len(run)))


def bucket_counts(streams: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: sorted runs, run lengths added up in each task and then over tasks. A number a bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0):
                values, lengths = run_lengths(np.frombuffer(packed.as_buffer(), dtype="<u2"))
                total[values] += lengths
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for row in streams.select("stream").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the quotient of a bucket's smoothed shares among the target's features and one's own, in doubles."""
    n = len(own)
    return np.floor(1000 * np.log((target + 1.0) * (own.sum() + float(n)) / ((own + 1.0) * (target.sum() + float(n))))).astype(np.int64)


def mean_gains(gains: np.ndarray, stream: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Floored mean of the gains of each document's features; 0 where it has none."""
    n = np.diff(ends, prepend=0)
    some = n > 0
    out = np.zeros(len(ends), dtype=np.int64)
    if some.any():
        out[some] = np.add.reduceat(gains[stream], (ends - n)[some]) // n[some]
    return out


def document_weights(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_features, n_words, weight) of every document of the streams."""
    shared = streams.sparkSession.sparkContext.broadcast(gains)  # at most 65,536 numbers
    kind = streams.schema["ids"].dataType.elementType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, ends, words, packed = (batch.column(i)[row] for i in range(4))
                ends = ends.values.to_numpy()
                weights = mean_gains(shared.value, np.frombuffer(packed.as_buffer(), dtype="<u2"), ends)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.diff(ends, prepend=0)), words.values, pa.array(weights)], names=["id", "n_features", "n_words", "weight"])

    return streams.mapInArrow(gather, f"id {kind}, n_features long, n_words long, weight long")


def gumbel(identity: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of SHA-256 of seed and id; the same on every run."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((bits + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """Adds rank to the floor(percent/100) highest scores of the eligible rows, ties to smaller ids, null ids last; null for the rest.

    ``scored`` has id, n_features, weight and score. Scores are integers of a bounded range, so one number a score says how many rows
    stand above. Only rows from the last score drawn upwards are then shuffled. Equal rows of one task travel as one row with a count, and
    no score has more than about 0.04 % of different ids, as each draws its own noise.
    """
    held = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()  # at most about 115,000 scores
    held = sorted(((r.score, r.n) for r in held), reverse=True)
    room = sum(n for _, n in held) * percent // 100
    above, steps = 0, []
    for score, n in held:
        if above >= room:
            break
        steps.append((score, above))
        above += n
    none = F.lit(None).cast("long").alias("rank")
    columns = ["id", "n_features", "weight", "score"]
    if not steps:
        return scored.select(*columns, none)
    least = F.lit(steps[-1][0])
    rest = scored.where(~eligible | (F.col("score") < least)).select(*columns, none)
    equal = scored.where(eligible & (F.col("score") >= least)).groupBy(*columns, F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features", "weight", "part").rowsBetween(Window.unboundedPreceding, -1)
    steps = F.broadcast(scored.sparkSession.createDataFrame(steps, "score long, above long"))
    first = F.col("above") + F.coalesce("earlier", F.lit(0)) + 1
    placed = equal.withColumn("earlier", F.sum("n").over(order)).join(steps, "score").withColumn("place", F.explode(F.sequence(first, first + F.col("n") - 1)))
    return placed.select(*columns, F.when(F.col("place") <= room, F.col("place")).alias("rank")).unionByName(rest)


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    longest: int = 1,
    buckets: int = 10_000,
    min_words: int = 20,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document: rank 1, 2, 3, ... where it is drawn, else null.

    Drawing the highest of weight plus Gumbel noise samples without replacement by exp(weight / 1000). Null and empty texts have no words,
    weight 0 and no rank. Rows that repeat an id draw one noise and are ranked each; a null id draws the
    noise of an empty one. Other columns are not read. An empty table gives no rows; an empty target gives every
    bucket one smoothed share.
    """
    streams = cut(bucket_streams(docs, id_col, text_col, longest, buckets))  # read for the counts and for the weights
    wanted = bucket_counts(bucket_streams(target.withColumn("id", F.lit(0)), "id", target_col, longest, buckets), buckets)
    weights = document_weights(streams, bucket_gains(bucket_counts(streams, buckets), wanted))
    scored = cut(weights.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    return ranked(scored, F.col("n_words") >= min_words, percent).withColumnRenamed("id", id_col)


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that importance_resample draws, with all columns. Rows that share an id stay if one of them is drawn."""
    drawn = importance_resample(docs, target, id_col=id_col, **options).where("rank IS NOT NULL")
    return docs.join(drawn.select(id_col).distinct(), id_col, "left_semi")
