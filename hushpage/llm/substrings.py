"""Removal of passages that repeat across documents.

Every window of k words has a Rabin-Karp hash. Blocks of documents, dealt by ranges of ids, send their distinct
window hashes to buckets of the hash space, where Spark brings those of all blocks together; a bucket
answers which windows a block of smaller ids holds too. Repeated windows then merge into maximal intervals of words.
Windows are told apart by 80 bits of two hashes: among n distinct windows one meets another's with a probability of about
n / 2**80, which is about 1e-11 at 100 TB of text.
"""

from __future__ import annotations

import math
import re
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushpage.llm.blocks import range_cuts, spread_block
from hushpage.llm.keysets import ANSWERS, BLOBS, answers, bucket_edges, decode_sorted, in_order, key_blobs, text_block_count, text_blocks
from hushpage.llm.textblocks import as_bytes, gram_hashes, tidy, tidy_pair, word_hashes

_OTHER_ROLL = np.uint64(0xA24BAED4963EE407)
_WORD_AND_GAP = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")


def windows(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all windows inside a text, 16 more bits of each, their word positions, word offsets of the texts)."""
    words, off = word_hashes(texts)
    grams = gram_hashes(words, k)
    more = (gram_hashes(words, k, _OTHER_ROLL) >> np.uint64(48)).astype(np.uint16)
    ends = np.repeat(off[1:], np.diff(off))[: len(grams)]
    at = np.flatnonzero(np.arange(len(grams)) + k <= ends)
    return grams[at], more[at], at, off


def repeated_words(texts: list[bytes], order: np.ndarray, k: int, earlier) -> tuple[np.ndarray, np.ndarray]:
    """(mask of words to remove, word offsets). ``order`` ranks the texts' ids, ascending; ``earlier`` maps
    the ascending distinct hashes to whether an earlier block holds them."""
    hashes, _, at, off = windows(texts, k)
    covered = np.zeros(off[-1] + 1, dtype=np.int32)
    if len(hashes):
        found, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        rank = order[np.searchsorted(off, at, side="right") - 1]
        gone = at[earlier(found)[back] | (rank > rank[first][back])]
        np.add.at(covered, gone, 1)
        np.add.at(covered, gone + k, -1)
    return np.cumsum(covered)[:-1] > 0, off


def held_earlier(keys: np.ndarray, more: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether each window occurs at a smaller rank, too. Windows are equal if their ``keys`` and ``more`` are."""
    order = np.argsort(keys, kind="stable")
    ranked, bits, place = keys[order], more[order], rank[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(keys)]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    out = np.zeros(len(keys), dtype=bool)
    if len(first):
        out[order] = place > np.minimum.reduceat(place, first)[group]
        mixed = np.minimum.reduceat(bits, first) != np.maximum.reduceat(bits, first)
        ends = np.append(first[1:], len(keys))
        for a, b in zip(first[mixed].tolist(), ends[mixed].tolist(), strict=True):  # different windows of one 64-bit hash
            least: dict[int, int] = {}
            for x, p in zip(bits[a:b].tolist(), place[a:b].tolist(), strict=True):
                least[x] = min(least.get(x, p), p)
            out[order[a:b]] = [p > least[x] for x, p in zip(bits[a:b].tolist(), place[a:b].tolist(), strict=True)]
    return out


def intervals(mask: np.ndarray) -> np.ndarray:
    """Maximal runs of True as rows (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edges.reshape(-1, 2)


def _sorted_block(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The block by id, nulls last, and the rank of each row's id among the distinct ones."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_end"))
    ids = rows["id"].to_pylist()
    rank = np.cumsum([0] + [a != b for a, b in zip(ids, ids[1:], strict=False)]) if ids else np.zeros(0, np.int64)
    return rows, rank


def remove_repeats(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text", report: bool = True) -> DataFrame:
    """All columns of docs, with the text less the words to remove, plus n_words, n_removed and removed_spans (with ``report``).

    A word goes if a window of k words that covers it also starts in a document of smaller id; windows are judged on
    the input. removed_spans are word positions (start, end), maximal and disjoint. A text that loses nothing
    is returned as it is; otherwise each word that stays keeps the white space before it. A null text has no
    words and stays null. Null ids are larger than all others; rows of equal id do not remove from each other. An
    empty table gives no rows. With ``report``, input columns named like the three new ones are replaced by them. Many rows with null
    ids, or with one id, are dealt to several blocks, which do not remove from each other either.
    """
    n = text_block_count(docs, text_col)
    whole, nulls = docs.agg(F.sum(F.octet_length(F.col(text_col)) + 64), F.sum(F.when(F.col(id_col).isNull(), F.octet_length(F.col(text_col)) + 64))).first()
    block, ranks = spread_block(id_col, F.xxhash64(text_col), range_cuts(docs, id_col, n, text_col), math.ceil(n * (nulls or 0) / (whole or 1)))
    n = len(ranks)
    new = ("n_words", "n_removed", "removed_spans") if report else ()
    names = [c for c in docs.columns if c != text_col and c not in new]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")  # kept apart, so that no name can clash
    columns = [row, F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")]
    base = text_blocks(docs, block, n, columns)

    def send(rows: pa.Table) -> pa.Table:
        hashes, more, _, _ = windows(as_bytes(rows["text"].to_pylist()), k)
        keys, first = np.unique(hashes, return_index=True)
        return key_blobs(rows["block"][0].as_py(), keys, more[first], n, 64)

    def judge(rows: pa.Table) -> pa.Table:
        keys = [decode_sorted(b) for b in rows["keys"].to_pylist()]
        sizes = [len(x) for x in keys]
        more = np.concatenate([np.frombuffer(b, np.uint16) for b in rows["counts"].to_pylist()])
        again = held_earlier(np.concatenate(keys), more, np.repeat(ranks[rows["block"].to_numpy()], sizes))
        return answers(rows, [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(sizes)[:-1])])

    fields = [T.StructField("row", T.StructType([docs.schema[c] for c in names])), T.StructField("text", T.StringType())]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields += [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", span)]

    def finish(rows: pa.Table, answer: pa.Table) -> pa.Table:
        rows, rank = _sorted_block(rows)
        raw = rows["text"].to_pylist()
        texts = as_bytes(raw)
        bits = in_order(answer)

        def earlier(found: np.ndarray) -> np.ndarray:
            sizes = np.diff(bucket_edges(found, n, 64))
            flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=s) for b, s in zip(bits, sizes[sizes > 0], strict=True)]
            return np.concatenate(flags).astype(bool)

        gone, off = repeated_words(texts, rank, k, earlier)
        kept, removed, spans = [], [], []
        for i, text in enumerate(raw):
            mask = gone[off[i] : off[i + 1]]
            removed.append(int(mask.sum()))
            spans.append([{"start": int(a), "end": int(b)} for a, b in intervals(mask)] if removed[-1] else [])
            kept.append(b"".join(compress(_WORD_AND_GAP.findall(text), (~mask).tolist())) if removed[-1] else text)
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "row": rows["row"],
                "text": pa.array(kept, pa.binary()).cast(pa.string()),
                "n_words": pa.array(np.diff(off)),
                "n_removed": pa.array(removed, pa.int64()),
                "removed_spans": pa.array(spans, span_type),
            }
        )

    sent = base.groupBy("block").applyInArrow(tidy(send), BLOBS)
    judged = sent.groupBy("bucket").applyInArrow(tidy(judge), ANSWERS)
    done = base.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(tidy_pair(finish), T.StructType(fields))
    shown = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c == text_col or c in names]
    return done.select(*shown, *new)
