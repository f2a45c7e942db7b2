"""Token counts by a two-tier map-side lookup.

A compact hash table of the lengths of frequent pre-tokens is broadcast (tier one). What it misses is looked up in a
cache that each Python worker keeps across its tasks, and encoded where that misses, too (tier two). No pre-token is shuffled and a
document never leaves its scan task. The frequent pre-tokens come from a sample of documents spread over the table by
hashed ids: it decides how often tier one answers, and never a count.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushpage.llm.textblocks import release_memory, span_hashes

#: Unicode's White_Space characters, which end a pre-token.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_IS_SPACE = np.zeros(0x3002, dtype=bool)
_IS_SPACE[list(WHITE_SPACE)] = True

#: Pre-tokens that a task of the sample sends on at most, the most frequent first.
_SENT = 4_096
_BATCH_CHARS = 1 << 19


def chunk_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, starts, ends and texts of their chunks, in no particular order).

    A byte-level BPE encodes chunks independently, as every pre-token lies in one of them: a run of other characters with
    the one space before it; what is left of the white space before such a run, and its last character by itself if it is no
    space; the white space at the end of a text.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    space = _IS_SPACE[np.minimum(points, 0x3001)]
    edge = np.zeros(len(points) + 1, dtype=bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[0] = True
    edge[ends] = True  # the last one ends everything
    at = np.flatnonzero(edge[:-1])
    start, end = at, np.append(at[1:], len(points))
    blank = space[start]
    last = np.zeros(len(points) + 1, dtype=bool)
    last[ends] = True
    before_word = blank & ~last[end]
    joins = before_word & (points[end - 1] == 0x20)  # that space goes with the word
    a = start - np.concatenate(([False], joins[:-1]))
    rest = before_word & (end - start > 1)
    alone = before_word & ~joins
    starts = np.concatenate((a[~blank], start[blank & ~before_word], start[rest], end[alone] - 1))
    stops = np.concatenate((end[~blank], end[blank & ~before_word], end[rest] - 1, end[alone]))
    return points, starts, stops, np.searchsorted(ends, starts, side="right")


class LengthTable:
    """An open-addressed hash table from 64-bit hashes to lengths, in two numpy arrays."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 0
        self.keys, self.lengths = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint32)

    def room(self) -> int:
        return (1 << self.bits - 1) - self.size  # at most half full

    def add(self, keys: np.ndarray, lengths: np.ndarray) -> None:
        """Adds distinct keys that the table has not."""
        self.size += len(keys)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            done = self.keys[slot] == keys  # of several keys for one slot the last was written
            self.lengths[slot[done]] = lengths[done]
            keys, lengths, slot = keys[~done], lengths[~done], slot[~done] + 1 & (1 << self.bits) - 1

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, whether found) of keys."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        found = held == keys
        out = np.where(found, self.lengths[slot], 0)
        open_ = np.flatnonzero(~found & (held != 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.lengths[slot[open_[hit]]]
            found[open_[hit]] = True
            open_ = open_[~hit & (held != 0)]
        return out, found


class ChunkLengths:
    """Token counts of chunks: the broadcast table first, then a cache of encoded misses that starts anew when half full."""

    def __init__(self, path: str, bits: int = 21):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and the library's threads keep memory each
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.frequent, self.bits, self.cache = LengthTable(1), bits, LengthTable(bits)

    def encode(self, texts: list[str], most: int = 1_024) -> list[int]:
        """Token counts of texts, some at a time, as the library's results are far larger than their texts."""
        out = []
        for i in range(0, len(texts), most):
            out += [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts[i : i + most], add_special_tokens=False)]
        return out

    def count(self, texts: list[str | None]) -> np.ndarray:
        out, plain, place = np.zeros(len(texts), dtype=np.int64), [], []
        for i, text in enumerate(texts):
            if text and any(s in text for s in self.special):  # added tokens cut a text before it is split
                out[i] = self.encode([text])[0]
            elif text:
                pieces = list(cut_long(text))
                plain += pieces
                place += [i] * len(pieces)
        for part in _parts(plain):
            np.add.at(out, place[part], self._sums(plain[part]))
        return out

    def _sums(self, texts: list[str]) -> np.ndarray:
        points, start, end, text = chunk_spans(texts)
        keys = chunk_hashes(points, start, end)
        lengths, found = self.frequent.get(keys)
        open_ = np.flatnonzero(~found)
        if len(open_):
            lengths[open_], found = self.cache.get(keys[open_])
            open_ = open_[~found]
        if len(open_):
            new, first, back = np.unique(keys[open_], return_index=True, return_inverse=True)
            joined, first = "".join(texts), open_[first]
            sizes = np.asarray(self.encode([joined[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]), dtype=np.uint32)
            lengths[open_] = sizes[back]
            if len(new) > self.cache.room():
                self.cache = LengthTable(self.bits)
            self.cache.add(new[: self.cache.room()], sizes[: self.cache.room()])
        return np.bincount(text, weights=lengths, minlength=len(texts)).astype(np.int64)


def chunk_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of chunks, none of them 0, which marks an empty slot."""
    return np.maximum(span_hashes(points, start, end), np.uint64(1))


def cut_long(text: str, size: int = _BATCH_CHARS) -> Iterator[str]:
    """A text in pieces of about ``size`` characters, cut only before a single space between two words, so its chunks stay whole."""
    at = 0
    while len(text) - at > 2 * size:
        end = text.find(" ", at + size)
        while end >= 0 and (text[end - 1].isspace() or text[end + 1 : end + 2].isspace() or end + 1 == len(text)):
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _parts(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about _BATCH_CHARS characters together."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= _BATCH_CHARS:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def frequent_table(docs: DataFrame, path: str, id_col: str, text_col: str, table_size: int, sample_docs: int) -> LengthTable:
    """Token counts of the most frequent chunks in about ``sample_docs`` documents, those with the least hashes of id and length.

    Tasks count their documents of the sample and send their most frequent chunks of up to 64 characters: at most ``_SENT`` each, and nothing
    where a task has none of the sample.
    """
    n = docs.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            texts = [piece for t in batch.column(0).to_pylist() if t for piece in cut_long(t)]
            for part in _parts(texts):
                own = texts[part]
                points, start, end, _ = chunk_spans(own)
                _, first, n = np.unique(chunk_hashes(points, start, end), return_index=True, return_counts=True)
                joined = "".join(own)
                for a, b, c in zip(start[first].tolist(), end[first].tolist(), n.tolist(), strict=True):
                    if b - a <= 64:
                        held[joined[a:b]] = held.get(joined[a:b], 0) + c
        top = sorted(held, key=lambda p: (-held[p], p))[:_SENT]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array([held[p] for p in top], pa.int64())], names=["chunk", "n"])

    place = F.pmod(F.xxhash64(id_col, F.length(text_col)), F.lit(1 << 30))
    sample = docs.where(place < int((1 << 30) * min(1.0, sample_docs / max(n, 1)))).select(text_col)
    total: dict[str, int] = {}
    for row in sample.mapInArrow(count, "chunk string, n long").toLocalIterator():
        total[row.chunk] = total.get(row.chunk, 0) + row.n
    top = sorted(total, key=lambda p: (-total[p], p))[:table_size]
    table = LengthTable(max(1, (2 * len(top)).bit_length()))
    if top:
        ends = np.cumsum(np.fromiter(map(len, top), dtype=np.int64, count=len(top)))
        points = np.frombuffer("".join(top).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        table.add(chunk_hashes(points, np.append(0, ends[:-1]), ends), np.asarray(ChunkLengths(path, 1).encode(top), dtype=np.uint32))
    return table


_counters: dict[str, ChunkLengths] = {}


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    table_size: int = 1 << 15,
    sample_docs: int = 2_000,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text under a byte-level BPE of the tokenizers library.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each; null ids pass through.
    Only the two named columns are read, so other columns cannot clash. An empty table gives no rows.
    No begin, end or other special tokens are added; special strings inside a text are taken as the
    library takes them by default. Chunks are told apart by 64-bit hashes: about one token in 10**13 meets another chunk's.
    """
    table = frequent_table(docs, tokenizer_path, id_col, text_col, table_size, sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # at most table_size entries

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _counters:  # once a worker
            _counters[tokenizer_path] = ChunkLengths(tokenizer_path)
        counter = _counters[tokenizer_path]
        counter.frequent = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = counter.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n), pa.array(n > limit)],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
