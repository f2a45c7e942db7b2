"""Packing documents into sequences by bin completion with branch and bound.

Only the counts of lengths matter to a packing, and there are at most ``capacity`` lengths: Spark
counts them, the search works on that bounded table, and its answer (how many sequences of which filling) is
dealt back to the pieces by their rank among pieces of equal length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushpage.llm.blocks import cut, partitions
from hushpage.llm.textblocks import release_memory, span_hashes
from hushpage.llm.token_counts import WHITE_SPACE

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first

# ---- the search -------------------------------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: the bound of Martello and Toth over all thresholds."""
    have = np.zeros(capacity + 2, dtype=np.int64)
    for length, n in counts.items():
        have[length] += n
    size = np.arange(capacity + 2) * have
    n_from = np.concatenate((np.cumsum(have[::-1])[::-1], [0]))  # pieces of at least this length
    s_from = np.concatenate((np.cumsum(size[::-1])[::-1], [0]))
    half = capacity // 2
    best = -(-int(size.sum()) // capacity)
    for a in range(1, half + 1):
        large, middle = int(n_from[capacity - a + 1]), int(n_from[half + 1] - n_from[capacity - a + 1])
        room = middle * capacity - int(s_from[half + 1] - s_from[capacity - a + 1])
        small = int(s_from[a] - s_from[half + 1])
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Filling]]:
    """Best-fit decreasing on counts: (number of bins, filling)."""
    groups: dict[int, list[list]] = {}  # room left -> [[bins, filling]]
    rooms: list[int] = []

    def put(room: int, bins: int, filling: Filling) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([bins, filling])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                bins = max(left // each, 1)
                each = min(each, left)
                put(capacity - each * length, bins, ((length, each),))
                left -= bins * each
                continue
            room = rooms[at]
            bins, filling = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = min(room // length, left)
            used = min(bins, left // each)
            if used < bins:
                put(room, bins - used, filling)
            put(room - each * length, used, (*filling, (length, each)))
            left -= used * each
    return [(bins, filling) for held in groups.values() for bins, filling in held]


class Budget:
    """Steps that a whole search may still take."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self, steps: int = 1) -> bool:
        self.left -= steps
        return self.left >= 0


def fillings(room: int, counts: dict[int, int], alive: list[int], waste: int, budget: Budget) -> Iterator[Filling]:
    """Undominated fillings of a room that leave at most ``waste``: first those that leave nothing, then in classes of what they leave, longer pieces first.

    ``alive`` are the lengths with a count, ascending. A filling is dominated if one or two of its pieces could be
    exchanged for one longer unused piece that fits. All are given while the budget lasts.
    """
    top = bisect_right(alive, room)
    few = sum(counts[k] * k for k in alive[:64]) < room if len(alive) <= 64 else False  # all that is left might not fill the room
    below = [0]
    for k in alive[:top] if few else ():
        below.append(below[-1] + k * counts[k])

    def dominated(chosen: list[tuple[int, int]], slack: int) -> bool:
        used = dict(chosen)
        free = lambda k: counts[k] > used.get(k, 0)
        for k in alive:
            if k > slack:
                break
            if free(k):
                return True
        parts = [k for k, _ in chosen]
        for total in set(parts) | {a + b for a in parts for b in parts if a != b or used[a] > 1}:
            for i in range(bisect_right(alive, total), len(alive)):
                if alive[i] > total + slack:
                    break
                if free(alive[i]):
                    return True
        return False

    def go(end: int, left: int, least: int, most: int, chosen: list[tuple[int, int]]) -> Iterator[Filling]:
        """With pieces of alive[:end] only; what stays free must lie between least and most."""
        if not budget.spend():
            return
        if least <= left <= most and not dominated(chosen, left):
            yield tuple(chosen)
        i = bisect_right(alive, left, 0, end) - 1
        if i >= 0 and alive[0] > left - alive[i]:  # alone it leaves no room for others, so it dominates the next shorter ones
            k = alive[i]
            if least <= left - k <= most and not dominated([*chosen, (k, 1)], left - k):
                yield (*chosen, (k, 1))
            i = bisect_right(alive, left - alive[0], 0, i) - 1
        for i in range(i, -1, -1):
            k = alive[i]
            if (few and left - below[i + 1] > most) or not budget.spend():
                return
            for n in range(min(left // k, counts[k]), 0, -1):
                chosen.append((k, n))
                yield from go(i, left - n * k, least, most, chosen)
                chosen.pop()

    yield from go(top, room, 0, 0, [])
    least, most = 1, 8
    if alive and room < 3 * alive[0]:  # at most two more pieces: few enough to sort
        yield from sorted(go(top, room, 1, waste, []), key=lambda f: -sum(k * n for k, n in f))
        return
    while least <= waste:
        yield from go(top, room, least, min(most, waste), [])
        least, most = most + 1, 4 * most + 8


@dataclass(frozen=True)
class Packing:
    """groups: (number of bins, filling). ``bins`` is their sum; a packing of ``bound`` bins is the best there is."""

    groups: list[tuple[int, Filling]]
    bins: int
    bound: int


def bin_completion(counts: dict[int, int], capacity: int, steps: int = 1_000_000) -> Packing:
    """A packing with as few bins as the search finds.

    The incumbent is best-fit decreasing. Depth first, each node fills the bin of the longest piece left with an
    undominated filling, in as many bins as the counts allow and, later, in one; it is cut off once its waste exceeds what a
    packing with one bin less than the incumbent may leave. The search ends at the lower bound, when all is tried, or when
    ``steps`` are spent, some seconds of the driver's time whatever the input; a packing above its bound may then not be the best.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    if not left:
        return Packing([], 0, 0)
    total, goal = sum(k * n for k, n in left.items()), lower_bound(left, capacity)
    best = best_fit(left, capacity)
    best_bins = sum(n for n, _ in best)
    budget, branches = Budget(0), None
    alive = sorted(left)

    def take(need: dict[int, int], times: int) -> None:
        """Removes pieces; a negative number of times puts them back."""
        for k, n in need.items():
            before = left.get(k, 0)
            left[k] = before - n * times
            if not left[k]:
                del alive[bisect_left(alive, k)]
            elif not before:
                insort(alive, k)

    def options(longest: int, allowed: int) -> Iterator[tuple[dict[int, int], int]]:
        take({longest: 1}, 1)
        seen = fillings(capacity - longest, left, list(alive), allowed, budget)
        first = next(seen, None)
        take({longest: 1}, -1)
        given = 0
        while first is not None:
            need = dict(first)
            need[longest] = need.get(longest, 0) + 1
            lost = capacity - sum(k * n for k, n in need.items())
            yield need, lost
            given += 1
            if given == branches:
                return
            take({longest: 1}, 1)  # the enumeration looks at what is left without this piece
            first = next(seen, None)
            take({longest: 1}, -1)

    def descend(best: list[tuple[int, Filling]], best_bins: int) -> tuple[list[tuple[int, Filling]], int]:
        """The best packing that depth-first search finds within the budget, or the one given."""
        path: list[list] = [[options(alive[-1], (best_bins - 1) * capacity - total), None]]  # [options, pieces, times, waste, tried once] of each node on the way
        bins = waste = 0
        while path and best_bins > goal and budget.left > 0:
            node = path[-1]
            if node[1] is not None:  # undo the step that was tried
                need, times, lost = node[1], node[2], node[3]
                take(need, -times)
                bins, waste = bins - times, waste - times * lost
                if branches is None and times > 1 and not node[4]:
                    node[2], node[4] = 1, True
                else:
                    node[1] = None
            if node[1] is None:
                found = next(node[0], None)
                if found is None:
                    path.pop()
                    continue
                need, lost = found
                times = min(left[k] // n for k, n in need.items())
                allowed = (best_bins - 1) * capacity - total - waste
                if lost:
                    times = min(times, allowed // lost)
                if times < 1:
                    continue
                node[1:] = [need, times, lost, False]
            need, times, lost = node[1], node[2], node[3]
            take(need, times)
            bins, waste = bins + times, waste + times * lost
            budget.spend(1 + len(alive) // 64)
            allowed = (best_bins - 1) * capacity - total - waste
            if allowed < 0:
                continue
            if not alive:
                best, best_bins = [(x[2], tuple(sorted(x[1].items(), reverse=True))) for x in path], bins
                continue
            path.append([options(alive[-1], allowed), None])
        while path:  # puts the pieces back for the next round
            node = path.pop()
            if node[1] is not None:
                take(node[1], -node[2])
        return best, best_bins

    for share, branches in ((4, 2), (4, 8), (2, None)):  # narrow rounds soon come back to early choices; the last one leaves nothing out
        if best_bins <= goal:
            break
        budget = Budget(steps // share)
        best, best_bins = descend(best, best_bins)
    return Packing(best, best_bins, goal)


# ---- the pieces -------------------------------------------------------------------------------------

#: The settings of the tokenizer files whose texts are cut here; files with other settings go to the library whole.
_SETTINGS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
_WORD = re.compile(f"[^{''.join(map(chr, WHITE_SPACE))}]+")

#: What that split pattern finds in lower-cased texts of characters below U+0180, without white space.
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\x00-\\x20\\x85\\xa0{_LETTER}{_NUMBER}]+")
#: Other characters, and the one among these whose lower case is two characters.
_OTHER = re.compile("[\x00-\x08\x0e-\x1f\u0130\u0180-\U0010ffff]")
#: Endings that the pattern cuts off after an apostrophe.
_ENDING = re.compile("'(?:[stmd]|re|ve|ll)")
_LOW = np.array([ord(chr(i).lower()[0]) for i in range(0x180)], dtype=np.uint16)
#: 0 white space, 1 letters, 2 numbers (each by itself), 3 the rest.
_CLASS = np.array(
    [0 if re.match(r"[\x09-\x0d \x85\xa0]", c) else 1 if re.match(f"[{_LETTER}]", c) else 2 if re.match(f"[{_NUMBER}]", c) else 3 for c in map(chr, range(0x180))],
    dtype=np.uint8,
)
_CACHED_CHARS, _CACHE_LIMIT = 64, 1 << 18
_encoders: dict[str, WordIds] = {}


def _byte_alphabet() -> dict[int, str]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """Ids of strings as little-endian 32-bit bytes; what is missing is encoded, and kept while there is room."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, key: str) -> bytes:
        value = self.encode(key)
        if len(key) <= _CACHED_CHARS:
            if len(self) >= _CACHE_LIMIT:
                self.clear()
            self[key] = value
        return value


class WordIds:
    """Ids of texts under a word BPE that lower-cases and drops white space, as little-endian 32-bit bytes.

    If the file's settings are ``_SETTINGS``, texts of characters below U+0180 are cut into pre-tokens here, and a worker's cache, keyed by 64-bit hashes, asks the
    tokenizer's BPE model for each once. Words with other characters go to the tokenizer whole, texts with special strings as well.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and the library's threads keep memory each
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        settings = json.loads(self.tokenizer.to_str())
        self.cuts = settings["model"]["type"] == "BPE" and all(settings[k] == v for k, v in _SETTINGS.items())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.alphabet = self.tokenizer.model, _byte_alphabet()
        self.parts, self.words = _Cache(self._part), _Cache(self._whole)
        self.hashed: dict[int, bytes] = {}

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if _OTHER.search(word):
            return self.words[word]
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(word.lower())))

    def _batch(self, texts: list[str]) -> list[bytes]:
        """Texts of plain characters: pre-tokens are cut and hashed for the whole batch, and looked up once each."""
        joined = "\n".join(texts) + "\n"
        low = _LOW[np.frombuffer(joined.encode("utf-16-le"), dtype="<u2")]
        kind = _CLASS[low]
        cut_here = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        start = np.flatnonzero(np.concatenate(([True], cut_here)) & (kind != 0))
        end = np.flatnonzero(np.concatenate((cut_here, [True])) & (kind != 0)) + 1
        found, first, back = np.unique(span_hashes(low, start, end), return_index=True, return_inverse=True)
        known, values = self.hashed, []
        for h, i in zip(found.tolist(), first.tolist(), strict=True):
            value = known.get(h)
            if value is None:
                value = self._part(joined[start[i] : end[i]].lower())
                if len(known) >= _CACHE_LIMIT:
                    known.clear()
                known[h] = value
            values.append(value)
        flat = np.frombuffer(b"".join(values), dtype="<u4")
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        each = sizes[back]
        ends = np.cumsum(each)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[back] - (ends - each), each) + np.arange(int(each.sum()))]
        bounds = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
        at = np.concatenate(([0], ends))[np.searchsorted(start, bounds)]
        return [ids[a:b].tobytes() for a, b in zip(np.concatenate(([0], at[:-1])), at, strict=True)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out, plain, get = [b""] * len(texts), [], self.parts.__getitem__
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.cuts or any(s in text for s in self.special):
                out[i] = self._whole(text)
            elif _OTHER.search(text):
                out[i] = b"".join(map(self._word, _WORD.findall(text)))
            elif _ENDING.search(lowered := text.lower()):
                out[i] = b"".join(map(get, _PARTS.findall(lowered)))
            else:
                plain.append(i)
        if plain:
            for i, ids in zip(plain, self._batch([texts[i] for i in plain]), strict=True):
                out[i] = ids
        return out


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as token ids and an end, cut only beyond the capacity."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = WordIds(tokenizer_path)
        ids_of = _encoders[tokenizer_path]
        tail, step = np.asarray([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, piece, start, length, crc = [], [], [], [], []
                for i, raw in enumerate(ids_of(part.column(1).to_pylist())):
                    raw += tail
                    for k in range(0, len(raw), step):
                        cut_out = raw[k : k + step]
                        row.append(i)
                        piece.append(k // step)
                        start.append(k // 4)
                        length.append(len(cut_out) // 4)
                        crc.append(zlib.crc32(cut_out))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        release_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 4096, steps: int = 1_000_000) -> DataFrame:
    """Adds sequence_id, offset, sequences and lower_bound to pieces (doc_id, piece, start, length, ids_crc32) of at most ``capacity`` tokens.

    ``sequences`` is how many there are, ``lower_bound`` how many any packing needs: where they differ, the search of ``steps`` steps may have
    ended before the best packing. The driver sees one count a length. Pieces of one length are ranked in salted groups, so a length that a third of
    all rows share is spread; ties are ordered by id, piece and checksum, and equal rows are interchangeable.
    """
    salts = partitions(pieces.sparkSession)
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")
    pieces = cut(pieces.withColumn("salt", salt))
    groups = pieces.groupBy("length", "salt").count()
    counts = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    starts, firsts, each, offset, strides = [], [], [], [], []
    rank: dict[int, int] = dict.fromkeys(counts, 0)
    sequence = 0
    packed = bin_completion(counts, capacity, steps)
    for bins, filling in packed.groups:
        place = 0
        for length, n in filling:
            starts.append((length << 40) + rank[length])
            firsts.append(sequence)
            each.append(n)
            offset.append(place)
            strides.append(length)
            rank[length] += bins * n
            place += n * length
        sequence += bins
    order = np.argsort(np.asarray(starts, dtype=np.int64), kind="stable")
    packed = Packing([], packed.bins, packed.bound)  # the groups stay here
    plan = pieces.sparkSession.sparkContext.broadcast(
        tuple(np.asarray(x, dtype=np.int64)[order] for x in (starts, firsts, each, offset, strides))
    )
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(inside) - 1).join(base, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("r")).alias("rank"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, first, n, off, step = plan.value
        for batch in batches:
            key = (batch.column(3).to_numpy() << 40) + batch.column(5).to_numpy()
            at = np.searchsorted(begin, key, side="right") - 1
            turn, slot = np.divmod(key - begin[at], n[at])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(first[at] + turn), pa.array(off[at] + slot * step[at]), *(pa.array(np.full(len(at), x, dtype=np.int64)) for x in (packed.bins, packed.bound))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "sequences", "lower_bound"],
            )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        deal, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, sequences long, lower_bound long"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, steps: int = 1_000_000) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens, as few as the search finds.

    A null or empty text is its end token alone. Repeated rows are packed each. Null ids pass through. An empty table gives no
    rows. Only doc_id and text are read, so other columns cannot clash.
    """
    return pack(token_pieces(docs, tokenizer_path, end_id, capacity), capacity, steps)
