"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text starts as single characters; an agenda holds all adjacent pairs that form a piece, the highest score first and the leftmost of
equal scores, and each merge puts the two new neighbouring pairs on it. No piece spans the start of a word, so words are merged by
themselves and a worker keeps the ids of those that it has met. The agendas of a batch's new words are worked together, as rows of an
array that each give up their best pair a round; a long word has a heap. The library normalises texts, and checks the agenda's ids
and the decoded texts, both in Arrow batches; it makes neither.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from hushpage.llm.textblocks import mix, release_memory, span_hashes
from hushpage.llm.token_counts import LengthTable

SPACE = "▁"
#: Characters that are worked on at a time: bounds the ids that are Python objects.
_PART = 1 << 19
#: Characters of a word whose agenda is a row of an array, and words that are merged together.
_SHORT, _TOGETHER = 48, 1 << 14
_NO_PAIR = np.int32(2**31 - 1)


def ragged(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - counts), counts)


class MergeVocabulary:
    """Pieces, scores and kinds of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = proto.ModelProto.SentencePiece
        rules = model.normalizer_spec
        usual = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or not usual:
            raise ValueError("the model must be a BPE with byte fallback that puts a space before a text and keeps all others")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = self.library.eos_id()
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.bytes = [byte[b] for b in range(256)]
        unknown = model.trainer_spec.unk_surface.encode()
        shown = {kinds.CONTROL: lambda p: b"", kinds.UNKNOWN: lambda p: unknown, kinds.BYTE: lambda p: bytes([int(p.piece[3:5], 16)])}
        self.surface = [shown.get(p.type, lambda p: p.piece.replace(SPACE, " ").encode())(p) for p in model.pieces]
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.control = np.asarray([p.type == kinds.CONTROL for p in model.pieces])
        self.spaced = {i for p, i in self.ids.items() if p.startswith(SPACE)}
        longer = [p for p in self.ids if len(p) > 1]
        inside = set().union(*longer) if longer else set()
        alone = "".join(c for c in "\t\n\r" if c not in inside)  # in no merge, so words end there
        self.alone = alone
        self.words = bool(alone) and not any(SPACE in p.lstrip(SPACE) for p in longer)  # else whole texts are merged
        self._pairs()

    def _pairs(self) -> None:
        """Symbols are pieces and the characters in them. A hash table gives the symbol that two make; its rank goes by score."""
        symbols = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p}):
            symbols.setdefault(c, len(self.surface) + len(symbols))
        width = max(symbols.values()) + 1
        self.character = np.full(0x110000, width, dtype=np.int32)  # that symbol makes no pair
        for piece, i in symbols.items():
            if len(piece) == 1:
                self.character[ord(piece)] = i
        made = {}
        for piece, i in self.ids.items():
            made.update({(symbols[piece[:k]], symbols[piece[k:]]): i for k in range(1, len(piece)) if piece[:k] in symbols and piece[k:] in symbols})
        self.pairs, self.width = LengthTable(max(2, (2 * len(made)).bit_length())), width + 1
        self.pairs.add(self._keys(*(np.asarray([p[i] for p in made], dtype=np.int64) for i in (0, 1))), np.asarray(list(made.values()), dtype=np.uint32))
        place = {s: i for i, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = np.zeros(len(self.surface), dtype=np.int32)
        for piece, i in self.ids.items():
            self.rank[i] = place[self.scores[piece]]

    def _keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mix(left.astype(np.uint64) * np.uint64(self.width) + right.astype(np.uint64) + np.uint64(1))  # mixing is one to one

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pieces that pairs of symbols make."""
        piece, found = self.pairs.get(self._keys(left, right))
        return np.where(found, self.rank[piece], _NO_PAIR)

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Packed ids of many normalised words."""
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        ids, counts = self.merge_spans("".join(words), ends - [len(w) for w in words], ends)
        last = np.cumsum(counts)
        return [ids[a:b].tobytes() for a, b in zip((last - counts).tolist(), last.tolist(), strict=True)]

    def merge_spans(self, text: str, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans of a normalised text one after the other, how many each has)."""
        points, parts = np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), []
        counts = np.zeros(len(start), dtype=np.int64)
        order = np.argsort(end - start, kind="stable")
        short = int(np.searchsorted((end - start)[order], _SHORT, side="right"))
        for first in range(0, short, _TOGETHER):
            some = order[first : min(first + _TOGETHER, short)]
            ids, counts[some] = self._merge_rows(points, start[some], end[some])
            parts.append(ids)
        for i in order[short:].tolist():
            ids = self.merge(text[start[i] : end[i]])
            counts[i] = len(ids)
            parts.append(np.asarray(ids, dtype="<i4"))
        held = np.concatenate([np.zeros(0, dtype="<i4"), *parts])
        ends = np.cumsum(counts[order])
        began = np.empty(len(order), dtype=np.int64)
        began[order] = ends - counts[order]
        return held[ragged(began, counts)], counts

    def _merge_rows(self, points: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As merge_spans, for spans of like lengths: a row has a word's symbols where they start, the next and the one before of each, and
        the ranks of the pairs that they begin."""
        sizes = last - first
        width, row = int(sizes.max()) + 1, np.repeat(np.arange(len(sizes)), sizes)
        col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = points[first[row] + col]
        symbols = np.full((len(sizes), width), self.width - 1, dtype=np.int32)  # makes no pair
        symbols[row, col] = self.character[letters]
        ranks = np.full((len(sizes), width), _NO_PAIR, dtype=np.int32)
        ranks[row, col] = self._made(symbols[row, col], symbols[row, col + 1])
        flat, pairs = symbols.ravel(), ranks.ravel()  # views; a symbol is a place in them
        after = np.minimum(np.arange(1, len(flat) + 1), len(flat) - 1).astype(np.int32)
        before = np.maximum(np.arange(-1, len(flat) - 1), 0).astype(np.int32)
        left = np.arange(len(sizes))
        while True:
            held = ranks if len(left) == len(sizes) else ranks[left]
            best = held.argmin(axis=1)  # the leftmost of equal ranks
            open_ = held[np.arange(len(left)), best] != _NO_PAIR
            left, at = left[open_], (left * width + best)[open_]
            if not len(left):
                break
            other = after[at]
            flat[at] = self.pairs.get(self._keys(flat[at], flat[other]))[0]
            flat[other], pairs[other] = -1, _NO_PAIR
            follow = after[other]
            after[at], before[follow] = follow, at
            pairs[at] = self._made(flat[at], flat[follow])
            inner = at[best[open_] > 0]
            head = before[inner]
            pairs[head] = self._made(flat[head], flat[inner])
        kept = symbols[row, col] >= 0
        found, row, letters = symbols[row, col][kept], row[kept], letters[kept]
        if (found < len(self.surface)).all():
            return found.astype("<i4"), np.bincount(row, minlength=len(sizes))
        spelt = [[x] if x < len(self.surface) else [self.bytes[b] for b in chr(c).encode()] for x, c in zip(found.tolist(), letters.tolist(), strict=True)]
        counts = np.bincount(row, weights=[len(x) for x in spelt], minlength=len(sizes)).astype(np.int64)
        return np.asarray([i for x in spelt for i in x], dtype="<i4"), counts  # characters that are no pieces became bytes

    def merge(self, text: str) -> list[int]:
        """Ids of a normalised text. Symbols are spans from a start to ``end[start]``; ``before`` names the symbol on their left."""
        scores, n = self.scores, len(text)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(-scores[text[i : i + 2]], i, i + 2) for i in range(n - 1) if text[i : i + 2] in scores]
        heapq.heapify(agenda)

        def offer(left: int, stop: int) -> None:
            score = scores.get(text[left:stop])
            if score is not None:
                heapq.heappush(agenda, (-score, left, stop))

        while agenda:
            _, left, stop = heapq.heappop(agenda)
            middle = end[left]
            if not left < middle < stop or end[middle] != stop:
                continue  # one of the two has gone into another merge
            end[left], end[middle] = stop, -1
            if stop < n:
                before[stop] = left
                offer(left, end[stop])
            if before[left] >= 0:
                offer(before[left], stop)
        out, at = [], 0
        while at < n:
            piece = text[at : end[at]]
            found = self.ids.get(piece)
            out += [found] if found is not None else [self.bytes[b] for b in piece.encode()]
            at = end[at]
        return out

    def decode(self, ids: list[int], broken: bool = True) -> str:
        """The text of ids; the space before it goes, bytes that form no character become U+FFFD each. ``broken``: control pieces may stand
        elsewhere than at the end."""
        runs = [ids]
        if broken:  # bytes on both sides of a control piece form no character
            at = [i for i, x in enumerate(ids) if x in self.silent]
            runs = [ids[a + 1 : b] for a, b in zip([-1, *at], [*at, len(ids)], strict=True)]
        out = "".join([b"".join(map(self.surface.__getitem__, run)).decode("utf-8", "sentence-piece-bytes") for run in runs])
        first = next((i for i in ids if i not in self.silent), None)
        return out[1:] if first in self.spaced else out


codecs.register_error("sentence-piece-bytes", lambda e: ("�" * (e.end - e.start), e.end))


class WordIds:
    """Ids of normalised words, kept by 64-bit hashes in numpy arrays; all are forgotten when 2**(bits - 1) words are held.

    ``wrong`` marks the words to which the library gives other ids.
    """

    def __init__(self, vocabulary: MergeVocabulary, bits: int = 21):
        self.vocabulary, self.bits = vocabulary, bits
        self._forget()

    def _forget(self) -> None:
        self.table, self.held = LengthTable(self.bits), 0
        self.start, self.counts, self.wrong = (np.zeros(1 << 12, dtype=t) for t in (np.int64, np.int32, bool))
        self.ids, self.used = np.zeros(1 << 14, dtype="<i4"), 0

    def of(self, texts: list[str], check: bool = False) -> tuple[list[bytes], list[bool]]:
        """(packed ids, whether the library agrees on all words) of normalised texts. The library sees words when they are new."""
        sizes = np.asarray([len(t) for t in texts], dtype=np.int64)
        text = "".join(texts)
        if not text:
            return [b""] * len(texts), [True] * len(texts)
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        start, end = self._words(points, np.cumsum(sizes) - sizes)
        keys, first, back = np.unique(np.maximum(span_hashes(points, start, end), np.uint64(1)), return_index=True, return_inverse=True)
        place, found = self.table.get(keys)
        if not found.all():
            if np.count_nonzero(~found) > self.table.room():
                self._forget()
                found[:] = False
            if np.count_nonzero(~found) > self.table.room():  # more new words than it can hold at all
                half = len(texts) // 2
                if not half:
                    ids, counts = self.vocabulary.merge_spans(text, start, end)
                    return [ids.tobytes()], [not check or not self._compare(text, start, end, ids, counts).any()]
                parts = self.of(texts[:half], check), self.of(texts[half:], check)
                return parts[0][0] + parts[1][0], parts[0][1] + parts[1][1]
            new = np.flatnonzero(~found)
            place[new] = self._add(keys[new], text, start[first[new]], end[first[new]], check)
        place = place[back].astype(np.int64)
        counts = self.counts[place].astype(np.int64)
        ids, total = self.ids[ragged(self.start[place], counts)], np.append(0, np.cumsum(counts))
        word = np.searchsorted(start, np.append(np.cumsum(sizes) - sizes, len(points)))
        cuts = total[word].tolist()
        bad = np.append(0, np.cumsum(self.wrong[place]))[word]
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], (np.diff(bad) == 0).tolist()

    def _words(self, points: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words: runs of spaces with what follows them, or characters that no piece has inside."""
        begins = np.zeros(len(points) + 1, dtype=bool)
        begins[texts] = True
        if self.vocabulary.words:
            space = points == ord(SPACE)
            begins[1:-1] |= space[1:] & ~space[:-1]
            for c in self.vocabulary.alone:
                alone = points == ord(c)
                begins[:-1] |= alone
                begins[1:] |= alone
        start = np.flatnonzero(begins[:-1])
        return start, np.append(start[1:], len(points))

    def _add(self, keys: np.ndarray, text: str, start: np.ndarray, end: np.ndarray, check: bool) -> np.ndarray:
        ids, counts = self.vocabulary.merge_spans(text, start, end)
        place = np.arange(self.held, self.held + len(keys))
        while len(self.start) < self.held + len(keys):
            self.start, self.counts, self.wrong = (np.append(x, np.zeros_like(x)) for x in (self.start, self.counts, self.wrong))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[place], self.counts[place] = self.used + np.cumsum(counts) - counts, counts
        self.wrong[place] = self._compare(text, start, end, ids, counts) if check else False
        self.held, self.used = self.held + len(keys), self.used + len(ids)
        self.table.add(keys, place.astype(np.uint32))
        return place

    def _compare(self, text: str, start: np.ndarray, end: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which words get other ids from the library. It puts a space before a text; where a word has none, a character that no piece has
        inside comes first."""
        library, alone = self.vocabulary.library, self.vocabulary.alone[:1]
        front = np.asarray(library.encode(alone, num_threads=1), dtype="<i4")
        wrong, ends = np.zeros(len(start), dtype=bool), np.append(0, np.cumsum(counts))
        for first in range(0, len(start), _TOGETHER):
            some = slice(first, first + _TOGETHER)
            words = [text[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]
            own = np.asarray([w[0] == SPACE and len(w) > 1 for w in words])  # an empty text has no space before it
            found = library.encode([w[1:] if o else alone + w for w, o in zip(words, own, strict=True)], num_threads=1)
            lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            flat, last = np.fromiter(chain.from_iterable(found), dtype="<i4"), np.cumsum(lengths)
            began = last - lengths + np.where(own, 0, len(front))
            same = last - began == counts[some]
            wrong[some] = ~same
            at = np.flatnonzero(same)
            n = counts[some][at]
            equal = flat[ragged(began[at], n)] == ids[ragged(ends[first + at], n)]
            wrong[first + at] = np.add.reduceat(np.append(~equal, False), np.cumsum(n) - n)[: len(at)] > 0 if len(at) else False
        return wrong


def parts_of(text: str, size: int = _PART) -> Iterator[str]:
    """A normalised text in parts of about ``size`` characters, each starting with a word's first space."""
    at = 0
    while len(text) - at > 2 * size:
        cut = text.find(SPACE, at + size)
        while cut >= 0 and text[cut - 1] == SPACE:
            cut = text.find(SPACE, cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Coder:
    """Encodes and decodes texts, some at a time, and compares them with the library where it is asked to."""

    def __init__(self, path: str, part: int = _PART):
        self.vocabulary, self.part = MergeVocabulary(path), part
        self.words = WordIds(self.vocabulary)

    def encode(self, texts: list[str | None], check: str | None) -> tuple[list[bytes], list[bool]]:
        """(packed ids with the end id, whether the library has the same) of each text."""
        library, end = self.vocabulary.library, np.asarray([self.vocabulary.end], dtype="<i4").tobytes()
        parts = [list(parts_of(t, self.part)) if self.vocabulary.words else [t] for t in (library.normalize(t or "") for t in texts)]
        ids, right = self.words.of([p for own in parts for p in own], check == "words")
        ends = np.cumsum([0, *map(len, parts)]).tolist()
        out, same = [], []
        for text, own, a, b in zip(texts, parts, ends[:-1], ends[1:], strict=True):
            out.append(b"".join([*ids[a:b], end]))
            equal = all(right[a:b])
            if check == "texts":
                given = [text or ""] if len(own) == 1 else [p[1:] for p in own]  # the library puts a space before each
                equal = all(np.array_equal(np.frombuffer(x, "<i4"), library.encode(y, num_threads=1)) for x, y in zip(ids[a:b], given, strict=True))
            same.append(equal)
        return out, same

    def decode(self, packed: list[bytes | None], check: bool) -> tuple[list[str | None], list[bool]]:
        """(text, whether the library has the same) of packed ids; null gives null."""
        library, most = self.vocabulary.library, len(self.vocabulary.surface)
        out, same = [], []
        for ids in packed:
            if ids is None:
                out.append(None)
                same.append(True)
                continue
            values = np.frombuffer(ids, dtype="<i4")
            if len(values) and not 0 <= values.min() <= values.max() < most:
                raise ValueError("an id is not in the vocabulary")
            texts, equal = [], True
            for at in self._cuts(values):
                part = values[at].tolist()
                text = self.vocabulary.decode(part, bool(self.vocabulary.control[values[at][:-1]].any()))
                equal = equal and (not check or text == library.decode(part))
                texts.append(text)
            out.append(" ".join(texts))  # decoding takes one space from each part
            same.append(equal)
        return out, same

    def _cuts(self, values: np.ndarray) -> Iterator[slice]:
        """Runs of ids; all but the first start with a piece that has a space."""
        if len(values) <= 2 * self.part:
            yield slice(0, len(values))
            return
        starts = np.flatnonzero(np.isin(values, list(self.vocabulary.spaced)))
        ends = [int(starts[i]) for i in np.searchsorted(starts, np.arange(self.part, len(values) - 1, self.part)) if i < len(starts)]
        heard = np.flatnonzero(~np.isin(values, list(self.vocabulary.silent)))
        ends = sorted({e for e in ends if len(heard) and e > heard[0]})
        for a, b in zip([0, *ends], [*ends, len(values)], strict=True):
            yield slice(a, b)


_coders: dict[str, Coder] = {}


def _coder(path: str) -> Coder:
    if path not in _coders:  # once a worker
        _coders[path] = Coder(path)
    return _coders[path]


def _groups(sizes: list[int], most: int = _PART) -> Iterator[slice]:
    """Runs of rows of about ``most`` together."""
    first = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield slice(first, i + 1)
            first, total = i + 1, 0
    if first < len(sizes):
        yield slice(first, len(sizes))


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))


def _sizes(column: pa.Array) -> list[int]:
    """Bytes or elements of each value; null has none."""
    lengths = column.value_lengths() if pa.types.is_list(column.type) else pc.binary_length(column)
    return pc.fill_null(lengths, 0).to_pylist()


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: str | None = "words", decode: bool = False) -> DataFrame:
    """(id, ids, agrees) of every whole text, or with ``decode`` (id, ids, decoded, agrees): the ids, their end id last, and their text.

    ``agrees`` says that the library gives the same, for decoding the whole text of the ids, for encoding each word of the text: it sees the
    words of each Arrow batch that are new to the worker, and no piece crosses words. With ``check="texts"`` it encodes every whole text, too,
    which takes about as long as all the rest; texts of over 2**20 characters are compared in parts that start with words. Without ``check`` all agree. Null and empty texts have the end id alone. Repeated rows are encoded each, null ids pass
    through, only the two named columns are read, and an empty table gives no rows. A worker tells the words that it keeps apart by 64-bit
    hashes: of a million words, two share one with a probability of 3e-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model_path)
        for batch in batches:
            for at in _groups(_sizes(batch.column(1))):
                part = batch.slice(at.start, at.stop - at.start)
                packed, same = coder.encode(part.column(1).to_pylist(), check)
                columns, names = [part.column(0), _lists(packed)], [id_col, "ids"]
                if decode:
                    texts, also = coder.decode(packed, check is not None)
                    columns.append(pa.array(texts, pa.string()))
                    names.append("decoded")
                    same = [a and b for a, b in zip(same, also, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(same, pa.bool_())], names=[*names, "agrees"])
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, " + "decoded string, " * decode + "agrees boolean")


def decode_ids(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", check: bool = True) -> DataFrame:
    """(id, text, agrees): the text of each row's ids, and whether the library gives the same. Null ids, and lists that hold a null,
    give null; an id outside the vocabulary is an error. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model_path)
        for batch in batches:
            for at in _groups(_sizes(batch.column(1))):
                part = batch.slice(at.start, at.stop - at.start)
                packed = [None if x is None or None in x else np.asarray(x, dtype="<i4").tobytes() for x in part.column(1).to_pylist()]
                texts, same = coder.decode(packed, check)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(same, pa.bool_())], names=[id_col, "text", "agrees"])
        release_memory()

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, rows[ids_col].cast("array<int>").alias(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string, agrees boolean")
