import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hushpage.llm import packing, token_counts
from hushpage.llm.packing import WordIds, best_fit, bin_completion, lower_bound, pack_documents
from hushpage.llm.token_counts import ChunkLengths

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXT = st.text(st.one_of(st.sampled_from("ab Z'st\n\t .,!1é\xa0\x1c\x85 İßΣ<|endoftext|>"), st.characters(codec="utf-8")), max_size=60)
COUNTER, IDS = ChunkLengths(BYTE, 8), WordIds(WORD)
BYTE_TOKENIZER, WORD_TOKENIZER = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_counts_equal_the_library(texts):
    assert COUNTER.count([*texts, None]).tolist() == [len(BYTE_TOKENIZER.encode(t, add_special_tokens=False).ids) for t in texts] + [0]


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_ids_equal_the_library(texts):
    want = [np.asarray(WORD_TOKENIZER.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert IDS(texts) == want


def test_special_strings_and_long_words():
    texts = ["a <|endoftext|> b  <|endoftext|>", "x" * 5000 + " " + "yé" * 100, " \n\n ", "don't stop'S 123"]
    assert COUNTER.count(texts).tolist() == [len(BYTE_TOKENIZER.encode(t, add_special_tokens=False).ids) for t in texts]
    assert IDS(texts) == [np.asarray(WORD_TOKENIZER.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@given(st.dictionaries(st.integers(1, 2**64 - 1), st.integers(0, 2**31), max_size=100), st.lists(st.integers(1, 2**64 - 1), max_size=20))
def test_length_table(entries, others):
    table = token_counts.LengthTable(8)
    keys = np.asarray(list(entries), dtype=np.uint64)
    for part in (slice(0, 40), slice(40, None)):
        table.add(keys[part], np.asarray(list(entries.values()), dtype=np.uint32)[part])
    asked = np.asarray([*entries, *others], dtype=np.uint64)
    got, found = table.get(asked)
    assert found.tolist() == [k in entries for k in asked.tolist()]
    assert got.tolist() == [entries.get(k, 0) for k in asked.tolist()]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\xa0c"), max_size=60), st.integers(1, 9))
def test_cut_texts_have_the_same_chunks(text, size):
    pieces = list(token_counts.cut_long(text, size))
    assert "".join(pieces) == text
    chunks = lambda t: sorted(t[a:b] for a, b in zip(*(x.tolist() for x in token_counts.chunk_spans([t])[1:3]))) if t else []
    assert sorted(c for p in pieces for c in chunks(p)) == chunks(text)


def test_other_settings_go_to_the_library():
    ids, tokenizer = WordIds(BYTE), BYTE_TOKENIZER
    assert not ids.cuts and IDS.cuts
    texts = ["Some Words, here", "  two  spaces", "É"]
    assert ids(texts) == [np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_bounded_caches(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE_LIMIT", 8)
    ids, counter = WordIds(WORD), ChunkLengths(BYTE, 4)
    texts = [" ".join(f"w{i}x{j}" for j in range(7)) for i in range(9)]
    assert ids(texts) == [np.asarray(WORD_TOKENIZER.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for t in texts:
        assert ids([t]) == [np.asarray(WORD_TOKENIZER.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
        assert counter.count([t]).tolist() == [len(BYTE_TOKENIZER.encode(t, add_special_tokens=False).ids)]


def test_token_counts_query(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "one two", "x"), (3, "héllo wörld " * 300, "x"), (3, "héllo wörld " * 300, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts.token_counts(docs, BYTE).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(BYTE_TOKENIZER.encode(t or "").ids), n > 512) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(docs.limit(0), BYTE).count() == 0


def fewest(lengths, capacity):
    """Exhaustive search for the number of bins."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= lengths[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, [*rest, room - lengths[i]])
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bin_completion_is_optimal_on_small_inputs(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    packed = bin_completion(counts, 20)
    got = {}
    for bins, filling in packed.groups:
        assert sum(k * n for k, n in filling) <= 20
        for k, n in filling:
            got[k] = got.get(k, 0) + bins * n
    assert got == counts
    assert packed.bound == lower_bound(counts, 20) if counts else packed.bound == 0
    assert packed.bound <= packed.bins == sum(b for b, _ in packed.groups) == (fewest(lengths, 20) if lengths else 0)


@pytest.mark.parametrize("low,high,n,most", [(1000, 2100, 20_000, 1.0), (1300, 1500, 3_000, 1.0), (600, 1400, 300, 0.99), (1, 4096, 3_000, 1.0)])
def test_search_is_bounded_and_no_worse_than_best_fit(low, high, n, most):
    r = random.Random(1)
    counts = Counter(r.randrange(low, high) for _ in range(n))
    began = time.process_time()
    packed = bin_completion(dict(counts), 4096)
    assert time.process_time() - began < 60
    got = Counter()
    for bins, filling in packed.groups:
        assert sum(k * m for k, m in filling) <= 4096
        for k, m in filling:
            got[k] += bins * m
    assert got == counts and packed.bound <= packed.bins <= most * sum(b for b, _ in best_fit(dict(counts), 4096))


def test_pack_documents(spark):
    rows = [(i, "word " * (i * 37 % 300), "s") for i in range(60)] + [(7, None, "s"), (None, "a", "t"), (99, "long " * 9000, "u"), (99, "long " * 9000, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = pack_documents(docs, WORD).collect()
    ids = lambda t: [*WORD_TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1]
    want = []
    for i, t, _ in rows:
        all_ids = np.asarray(ids(t), dtype="<u4")
        want += [(i, k // 4096, k, len(c := all_ids[k : k + 4096]), zlib.crc32(c.tobytes())) for k in range(0, len(all_ids), 4096)]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == -(-sum(w[3] for w in want) // 4096)
    assert pack_documents(docs.limit(0), WORD).count() == 0


def test_pack_searches_where_best_fit_is_above_the_bound(spark):
    """Six lengths that best fit puts into three sequences and the search into two."""
    pieces = spark.createDataFrame([(i, 0, 0, n, 7) for i, n in enumerate([1800, 1400, 1296, 1300, 1200, 1196])], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces).collect()
    assert {r.sequences for r in got} == {len({r.sequence_id for r in got})} and {r.lower_bound for r in got} == {2}
    alone = spark.createDataFrame([(i, 0, 0, 2100, 7) for i in range(5)] + [(9, 0, 0, 1990, 7)], pieces.schema)
    assert len({r.sequence_id for r in packing.pack(alone, steps=50).collect()}) == 5
