"""Blocks by ranges of ids: heavy and null ids have blocks of their own, which share a rank; and 80-bit windows."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushpage.llm import substrings
from hushpage.llm.blocks import range_cuts, spread_block
from hushpage.llm.substrings import held_earlier, remove_repeats


def test_heavy_and_null_ids_are_spread(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randrange(50)) for i in range(200)] + [(77, f"heavy {i} " * 900) for i in range(150)] + [(None, f"null {i} " * 900) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = range_cuts(docs, "doc_id", 12, "text")
    block, ranks = spread_block("doc_id", F.xxhash64("text"), cuts, 6)
    got = docs.select("doc_id", block.alias("block")).collect()
    of = lambda i: {x.block for x in got if x.doc_id == i}
    assert len(of(77)) >= 4 and len({ranks[b] for b in of(77)}) == 1
    assert len(of(None)) >= 3 and {ranks[b] for b in of(None)} == {max(ranks)} and max(ranks) not in {ranks[x.block] for x in got if x.doc_id is not None}
    for a in got:
        for b in got[::17]:
            if a.doc_id is not None and b.doc_id is not None and ranks[a.block] < ranks[b.block]:
                assert a.doc_id < b.doc_id


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 2), st.integers(0, 5)), max_size=40))
def test_windows_are_equal_by_all_their_bits(rows):
    keys, more, rank = (np.asarray([r[i] for r in rows], dtype=t) for i, t in enumerate((np.uint64, np.uint16, np.int64)))
    want = [any(b[:2] == a[:2] and b[2] < a[2] for b in rows) for a in rows]
    assert held_earlier(keys, more, rank).tolist() == want


def brute(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = []
    for i, t in rows:
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - 12):
            f = first[tuple(w[k : k + 13])]
            if f is not None and (i is None or f < i):
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_null_and_repeated_ids_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "text_block_count", lambda *a, **k: 9)
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    text = lambda n: " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(n))
    rows = [(r.choice([None, None, 5, 5, 5, 5, r.randrange(60)]), f"{text(r.randrange(30))} {passage if r.random() < 0.4 else ''} {text(4)}") for _ in range(200)]
    rows += [(None, None), (5, None), (3, ""), (2, passage + " ") , (61, "word " * 300_000)]
    docs = spark.createDataFrame([(*x, 1, "n") for x in rows], "doc_id long, text string, n_words int, row string")
    got = remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "row", "n_words", "n_removed", "removed_spans"]
    digest = lambda t: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, digest(x.text)) for x in got.collect()) == brute(rows)
    plain = remove_repeats(docs, report=False)
    assert plain.columns == docs.columns and plain.count() == len(rows)
