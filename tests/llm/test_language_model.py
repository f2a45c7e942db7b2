"""The language model: distributions that sum to one, rows of class counts, and scores against plain Python."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushpage.llm import language_model as lm
from hushpage.llm.toxicity import id_remainder
from tests.llm.test_operators import SCHEMA, make_docs


def test_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    model = lm.LeafModel(r.normal(0, 2, (lm.ROWS, lm.WIDTH)).astype(np.float32))
    prior = r.random(lm.WIDTH)
    prior /= prior.sum()
    one, two = (np.exp(r.normal(0, 1, (5, lm.WIDTH))).astype(np.float32) for _ in range(2))
    leaves = np.arange(lm.LEAVES)
    for context in range(5):
        features = [np.full(lm.LEAVES, r.integers(1 << 62), dtype=np.uint64) for _ in range(3)]
        at = np.full(lm.LEAVES, context)
        p = np.exp(lm.log_classes(prior, one, two, at, at, leaves // lm.WIDTH))
        p = p * np.exp(model.log(lm.LeafModel.rows(features, leaves // lm.WIDTH), leaves % lm.WIDTH))
        assert math.isclose(p.sum(), 1, abs_tol=1e-4)
    n, v = r.integers(1, 500, 40), 40  # words of one shared leaf, and the unknown word
    words = np.exp(np.log(np.append(n, 0) + 0.5) - np.log(n.sum() + 0.5 * (v + 1)))
    assert math.isclose(words.sum(), 1, abs_tol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 31), st.sampled_from([1, 2, 3, 40, 254, 255, 256, 70_000, 2**40]), max_size=6), min_size=1, max_size=12))
def test_rows_of_counts(words):
    counts = np.zeros((len(words), lm.WIDTH), dtype=np.int64)
    for i, row in enumerate(words):
        for c, n in row.items():
            counts[i, c] = n
    edges = np.asarray([0, len(words) // 2, len(words)])
    parts, start = [], 0
    for blob, size in zip(lm.pack_counts(counts, edges), np.diff(edges)):
        many, kind, n = lm.unpack_counts(blob, size)
        parts.append((start + np.repeat(np.arange(size), many), kind, n))
        start += size
    word, kind, n = (np.concatenate(x) for x in zip(*parts))
    assert Counter({(w, k): c for w, k, c in zip(word.tolist(), kind.tolist(), n.tolist())}) == Counter({(i, c): n for i, row in enumerate(words) for c, n in row.items()})
    table = lm.ClassRows(np.concatenate([word, word]), np.concatenate([kind, kind]), np.concatenate([n, n]), len(words))
    factors = lm.class_factors([table.blob(np.arange(len(words)))], np.asarray([len(words)]), 2.0 * counts.sum(axis=1), np.full(lm.WIDTH, 1 / lm.WIDTH))
    for i, row in enumerate(words):
        total = 2 * sum(row.values())
        for c in range(lm.WIDTH):
            kept = 2 * row.get(c, 0) >= 2 and 16 * row.get(c, 0) >= total
            share = (2 * row.get(c, 0) + lm.SMOOTH / lm.WIDTH) / (total + lm.SMOOTH)
            assert math.isclose(factors[i, c], math.sqrt(share * lm.WIDTH) if kept else 1, rel_tol=0.02)


def plain_scores(rows, held):
    """Scores without gradient rounds, word by word: counts of classes by previous word and by the one before it, and counts of leaves."""
    words = lambda t: [*(t or "").encode().lower().split(), None]
    shared = {}
    for _, t, *_ in rows:
        raw = words(t)
        shared |= dict(zip(raw, lm.Tokens([b" ".join(raw[:-1])]).shared.tolist()))
    hashes = {w: int(lm.Tokens([w or b""]).hash[0]) for w in shared}
    train = [words(t) for i, t, *_ in rows if not held(i)]
    n = Counter(w for ws in train for w in ws)
    by_class = defaultdict(list)
    for w in n:
        by_class[shared[w] // lm.WIDTH].append(w)
    leaf = dict(shared)
    for c, ws in by_class.items():
        for k, w in enumerate(sorted(ws, key=lambda w: (-n[w], hashes[w]))[: lm.OWN]):
            leaf[w] = c * lm.WIDTH + k
    leaf_n, leaf_v = Counter(), Counter()
    for w, c in n.items():
        leaf_n[leaf[w]] += c
        leaf_v[leaf[w]] += 1
    prior = np.asarray([sum(leaf_n[c * lm.WIDTH + k] for k in range(lm.WIDTH)) + 0.5 for c in range(lm.WIDTH)])
    prior = prior / prior.sum()
    rows_of = [defaultdict(Counter), defaultdict(Counter)]
    for ws in train:
        context = ["start", "start", *ws]
        for k, w in enumerate(ws):
            rows_of[0][context[k + 1]][leaf[w] // lm.WIDTH] += 1
            rows_of[1][context[k]][leaf[w] // lm.WIDTH] += 1

    def factor(f, context, c):
        row, seen = rows_of[f][context], n[context] if context != "start" else 0
        total = sum(row.values())
        if row[c] < 2 or 8 * row[c] < total:
            return 1.0
        return math.sqrt(((row[c] / total) * seen + lm.SMOOTH * prior[c]) / (seen + lm.SMOOTH) / prior[c])

    out = []
    for _, t, *_ in rows:
        ws, total = words(t), 0.0
        context = ["start", "start", *ws]
        for k, w in enumerate(ws):
            c, inner = divmod(leaf[w], lm.WIDTH)
            each = [prior[x] * factor(0, context[k + 1], x) * factor(1, context[k], x) for x in range(lm.WIDTH)]
            p = each[c] / sum(each)
            p *= (leaf_n[leaf[w]] + 0.5) / sum(leaf_n[c * lm.WIDTH + x] + 0.5 for x in range(lm.WIDTH))
            if inner >= lm.OWN:
                p *= (n[w] + 0.5) / (leaf_n[leaf[w]] + 0.5 * (leaf_v[leaf[w]] + 1))
            total += math.log10(p)
        out.append(total)
    return out


def test_scores_follow_plain_counts(spark):
    rows = [(i, t, *r) for i, t, *r in make_docs(4, 120)]
    rows = [(i if k % 11 else None, *r) for k, (i, *r) in enumerate(rows)]
    docs = spark.createDataFrame(rows, SCHEMA)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    got = Counter((r.doc_id, r.n_tokens, round(r.score, 1)) for r in lm.language_model_scores(docs, id_remainder("doc_id", 5) == 1, rounds=0).collect())
    tokens = lambda t: len((t or "").split()) + 1
    want = Counter((r[0], tokens(r[1]), round(s, 1)) for r, s in zip(rows, plain_scores(rows, held)))
    assert sum((got & want).values()) >= 0.9 * len(rows)  # shares travel in steps of 2**(1/32), so some sums round otherwise
    assert sorted((i or -1, n) for i, n, _ in got.elements()) == sorted((i or -1, n) for i, n, _ in want.elements())
    for (i, n, s), (j, m, t) in zip(sorted(got.elements(), key=str), sorted(want.elements(), key=str)):
        assert abs(s - t) < 0.02 * n + 0.11


def scored(docs):
    return sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 9), round(r.score, 6)) for r in lm.language_model_scores(docs, id_remainder("doc_id", 5) == 1, rounds=2).collect())


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(make_docs(2, 80), SCHEMA)
    want = scored(docs.repartition(7))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert scored(docs.coalesce(1)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_many_blocks(spark, monkeypatch):
    """Several blocks and rounds: counts stay exact, and contexts help."""
    monkeypatch.setattr(lm, "text_block_count", lambda *a, **k: 5)
    rows = make_docs(6, 150)
    got = lm.language_model_scores(spark.createDataFrame(rows, SCHEMA), id_remainder("doc_id", 5) == 1, rounds=2).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    n = sum(len((t or "").split()) + 1 for i, t, *_ in rows if not held(i))
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)


def test_long_text_and_empty_tables(spark):
    rows = [(1, "one two three " * 400_000), (2, ""), (3, None), (4, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.language_model_scores(docs, F.lit(False), rounds=1).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {1: 1_200_001, 2: 1, 3: 1, 4: 4}
    assert got[2].score == got[3].score
    assert lm.language_model_scores(docs.limit(0), F.lit(False), rounds=1).count() == 0
