"""Each operator against brute force on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushpage.llm import jaccard_join
from hushpage.llm.components import connected_components
from hushpage.llm.fingerprints import combine, edited, fingerprint_with_next, likeness, parse, render, vectors
from hushpage.llm.jaccard_join import PrefixTree, keep_one_of_each, near_duplicates
from hushpage.llm.keysets import bucket_edges, decode_sorted, encode_sorted
from hushpage.llm.language_model import language_model_scores
from hushpage.llm.mixing import mix_sources, mixed_documents, quality_weight, source_targets, word_count
from hushpage.llm.substrings import remove_repeats
from hushpage.llm.textblocks import gram_hashes, word_hashes
from hushpage.llm.toxicity import id_remainder, toxicity_scores, without_toxic
from hushpage.llm.vector_search import exact_top_k

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi omi pi rho sig tau ups".split()


def make_docs(seed=0, n=60):
    """Texts with exact copies, near copies, shared passages, odd white space, nulls and repeated rows."""
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(WORDS) + r.choice(["", "", "x", "y"]) for _ in range(k))
    base, passage = text(90), text(20)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = text(r.choice([0, 1, 4, 5, 30, 80]))
        elif kind == 1:
            w = base.split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                w[r.randrange(len(w))] = "changed"
            t = "  ".join(w)
        elif kind == 2:
            t = text(10) + "\n" + passage + "\t" + text(6)
        elif kind == 3:
            t = base.upper()
        elif kind == 4:
            t = (text(3) + "\n") * 12
        else:
            t = None if i % 12 == 5 else text(40)
        rows.append((1000 - 7 * i, t, r.choice(["en", None]), r.choice(["s1", "s2", "s2", None]), 5))
    rows += rows[:4]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = "block long, id string, tokens int, key string, size int, unit int"  # names the operators use inside
    return spark.createDataFrame([(*r, 1, "i", 2, "k", 3, 4) for r in rows], f"{SCHEMA}, {extra}").repartition(5)


@pytest.mark.parametrize("keys", [[], [0], [5, 9], [0, 2**64 - 1], list(range(0, 5000, 3))])
def test_key_codec(keys):
    a = np.asarray(keys, dtype=np.uint64)
    assert np.array_equal(decode_sorted(encode_sorted(a)), a)


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_key_codec_random(keys):
    a = np.asarray(sorted(keys), dtype=np.uint64)
    assert np.array_equal(decode_sorted(encode_sorted(a)), a)
    edges = bucket_edges(a, 7, 64)
    assert edges[0] == 0 and edges[-1] == len(a) and np.all(np.diff(edges) >= 0)


@given(st.lists(st.text(alphabet="ab \t\né\x0b", max_size=30), max_size=6))
def test_word_hashes_follow_split(texts):
    raw = [t.encode() for t in texts]
    h, off = word_hashes(raw)
    assert [b - a for a, b in zip(off, off[1:])] == [len(t.split()) for t in raw]
    seen = {}
    for w, x in zip([w for t in raw for w in t.split()], h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_gram_hashes_tell_order():
    h, _ = word_hashes([b"a b a b a", b"b a"])
    g = gram_hashes(h[:5], 2)
    assert g[0] == g[2] and g[1] == g[3] and g[0] != g[1]


def test_mixing(docs, rows):
    size = word_count(F.col("text"))
    got = mix_sources(docs, size, quality_weight(F.col("text"), size)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        want[r[3]] += len((r[1] or "").encode().split())
    total, names = 1.5 * sum(want.values()), sorted(k for k in want if k is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = total - sum(2 * want[s] for s in names if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * want[s]}
        if not over:
            break
        free -= over
    target = {s: share[s] if s in free else 2.0 * want[s] for s in names}
    source_of = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == want[s] and math.isclose(r.target, target[s], abs_tol=1e-6)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * max(len((r[1] or "").split()) for r in rows if r[3] == s)
    again = mix_sources(docs.repartition(2), size, quality_weight(F.col("text"), size)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixed_documents(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: sum(r.copies for r in got if r.doc_id == i) for i in source_of if any(r.copies for r in got if r.doc_id == i)})
    assert mix_sources(docs.limit(0), size, quality_weight(F.col("text"), size)).count() == 0


def test_targets_of_many_sources(spark):
    r = random.Random(11)
    for _ in range(4):
        sizes = {f"s{i}": r.choice([0, 1, 5, 100, 1000, 3000]) for i in range(12)}
        got = source_targets(spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, docs long"))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
        free, left = set(sizes), 1.5 * sum(sizes.values())
        while free:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = {s for s in free if share[s] > 2 * sizes[s]}
            if not over:
                break
            free -= over
            left -= sum(2 * sizes[s] for s in over)
        for row in got.collect():
            want = share[row.source] if row.source in free else 2.0 * sizes[row.source]
            assert math.isclose(row.target, want, abs_tol=1e-6), row


def test_substrings(docs, rows):
    got = remove_repeats(docs).collect()
    assert len(got) == len(rows) and remove_repeats(docs).columns == [*docs.columns, "n_words", "n_removed", "removed_spans"]
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), kept))
    assert sorted((r.doc_id, r.n_words, r.n_removed, b" ".join((r.text or "").encode().split())) for r in got) == sorted(want)
    originals = {r[0]: r[1] for r in rows}
    for r in got:
        assert sum(s.end - s.start for s in r.removed_spans) == r.n_removed
        if not r.n_removed:
            assert r.text == originals[r.doc_id]
    assert remove_repeats(docs.limit(0)).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows):
    sets, parent = [(r[0], shingles(r[1])) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_near_duplicates(spark, seed):
    rows = make_docs(seed, 90)
    r = random.Random(seed)
    chain = [r.choice(WORDS) + str(i % 3) for i in range(120)]  # links that only a path of neighbours shows
    for step in range(12):
        for _ in range(2):
            chain[r.randrange(120)] = "z" + str(r.randrange(99))
        rows.append((5000 + step, " ".join(chain), None, None, 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = near_duplicates(docs).collect()
    assert sorted(map(tuple, got)) == sorted(classes(rows))
    assert near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_with_a_shingle_of_many_components(spark, monkeypatch):
    """One shingle that hundreds of texts share without being alike: trees are searched, and no link is lost."""
    monkeypatch.setattr(jaccard_join, "TOKEN_PAIRS", 50)
    monkeypatch.setattr(jaccard_join, "TREE_SETS", 8)
    r = random.Random(9)
    common = [f"c{i}" for i in range(9)]
    rows = []
    for i in range(70):
        own = r.sample(common, 5) if i % 3 else common[:5]
        more = [r.choice("xyz") for _ in range(i % 4)]
        rows.append((i, " ".join([*own, *more, *common[:5]]), None, None, 1))
        if i % 7 == 0:
            rows.append((1000 + i, " ".join([*own, *more, *common[:6]]), None, None, 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, near_duplicates(docs).collect())) == sorted(classes(rows))


def test_near_duplicates_null_ids_and_pipeline_stage(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A b c d e  f", "x"), (None, "a b c d e f", "x"), (3, "", "x"), (4, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {(1, 2, 1), (2, 2, 1), (None, 2, None), (3, 0, 3), (4, 0, 4)}
    kept = keep_one_of_each(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "None"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=1, max_size=12), st.sets(st.integers(0, 14), min_size=1))
def test_prefix_tree(sets, query):
    tree = PrefixTree(80)
    for i, s in enumerate(sets):
        tree.insert(i, len(s), np.asarray(sorted(s), dtype=np.uint64))
    got = tree.search(len(query), np.asarray(sorted(query), dtype=np.uint64))
    assert sorted(got) == [i for i, s in enumerate(sets) if 100 * len(s & query) >= 80 * len(s | query)]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 3), (20, 21), (21, 20), (30, 30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 6, 7, 8, 9), 1), 20: 20, 21: 20}


def test_fingerprints(docs, rows):
    got = fingerprint_with_next(docs).collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = []
    for i, r in enumerate(order):
        t, u = texts[i], texts[(i + 1) % len(texts)]
        e = edited(t, u)
        k = len(t) // 2
        assert e == t[: len(t) - k] + u[:k]
        want.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_text = {}
    text_of = {r[0]: r[1] or "" for r in rows}
    for r in got:
        assert by_text.setdefault(text_of[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in got if r.n_chars > 200]
    assert sum(r.near_edited for r in long) > sum(r.near_next for r in long)
    assert fingerprint_with_next(docs.limit(0)).count() == 0


def test_fingerprints_with_null_ids_come_last(spark):
    rows = [(5, "first text here"), (3, "second one"), (None, "nobody's"), (None, None)]
    got = fingerprint_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = [rows[0], rows[1], rows[3], rows[2]]  # equal ids are ordered by text
    want = []
    for i, (d, t) in enumerate(order):
        t, u = t or "", order[(i + 1) % 4][1] or ""
        want.append((d, len(t), hashlib.sha256(edited(t, u).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    lone = fingerprint_with_next(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()
    assert lone[0].near_next == 1.0 and lone[0].edited_sha256 == hashlib.sha256(edited(rows[0][1], rows[0][1]).encode()).hexdigest()


def test_fingerprints_are_homomorphic():
    one, two, both = (render(*(x[0] for x in vectors([t]))) for t in ("first line here", "second line\nthird", "second line\nthird\nfirst line here"))
    assert combine(one, two) == both and combine(both, two, -1) == one
    assert likeness(parse(one), parse(one)) == 1.0 and likeness(parse(both), parse(two)) > likeness(parse(one), parse(two))


def test_vector_search(spark):
    r = random.Random(3)
    vectors = [(i, [r.randrange(-60, 60) for _ in range(8)]) for i in range(300)]
    vectors += [(300 + i, [1] * 8) for i in range(40)] + [(900, None), (901, [None] * 8), (None, [1] * 8), (902, [5, 5])]
    df = spark.createDataFrame([(i, v, "c") for i, v in vectors], "vec_id long, vector array<long>, q string")
    got = exact_top_k(df, F.col("vec_id") % 20 == 0, k=20, tile_values=64 * 8).collect()
    good = [(i, v) for i, v in vectors if i is not None and v is not None and None not in v]
    want = []
    for q, v in good:
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q))[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0, k=20).count() == 0
    assert exact_top_k(df.where("vec_id = 40"), F.col("vec_id") % 20 == 0, k=20).count() == 0


def test_language_model(docs, rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    got = language_model_scores(docs, id_remainder("doc_id", 5) == 1, rounds=2).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = {(i, t): (held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, t, *_ in rows}
    text_of = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        flag, size, known, base = want[(r.doc_id, text_of[r.doc_id])]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (flag, size, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    train = [r for r in got if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)
    assert language_model_scores(docs.limit(0), F.lit(False), rounds=1).count() == 0
    assert language_model_scores(docs, F.lit(True), rounds=1).agg(F.max("train_tokens")).first()[0] == 0


def test_toxicity(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(WORDS) + r.choice("abcdef") for _ in range(r.randrange(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(["awful", "nasty"])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(bad)))
    rows += [(1000, "", "x"), (1001, None, "x"), (None, "awful nasty awful", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity_scores(docs, marks).collect()
    assert len(got) == len(rows)
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 600]
    right = sum(g.predicted == (g.doc_id % 5 == 0) for g in held)
    assert right / len(held) > 0.97
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in got)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got if g.doc_id is not None)
    kept = without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(g.predicted == 0 for g in got)
    assert toxicity_scores(docs, marks.limit(0)).agg(F.max("score")).first()[0] == 0
    assert toxicity_scores(docs.limit(0), marks).count() == 0
