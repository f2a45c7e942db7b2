"""Importance resampling against a plain version, and its parts by themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushpage.llm import importance
from hushpage.llm.importance import Buckets, drawn_documents, feature_stream, importance_resample, mean_gains, run_lengths, word_parts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
A_TO_Z = {i: i + 32 for i in range(65, 91)}


def features(text, longest):
    words = WORD.findall((text or "").translate(A_TO_Z))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, longest=1, buckets=10_000, min_words=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own, wanted = (Counter(bucket(f) for t in texts for f in features(t, longest)[1]) for texts in ([t for _, t in docs], target))
    S, T = sum(own.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (S + buckets) / ((own[b] + 1) * (T + buckets))))
    rows = []
    for i, text in docs:
        n, held = features(text, longest)
        weight = sum(gain(bucket(f)) for f in held) // len(held) if held else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranks = {}
    for place, r in enumerate(able[: len(able) * percent // 100]):
        ranks.setdefault(r, []).append(place + 1)
    return sorted(((r[0], r[2], r[3], r[4], ranks[r].pop() if ranks.get(r) else None) for r in rows), key=str)


def answer(spark, docs, target, **options):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, id int, weight int")
    other = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(map(tuple, importance_resample(df, other, **options).collect()), key=str)


def texts(n, seed=3):
    r = random.Random(seed)
    return [" ".join(r.choice(["Alpha", "beta", "γάμμα", "d4", "e-f", "x_y", "İ"]) for _ in range(r.choice([0, 5, 19, 20, 21, 60]))) for _ in range(n)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aZ09 -é_\x7f\x80"), st.characters(codec="utf-8")), max_size=60), st.integers(1, 3), st.integers(1, 9))
def test_streams(text, longest, size):
    words, want = features(text, longest)
    assert [w for p in word_parts(text.encode(), size) for w in p] == [w.encode() for w in features(text, 1)[1]]
    n, got = feature_stream(text.encode(), longest, Buckets(500, most=4), size)
    assert n == words and sorted(got.tolist()) == sorted(zlib.crc32(f.encode()) % 500 for f in want)


@given(st.lists(st.lists(st.integers(0, 9), max_size=5), max_size=8))
def test_runs_and_sums(docs):
    stream = np.asarray([x for d in docs for x in d], dtype=np.uint16)
    values, lengths = run_lengths(stream)
    assert dict(zip(values.tolist(), lengths.tolist())) == dict(Counter(stream.tolist()))
    gains = np.asarray([-7, 3, 0, 11, -2, 5, 1, 1, -9, 4])
    got = mean_gains(gains, stream, np.cumsum([len(d) for d in docs], dtype=np.int64))
    assert got.tolist() == [sum(gains[x] for x in d) // len(d) if d else 0 for d in docs]


def test_equals_the_plain_version(spark):
    docs = list(enumerate(texts(300)))
    assert answer(spark, docs, texts(20, 9)) == brute(docs, texts(20, 9))


def test_runs_of_words_few_buckets_and_small_rows(spark, monkeypatch):
    monkeypatch.setattr(importance, "_ROW", 40)
    docs = list(enumerate(texts(120)))
    options = {"percent": 35, "longest": 3, "buckets": 7, "min_words": 5, "seed": 1}
    assert answer(spark, docs, texts(9, 2), **options) == brute(docs, texts(9, 2), **options)


def test_repeated_ids_nulls_and_empty_tables(spark):
    same = "one two three " * 8
    docs = [(7, same)] * 40 + [(None, same)] * 25 + [(None, None), (3, None), (4, ""), (5, "a " * 30_000)] + list(enumerate(texts(40)))
    assert answer(spark, docs, texts(5), percent=50) == brute(docs, texts(5), percent=50)
    assert answer(spark, docs, []) == brute(docs, [])
    assert answer(spark, docs, ["x"], percent=0) == brute(docs, ["x"], percent=0)
    assert answer(spark, [], ["x"]) == []


def test_drawn_documents_look_like_the_target(spark):
    near = ["solar panel energy grid " * 8] * 30
    docs = [(i, near[0] if i < 30 else "football match goal team " * 8) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = drawn_documents(df, spark.createDataFrame([(t,) for t in near], "text string"), percent=8, buckets=500)
    assert kept.columns == ["doc_id", "text"] and kept.where("doc_id < 30").count() >= 23 and kept.count() == 24


def test_too_many_buckets(spark):
    with pytest.raises(ValueError, match="16-bit"):
        answer(spark, [(1, "a")], [], buckets=1 << 17)
