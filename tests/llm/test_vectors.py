"""Vector-approximation files: bounds hold, few exact vectors are read, long and unlike vectors, rows that share an id."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushpage.llm.vector_search import Grid, candidates, exact_top_k, kth_of_each, usable

VECTORS = st.lists(st.lists(st.one_of(st.integers(-5000, 5000), st.sampled_from([0, 3, 10**9, -(10**12)])), min_size=5, max_size=5), min_size=1, max_size=20)


@settings(max_examples=200, deadline=None)
@given(VECTORS, VECTORS)
def test_bounds_hold(rows, sample):
    v = np.asarray(rows, dtype=np.float64)
    grid = Grid(np.asarray(sample, dtype=np.float64))
    lower, upper = grid.bounds(v, *grid.decode(grid.encode(v)))
    exact = v @ v.T
    assert np.all(lower <= exact) and np.all(exact <= upper)


def test_kth():
    scores = np.asarray([[3.0, 1.0, 2.0], [-np.inf, 5.0, 5.0]])
    assert kth_of_each(scores, 2).tolist() == [2.0, 5.0] and kth_of_each(scores, 4).tolist() == [-np.inf, -np.inf]


def brute(rows, k):
    good = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    queries = {}
    for i, v in good:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def asked(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    return df, F.col("vec_id") % 20 == 0


def test_few_exact_vectors_are_read_with_an_outlier_or_without(spark):
    r = random.Random(8)
    rows = [(i, [r.randrange(-3000, 3000) for _ in range(16)]) for i in range(3000)]
    sizes = []
    for more in ([], [(9001, [10**6] * 16)], [(9001, [10**6 * (-1) ** i for i in range(16)])]):
        df, is_query = asked(spark, rows + more)
        sizes.append(candidates(usable(df, is_query, "vec_id", "vector"), 5, 16 * 512, 1024).count())
    assert sizes[0] < 150 * 40  # of 150 queries by 3,000 vectors
    assert max(sizes[1:]) < 1.1 * sizes[0] + 150
    df, is_query = asked(spark, rows + [(9001, [10**6] * 16)])
    assert sorted(map(tuple, exact_top_k(df, is_query, k=5, tile_values=16 * 512).collect())) == brute(rows + [(9001, [10**6] * 16)], 5)


def test_heavy_tails_and_reading_in_steps(spark):
    r = random.Random(3)
    rows = [(i, [int(r.paretovariate(0.6) * r.choice([-3, 3])) for _ in range(6)]) for i in range(400)]
    df, is_query = asked(spark, rows)
    for options in ({}, {"sample": 20, "first": 1, "tile_values": 300}, {"sample": 1, "first": 5}):
        assert sorted(map(tuple, exact_top_k(df, is_query, k=5, **options).collect())) == brute(rows, 5)


def test_unlike_lengths_repeated_rows_and_long_vectors(spark):
    r = random.Random(4)
    rows = [(r.randrange(60), [r.randrange(-9, 9) for _ in range(r.choice([0, 1, 3, 8]))]) for _ in range(150)]
    rows += rows[:30] + [(40, [2] * 3000), (20, [1] * 3000), (7, [None]), (None, [1]), (8, None)] + [(33, [5, 5])] * 50
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, vector array<long>, cells string, key int")
    for first in (1, 64):
        got = sorted(map(tuple, exact_top_k(df, F.col("vec_id") % 20 == 0, k=20, tile_values=3000 * 16, first=first).collect()))
        assert got == brute(rows, 20)


def test_copies_of_a_vector_make_no_pairs(spark):
    rows = [(i, [3, 1, 4]) for i in range(600)] + [(i, [3, 1, 4]) for i in (0, 0, 20, 40)] + [(1000 + i, [i % 7, 1, 2]) for i in range(60)]
    df, is_query = asked(spark, rows)
    assert candidates(usable(df, is_query, "vec_id", "vector"), 5, 3 * 64, 64).count() < 33 * 60
    assert sorted(map(tuple, exact_top_k(df, is_query, k=5, tile_values=3 * 64).collect())) == brute(rows, 5)


def test_empty_tables(spark):
    df, is_query = asked(spark, [])
    assert exact_top_k(df, is_query, k=5).collect() == []
    df, is_query = asked(spark, [(20, [1, 2])])
    assert exact_top_k(df, is_query, k=5).collect() == []
