"""Hard negatives against brute force; the pivot table's brackets by themselves."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushpage.llm.hard_negatives import PivotTable, far_apart, mine_hard_negatives, top_of_each

VECTORS = st.lists(st.lists(st.integers(-3000, 3000), min_size=4, max_size=4), min_size=1, max_size=15)


@settings(max_examples=200, deadline=None)
@given(VECTORS, VECTORS, st.integers(1, 6))
def test_brackets_hold(rows, anchors, n):
    x, q = np.asarray(rows, dtype=np.float64), np.asarray(anchors, dtype=np.float64)
    table = PivotTable(far_apart(x, n), float((x * x).sum(axis=1).max()))
    near = table.of_rows(x)
    lower, upper = table.bracket((q * q).sum(axis=1), table.of_anchors(q), near, near)
    assert np.all(lower <= q @ x.T) and np.all(q @ x.T <= upper)
    lower, upper = table.bracket((q * q).sum(axis=1), table.of_anchors(q), near.min(axis=0)[None], near.max(axis=0)[None])
    assert np.all(lower <= q @ x.T) and np.all(q @ x.T <= upper)


@given(st.lists(st.lists(st.sampled_from([-np.inf, 1.0, 2.0, 3.0]), min_size=6, max_size=6), min_size=1, max_size=5), st.integers(1, 8))
def test_top_of_each(scores, k):
    ids = np.asarray([5, 3, 9, 3, 1, 0])
    row, col = top_of_each(np.asarray(scores), ids, k)
    for i, own in enumerate(scores):
        want = sorted((-s, ids[j]) for j, s in enumerate(own) if s > -np.inf)[:k]
        assert [(-own[j], ids[j]) for j in col[row == i]] == want


def brute(rows, every=5, positives=5, negatives=3, low=50, high=95):
    good = [(i, y, v) for i, y, v in rows if i is not None and y is not None and v is not None and None not in v]
    anchors = {}
    for i, y, v in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (y, v) in anchors.items():
        best = sorted((-dot(v, w), i) for i, z, w in good if i != a and z == y)[:positives]
        for p, i in sorted({(-s, i) for s, i in best}):
            band = sorted((-dot(v, w), j) for j, z, w in good if z != y and low * p <= 100 * dot(v, w) <= high * p)[:negatives]
            out += [(a, i, r + 1, j, p, -s) for r, (s, j) in enumerate(band)]
    return sorted(out)


def mined(spark, rows, every=5, **options):
    df = spark.createDataFrame([(i, y, v, 1, 2) for i, y, v in rows], "vec_id long, label int, vector array<long>, q int, near int")
    return sorted(map(tuple, mine_hard_negatives(df, F.col("label"), F.col("vec_id") % every == 0, **options).collect()))


def test_equals_brute_force_in_tiles(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(3), [r.randrange(-40, 90) for _ in range(8)]) for i in range(500)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, tile_values=300, pivots=3, sample=20) == brute(rows)
    other = {"positives": 2, "negatives": 7, "low": 20, "high": 80}
    assert mined(spark, rows, positives=2, negatives=7, low_percent=20, high_percent=80) == brute(rows, **other)


def test_one_label_and_copies_hold_most_rows(spark):
    rows = [(i, 1, [9, 1, 4]) for i in range(400)] + [(5, 1, [9, 1, 4])] * 60 + [(1000 + i, i % 4, [i % 9, i % 5, 2]) for i in range(90)]
    assert mined(spark, rows, tile_values=90) == brute(rows)


def test_nulls_repeats_unlike_lengths_and_large_numbers(spark):
    r = random.Random(6)
    rows = [(r.randrange(40), r.choice([0, 1, None]), [r.randrange(-9, 9) for _ in range(r.choice([0, 1, 3, 8]))]) for _ in range(150)]
    rows += rows[:30] + [(40, 1, [2] * 900), (20, 0, [70_000_000] * 2), (7, 1, [None, 1]), (None, 1, [1]), (8, 0, None), (-5, 0, [1, 1])]
    assert mined(spark, rows) == brute(rows)


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1]), (2, 1, [2])]) == []
    assert mined(spark, [(5, 1, [0, 0]), (6, 1, [0, 0]), (7, 2, [0, 0])]) == [(5, 6, 1, 7, 0, 0)]
