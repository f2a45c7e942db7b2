"""Hard negatives by inner product, with a pivot table.

One more component, the root of M^2 - |x|^2 (M: the greatest norm), gives all rows the same length, so a high inner product with an anchor is
a small Euclidean distance from it. The table stores every row's distances from a few pivots. By the triangle inequality they bracket
its distance from an anchor, hence its score: whole runs of rows with like distances are passed over first, then single rows, and what
survives is scored exactly. Anchors, a stated set, meet all rows in blocks; a block returns a bounded number of rows for each anchor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushpage.llm.blocks import cut, partitions
from hushpage.llm.textblocks import tidy_pair
from hushpage.llm.vector_search import matrix, usable

#: Rows that the interval of a run's distances stands for, rows that are scored first, and pairs that are bracketed at a time.
_RUN, _PROBE, _PAIRS = 256, 256, 1 << 21


@dataclass(frozen=True)
class PivotTable:
    """Pivots as rows, and the square of the greatest norm of all rows."""

    pivots: np.ndarray
    most: float

    def _up(self, x: np.ndarray) -> np.ndarray:
        """The component that gives rows the greatest norm."""
        return np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        p = self.pivots
        flat = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (x @ p.T)
        return np.sqrt(np.maximum(flat + (self._up(x)[:, None] - self._up(p)) ** 2, 0)).astype(np.float32)

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + self.most - 2 * (q @ self.pivots.T), 0)).astype(np.float32)

    def scores(self, squares: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores of anchors of these squared norms at distances from least to greatest, with room for
        what 32-bit numbers lose."""
        total, spare = (squares + self.most)[:, None], 1e-6 * (np.sqrt(squares) + np.sqrt(self.most))[:, None] ** 2
        return (total - greatest.astype(np.float64) ** 2) / 2 - spare, (total - least.astype(np.float64) ** 2) / 2 + spare

    def bracket(self, squares: np.ndarray, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of anchors with rows whose distances from the pivots lie between low and high."""
        least = np.zeros((len(anchors), len(low)), dtype=np.float32)
        greatest = np.full_like(least, np.inf)
        for j in range(anchors.shape[1]):
            a = anchors[:, j, None]
            np.maximum(least, low[:, j] - a, out=least)
            np.maximum(least, a - high[:, j], out=least)
            np.minimum(greatest, high[:, j] + a, out=greatest)
        return self.scores(squares, least, greatest)


def far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """At most n rows, each the farthest from those before it, from the longest on; equal rows once."""
    if not len(rows):
        return rows
    at, gap = int((rows * rows).sum(axis=1).argmax()), np.full(len(rows), np.inf)
    chosen = []
    while len(chosen) < n and gap[at] > 0:
        chosen.append(at)
        gap = np.minimum(gap, ((rows - rows[at]) ** 2).sum(axis=1))
        at = int(gap.argmax())
    return rows[chosen]


class Block:
    """Rows of a tile in order of their nearest pivots, so that runs of rows have like distances."""

    def __init__(self, table: PivotTable, rows: pa.Table, dim: int, kind: str):
        near = _unpacked(rows["near"], "<f4", len(table.pivots))
        first = near.argmin(axis=1)
        order = np.lexsort((near.min(axis=1), first))
        self.table, self.near = table, near[order]
        self.ids, self.labels = rows["id"].to_numpy()[order], rows["label"].to_numpy()[order]
        self.vectors = _unpacked(rows["v"], kind, dim)[order]

    def survivors(self, rows: np.ndarray, squares: np.ndarray, anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(those of ``rows`` that may score from least to most with an anchor, whether they may with each)."""
        if not len(rows):
            return rows, np.zeros((len(anchors), 0), dtype=bool)
        starts = np.arange(0, len(rows), _RUN)
        low, high = np.minimum.reduceat(self.near[rows], starts), np.maximum.reduceat(self.near[rows], starts)
        lower, upper = self.table.bracket(squares, anchors, low, high)
        open_ = ((upper >= least[:, None]) & (lower <= most[:, None])).any(axis=0)
        rows = rows[np.repeat(open_, np.diff(np.append(starts, len(rows))))]
        lower, upper = self.table.bracket(squares, anchors, self.near[rows], self.near[rows])
        may = (upper >= least[:, None]) & (lower <= most[:, None])
        some = may.any(axis=0)
        return rows[some], may[:, some]


def _unpacked(column: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def top_of_each(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, ties to smaller ids; minus infinity is no score."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    else:
        least = -np.inf
    row, col = np.nonzero((scores >= least) & (scores > -np.inf))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _slices(labels: np.ndarray, rows: int):
    """(label, indices) of anchors of one label, as many as may be bracketed with so many rows at a time."""
    order = np.argsort(labels, kind="stable")
    value, first = np.unique(labels[order], return_index=True)
    step = max(1, min(256, _PAIRS // max(rows, 1)))
    for label, own in zip(value.tolist(), np.split(order, first[1:]), strict=True):
        for at in range(0, len(own), step):
            yield label, own[at : at + step]


def mine_hard_negatives(
    vectors: DataFrame,
    label: Column,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    pivots: int = 16,
    id_col: str = "vec_id",
    vec_col: str = "vector",
    tile_values: int = 1 << 21,
    sample: int = 1_024,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows have integer vectors and a label. Those whose id, label or vector is null or holds a null take no part; vectors of unlike
    length count as padded with zeros; scores are exact up to 2**53. An anchor's positives are its ``positives`` highest
    rows of other ids and its label; for each, the ``negatives`` highest rows of other labels follow whose score lies between both percentages of
    the positive's. Ties go to smaller ids. Where rows share an id, an anchor has the least (label, vector), each row is a
    candidate, and equal (positive_id, positive_score) of an anchor are one pair. A pair without such rows, and an empty table, give none.
    Pivots come from about ``sample`` rows drawn at random; they change what is passed over, never the result.
    """
    rows = usable(vectors.withColumn("__label", label.cast("long")), F.coalesce(is_anchor, F.lit(False)), id_col, vec_col, "__label").where("label IS NOT NULL")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda total, x: total + x * x)
    edge = F.array_max(F.transform("v", lambda x: F.abs(x)))
    n, n_anchors, dim, most, edge = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.max(F.size("v")), F.max(square), F.max(edge)).first()
    dim, most, edge = max(dim or 0, 1), float(most or 0), edge or 0
    kind = "<i2" if edge < 1 << 15 else "<i4" if edge < 1 << 31 else "<i8"
    exact = np.float32 if most < 1 << 24 else np.float64  # no partial sum is greater than the greatest square
    seen = rows.select("v").sample(min(1.0, sample / max(n, 1)), seed=1).limit(2 * sample).toArrow()  # some rows more or less, never a copy's all
    table = PivotTable(far_apart(matrix(seen["v"], dim), pivots) if len(seen) else np.zeros((1, dim)), most)

    def pack(anchor: bool):
        def run(batches):
            turn = 0
            for batch in batches:
                v = matrix(pa.chunked_array([batch.column(2)]), dim)
                near = table.of_anchors(v) if anchor else table.of_rows(v)
                parts = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (v.astype(kind), near)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *parts, pa.array(np.arange(turn, turn + len(v)))], names=["id", "label", "v", "near", "turn"])
                turn += len(v)

        return run

    packed = "id long, label long, v binary, near binary, turn long"
    held = cut(rows.select("id", "label", "v").mapInArrow(pack(False), packed))  # the pivot table; both searches read it
    least = rows.where("q").groupBy("id").agg(F.min(F.struct("label", "v")).alias("least")).select("id", "least.label", "least.v")
    anchors = cut(least.mapInArrow(pack(True), packed))

    tile = max(1, tile_values // dim)
    n_c, n_q = max(-(-n // tile), min(partitions(vectors.sparkSession), -(-n // 1_024)), 1), max(-(-n_anchors // tile), 1)
    deal = lambda n: F.pmod(F.xxhash64("id", "turn"), F.lit(n)).cast("int")  # noqa: E731  copies of a row are spread, too
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = held.withColumns({"c": deal(n_c), "q": every(n_q)}).groupBy("c", "q")
    asked = lambda found: found.withColumns({"q": deal(n_q), "c": every(n_c)}).groupBy("c", "q")

    def nearest(block: pa.Table, wanted: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64),) * 3]
        if block.num_rows and wanted.num_rows:
            held = Block(table, block, dim, kind)
            names, labels = wanted["id"].to_numpy(), wanted["label"].to_numpy()
            queries, near = _unpacked(wanted["v"], kind, dim).astype(exact), _unpacked(wanted["near"], "<f4", len(table.pivots))
            by_label = {x: np.flatnonzero(held.labels == x) for x in np.unique(labels).tolist()}
            for own_label, at in _slices(labels, len(held.ids)):
                own = by_label[own_label]
                q, squares = queries[at], (queries[at].astype(np.float64) ** 2).sum(axis=1)
                first = own[:: max(1, len(own) // _PROBE)]  # their scores say what a row must reach
                scores = np.where(held.ids[first] == names[at, None], -np.inf, q @ held.vectors[first].astype(exact).T)
                sure = np.partition(scores, -positives, axis=1)[:, -positives] if len(first) >= positives else np.full(len(at), -np.inf)
                left, may = held.survivors(own, squares, near[at], sure, np.full(len(at), np.inf))
                scores = np.where(may & (held.ids[left] != names[at, None]), q @ held.vectors[left].astype(exact).T, -np.inf)
                i, j = top_of_each(scores, held.ids[left], positives)
                parts.append((names[at[i]], held.ids[left[j]], scores[i, j].astype(np.int64)))
        return pa.table({n: np.concatenate(x) for n, x in zip(("anchor_id", "positive_id", "positive_score"), zip(*parts, strict=True), strict=True)})

    found = blocks.cogroup(asked(anchors)).applyInArrow(tidy_pair(nearest), "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives)
    pairs = pairs.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set(F.struct("positive_id", "positive_score")).alias("pairs"))
    paired = cut(anchors.join(pairs, "id"))

    def hard(block: pa.Table, wanted: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64),) * 5]
        if block.num_rows and wanted.num_rows:
            held = Block(table, block, dim, kind)
            names, labels = wanted["id"].to_numpy(), wanted["label"].to_numpy()
            queries, near = _unpacked(wanted["v"], kind, dim).astype(exact), _unpacked(wanted["near"], "<f4", len(table.pivots))
            given = [[(p["positive_id"], p["positive_score"]) for p in x] for x in wanted["pairs"].to_pylist()]
            others = {x: np.flatnonzero(held.labels != x) for x in np.unique(labels).tolist()}
            for own_label, at in _slices(labels, len(held.ids)):
                q, squares = queries[at], (queries[at].astype(np.float64) ** 2).sum(axis=1)
                turn = [(i, *p) for i, a in enumerate(at.tolist()) for p in given[a]]
                who, positive, score = (np.asarray(x, dtype=np.int64) for x in zip(*turn, strict=True))
                low, high = -(-low_percent * score // 100), high_percent * score // 100
                least, most = np.full(len(at), np.inf), np.full(len(at), -np.inf)
                np.minimum.at(least, who, low)
                np.maximum.at(most, who, high)
                left, may = held.survivors(others[own_label], squares, near[at], least, most)
                scores = np.where(may, q @ held.vectors[left].astype(exact).T, -np.inf)
                for first in range(0, len(who), len(at)):  # as many pairs at a time as there are anchors
                    some = slice(first, first + len(at))
                    mine = scores[who[some]]
                    mine = np.where((mine >= low[some, None]) & (mine <= high[some, None]), mine, -np.inf)
                    i, j = top_of_each(mine, held.ids[left], negatives)
                    at_pair = first + i
                    parts.append((names[at[who[at_pair]]], positive[at_pair], score[at_pair], held.ids[left[j]], mine[i, j].astype(np.int64)))
        names_ = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table({n: np.concatenate(x) for n, x in zip(names_, zip(*parts, strict=True), strict=True)})

    near = blocks.cogroup(asked(paired)).applyInArrow(tidy_pair(hard), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return near.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
