"""Exact top-k by inner product with vector-approximation files.

Every vector is approximated by its cells, one byte a dimension, between quantiles of that dimension; a row that lies beyond the sample that
these come from travels as it is, so that outliers blur no cell. Blocks of cells meet blocks of queries; cells bound the scores from
both sides, and a block passes on only those vectors that can still be among a query's best, of the block and of the sample. Equal
vectors take part with their least ids only, so copies make no pairs. Over all blocks the k-th best lower bound cuts them once more. Exact
vectors are then read for what is left, by a join on ids, in the order of their upper bounds, some at a time, until the k-th best score
is certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushpage.llm.blocks import cut, partitions
from hushpage.llm.textblocks import tidy_pair

CELLS = 256


class Grid:
    """Cells of each dimension: equal shares of a sample, between its least and its greatest component."""

    def __init__(self, sample: np.ndarray):
        self.edges = np.quantile(sample, np.linspace(0, 1, CELLS + 1), axis=0, method="inverted_cdf").T.astype(np.float64)
        self.middle = ((self.edges[:, 1:] + self.edges[:, :-1]) / 2).astype(np.float32)
        apart = np.maximum(self.edges[:, 1:] - self.middle, self.middle - self.edges[:, :-1])
        self.half = np.nextafter((apart * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))

    def encode(self, vectors: np.ndarray) -> list[bytes]:
        """A byte a dimension; the vector itself in 64-bit numbers where it leaves the sample's range."""
        wide = ((vectors < self.edges[:, 0]) | (vectors > self.edges[:, -1])).any(axis=1)
        cells = np.empty(vectors.shape, dtype=np.uint8)
        for d in range(vectors.shape[1]):
            cells[:, d] = np.searchsorted(self.edges[d, 1:-1], vectors[:, d], side="right")
        return [v.astype("<f8").tobytes() if w else c.tobytes() for v, c, w in zip(vectors, cells, wide.tolist(), strict=True)]

    def decode(self, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(middles, greatest differences from them) of vectors."""
        dim = len(self.edges)
        wide = np.asarray([len(c) > dim for c in codes], dtype=bool)
        middle, half = np.empty((len(codes), dim), dtype=np.float32), np.zeros((len(codes), dim), dtype=np.float32)
        cells = np.frombuffer(b"".join([c for c in codes if len(c) == dim]), dtype=np.uint8).reshape(-1, dim)
        at = cells + CELLS * np.arange(dim)
        middle[~wide], half[~wide] = self.middle.ravel()[at], self.half.ravel()[at]
        if wide.any():
            middle[wide] = np.frombuffer(b"".join([c for c in codes if len(c) > dim]), dtype="<f8").reshape(-1, dim)
        return middle, half

    @staticmethod
    def bounds(queries: np.ndarray, middle: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of every score, wide enough for what 32-bit sums lose."""
        q = queries.astype(np.float32)
        score, spread = (q @ middle.T).astype(np.float64), (np.abs(q) @ half.T).astype(np.float64)
        long = np.linalg.norm(queries, axis=1)[:, None] * (np.linalg.norm(middle.astype(np.float64), axis=1) + np.linalg.norm(half.astype(np.float64), axis=1))
        spread += 1.2e-7 * (middle.shape[1] + 64) * (1 + long)
        return score - spread, score + spread


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of integers as rows, shorter ones padded with zeros."""
    lists = column.combine_chunks()
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.zeros((len(ends), dim), dtype=np.float64)
    row = np.repeat(np.arange(len(ends)), ends)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(ends) - ends, ends)] = values
    return out


def kth_of_each(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row; minus infinity where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def usable(vectors: DataFrame, is_query: Column, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """(id, v, q), or (id, v, q, label): rows with an id and a vector of integers without nulls."""
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull()))
    label = [F.col(label_col).alias("label")] if label_col else []
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<long>").alias("v"), is_query.alias("q"), *label)


def candidates(rows: DataFrame, k: int, tile_values: int, sample: int) -> DataFrame:
    """(query_id, id, key, upper, place): for each query the vectors whose bounds leave them a place among the k best, in order of their upper
    bounds.

    Vectors travel as cells, a byte a dimension, and once for each block of queries; queries, a stated set, once for each block of
    vectors. ``key`` is a hash of the vector, which tells apart rows that share an id. A block has so many vectors, or queries, that they have
    ``tile_values`` components.
    """
    n, n_queries, dim = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.max(F.size("v"))).first()
    dim = max(dim or 1, 1)
    tile = max(1, tile_values // dim)
    n_c, n_q = max(-(-n // tile), min(partitions(rows.sparkSession), -(-n // 1_024)), 1), max(-(-n_queries // tile), 1)
    sample = min(sample, max(tile_values // (2 * dim), 1))
    seen = rows.select("id", "v").sample(min(1.0, sample / max(n, 1)), seed=1).limit(2 * sample).toArrow()  # some rows more or less, never a copy's all
    held_ids, held_vectors = seen["id"].to_numpy(), matrix(seen["v"], dim) if len(seen) else np.zeros((1, dim))
    grid = Grid(held_vectors)

    def encode(batches):
        for batch in batches:
            codes = grid.encode(matrix(pa.chunked_array([batch.column(2)]), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], names=["id", "key", "cells"])

    def ask(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                wanted = matrix(pa.chunked_array([part.column(1)]), dim)
                scores = wanted @ held_vectors[: len(held_ids)].T
                scores[part.column(0).to_numpy()[:, None] == held_ids] = -np.inf
                columns = [pa.array([w.tobytes() for w in wanted], pa.binary()), pa.array(kth_of_each(scores, k))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "v", "sure"])

    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keyed = rows.select("id", F.xxhash64("v").alias("key"), "v")
    held = keyed.mapInArrow(encode, "id long, key long, cells binary").groupBy("id", "key").agg(F.min("cells").alias("cells"))
    # Of equal vectors, whose scores are equal, only those of the k + 1 least ids can be among a query's best, one of them its own.
    held = held.withColumn("r", F.dense_rank().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    held = held.select("id", "key", "cells", deal(n_c, "id", "key").alias("c"), every(n_q).alias("q"))
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v")).mapInArrow(ask, "id long, v binary, sure double")
    asked = asked.select("id", "v", "sure", deal(n_q, "id").alias("q"), every(n_c).alias("c"))

    def meet(block: pa.Table, queries: pa.Table) -> pa.Table:
        parts = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float, float))]
        if block.num_rows and queries.num_rows:
            ids, keys = block["id"].to_numpy(), block["key"].to_numpy()
            middle, half = grid.decode(block["cells"].to_pylist())
            names, least = queries["id"].to_numpy(), queries["sure"].to_numpy()
            wanted = np.frombuffer(b"".join(queries["v"].to_pylist()), dtype=np.float64).reshape(-1, dim)
            step = max(1, min(128, (1 << 20) // len(ids)))
            for at in range(0, len(names), step):
                lower, upper = grid.bounds(wanted[at : at + step], middle, half)
                own = names[at : at + step, None] == ids[None, :]
                lower[own] = -np.inf
                sure = np.maximum(kth_of_each(lower, k), least[at : at + step])
                q, c = np.nonzero((upper >= sure[:, None]) & ~own)
                parts.append((names[at + q], ids[c], keys[c], lower[q, c], upper[q, c]))
        return pa.table({n: np.concatenate(x) for n, x in zip(("query_id", "id", "key", "lower", "upper"), zip(*parts, strict=True), strict=True)})

    near = held.groupBy("c", "q").cogroup(asked.groupBy("c", "q")).applyInArrow(tidy_pair(meet), "query_id long, id long, key long, lower double, upper double")
    by_lower = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    whole = Window.partitionBy("query_id")
    kept = near.withColumn("r", F.row_number().over(by_lower)).withColumn("sure", F.max(F.when(F.col("r") == k, F.col("lower"))).over(whole))
    kept = kept.where(F.col("sure").isNull() | (F.col("upper") >= F.col("sure")))
    by_upper = Window.partitionBy("query_id").orderBy(F.desc("upper"), "id", "key")
    return kept.select("query_id", "id", "key", "upper", F.row_number().over(by_upper).alias("place"))


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vec_col: str = "vector",
    tile_values: int = 1 << 21,
    sample: int = 16_384,
    first: int = 64,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all rows of other ids.

    ``vec_col`` holds integers; scores are exact up to 2**53. Rows whose id or vector is null, or whose vector
    holds a null, take no part. Vectors of unlike length count as padded with zeros. A query has one
    vector an id (the least, if rows differ); repeated vectors are candidates each. Ties go to the smaller id. Fewer
    than k other rows give all of them; an empty table gives no rows. Only the named columns are read. About ``sample`` rows, drawn at random,
    lay the cells and say what every result must reach; they never change it. Exact vectors are read for ``first`` candidates of each query,
    then for eight times as many, then for all that are left, always only for those that can still be among the best.
    """
    rows = usable(vectors, is_query, id_col, vec_col)
    near = cut(candidates(rows, k, tile_values, sample))
    # Rows that are equal are candidates each.
    exact = rows.select("id", F.xxhash64("v").alias("key"), "v").groupBy("id", "key").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("times"))
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("query")).withColumnRenamed("id", "query_id")

    def multiply(batches):
        for batch in batches:
            columns = [pa.chunked_array([batch.column(i)]) for i in (2, 3)]
            dim = max([1, *(int(max(c.combine_chunks().value_lengths().to_pylist(), default=0)) for c in columns)])
            scores = np.einsum("ij,ij->i", *(matrix(c, dim) for c in columns)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["query_id", "id", "score"])

    def read(part: DataFrame) -> DataFrame:
        found = part.dropDuplicates(["query_id", "id", "key"]).join(exact, ["id", "key"])
        both = found.withColumn("n", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k))))).join(asked, "query_id")
        return both.select("query_id", "id", "v", "query").mapInArrow(multiply, "query_id long, id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    done, at = top(read(near.where(F.col("place") <= max(first, k)))), max(first, k)
    for most in (8 * at, None):
        left = near.where(F.col("place") > at)
        if left.isEmpty():
            break
        done = cut(done.select("query_id", "id", "score"))
        least = done.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        left = left.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("n") < k) | (F.col("upper") >= F.col("least")))
        more = read((left if most is None else left.where(F.col("place") <= most)).select("query_id", "id", "key"))
        done, at = top(done.unionAll(more)), most
    return done.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def scaled_integers(embedding: Column, scale: float) -> Column:
    """floor(scale * x) of each component taken as double; null if the vector holds a null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))
