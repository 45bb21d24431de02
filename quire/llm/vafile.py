"""Exact top-k inner-product search over vector-approximation files.

Every component is quantised to one of `CELLS` equal cells between its smallest and largest value in all rows (one byte a component).
A scan of the cells gives each query a lower and an upper bound of its score with each vector; what cannot reach the k-th best lower
bound is left. Exact vectors are then read in the order of their upper bounds: first the best k, and after them only those whose
bound reaches the k-th exact score, so the result is certain.

Vectors with equal components are one cell row with their `k + 1` smallest ids: more can't be asked for. Equal queries are one.
Queries and vectors meet in blocks on a grid (`QUERIES` queries, `VECTORS` vectors): a vector block goes once to each query block.

Defined cases: a vector that is null or holds a null or non-finite component takes no part; ties go to the smaller id; shorter
vectors count as filled up with zeros, an empty one scores 0; rows that repeat id and vector are one, rows with one id and several
vectors stay candidates each; a null id takes no part; fewer rows than k give fewer results; an empty table gives no rows; other
columns are ignored. Scores are longs and must fit one; components must be below
2^52 / 256. Where sums of products may pass 2^53, bounds are widened by their rounding error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy

CELLS = 64
QUERIES, VECTORS = 512, 2048
SCALE = 256


def integer_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v: floor(256 * x) of every component, for the vectors that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    rows = rows.where(x.isNotNull() & F.col(vec_id).isNotNull() & fine)
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v")).distinct()


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """A column of vectors as rows of length dims, filled up with zeros."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    out, sizes = np.zeros((len(column), dims), dtype=np.int64), np.diff(ends)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], sizes)] = flat[ends[0]:ends[-1]]
    return out


class Marks:
    """Equal cells of each dimension between the smallest and the largest value there."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int):
        self.low, self.cells = low.astype(np.int64), cells
        self.width = np.maximum(-(-(high - low + 1) // cells), 1).astype(np.int64)

    def quantise(self, v: np.ndarray) -> np.ndarray:
        return np.clip((v - self.low) // self.width, 0, self.cells - 1).astype(np.uint8)

    def bounds(self, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products, queries by cell rows."""
        least = self.low + cells.astype(np.int64) * self.width
        least, most = least.astype(float), (least + self.width - 1).astype(float)
        up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
        low, high = up @ least.T + down @ most.T, up @ most.T + down @ least.T
        size, largest = np.abs(queries).astype(float), np.maximum(np.abs(least), np.abs(most))
        if len(size) and len(largest) and (size @ largest.max(0)).max() >= 2.0 ** 52:  # below it every sum is exact
            margin = size @ largest.T * ((cells.shape[1] + 4) * np.finfo(float).eps)
            low, high = low - margin, high + margin
        return low, high


def approximation_file(distinct: DataFrame, marks: Marks) -> DataFrame:
    """distinct(v_id, v) -> block, v_ids, cells: blocks of VECTORS quantised rows."""
    dims = len(marks.low)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, VECTORS):
                part = b.slice(at, VECTORS)
                ids = part.column(0).to_numpy()
                cells = marks.quantise(matrix(part.column(1), dims))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(ids.min())]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary())],
                    names=["block", "v_ids", "cells"])

    return distinct.select("v_id", "v").mapInArrow(run, "block long, v_ids binary, cells binary")


def query_blocks(queries: DataFrame, dims: int, blocks: int) -> DataFrame:
    """queries(v_id, v) -> q_block, q_ids, vectors."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column(0).to_numpy()
            for block in np.unique(of):
                part = b.filter(pa.array(of == block))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(block)], pa.int32()), pa.array([part.column(1).to_numpy().astype("<i8").tobytes()], pa.binary()),
                     pa.array([matrix(part.column(2), dims).astype("<i8").tobytes()], pa.binary())], names=["q_block", "q_ids", "vectors"])

    placed = queries.select(F.pmod(F.xxhash64("v_id"), F.lit(blocks)).cast("int").alias("q_block"), "v_id", "v")
    return placed.repartition("q_block").sortWithinPartitions("q_block").mapInArrow(run, "q_block int, q_ids binary, vectors binary")


def scan(blocks: DataFrame, queries: DataFrame, marks: Marks, k: int, n_query_blocks: int) -> DataFrame:
    """query, v_id, low, high: of each block of vectors, the ones whose upper bound reaches the block's k-th lower bound."""
    dims = len(marks.low)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, vectors, v_ids, cells in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                q_ids, v_ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(v_ids, "<i8")
                low, high = marks.bounds(np.frombuffer(cells, np.uint8).reshape(-1, dims), np.frombuffer(vectors, "<i8").reshape(-1, dims))
                kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else low.min(1)
                i, j = np.nonzero(high >= kth[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[i], v_ids[j], low[i, j], high[i, j])], names=["query", "v_id", "low", "high"])

    # the grid: each vector block is dealt with each query block, by a key that spreads the pairs
    vector_side = blocks.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    shards = F.pmod(F.xxhash64("block"), F.lit(64))
    vector_side = vector_side.withColumn("shard", shards)
    query_side = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    pairs = vector_side.join(query_side, ["q_block", "shard"]).select("q_ids", "vectors", "v_ids", "cells")
    return pairs.mapInArrow(run, "query long, v_id long, low double, high double")


def exact(pairs: DataFrame, queries: DataFrame, distinct: DataFrame) -> DataFrame:
    """pairs(query, v_id, ...) with the exact score."""
    left = pairs.join(queries.select(F.col("v_id").alias("query"), F.col("v").alias("q")), "query")
    both = left.join(distinct.select("v_id", "v"), "v_id")
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    return both.select("query", "v_id", score.alias("score"))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that is_query (a condition on column id) marks."""
    vectors = stored(integer_vectors(rows, vec_id, vector), "vectors")
    first = Window.partitionBy("v").orderBy("id")
    ids = vectors.select("v", "id", F.row_number().over(first).alias("n")).where(F.col("n") <= k + 1)
    ids = ids.groupBy("v").agg(F.min("id").alias("v_id"), F.sort_array(F.collect_list("id")).alias("ids"))
    # an id may stand for several vectors: those need a number of their own
    distinct = stored(ids.select(F.xxhash64("v_id", "v").alias("v_id"), "v", "ids"), "distinct-vectors")
    of = distinct.agg(F.max(F.size("v"))).first()[0]
    if not of:
        if of is None:
            return vectors.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
        of = 1
    at = vectors.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()
    low, high = np.zeros(of, dtype=np.int64), np.zeros(of, dtype=np.int64)
    for r in at:  # zero belongs to the range where a vector may be shorter
        low[r["at"]], high[r["at"]] = min(r["low"], 0), max(r["high"], 0)
    marks = Marks(low, high, CELLS)

    asked = vectors.where(is_query)
    queries = stored(asked.select("v").distinct().join(distinct.select("v_id", "v"), "v"), "queries")
    n_blocks = max(1, -(-queries.count() // QUERIES))
    blocks = stored(approximation_file(distinct, marks), "approximation-file")
    # k + 1, as a query's own row is among them
    bounds = stored(scan(blocks, query_blocks(queries, of, n_blocks), marks, k + 1, n_blocks), "bounds")
    best = Window.partitionBy("query").orderBy(F.col("low").desc(), "v_id")
    kth = bounds.select("query", "low", F.row_number().over(best).alias("n")).where(F.col("n") <= k + 1).groupBy("query").agg(
        F.when(F.max("n") == k + 1, F.min("low")).otherwise(F.lit(float("-inf"))).alias("least"))
    reach = Window.partitionBy("query").orderBy(F.col("high").desc(), "v_id")
    able = stored(bounds.join(kth, "query").where(F.col("high") >= F.col("least")).select("query", "v_id", "high", F.row_number().over(reach).alias("n")), "able")
    read = stored(exact(able.where(F.col("n") <= k + 1), queries, distinct), "first-reads")
    sure = read.groupBy("query").agg(F.when(F.count(F.lit(1)) == k + 1, F.min("score")).otherwise(F.lit(None)).alias("sure"))
    rest = able.where(F.col("n") > k + 1).join(sure, "query").where(F.col("sure").isNull() | (F.col("high") >= F.col("sure")))
    scores = read.unionByName(exact(rest.select("query", "v_id"), queries, distinct))

    # back to rows: the ids behind each vector, the query's own taken out
    top = scores.join(distinct.select("v_id", "ids"), "v_id").select("query", "score", F.explode("ids").alias("vec_id"))
    order = [F.col("score").desc(), F.col("vec_id")]
    top = top.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("n") <= k + 1).drop("n")
    own = asked.join(queries.select("v", F.col("v_id").alias("query")), "v").select(F.col("id").alias("query_id"), "query")
    found = own.join(top, "query").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(*order))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
