"""What the two searches share: clean vectors, blocks of bounded size, and the best of each block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Candidates and queries of a block: what one task holds at once.
CANDIDATES, QUERIES = 8192, 2048


def clean(vectors: DataFrame, no_zero: bool) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows (vec_id, embedding as doubles, d) that take part, and their dimensions with their numbers of rows, the most frequent first.

    Left out: null ids and vectors, vectors with null or non-finite components, empty ones, and with ``no_zero`` those of zeros.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("d"))
    fine = rows.where("vec_id IS NOT NULL AND d > 0").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if no_zero:
        fine = fine.where(F.exists("embedding", lambda x: x != 0))
    found = fine.groupBy("d").count().orderBy(F.desc("count"), "d").collect()  # a row a dimension
    return fine, [(r["d"], r["count"]) for r in found]


def each_dimension(rows: DataFrame, dims: list[tuple[int, int]], queries: Column, indexed: Callable[[DataFrame, int], DataFrame], score: Callable[[pa.Table, pa.Table], pa.Table], kind: str) -> DataFrame:
    """What is found in each dimension: vectors have products only with others of theirs.

    ``indexed`` searches the most frequent dimension, and any other that has more rows than a block. Those with fewer are one block each, which ``score`` compares.
    """
    out = None
    for k, (d, n) in enumerate(dims):
        if not k or n > CANDIDATES:
            found = indexed(rows.where(F.col("d") == d).drop("d"), d)
            out = found if out is None else out.union(found)
    small = [d for k, (d, n) in enumerate(dims) if k and n <= CANDIDATES]
    if small:
        rest = rows.where(F.col("d").isin(small))
        asks = rest.where(queries).select("d", F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        out = out.union(rest.groupBy("d").cogroup(asks.groupBy("d")).applyInArrow(score, kind))
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one dimension."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best(found: DataFrame, k: int, score: str) -> DataFrame:
    """Of (query_id, vec_id, score) the k best of each query, ties to the smaller vec_id. The window keeps k rows a query and task before the shuffle."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast(score))


def part(column: str, n: int | Column) -> Column:
    """A block number by hash."""
    return F.pmod(F.xxhash64(column), n if isinstance(n, Column) else F.lit(n)).cast("int")


def top(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row of ``scores`` the columns of its k greatest, and of all that tie with the least of these, but for the query's own."""
    scores = np.where(own, -np.inf, scores)
    out = []
    for row in scores:
        if len(row) <= k:
            out.append(np.flatnonzero(row > -np.inf))
            continue
        least = np.partition(row, len(row) - k)[len(row) - k]
        out.append(np.flatnonzero((row >= least - 1e-9 * max(1.0, abs(least))) & (row > -np.inf)) if np.isfinite(least) else np.flatnonzero(row > -np.inf))
    return out
