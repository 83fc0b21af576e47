"""Exact top-k by Fagin's threshold algorithm.

Candidates are dealt to blocks of bounded size. A block sorts its vectors once along each dimension. For a query, the lists are
read from their better end (the greater values where the query is positive, the smaller ones where it is negative) to the
same depth; every vector met is scored in full; the products of the query with the values at that depth sum to a bound
on all vectors not yet met. Once the kth score is above the bound, no other vector can be among the k best, ties included.
Depth grows by steps, so that the work of a step is a few array operations. Blocks' best are merged by a window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .vectors import CANDIDATES, QUERIES, best, clean, each_dimension, matrix, part

#: Rows of each list that a step reads at first; it doubles. Results a query, and the factor before floor.
STEP, K, SCALE = 8, 5, 256


#: Scores beyond these count as these.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exactly: as doubles where these hold it, else as Python's integers."""
    with np.errstate(over="ignore"):
        found = np.floor(x * float(scale))
    if np.isfinite(found).all():
        return found
    return np.array([[math.floor(v * scale) if abs(v) < 2**900 else int(v) * scale for v in row] for row in x.tolist()], object)


class Lists:
    """Sorted lists of a block of vectors of whole numbers. ``reach``: the greatest absolute value of a query."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, reach: float | None = None):
        order = np.argsort(ids, kind="stable")
        largest = max(float(min(abs(values).max(), 2**600)) if values.size else 0.0, reach or 0.0)
        bound = values.shape[1] * largest**2 if largest < 2**500 else math.inf
        # whole numbers below 2**53 are exact as doubles, and their products are faster; those beyond 2**63 need Python's
        kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object
        self.ids = ids[order]
        self.fast = values[order].astype(kind) if kind is not object else np.array([[int(v) for v in row] for row in values[order].tolist()], object).reshape(values.shape)
        self.values = self.fast.astype(np.int64) if kind is np.float64 else self.fast
        self.down = np.argsort(-self.values, axis=0, kind="stable").T.copy()  # a row a dimension, greatest first
        self.read = 0

    def _long(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.int64) if x.dtype != object else np.array([min(max(v, LEAST), MOST) for v in x.tolist()], np.int64)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best for ``query`` but those with the id ``own``, ties to the smaller id."""
        query = query.astype(self.values.dtype) if self.values.dtype != object else np.array([int(v) for v in query.tolist()], object)
        n, dims = len(self.ids), np.flatnonzero(query)
        if not len(dims):  # every score is 0
            found = np.flatnonzero(self.ids != own)[:k]
            return self.ids[found], np.zeros(len(found), np.int64)
        weights = query[dims]
        wanted = query.astype(self.fast.dtype)
        met = np.zeros(n, bool)
        kept, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, STEP
        while depth < n:
            upto = min(n, depth + step)
            lists = np.where((weights > 0)[:, None].astype(bool), self.down[dims, depth:upto], self.down[dims, n - upto : n - depth][:, ::-1])
            new = np.zeros(n, bool)
            new[lists.ravel()] = True
            new &= ~met
            met |= new
            new = np.flatnonzero(new)
            self.read += len(new)
            made = self._long(self.fast[new] @ wanted)
            free = self.ids[new] != own
            kept, scores = np.concatenate([kept, new[free]]), np.concatenate([scores, made[free]])
            order = np.lexsort((kept, ~scores))[:k]  # ids ascend with places; ~ has no overflow
            kept, scores = kept[order], scores[order]
            bound = min(max(int((self.values[lists[:, -1], dims] * weights).sum()), LEAST), MOST)
            if len(kept) == k and scores[-1] > bound:
                break
            depth, step = upto, step * 2
        return self.ids[kept], scores


def search(vectors: DataFrame, queries: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """The k highest integer inner products of each row for which ``queries`` holds: query_id, rank, vec_id, score.

    Components become floor(scale * x). Products are exact at any size; a score beyond a long counts as the nearest long. See
    ``vectors.clean`` for rows that take no part; zero vectors do. Vectors of different dimensions have no product, so each dimension
    is searched by itself. Rows with the query's own vec_id are no candidates of it. Fewer candidates than k are all returned. An
    empty table gives an empty result. Other columns are not read.
    """
    rows, dims = clean(vectors, False)
    kind = "query_id long, vec_id long, score long"
    if not dims:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        form = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return form.empty_table()
        asked = whole(matrix(right["query"]), scale)
        lists = Lists(left["vec_id"].to_numpy(), whole(matrix(left["embedding"]), scale), float(min(abs(asked).max(), 2**600)))
        out = []
        for name, query in zip(right["query_id"].to_numpy(), asked, strict=True):
            ids, scores = lists.top(query, name, k)
            out.append((np.full(len(ids), name), ids, scores))
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], schema=form)

    def blocks(some: DataFrame, _: int) -> DataFrame:
        held = common.stored(some, "vectors")
        asked = held.where(queries)
        n_blocks, n_queries = (max(1, -(-x.count() // size)) for x, size in ((held, CANDIDATES), (asked, QUERIES)))
        candidates = held.select(part("vec_id", n_blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q"), "vec_id", "embedding")
        asks = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), part("vec_id", n_queries).alias("q"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        return candidates.groupBy("block", "q").cogroup(asks.groupBy("block", "q")).applyInArrow(score, kind)

    return best(each_dimension(rows, dims, queries, blocks, score, kind), k, "long")


def op9_threshold(spark, sf_dir: str) -> DataFrame:
    """The 5 highest integer products of every vector whose id is divisible by 50."""
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
