"""Approximate nearest neighbours with learned partitions.

Fit, on a bounded sample of vectors: the graph of each one's nearest neighbours; a balanced partition of that graph, by
halving along its smoothest vector and swapping pairs of nodes while that cuts fewer edges; a small network that learns from a
vector in which parts its neighbours lie. How many parts a query visits is the least number that reaches ``RECALL`` on the sample.

Index: the network puts every row into its likeliest part. Search: a query goes to its likeliest parts, whose rows are
scored exactly on the original vectors. Parts are split into blocks of bounded size by a hash of vec_id, and so are the
queries, so neither a large part nor a popular one meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .vectors import CANDIDATES, QUERIES, best, clean, each_dimension, matrix, part, top

#: Rows that the fit reads at most, parts, neighbours of a node, hidden units, and the recall asked for on the sample.
SAMPLE, PARTS, NEIGHBOURS, HIDDEN, RECALL, K = 6144, 16, 16, 128, 0.97, 20


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k greatest inner products with other rows (n, k)."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _halves(edges: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Which half each of n nodes goes to: equal halves that cut few of the ``edges`` (m, 2)."""
    degree = np.maximum(np.bincount(edges.ravel(), minlength=n), 1).astype(float)
    v = rng.standard_normal(n)
    for _ in range(60):  # the second vector of the random walk
        v -= (v * degree).sum() / degree.sum()
        flow = np.bincount(edges[:, 0], v[edges[:, 1]], n) + np.bincount(edges[:, 1], v[edges[:, 0]], n)
        v = 0.5 * v + 0.5 * flow / degree
        v /= np.linalg.norm(v) or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        sign = np.where(side, 1.0, -1.0)
        pull = np.bincount(edges[:, 0], sign[edges[:, 1]], n) + np.bincount(edges[:, 1], sign[edges[:, 0]], n)
        gain = -sign * pull  # edges to the other half less those to the own
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right), max(1, n // 40))
        good = int((gain[left[:m]] + gain[right[:m]] > 2).sum())
        if not good:
            break
        side[left[:good]], side[right[:good]] = True, False
    return side


def balanced_parts(near: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part for each node of the neighbour graph, all of the same size but for one; ``parts`` is a power of two."""
    rng, label = np.random.default_rng(seed), np.zeros(len(near), np.int64)
    every = np.stack([np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()], 1)
    for _ in range(int(np.log2(parts))):
        new = label * 2
        for now in np.unique(label):
            nodes = np.flatnonzero(label == now)
            place = np.full(len(near), -1)
            place[nodes] = np.arange(len(nodes))
            edges = place[every]
            new[nodes] += _halves(edges[(edges >= 0).all(1)], len(nodes), rng)
        label = new
    return label


class Router:
    """A network with one hidden layer: the probabilities of the parts that hold a vector's neighbours."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 7, epochs: int = 30):
        rng, d, p = np.random.default_rng(seed), x.shape[1], target.shape[1]
        self.scale = float(np.sqrt((x**2).mean())) or 1.0
        w = [rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, p)) / np.sqrt(HIDDEN), np.zeros(p)]
        first, second, t = [0 * a for a in w], [0 * a for a in w], 0
        self.w = w
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                z = x[rows] / self.scale
                h = np.maximum(z @ w[0] + w[1], 0)
                out = self._softmax(h @ w[2] + w[3]) - target[rows]
                back = (out @ w[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((z.T @ back, back.sum(0), h.T @ out, out.sum(0))):
                    g = g / len(rows) + 1e-4 * w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    w[k] -= 0.003 * (1 - epoch / epochs) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts, likeliest first (n, parts)."""
        h = np.maximum(x / self.scale @ self.w[0] + self.w[1], 0)
        return np.argsort(-(h @ self.w[2] + self.w[3]), axis=1, kind="stable")


def fit(sample: np.ndarray, k: int = K, parts: int = PARTS, recall: float = RECALL) -> tuple[Router | None, int]:
    """A router and the parts that a query visits; without a router, for samples too small to part, one part holds all."""
    while parts > 1 and len(sample) < 32 * parts:
        parts //= 2
    if parts < 2:
        return None, 1
    near = neighbours(sample, min(max(NEIGHBOURS, k), len(sample) - 1))
    label = balanced_parts(near[:, :NEIGHBOURS], parts)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.repeat(np.arange(len(sample)), near.shape[1]), label[near].ravel()), 1 / (near.shape[1] + 1))
    target[np.arange(len(sample)), label] += 1 / (near.shape[1] + 1)
    router = Router(sample, target)
    ranked = router.order(sample)
    home, place = ranked[:, 0], np.argsort(ranked, axis=1)
    needed = np.sort(place[np.arange(len(sample))[:, None], home[near[:, :k]]].ravel())
    return router, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def search(vectors: DataFrame, queries: Column, k: int = K, sample: int = SAMPLE) -> DataFrame:
    """The k nearest found of each row for which the condition ``queries`` holds: query_id, rank, vec_id, score (inner product).

    See ``vectors.clean`` for rows that take no part; vectors of different dimensions have no product, so each dimension is searched
    by itself. Rows with the query's own vec_id are no candidates of it; other rows with equal ids or vectors are candidates of
    their own. Ties go to the smaller vec_id. Fewer candidates than k are all returned. An empty table gives an empty result. Other columns are not read.
    """
    rows, dims = clean(vectors, True)
    if not dims:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        c, ids = matrix(left["embedding"]), left["vec_id"].to_numpy()
        q, names = matrix(right["query"]), right["query_id"].to_numpy()
        out = []
        for a in range(0, len(q), 128):
            products = q[a : a + 128] @ c.T
            for row, found in enumerate(top(products, names[a : a + 128, None] == ids[None, :], ids, k)):
                exact = (c[found] * q[a + row]).sum(1)  # summed alike wherever a vector lies
                order = np.lexsort((ids[found], -exact))[:k]
                out.append((np.full(len(order), names[a + row]), ids[found][order], exact[order]))
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], schema=kind)

    kind = "query_id long, vec_id long, score double"
    return best(each_dimension(rows, dims, queries, lambda some, d: _indexed(some, d, queries, k, sample, score, kind), score, kind), k, "double")


def _indexed(rows: DataFrame, d: int, queries: Column, k: int, sample: int, score: Callable, kind: str) -> DataFrame:
    """The best of each block that a query visits, by way of the learned parts."""
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("embedding")).limit(sample).toPandas()  # bounded
    router, visits = fit(np.array(chosen["embedding"].tolist()), k)
    held = rows.sparkSession.sparkContext.broadcast(router)

    @F.pandas_udf("array<int>")
    def route(x: pd.Series) -> pd.Series:
        if held.value is None:
            return pd.Series([[0]] * len(x))
        return pd.Series(list(held.value.order(np.array(x.tolist()).reshape(-1, d))[:, :visits].astype(np.int32)))

    index = common.stored(rows.withColumn("parts", route("embedding")), "index")
    sizes = index.groupBy(F.col("parts")[0].alias("part")).agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).alias("blocks"))  # a row a part
    # a part's blocks meet only the query blocks of the part: its own number of them
    asked = index.where(queries).select(F.explode("parts").alias("part"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    sizes = sizes.join(asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("asks")), "part")
    candidates = index.select(F.col("parts")[0].alias("part"), "vec_id", "embedding").join(F.broadcast(sizes), "part")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    candidates = candidates.select("part", part("vec_id", F.col("blocks")).alias("block"), every("asks").alias("q"), "vec_id", "embedding")
    asks = asked.join(F.broadcast(sizes), "part").select("part", every("blocks").alias("block"), part("query_id", F.col("asks")).alias("q"), "query_id", "query")
    keys = ("part", "block", "q")
    return candidates.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(score, kind)


def op4_learned_partitions(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
