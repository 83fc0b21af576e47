"""Classifiers by held-out accuracy, searches by brute force, the pipeline by its parts."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemill.llm import ann, catalog, classify, common, topk

from .fixtures import documents, empty


@pytest.mark.parametrize(("label", "score", "modulus", "remainder", "least"), [("quality", classify.score_quality, 4, 2, 0.9), ("toxic", classify.score_toxic, 5, 0, 0.93)])
def test_held_out_accuracy(spark, label, score, modulus, remainder, least):
    table, labels = common.table(spark, "/root/testdata/sf0.1", "documents"), common.table(spark, "/root/testdata/sf0.1", "labels")
    got = score(table, labels).join(labels, "doc_id").toPandas()
    assert [zlib.crc32(str(k).encode()) % modulus == remainder for k in got["doc_id"]] == got["held_out"].tolist()
    held = got[got["held_out"]]
    assert (held["predicted"] == held[label]).mean() >= least
    ranks, y = held["score"].rank(), held[label] == 1
    assert (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) >= least
    assert got["score"].between(0, 1).all()


def test_scores_of_awkward_rows(spark):
    table = documents(spark)
    labels = spark.createDataFrame([(k * 3, k % 2, None if k % 5 == 0 else (k // 2) % 2, 1) for k in range(100)] + [(None, 1, 1, 2), (0, 1, 1, 3)], "doc_id long, quality int, toxic int, text int")
    for score in (classify.score_quality, classify.score_toxic):
        got = score(table, labels).toPandas()
        assert len(got) == table.count() and got["score"].between(0, 1).all()
        same = score(table, labels.limit(0)).toPandas()
        assert (same["score"] == 0.5).all()
        assert score(empty(spark), labels).count() == 0


def vectors(spark, n=700, d=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).round(2)
    rows = [(k, x[k].tolist(), "x") for k in range(n)]
    rows += [(n + k, x[20].tolist(), "copy") for k in range(60)]  # ties
    rows += [(5000, None, None), (5020, [0.0] * d, "zero"), (5040, [math.nan] * d, ""), (5060, [math.inf] * d, ""), (5080, [None] * d, ""), (5100, [], ""), (5120, [1.0], "short"), (None, [1.0] * d, "")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(3)


def plain(table, every, k, integer):
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 12 and all(v is not None and math.isfinite(v) for v in r.embedding)]
    rows = [(i, np.floor(256 * np.array(v)).astype(int) if integer else np.array(v)) for i, v in rows if integer or any(v)]
    out = {}
    for i, q in rows:
        if i % every == 0:
            found = sorted(((-((q * v).sum()), j) for j, v in rows if j != i))[:k]
            out[i] = [(j, -s) for s, j in found]
    return out


def test_threshold_algorithm_is_exact(spark):
    table = vectors(spark)
    want = plain(table, 10, 5, True)
    got = topk.search(table, F.col("vec_id") % 10 == 0).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == {(q, k + 1): x for q, v in want.items() for k, x in enumerate(v)}
    few = topk.search(table.where("vec_id < 3"), F.col("vec_id") == 0)
    assert few.count() == 2
    assert topk.search(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(0)
    values = (rng.pareto(1.5, (20_000, 6)) * 100).astype(np.int64)
    lists = topk.Lists(np.arange(20_000), values)
    ids, scores = lists.top(values[3], 3, 5)
    products = values @ values[3]
    products[3] = -1
    assert sorted(scores.tolist(), reverse=True) == sorted(products.tolist(), reverse=True)[:5]
    assert lists.read < 4_000


def test_neighbours_of_awkward_rows(spark):
    table = vectors(spark)
    want = plain(table, 20, 20, False)
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    assert got.keys() == want.keys()
    assert all([x[2] for x in v] == list(range(1, len(v) + 1)) for v in got.values())
    recall = np.mean([len({x[0] for x in got[q]} & {x[0] for x in v}) / len(v) for q, v in want.items()])
    assert recall >= 0.9
    of = {r.vec_id: np.array(r.embedding) for r in table.where("vec_id < 760").collect()}
    assert all(abs(s - (of[q] * of[j]).sum()) < 1e-12 for q, v in got.items() for j, s, _ in v)
    assert ann.search(table.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(table.where("vec_id < 4"), F.col("vec_id") == 0).count() == 3


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    got = catalog.queries()["op4_learned_partitions"](spark, sf).toPandas()
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    x, ids = np.array(e["embedding"].tolist(), float), e["vec_id"].to_numpy()
    hits = n = 0
    for q, found in got.groupby("query_id")["vec_id"]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len({*ids[np.argsort(-s, kind="stable")[:20]]} & {*found})
        n += 20
    assert len(got) == n and hits / n >= 0.9


def test_balanced_parts():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((512, 8))
    label = ann.balanced_parts(ann.neighbours(x, 8), 8)
    assert set(Counter(label.tolist()).values()) == {64}


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = common.table(spark, small, "documents")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, small)
        if name != "pack":
            assert docs.columns == columns
            docs = common.stored(docs, "test")
            kept.append(docs.count())
        if name in ("quality", "toxicity", "near_duplicates"):
            assert docs.exceptAll(before).count() == 0
        if name == "near_duplicates":
            from .test_rows import groups_of

            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in docs.collect()} == {g for _, _, g in groups_of(rows, 5, 80)}
        if name == "mix":
            copies = Counter(r.doc_id for r in docs.collect())
            assert set(copies.values()) <= {1, 2} and max(copies.values()) == 2
        if name == "pack":
            assert Counter(r.doc_id for r in docs.where("piece = 0").collect()) == copies
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] > 0.5 * kept[0]
    assert corpus_pipeline.run(spark, small).count() == docs.count()
