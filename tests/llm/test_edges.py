"""Cases that once gave wrong results or none: dimensions, large components, clashing columns, hot rows, the shared folder."""

import math
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill import session
from sievemill.llm import ann, common, mixing, sharding, topk, vectors


def plain(rows, every, k, product):
    out = {}
    for i, q in rows:
        if i % every == 0:
            found = sorted((-product(q, v), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out[i] = [(j, -s) for s, j in found]
    return {q: v for q, v in out.items() if v}


def found(table):
    out = defaultdict(dict)
    for r in table.collect():
        out[r.query_id][r["rank"]] = (r.vec_id, r.score)
    return {q: [v[n] for n in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("most", [8192, 50])
def test_each_dimension_is_searched(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "CANDIDATES", most)
    monkeypatch.setattr(topk, "CANDIDATES", most)
    rng = np.random.default_rng(0)
    rows = [(k, rng.standard_normal(d).round(2).tolist()) for d, a, n in ((6, 0, 300), (4, 300, 120), (1, 420, 30), (9, 450, 1)) for k in range(a, a + n)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert found(topk.search(table, F.col("vec_id") % 7 == 0)) == plain([(k, [math.floor(256 * x) for x in v]) for k, v in rows], 7, 5, lambda q, v: sum(a * b for a, b in zip(q, v, strict=True)))
    got, want = found(ann.search(table, F.col("vec_id") % 7 == 0)), plain(rows, 7, 20, lambda q, v: float((np.array(q) * np.array(v)).sum()))
    assert got.keys() == want.keys()
    assert np.mean([len({x for x, _ in got[q]} & {x for x, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9


@pytest.mark.parametrize("size", [1e6, 3e12, 1e17, 1e200, 1.5e308])
def test_products_are_exact_at_any_size(spark, size):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.uniform(-1, 1, 5) * size).tolist()) for k in range(60)] + [(60, [size, 1.0, 0.0, 0.0, 0.25]), (61, [0.0] * 5), (62, [1.0, -size, 0.5, 0.0, 0.0])]
    cut = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    from fractions import Fraction

    exact = [(k, [math.floor(Fraction(x) * 256) for x in v]) for k, v in rows]
    want = plain(exact, 10, 5, lambda q, v: cut(sum(a * b for a, b in zip(q, v, strict=True))))
    assert found(topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0)) == want


def test_mix_of_columns_that_clash(spark):
    rows = [(k, "ab"[k % 2], k % 9 + 1, "x", "y", "z", 1, 2) for k in range(200)]
    names = "doc_id long, source string, size long, source_size string, target string, copies string, row_no long, __part int"
    got = mixing.mix(spark.createDataFrame(rows, names), "size")
    want = mixing.mix(spark.createDataFrame([r[:3] for r in rows], "doc_id long, source string, size long"), "size")
    columns = ["doc_id", "source", "size", "source_size", "target"]
    assert Counter(got.select(*columns).collect()) == Counter(want.select(*columns).collect())
    assert len(got.columns) == len(set(got.columns)) and got.agg(F.sum("copies")).first()[0] > 0


def test_rows_that_are_wholly_equal_are_dealt_out(spark):
    """A third of all rows has one key and one text; its range is subdivided all the same."""
    rows = [(7, "hot text")] * 3000 + [(k, f"text {k}") for k in range(6000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text", ranges=40).collect()
    weight, slots = Counter(), defaultdict(list)
    for r in got:
        weight[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean = sum(weight.values()) / 24
    assert len(got) == 9000 and len(weight) == 24 and max(weight.values()) < 1.03 * mean
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_whole_groups_are_a_choice(spark):
    rows = [(k, f"text {k // 40}") for k in range(2400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for whole, most in ((1.0, 1), (0.0, 3)):
        of = defaultdict(set)
        for r in sharding.shard(table, "doc_id", "text", whole=whole).collect():
            of[r.text_crc32].add(r.shard)
        assert max(map(len, of.values())) == most or (whole == 0.0 and max(map(len, of.values())) > 1)


def test_the_shared_folder_is_asked_for(monkeypatch, spark):
    asked = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))))
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(asked)
    held = common.stored(spark.range(5).toDF("x"), "test")
    assert held.count() == 5
    path = common._PATHS[held].removeprefix("file://").removeprefix("file:")
    import os

    assert os.path.isdir(path)
    common.dropped(held)
    assert not os.path.exists(path)
