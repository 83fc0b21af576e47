"""Near-duplicates, mixing and sharding against plain versions."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.llm import catalog, common, mixing, neardup, sharding

from .fixtures import documents, empty


def sets_of(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) or frozenset([tuple(words)])


def groups_of(rows, width, percent):
    sets = [sets_of(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and rows[a][0] is not None and rows[b][0] is not None and (100 * len(x & y) >= percent * len(x | y) or rows[a][0] == rows[b][0]):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k, (key, _) in enumerate(rows):
        least[root(k)].append(key)
    return Counter((key, len(s), key if key is None or not s else min(least[root(k)])) for k, ((key, _), s) in enumerate(zip(rows, sets, strict=True)))


def check_groups(table, width, percent):
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    got = neardup.near_duplicates(table, width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups_of(rows, width, percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    return got


def test_near_duplicates(spark):
    got = check_groups(documents(spark), 3, 85)
    assert any(not r.kept for r in got)
    check_groups(documents(spark), 5, 80)
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_the_test_table(spark, small):
    check_groups(common.table(spark, small, "documents"), 3, 85)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_agrees(spark, small, name):
    base = duckdb.connect()
    for table in ("documents", "embeddings"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{small}/{table}.parquet')")
    got = catalog.queries()[name](spark, small)
    want = base.sql(catalog.oracle_sql()[name])
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.project(", ".join(columns)).fetchall())


def test_near_duplicates_in_a_chain_at_the_threshold(spark):
    """A large group whose members are alike only along a chain: pivots don't join it, the full comparison does."""
    rows = [(k, " ".join(f"w{x}" for x in range(3 * k, 3 * k + 80)), "x") for k in range(60)]
    check_groups(spark.createDataFrame(rows, "doc_id long, text string, n_shingles string").repartition(5), 3, 85)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(90)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    assert got == {k: v for k, v in up.items() if k != v}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    u = rng.integers(0, 2**63, 600, dtype=np.uint64)
    made = neardup.signatures(np.concatenate([u[:500], u[100:]]), np.array([500, 500, 0]))
    assert abs((made[0] == made[1]).mean() - 400 / 600) < 0.1
    assert (made[2] == neardup._NONE).all()
    assert neardup.rows_of(0.85) == 7 and neardup.rows_of(0.8) == 6


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, total, out = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
        total -= sum(out[s] for s in over)
        left -= over
    return out


def test_mix(spark):
    table = documents(spark)
    sized = table.select("doc_id", "source", "n_chars", common.n_words(F.col("text")).alias("size"))
    got = mixing.mix(sized, "size").collect()
    again = mixing.mix(sized.repartition(7), "size").collect()
    assert Counter(got) == Counter(again)
    sizes = Counter()
    for r in table.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = plain_targets(dict(sizes))
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
    assert len(got) == table.count()
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    assert mixing.mix(empty(spark).select("doc_id", "source", "size"), "size").count() == 0


def test_targets_with_all_sources_at_their_bound(spark):
    rows = mixing.targets(spark.createDataFrame([("a", 10), ("b", 0), (None, 5)], "source string, source_size long"), share=2.0).collect()
    assert {r.source: r.target for r in rows} == {"a": 20.0, "b": 0.0, None: 10.0}


def test_shards(spark):
    table = documents(spark)
    for part, shards in ((table, 24), (table.where("doc_id < 9"), 24), (table, 5)):
        rows = part.collect()
        got = sharding.shard(part, "doc_id", "text", shards, ranges=40).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
        of, weight = defaultdict(list), Counter()
        for r in got:
            of[r.shard].append(r.slot)
            weight[r.shard] += r["size"]
            assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        assert all(sorted(x) == list(range(len(x))) for x in of.values())
        largest = max(r["size"] for r in got)
        assert max(weight.values()) <= sum(weight.values()) / shards * (1 + sharding.WHOLE) + largest
    assert sharding.shard(empty(spark), "doc_id", "text").count() == 0


def test_equal_texts_keep_together_unless_they_are_many(spark):
    rows = [(k, f"text {k % 2000}", "x") for k in range(4000)] + [(5000 + k, "hot", "x") for k in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, h string"), "doc_id", "text").collect()
    of = defaultdict(set)
    weight = Counter()
    for r in got:
        of[r.text_crc32].add(r.shard)
        weight[r.shard] += r["size"]
    hot = zlib.crc32(b"hot")
    assert all(len(v) == 1 for k, v in of.items() if k != hot) and len(of[hot]) > 5
    assert max(weight.values()) <= sum(weight.values()) / 24 * 1.05
