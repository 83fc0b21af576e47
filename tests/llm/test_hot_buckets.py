"""Pairs of hot buckets that no pivot joins, against brute force."""

import numpy as np

from sievemill.llm import neardup


def test_a_band_is_shared_by_its_key_only(spark):
    """Two documents whose low bytes agree everywhere, but whose first three band keys differ."""
    bands = [list(range(36)), [-1, -2, -3, *range(3, 36)]]
    rows = [(k, b, d, 100, d, bytes(neardup.SLOTS), bands[d]) for d in (0, 1) for b, k in ((3, 3), (4, 4))]
    table = spark.createDataFrame(rows, "key long, band int, doc_id long, n_shingles long, group long, slots binary, bands array<long>")
    sets = spark.createDataFrame([(d, bytes(range(80))) for d in (0, 1)], "doc_id long, elements binary")
    assert [tuple(r) for r in neardup._block_links(table, sets, 85, [3]).collect()] == [(1, 0)]


def test_the_filter_loses_less_than_the_bands():
    for similarity in (0.8, 0.85):
        rng = np.random.default_rng(0)
        drawn = rng.binomial(neardup.SLOTS, similarity, 4_000_000)
        assert (drawn < neardup.least_equal(similarity)).mean() <= neardup.MISS


def test_a_hot_bucket_with_few_links(spark):
    """A template with a tail of its own for each document; each two of a hundred pairs have tails nearly alike."""
    n, links = 1300, 100
    head = [f"t{x}" for x in range(102)]
    tails = [[f"u{k}_{x}" for x in range(16)] for k in range(n)]
    for k in range(links):
        tails[2 * k + 1] = [*tails[2 * k][:8], *tails[2 * k + 1][8:]]
    words = [head + t for t in tails]
    number: dict = {}
    sets = [sorted({number.setdefault(tuple(w[i : i + 3]), len(number)) for i in range(len(w) - 2)}) for w in words]
    held = np.zeros((n, len(number)), np.float32)
    for k, s in enumerate(sets):
        held[k, s] = 1
    both = (held @ held.T).astype(int)
    sizes = both.diagonal()
    alike = 100 * both >= 85 * (sizes[:, None] + sizes - both)
    want = {k: int(np.flatnonzero(alike[k])[0]) for k in range(n)}
    assert sum(k != v for k, v in want.items()) == links
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table, 3, 85).collect()}
    assert got == want
