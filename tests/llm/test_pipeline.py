"""Each stage's rows against a plain version."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pandas as pd

from sievemill.llm import classify, common

from .test_rows import groups_of, plain_targets
from .test_tokens import crc, ids


def test_stages_row_by_row(spark, small):
    docs, labels = common.table(spark, small, "documents"), common.table(spark, small, "labels")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.stored(stage(spark, docs, small), "test")
        rows, got = before.collect(), Counter(docs.select(*names).collect())
        if name in ("quality", "toxicity"):
            scorer = (classify.quality_scorer if name == "quality" else classify.toxic_scorer)(before, labels)
            scores = [float(scorer.score(pd.Series([r.text]))[0]) for r in rows]
            good = [s >= classify.QUALITY_THRESHOLD if name == "quality" else s < classify.TOXIC_THRESHOLD for s in scores]
            assert got == Counter(r for r, g in zip(rows, good, strict=True) if g)
        if name == "near_duplicates":
            kept = {c for _, _, c in groups_of([(r.doc_id, r.text) for r in rows], 5, 80)}
            assert got == Counter(r for r in rows if r.doc_id in kept)
        if name == "mix":
            assert set(got) <= set(rows) and max(got.values()) <= 2
            size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
            sizes, largest, taken = Counter(), Counter(), Counter()
            for r in rows:
                sizes[r.source] += size[r]
                largest[r.source] = max(largest[r.source], size[r])
                taken[r.source] += got[r] * size[r]
            assert all(abs(taken[s] - t) <= largest[s] + 1e-6 for s, t in plain_targets(dict(sizes)).items())
    want, of = Counter(), defaultdict(list)
    for r in docs.collect():
        x = [*ids(r.text), 2]
        n = -(-len(x) // 1024)
        cuts = [0, *[len(x) - 1024 * (n - 1 - k) for k in range(n)]]
        for k in range(n):
            want[r.doc_id, k, cuts[k], cuts[k + 1] - cuts[k], crc(x[cuts[k] : cuts[k + 1]])] += 1
    piece = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    packed = corpus_pipeline.pack(spark, docs, small).collect()
    assert Counter(map(piece, packed)) == want
    for r in packed:
        of[r.sequence_id].append((r.offset, r.length))
    for parts in of.values():
        at = 0
        for begin, length in sorted(parts):
            assert begin == at
            at += length
        assert at <= 1024
    assert Counter(map(piece, corpus_pipeline.run(spark, small).collect())) == want
