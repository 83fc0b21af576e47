"""Operators whose results SQL can't express, against plain versions of the same definition."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
import zstandard

from sievemill.llm import classify, common, sharding

from .fixtures import documents, empty


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_shards(rows, shards, whole):
    """In order of (hash of the text, key), null keys first; a light group of equal texts by its middle, any other record by its own."""
    items = sorted((signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), -(1 << 63) if k is None else k, k, t) for k, t in rows)
    sizes = [len((t or "").encode()) + 8 for *_, t in items]
    per = sum(sizes) / shards
    weight, start, at, out = Counter(), {}, 0, []
    for (h, *_), n in zip(items, sizes, strict=True):
        start.setdefault(h, at)
        weight[h] += n
        at += n
    at = 0
    for (h, _, k, t), n in zip(items, sizes, strict=True):
        middle = start[h] + weight[h] / 2 if weight[h] <= whole * per else at + n / 2
        out.append((k, n, zlib.crc32((t or "").encode()), min(shards - 1, math.floor(middle / per))))
        at += n
    return Counter(out)


def test_shards(spark):
    table = documents(spark)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    for shards, whole in ((24, sharding.WHOLE), (5, sharding.WHOLE), (7, 0.2), (24, 0.0)):
        got = sharding.shard(table, "doc_id", "text", shards, ranges=30, whole=whole).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in got) == plain_shards(rows, shards, whole)


def frame_size(data, dictionary, trained, params):
    kind = zstandard.DICT_TYPE_AUTO if trained else zstandard.DICT_TYPE_RAWCONTENT
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    return len(zstandard.ZstdCompressor(dict_data=held, **params).compress(data))


def logistic(x, scorer):
    z = float(np.dot((np.array(x) - scorer.mean) / scorer.scale, scorer.weights[:-1]) + scorer.weights[-1])
    return 1 / (1 + math.exp(-z))


def test_quality_by_hand(spark, small):
    docs, labels = common.table(spark, small, "documents"), common.table(spark, small, "labels")
    scorer = classify.quality_scorer(docs, labels)
    got = {r.doc_id: r.score for r in classify.score_quality(docs, labels).collect()}
    params = {"level": 3, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
    for r in docs.limit(60).collect():
        data = (r.text or "").encode()
        good, bad = (frame_size(data, d["data"], d["data"][:4] == b"\x37\xa4\x30\xec", params) for d in scorer.dictionaries)
        n = len(data) + 64
        assert abs(got[r.doc_id] - logistic([(bad - good) / (bad + good), (bad - good) / n, math.log((min(good, bad) + 28) / n)], scorer)) < 1e-9


def test_toxicity_by_hand(spark, small):
    """Words are coded by their first four letters and wholly, windows have 32 words, and lengths are compared by compressors made anew."""
    docs, labels = common.table(spark, small, "documents"), common.table(spark, small, "labels")
    scorer = classify.toxic_scorer(docs, labels)
    got = {r.doc_id: r.score for r in classify.score_toxic(docs, labels).collect()}
    toxic, ordinary, shared = scorer.dictionaries
    presses = [classify._matcher(d + shared) for d in (toxic, ordinary)]
    for r in docs.limit(40).collect():
        letters = "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in r.text or "")
        codes = [xxhash.xxh3_64_digest(("^" + w[:4]).encode()) + xxhash.xxh3_64_digest(w.encode()) for w in letters.split(" ") if w]
        gains = [len(presses[1](x)) - len(presses[0](x)) for x in (b"".join(codes[k : k + 32]) for k in range(0, len(codes), 32))]
        n = len(gains) + 2
        most = sum(sorted(gains)[-3:]) / 3 if gains else 0
        assert abs(got[r.doc_id] - logistic([math.log1p(max(most, 0)), math.sqrt(sum(max(g, 0) for g in gains) / n), sum(gains) / n], scorer)) < 1e-9


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    """Every stage takes rows with nulls, repeats and clashing columns, and tables without rows, and returns the columns that it got."""
    import corpus_pipeline

    labels = pd.DataFrame({"doc_id": range(0, 360, 3), "quality": [k % 4 != 0 for k in range(120)], "toxic": [k % 5 == 0 for k in range(120)]}).astype(int)
    labels.to_parquet(tmp_path / "labels.parquet")
    for rows in (documents(spark), empty(spark)):
        docs, names = rows, rows.columns
        for name, stage in corpus_pipeline.STAGES:
            # the classifiers may reject anything here; each stage gets the whole table
            out = stage(spark, docs, str(tmp_path))
            found = out.collect()
            assert len(found) <= 2 * max(docs.count(), 1) * 45
            if name != "pack":
                assert out.columns == names and {r.doc_id for r in found} <= {r.doc_id for r in docs.collect()}
            elif docs.count():
                assert {r.doc_id for r in found} == {r.doc_id for r in docs.collect()}
            if name == "near_duplicates" and docs.count():
                texts = [r.text for r in found if r.text and r.text.split()]
                assert len(texts) == len(set(texts))
