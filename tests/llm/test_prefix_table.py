"""Budgets are answered from the stored counts at all prefixes, without a tokenizer."""

import numpy as np
import public_tokenizers
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemill.llm import common, prefix

from .fixtures import documents
from .test_tokens import TEXTS, ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(TEXTS, max_size=5))
@settings(max_examples=150, deadline=None)
def test_counts_of_all_texts(texts):
    counts, n = prefix.counter(PATH).all_counts(texts)
    assert n.tolist() == list(map(len, texts))
    assert counts.tolist() == [len(ids(t[: k + 1])) for t in texts for k in range(len(t))]


@given(st.lists(st.integers(-300, 300), max_size=40))
def test_packed_counts(steps):
    counts = np.cumsum(np.array(steps, np.int64))
    assert prefix.unpacked(prefix._packed(counts, zstandard.ZstdCompressor())).tolist() == [0, *counts.tolist()]


def test_stored_table_answers_any_budget(spark, monkeypatch):
    rows = documents(spark)
    held = common.stored(prefix.table(rows, PATH), "test")
    texts = [(r.doc_id, r.text or "") for r in rows.collect()]
    monkeypatch.setattr(prefix, "counter", None)
    for budget in (0, 1, 7, 40, 512):
        got = held.select("doc_id", "n_chars", prefix.longest(F.col("prefixes"), F.col("n_tokens"), F.col("n_chars"), budget).alias("fit"), prefix.counts_at(F.col("prefixes"), F.lit(budget)).alias("at")).collect()
        want = []
        for key, text in texts:
            if len(text) > 400:
                continue
            fit = max(k for k in range(len(text) + 1) if len(ids(text[:k])) <= budget)
            want.append((key, len(text), fit, len(ids(text[:budget]))))
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got if r.n_chars <= 400)


def test_counter_starts_anew_when_full():
    few = prefix.PrefixCounter(PATH, keep=5)
    for text in ("one two three four five six seven", "one more", "a  b", "six seven", "one two one two one two three eight"):
        assert few.all_counts([text])[0].tolist() == [len(ids(text[: k + 1])) for k in range(len(text))]
