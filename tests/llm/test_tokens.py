import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievemill.llm import packing, prefix, repair, tokens

from .fixtures import documents, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = st.text(alphabet=st.one_of(st.sampled_from("ab 's\n\tvre1!é×’。n. \x1c<|endoftext|>日"), st.characters(blacklist_categories=["Cs"])), max_size=60)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@given(st.lists(TEXTS, max_size=5))
@settings(max_examples=150, deadline=None)
def test_chunked_ids_are_the_library_s(texts):
    flat, counts = tokens.coder(PATH).encode_all(texts)
    assert flat.tolist() == [y for t in texts for y in ids(t)]
    assert counts.tolist() == [len(ids(t)) for t in texts]


def test_coder_starts_anew_when_full():
    coder = tokens.ChunkCoder(PATH, keep=5)
    for text in ("one two three four five six seven", "one more", "a  b", "six seven", "one two one two one two three eight", "three eight", "one two"):
        assert coder.encode(text).tolist() == ids(text)


def test_table_of_hashes():
    rng = np.random.default_rng(0)
    table = tokens._Table(4)
    keys, checks = rng.integers(0, 1 << 64, 50_000, np.uint64), rng.integers(0, 1 << 32, 50_000, np.uint32)
    keys[::3] = keys[1::3][: len(keys[::3])] if len(keys[1::3]) >= len(keys[::3]) else np.append(keys[1::3], keys[1])  # alike but for the check
    keys |= np.uint64(1)
    for k in range(0, 50_000, 5000):
        assert (table.find(keys[k : k + 5000], checks[k : k + 5000]) == 0).all()
        table.add(keys[k : k + 5000], checks[k : k + 5000], np.arange(k + 1, k + 5001, dtype=np.int32))
    assert (table.find(keys, checks) == np.arange(1, 50_001)).all()


def test_slices_of_columns():
    column = pa.array(["one", None, "two three", "", "a  b", "ünï cödé\nx"] * 3)
    flat, counts = tokens.coder(PATH).encode_all(column[4:15], 2)
    want = [[*ids(t), 2] for t in column[4:15].to_pylist()]
    assert flat.tolist() == [y for x in want for y in x] and counts.tolist() == list(map(len, want))
    assert [s.stop for s in tokens.batches(column, 10)][-1] == 18 and len(list(tokens.batches(column[:0]))) == 0


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_prefix_counts(text):
    assert prefix.counter(PATH).counts(text).tolist() == [len(ids(text[:k])) for k in range(len(text) + 1)]


def test_counts_and_longest_prefix_of_all_rows(spark):
    table = documents(spark)
    rows = prefix.count_tokens(table, PATH, 20).collect()
    texts = Counter((r.doc_id, r.text) for r in table.collect())
    assert len(rows) == table.count()
    want = Counter()
    for (key, text), n in texts.items():
        t, k = text or "", len(ids(text))
        fit = len(t) if k <= 20 else max(m for m in range(min(len(t), 400) + 1) if len(ids(t[:m])) <= 20)
        want[key, len(t.encode()), k, k > 20, fit] += n
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.fit_chars) for r in rows) == want
    assert prefix.count_tokens(empty(spark), PATH).count() == 0


@given(st.lists(st.integers(0, 12), max_size=300), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_grammar_round_trip(values, times):
    flat = np.array(values * times * 20 + [2], np.uint32)
    alphabet, symbols, rules = repair.compress(flat)
    grammar = repair.Grammar(alphabet, rules)
    assert grammar.expand(symbols).tolist() == flat.tolist()
    assert len(symbols) <= len(flat)
    sizes = repair.lengths_of(rules, len(alphabet))
    assert all(n == len(grammar.expand(np.array([len(alphabet) + k]))) for k, n in enumerate(sizes))
    used = Counter([*symbols.tolist(), *rules.ravel().tolist()])
    assert all(used[len(alphabet) + k] > 1 or len(alphabet) + k in rules for k in range(len(rules)))
    assert not any(grammar.expand(rules[k, :1])[-1] == 2 for k in range(len(rules)))


def test_of_overlapping_pairs_the_more_frequent_is_replaced():
    flat = np.array([5, 6] * 30 + [9] + [6, 7, 8] * 12 + [9, 5, 6, 7, 8], np.uint32)  # the last 6 is in (5, 6), not in (6, 7)
    alphabet, symbols, rules = repair.compress(flat)
    grammar = repair.Grammar(alphabet, rules)
    assert [5, 6] in [grammar.expand(np.array([len(alphabet) + k])).tolist() for k in range(len(rules))]
    assert grammar.expand(symbols[-3:-2]).tolist() == [5, 6]


def test_block_random_access():
    rng = np.random.default_rng(0)
    parts = [np.append(rng.integers(2, 40, rng.integers(0, 400)), 2).astype(np.uint32) for _ in range(50)] + [np.array([2], np.uint32)] * 40
    block = repair.Block(repair.pack(np.concatenate(parts), np.array([len(x) for x in parts])))
    assert len(block.rules)
    for k in (0, 7, 31, 49, 50, 89):
        assert block.ids(k).tolist() == parts[k].tolist()
        for a, b in ((0, 1), (3, 50), (5, 5), (390, 500)):
            assert block.ids(k, a, b).tolist() == parts[k][a:b].tolist()
    with pytest.raises(ValueError):
        repair.Block(b"other file")


@pytest.mark.parametrize("top", [60_000, 70_000, 1 << 31])
def test_a_grammar_has_no_bound_on_ids_or_symbols(top):
    rng = np.random.default_rng(1)
    flat = np.tile(rng.integers(top - 30_000, top, 90_000), repair.WORTH).astype(np.uint32)
    block = repair.Block(repair.pack(np.append(flat, 2).astype(np.uint32), np.array([len(flat) + 1])))
    assert block.all_ids().tolist() == [*flat.tolist(), 2]
    assert len(block.rules) > 1 << 16 and len(block.symbols) < 100


def test_files_of_all_documents(spark):
    table = documents(spark)
    got = repair.read_documents(repair.write_blocks(table, PATH, block=2000)).collect()
    assert len({(r.shard, r.block) for r in got}) > 3
    rows = sorted(table.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want, start = Counter(), 0
    for r in rows:
        x = [*ids(r.text), 2]
        want[r.doc_id, start, len(x), crc(x)] += 1
        start += len(x)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    assert repair.read_documents(repair.write_blocks(empty(spark), PATH)).count() == 0


@given(st.lists(st.integers(1, 32), max_size=200))
@settings(max_examples=150, deadline=None)
def test_packing_is_whole_and_tight(lengths):
    sizes = np.array(lengths, np.int64)
    sequence, offset = packing.pack(sizes, 32)
    of = defaultdict(list)
    for k, s in enumerate(sequence):
        of[s].append((offset[k], sizes[k]))
    for parts in of.values():
        at = 0
        for begin, size in sorted(parts):
            assert begin == at
            at += size
        assert at <= 32
        assert sum(size > 10 for _, size in parts) <= 2
    assert sorted(of) == list(range(len(of)))
    total = sum(lengths)
    assert len(of) <= max(-(-total // 32) * 1.5 + 1, sum(x > 16 for x in lengths))


def test_packed_documents(spark):
    table = documents(spark)
    got = packing.pack_documents(table, PATH, shard=100).collect()
    want = Counter()
    for r in table.collect():
        x = [*ids(r.text), 2]
        n = -(-len(x) // 1024)
        head = len(x) - 1024 * (n - 1)
        cuts = [0, *[head + 1024 * k for k in range(n)]]
        for k in range(n):
            want[r.doc_id, k, cuts[k], cuts[k + 1] - cuts[k], crc(x[cuts[k] : cuts[k + 1]])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    of = defaultdict(list)
    for r in got:
        of[r.sequence_id].append((r.offset, r.length))
    for parts in of.values():
        at = 0
        for begin, size in sorted(parts):
            assert begin == at
            at += size
        assert at <= 1024
    assert len(of) <= sum(r.length for r in got) / 1024 * 1.05 + 3
    assert packing.pack_documents(empty(spark), PATH).count() == 0
