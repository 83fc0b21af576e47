"""Re-Pair grammar compression of token ids, with random access.

A block holds whole documents in a row, each ended by the end id. Its symbols are first numbers in the block's own alphabet. In
every round the pairs of neighbouring symbols are counted over the whole block, and those that occur ``WORTH`` times or more
become nonterminals. Where occurrences of two pairs overlap, the more frequent pair has it. The rounds end when no pair is worth
a rule. Rules that are then used once or never are undone. No pair starts with a symbol whose expansion ends in the end id, so
every document starts at a symbol: the symbols that each document has are stored, and only its own are expanded. The lengths of
the rules' expansions are stored, too, so that a part of a document is found without expanding what is before it.

File format of a block (little-endian): ``RPR2``; unsigned 32-bit n_documents, n_rules, symbol width in bytes; the six lengths of
the zstandard frames that follow: alphabet (u32; symbol k stands for the k-th id), rules (pairs of symbols; the k-th is the symbol
after the alphabet and k rules), expansion lengths of the rules (u32), symbols, ids of each document (u32), symbols of each
document (u32). The table that holds the blocks has one row for each, with its place in the order of the ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, tokens

#: Ids in a block, and occurrences that make a rule worth its bytes.
BLOCK, WORTH = 1 << 20, 12
END = 2


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, ascending, and the number of each id among them."""
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    if int(ids.max()) >= 1 << 22:
        alphabet, symbols = np.unique(ids, return_inverse=True)
        return alphabet.astype(np.uint32), symbols.astype(np.uint32)
    present = np.zeros(int(ids.max()) + 1, bool)
    present[ids] = True
    number = np.cumsum(present, dtype=np.uint32) - np.uint32(1)
    return np.flatnonzero(present).astype(np.uint32), number[ids]


def _chosen(where: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending places of pairs, each two symbols wide, those that are replaced, and their ranks: where places overlap, the lower rank is taken, and of equal pairs in a row every second."""
    next_ = where[1:] - where[:-1] == 1
    if (alike := next_ & (rank[1:] == rank[:-1])).any():
        start = np.append(True, ~alike)
        first = np.maximum.accumulate(np.where(start, np.arange(len(where)), 0))
        keep = (np.arange(len(where)) - first) % 2 == 0
        where, rank = where[keep], rank[keep]
        next_ = where[1:] - where[:-1] == 1
    places, ranks = [], []
    while True:
        less = rank[:-1] < rank[1:]
        best = np.ones(len(where), bool)  # no neighbour is better
        best[1:] &= ~(next_ & less)
        best[:-1] &= ~(next_ & ~less)
        places.append(where[best])
        ranks.append(rank[best])
        gone = best.copy()  # with their neighbours
        gone[1:] |= next_ & best[:-1]
        gone[:-1] |= next_ & best[1:]
        if gone.all():
            return np.concatenate(places), np.concatenate(ranks)
        where, rank = where[~gone], rank[~gone]
        next_ = where[1:] - where[:-1] == 1


def _ranks(keys: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` that are among ``pairs``, and which of these each is: by a table, and by search for pairs that share a place there."""
    bits = max(18, int(len(pairs)).bit_length() + 3)
    if keys.dtype == np.uint64:
        spread = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    else:
        spread = lambda x: (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    table, number = np.zeros(1 << bits, keys.dtype), np.full(1 << bits, -1, np.int32)
    own = spread(pairs)
    table[own], number[own] = pairs, np.arange(len(pairs))
    places = spread(keys)
    found = number[places]
    same = table[places] == keys
    rest = np.flatnonzero(number[own] != np.arange(len(pairs)))
    if len(rest):
        other = np.flatnonzero(~same & (found >= 0))
        late = rest[np.argsort(pairs[rest])]
        at = np.minimum(np.searchsorted(pairs[late], keys[other]), len(late) - 1)
        hit = pairs[late][at] == keys[other]
        found[other[hit]], same[other[hit]] = late[at[hit]], True
    where = np.flatnonzero(same & (found >= 0))
    return where, found[where]


def compress(ids: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The alphabet, the symbols and the rules (n, 2). Symbols are as wide as their number asks for."""
    alphabet, symbols = _alphabet(ids)
    free, fresh, rules = len(alphabet), 0, []
    closes = alphabet == end  # whether a symbol's expansion ends in the end id
    while len(symbols) > 1:
        key, half = (np.uint64, np.uint64(32)) if free > 1 << 16 else (np.uint32, np.uint32(16))
        # after the first round only pairs with a new symbol: all others are too rare already, and replacing makes none of them
        new = symbols >= fresh
        at = np.flatnonzero(new[:-1] | new[1:]) if fresh else np.arange(len(symbols) - 1)
        keys = (symbols[at].astype(key) << half) | symbols[at + 1].astype(key)
        likely = np.sort(keys)
        last = np.flatnonzero(np.append(likely[1:] != likely[:-1], True))
        counts = np.diff(last, prepend=-1)
        often = counts >= WORTH
        pairs, counts = likely[last[often]], counts[often]
        good = ~closes[pairs >> half]
        pairs, counts = pairs[good], counts[good]
        if not len(pairs):
            break
        pairs = pairs[np.argsort(-counts, kind="stable")]
        where, rank = _ranks(keys, pairs)
        at, rank = _chosen(at[where], rank)
        held = np.bincount(rank, minlength=len(pairs)) > 0  # pairs that lost all their places get no rule
        symbols[at] = (free + np.cumsum(held) - 1)[rank]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        pairs = pairs[held]
        rules.append(np.stack([pairs >> half, pairs & key((1 << int(half)) - 1)], 1).astype(np.uint32))
        closes = np.concatenate([closes, closes[rules[-1][:, 1]]])
        fresh, free = free, free + len(pairs)
    made = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return alphabet, *_pruned(symbols, made, len(alphabet))


def _pruned(symbols: np.ndarray, rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Without the rules that are never used, or once and that among the symbols."""
    while len(rules):
        among = np.bincount(symbols, minlength=first + len(rules))[first:]
        every = among + np.bincount(rules.ravel(), minlength=first + len(rules))[first:]
        undo = (every == 0) | ((every == 1) & (among == 1))
        if not undo.any():
            break
        hit = np.flatnonzero(symbols >= first)
        hit = hit[undo[symbols[hit] - first]]
        wide = np.ones(len(symbols), np.int64)
        wide[hit] = 2
        at = (np.cumsum(wide) - wide)[hit]
        pair = rules[symbols[hit] - first]
        symbols = np.repeat(symbols, wide)
        symbols[at], symbols[at + 1] = pair[:, 0], pair[:, 1]
        number = np.concatenate([np.arange(first), first + np.cumsum(~undo) - 1]).astype(np.uint32)
        symbols, rules = number[symbols], number[rules[~undo]]
    return symbols, rules


def lengths_of(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule's nonterminal stands for; rules use earlier nonterminals only."""
    out = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    nested = rules.astype(np.int64) - first
    while len(todo):
        parts = nested[todo]
        size = np.where(parts < 0, 1, out[np.maximum(parts, 0)])
        ready = (size > 0).all(1)
        out[todo[ready]] = size[ready].sum(1)
        todo = todo[~ready]
    return out


def _copied(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` at ``starts`` in a row."""
    ends = np.cumsum(sizes)
    where = np.repeat(starts - ends + sizes, sizes)
    where += np.arange(len(where))
    return flat[where]


class Grammar:
    """The expansions of all symbols, written once."""

    def __init__(self, alphabet: np.ndarray, rules: np.ndarray, lengths: np.ndarray | None = None):
        first = len(alphabet)
        lengths = lengths_of(rules, first) if lengths is None else lengths.astype(np.int64)
        self.sizes = np.concatenate([np.ones(first, np.int64), lengths])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.zeros(int(self.sizes.sum()), np.uint32)
        self.flat[:first] = alphabet
        left, right = rules[:, 0].astype(np.int64), rules[:, 1].astype(np.int64)
        known = np.arange(first + len(rules)) < first
        todo = np.arange(len(rules))
        while len(todo):
            ready = known[left[todo]] & known[right[todo]]
            now = todo[ready]
            for part, shift in ((left[now], 0), (right[now], self.sizes[left[now]])):
                n = self.sizes[part]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                self.flat[np.repeat(self.starts[first + now] + shift, n) + step] = self.flat[np.repeat(self.starts[part], n) + step]
            known[first + now] = True
            todo = todo[~ready]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        return _copied(self.flat, self.starts[symbols], self.sizes[symbols])


def pack(ids: np.ndarray, counts: np.ndarray, end: int = END) -> bytes:
    """A block of the file format."""
    alphabet, symbols, rules = compress(ids, end)
    lengths = lengths_of(rules, len(alphabet))
    sizes = np.concatenate([np.ones(len(alphabet), np.int64), lengths])[symbols]
    own = np.diff(np.searchsorted(np.cumsum(sizes), np.cumsum(counts), side="right"), prepend=0)  # documents that have no id have no symbol
    width = "<u2" if len(alphabet) + len(rules) <= 1 << 16 else "<u4"
    press = zstandard.ZstdCompressor(level=1)
    parts = [press.compress(x.astype(kind).tobytes()) for x, kind in ((alphabet, "<u4"), (rules, width), (lengths, "<u4"), (symbols, width), (counts, "<u4"), (own, "<u4"))]
    return b"RPR2" + struct.pack("<9I", len(counts), len(rules), int(width[-1]), *map(len, parts)) + b"".join(parts)


class Block:
    """A block read back: ``ids(k)`` is document k's, or a part of them, ``all_ids()`` every document's in a row."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPR2":
            raise ValueError("not a Re-Pair block")
        _, n_rules, width, *sizes = struct.unpack("<9I", data[4:40])
        at, parts = 40, []
        for size, kind in zip(sizes, ("<u4", f"<u{width}", "<u4", f"<u{width}", "<u4", "<u4"), strict=True):
            parts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size]), kind))
            at += size
        alphabet, rules, lengths, self.symbols, counts, own = parts
        self.grammar = Grammar(alphabet, rules.reshape(n_rules, 2), lengths)
        self.rules, self.counts = rules.reshape(n_rules, 2), counts.astype(np.int64)
        self.ends = np.cumsum(own.astype(np.int64))

    def all_ids(self) -> np.ndarray:
        return self.grammar.expand(self.symbols)

    def ids(self, k: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``begin`` to ``end`` of document ``k``; only the symbols that have them are expanded."""
        own = self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]]
        end = int(self.counts[k]) if end is None else min(end, int(self.counts[k]))
        upto = np.cumsum(self.grammar.sizes[own])
        a, b = np.searchsorted(upto, begin, side="right"), np.searchsorted(upto, end, side="left") + 1
        skipped = int(upto[a - 1]) if a else 0
        return self.grammar.expand(own[a:b])[begin - skipped : max(end - skipped, 0)]


_SHARDS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_documents", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])


def write_blocks(documents: DataFrame, tokenizer: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """Encodes ``documents`` (doc_id, text) in ascending doc_id order and writes the table of blocks; returns it, read back.

    A null text counts as empty; equal doc_ids keep together, in order of their texts; a null doc_id comes first. A document
    longer than a block has one to itself. Other columns are not read. Each task streams its own range of doc_ids.
    """

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        names: list = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            every = np.concatenate(counts)
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip([shard, number, len(every), held, names, pack(np.concatenate(ids), every, end)], _SHARDS, strict=True)], schema=_SHARDS)

        coder = tokens.coder(tokenizer)
        for frame in frames:
            keys, texts = frame.column(0).to_pylist(), frame.column(1)
            for part in tokens.batches(texts):
                flat, n = coder.encode_all(texts[part], end)
                names += keys[part]
                ids.append(flat)
                counts.append(n)
                held += len(flat)
                if held >= block:
                    yield out()
                    number, held, names, ids, counts = number + 1, 0, [], [], []
        if counts:
            yield out()

    n = common.partitions(documents.sparkSession)
    rows = documents.select("doc_id", "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return common.stored(rows.mapInArrow(common.tidied(encode), "shard int, block int, n_documents long, n_ids long, doc_ids array<long>, payload binary"), "repair")


def read_documents(blocks: DataFrame) -> DataFrame:
    """Per document of a table of blocks: doc_id, start, n_tokens, ids_crc32 and n_symbols of its block; empty for an empty table."""

    def decode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for shard, block, names, payload in zip(*[frame.column(k).to_pylist() for k in range(4)], strict=True):
                found = Block(payload)
                ids = found.all_ids()
                ends = np.cumsum(found.counts)
                starts = ends - found.counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(names), pa.int32()), pa.array([block] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(starts), pa.array(found.counts), pa.array([tokens.crc(ids[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64())],
                    ["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    inner = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    places = inner.join(base, "shard").select("shard", "block", (F.col("s") + F.col("b")).alias("base"))
    read = blocks.select("shard", "block", "doc_ids", "payload").mapInArrow(common.tidied(decode), "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return read.join(places, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", F.col("shard"), F.col("block"))


def op1_repair(spark, sf_dir: str) -> DataFrame:
    """Re-Pair files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    blocks = write_blocks(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(blocks)
