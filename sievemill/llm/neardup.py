"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and distributed union-find.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered; a document's set has its distinct shingles of ``width`` words, or
the whole sequence where it has fewer. Documents with equal sets are one class, found by a digest. Of the other classes:

1. ``signatures``: every element of a set has a permutation of the slots, drawn step by step; in step j it puts j + a random
   fraction into its j-th slot, and a slot keeps the least. All elements take a step together, so a document is done when
   each slot has a value, after one or two steps for long ones (early stopping).
2. ``bands``: rows of a signature make band keys. Their number follows from the similarity asked for, so that a pair at that
   similarity shares a band but for a chance of ``MISS``.
3. Verification in rounds. A round compares every member of a bucket with one pivot of it; verified links join
   components. A large group of near copies so takes a few comparisons a member, not all its pairs. What is then left, the
   pairs of a bucket that no chain of links joins yet, is compared in blocks: pairs whose share of equal slots is not too low
   for the similarity (``least_equal``) are verified there, so no row is made for a pair. Nothing is capped.
4. Components by alternating large-star and small-star steps on tables in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Slots of a signature; chance that a pair at the similarity asked for shares no band; rounds with one pivot a bucket.
SLOTS, MISS, PIVOT_ROUNDS = 252, 1e-5, 2
#: Members of a block of a bucket. A bucket with more than a ``HOT``-th of all members is hot; a join on bucket keys deals its members to ``SALTS`` tasks.
BLOCK, HOT, SALTS = 512, 1024, 32
_GOLD, _A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def rows_of(similarity: float) -> int:
    """Rows of a band: as many as keep the chance of no common band at most ``MISS``."""
    return max(r for r in range(1, SLOTS + 1) if r == 1 or (1 - similarity**r) ** (SLOTS // r) <= MISS)


def least_equal(similarity: float) -> int:
    """Equal slots that a pair at the similarity falls short of with a chance of at most ``MISS``, at the variance of plain MinHash (SuperMinHash's is lower)."""
    below, k = 0.0, 0
    while (below := below + math.comb(SLOTS, k) * similarity**k * (1 - similarity) ** (SLOTS - k)) <= MISS:
        k += 1
    return k


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = found
        return found


_WORDS = _Words()


def shingles(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts as 64-bit hashes, sorted within each text, and how many each text has."""
    common.claim("words", _WORDS.clear)
    words = [text.encode().lower().split() if text else [] for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    hashed = np.fromiter((h for part in words for h in map(_WORDS.__getitem__, part)), np.uint64, total)
    text_of = np.repeat(np.arange(len(texts)), counts)
    with np.errstate(over="ignore"):
        rolled, short = _mix(hashed), counts < width
        for k in range(1, width):  # a shingle that runs over its text's end goes below
            rolled[: total - k] = _mix(rolled[: total - k] * _C + hashed[k:]) if total > k else rolled[:0]
        ends = np.cumsum(counts)
        last = np.repeat(ends - width, counts)
        keep = np.arange(total) <= last
        for k in np.flatnonzero(short & (counts > 0)):
            part = hashed[ends[k] - counts[k] : ends[k]]
            whole = np.uint64(counts[k])
            for h in part:
                whole = _mix(np.array([whole * _C + h]))[0]
            rolled[ends[k] - counts[k]], keep[ends[k] - counts[k]] = whole, True
    rolled, text_of = rolled[keep], text_of[keep]
    order = np.lexsort((rolled, text_of))
    rolled, text_of = rolled[order], text_of[order]
    first = np.ones(len(rolled), bool)
    first[1:] = (rolled[1:] != rolled[:-1]) | (text_of[1:] != text_of[:-1])
    return rolled[first], np.bincount(text_of[first], minlength=len(texts)).astype(np.int64)


def signatures(elements: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures (len(counts), slots) of sets in a row; a set without elements has none of its slots set."""
    n = len(counts)
    best = np.full(n * slots, _NONE, np.uint64)
    owner = np.repeat(np.arange(n), counts)
    places: np.ndarray | None = None  # each element's permutation, as far as it is drawn
    with np.errstate(over="ignore"):
        for step in range(slots):
            if not len(owner):
                break
            draw = _mix(elements ^ (_C * np.uint64(step + 1)))
            at = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64) + step
            if places is None:
                slot = at
            else:
                rows = np.arange(len(owner))
                slot = places[rows, at].astype(np.int64)
                places[rows, at] = places[:, step]
            np.minimum.at(best, owner * slots + slot, (np.uint64(step) << np.uint64(32)) | (draw >> np.uint64(32)))
            open_ = (best.reshape(n, slots) == _NONE).any(1)[owner]
            if not open_.all():
                owner, elements, at = owner[open_], elements[open_], at[open_]
                if places is not None:
                    places = places[open_]
            if places is None:
                places = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(owner), 1))
                places[np.arange(len(owner)), at] = 0
    return best.reshape(n, slots)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """Band keys (n, slots // rows) as signed 64-bit integers."""
    n, slots = signature.shape
    bands = slots // rows
    part = signature[:, : bands * rows].reshape(n, bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(_mix(np.arange(bands, dtype=np.uint64)), (n, bands)).copy()
        for k in range(rows):
            key = _mix(key * _C + part[:, :, k])
    return key.view(np.int64)


def _groups(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of texts with about ``most`` elements together, one text at least."""
    begin = size = 0
    for k, n in enumerate(counts):
        size += int(n)
        if size >= most:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(counts):
        yield slice(begin, len(counts))


def sketches(documents: DataFrame, width: int, similarity: float) -> DataFrame:
    """Per document its set's size, digest, band keys (none for an empty set) and a byte of each slot."""
    rows = rows_of(similarity)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            ids, texts = frame.column(0), frame.column(1).to_pylist()
            at = 0
            for part in _groups(np.array([len(x or "") // 6 + 1 for x in texts]), 50_000):
                elements, counts = shingles(texts[part], width)
                ends = np.cumsum(counts)
                made = signatures(elements, counts)
                keys = band_keys(made, rows)
                short = [row.tobytes() for row in (made & np.uint64(0xFF)).astype(np.uint8)]
                digests = [xxhash.xxh3_128_digest(elements[e - c : e].tobytes()) if c else None for e, c in zip(ends, counts, strict=True)]
                lists = [row if c else [] for row, c in zip(keys, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(counts)), pa.array(counts), pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(short, pa.binary())], ["doc_id", "n_shingles", "digest", "bands", "slots"])
                at += len(counts)

    return documents.select("doc_id", "text").mapInArrow(common.tidied(run), "doc_id long, n_shingles long, digest binary, bands array<long>, slots binary")


def _sets(documents: DataFrame, width: int) -> DataFrame:
    """Per document its sorted set as bytes."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            ids, texts, at = frame.column(0), frame.column(1).to_pylist(), 0
            for part in _groups(np.array([len(x or "") // 6 + 1 for x in texts]), 200_000):
                elements, counts = shingles(texts[part], width)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(counts)), pa.array([elements[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary())], ["doc_id", "elements"])
                at += len(counts)

    return documents.mapInArrow(common.tidied(run), "doc_id long, elements binary")


def _alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sets."""
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    common_ = int((both[1:] == both[:-1]).sum())
    return 100 * common_ >= percent * (len(both) - common_)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            each = zip(frame.column(2).to_pylist(), frame.column(3).to_pylist(), strict=True)
            keep = [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in each]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(common.tidied(run), "a long, b long")


def _grouped(frames: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of the rows with equal first ``n_keys`` columns, which come in a row, perhaps over several frames."""
    held: pa.Table | None = None
    for frame in frames:
        table = pa.Table.from_batches([frame]) if held is None else pa.concat_tables([held, pa.Table.from_batches([frame])])
        keys = np.stack([table.column(k).to_numpy() for k in range(n_keys)], 1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield table.slice(a, b - a)
        held = table.slice(edges[-1])
    if held is not None and held.num_rows:
        yield held


def _candidates(table: pa.Table, percent: int, n_bands: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a bucket's block or two, each row and the later ones that may be alike: of another group, of a size and with a share of
    equal slots that allow it, not sharing an earlier band, and, where there are two blocks, of the other one."""
    ids, sizes, groups, blocks = (table.column(k).to_numpy() for k in ("doc_id", "n_shingles", "group", "block"))
    band = int(table.column("band")[0].as_py())
    slots = np.frombuffer(b"".join(table.column("slots").to_pylist()), np.uint8).reshape(-1, SLOTS)
    bands = np.concatenate([x.flatten().to_numpy() for x in table.column("bands").chunks]).reshape(-1, n_bands)
    apart = blocks.min() != blocks.max()
    for k in range(len(ids) - 1):
        rest = np.arange(k + 1, len(ids))
        fits = 100 * np.minimum(sizes[rest], sizes[k]) >= percent * np.maximum(sizes[rest], sizes[k])
        rest = rest[(groups[rest] != groups[k]) & fits & (ids[rest] != ids[k])]
        if apart:
            rest = rest[blocks[rest] != blocks[k]]
        if len(rest):
            good = (slots[rest] == slots[k]).sum(1) >= least
            good &= ~(bands[rest, :band] == bands[k, :band]).any(1)
            if good.any():
                yield k, rest[good]


def _links(table: pa.Table, pairs: Iterator[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Verified links among the candidates of a block; groups that a link has joined are one from then on."""
    ids, groups = table.column("doc_id").to_numpy(), table.column("group").to_numpy().tolist()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("elements").to_pylist()]
    up: dict[int, int] = {}

    def root(g: int) -> int:
        while (h := up.get(g, g)) != g:
            up[g] = g = up.get(h, h)
        return g

    out = []
    for k, others in pairs:
        for at in others.tolist():
            x, y = root(groups[k]), root(groups[at])
            if x != y and _alike(sets[k], sets[at], percent):
                up[x] = y
                out.append((int(max(ids[k], ids[at])), int(min(ids[k], ids[at]))))
    return out


def _by_key(members: DataFrame, keys: DataFrame, hot: list[int]) -> DataFrame:
    """``members`` joined with a row for each bucket key; members of hot buckets, of which there are less than ``HOT``, are dealt out, and the keys' rows copied to them."""
    if not hot:
        return members.join(keys, "key")
    is_hot = F.col("key").isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return members.withColumn("__salt", salt).join(keys.withColumn("__salt", F.explode(every)), ["key", "__salt"]).drop("__salt")


def _block_links(rows: DataFrame, sets: DataFrame, percent: int, hot: list[int]) -> DataFrame:
    """Links (a, b) that join documents of a bucket and different groups; between two groups of a block one is enough.

    ``rows``: key, band, doc_id, n_shingles, group, slots and bands, all band keys of the document. Members of a large bucket are
    dealt to blocks, and every two blocks meet once. First the signatures say which members have any candidate at all; these get their
    sets, and the block compares them itself, each pair in the first band that it shares. So what moves is a row a member, never a row a pair.
    """
    n_bands, least = SLOTS // rows_of(percent / 100), least_equal(percent / 100)
    keys = ("key", "lo", "hi")

    def some(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(frames, 3):
            found = np.zeros(table.num_rows, bool)
            for k, others in _candidates(table, percent, n_bands, least):
                found[k] = found[others] = True
            if found.any():
                yield from table.filter(pa.array(found)).to_batches()

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(frames, 3):
            links = _links(table, _candidates(table, percent, n_bands, least), percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    spark = rows.sparkSession
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    dealt = _by_key(rows, sizes, hot).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    lo, hi = F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    dealt = dealt.select("key", lo, hi, "block", "band", "doc_id", "n_shingles", "group", "slots", "bands")
    met = lambda frame: frame.repartition(common.partitions(spark), *keys).sortWithinPartitions(*keys, "doc_id")
    kind = "key long, lo int, hi int, block int, band int, doc_id long, n_shingles long, group long, slots binary, bands array<long>"
    left = common.stored(met(dealt).mapInArrow(common.tidied(some), kind), "candidates")
    return met(left.join(sets, "doc_id").select(*[c.split()[0] for c in kind.split(", ")], "elements")).mapInArrow(common.tidied(compare), "a long, b long")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Per node of ``edges`` (a, b) that has a link: node, component, the least node that it reaches.

    Large-star and small-star steps in turn until the edges are stars; each step is a minimum a node, taken before the shuffle, and a join.
    """
    edges = common.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while (now := _mark(edges)) != before:
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, edges = edges, common.stored(small, "edges")
        common.dropped(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Links join documents whose sets have 100 * intersection >= percent * union; component_id is the least doc_id that links
    reach. Null, empty and white texts have an empty set, no links, and are kept. Rows with equal doc_id are judged as
    documents of their own and answer with that id; a null doc_id gets no links and is kept. Whole texts are compared, the longest
    ones, too. An empty table gives an empty result. Other columns are not read.

    A link of two documents at exactly the similarity is missed with a chance of ``MISS`` where they share no band, and with another
    of at most ``MISS`` where only their signatures are compared; one of more similar documents is missed much more rarely.
    """
    made = common.stored(sketches(documents, width, percent / 100), "sketches")
    some = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    of_class = common.stored(some.select("doc_id", "digest").distinct().join(classes, "digest").select("doc_id", "rep"), "classes")
    reps = some.join(of_class.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
    rows = reps.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "n")
    shared = common.stored(shared, "shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r["key"] for r in shared.where(F.col("n") * HOT > F.lit(total)).select("key").collect()]  # less than HOT
    buckets = common.stored(_by_key(rows, shared.select("key"), hot).select("key", F.col("band").cast("int").alias("band"), "doc_id", "n_shingles"), "buckets")
    members = buckets.select("doc_id").distinct()
    texts = documents.select("doc_id", "text").join(members, "doc_id", "left_semi")
    sets = common.stored(_sets(texts, width), "sets")
    fits = 100 * F.least("n_shingles", "m_shingles") >= percent * F.greatest("n_shingles", "m_shingles")  # no other pair can be similar enough
    groups, done, links = None, None, None
    for turn in range(PIVOT_ROUNDS + 1):
        now = buckets.withColumn("group", F.col("doc_id")) if groups is None else buckets.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("group", F.coalesce("component", "doc_id")).drop("component")
        if turn:  # buckets of a single component have nothing left
            open_ = now.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("key")
            now = common.stored(_by_key(now, open_, hot), "open")
        if turn < PIVOT_ROUNDS:
            by = F.xxhash64("doc_id", F.lit(turn)) if not turn else F.xxhash64("doc_id", "key", F.lit(turn))
            pivot = now.groupBy("key").agg(F.min_by(F.struct("doc_id", "n_shingles", "group"), F.struct(by, "doc_id")).alias("p")).select("key", F.col("p.doc_id").alias("other"), F.col("p.n_shingles").alias("m_shingles"), F.col("p.group").alias("other_group"))
            pairs = _by_key(now, pivot, hot).where((F.col("group") != F.col("other_group")) & fits).select(F.greatest("doc_id", "other").alias("a"), F.least("doc_id", "other").alias("b")).distinct()
            if done is not None:
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            pairs = common.stored(pairs, "pairs")
            found = common.stored(_verified(pairs, sets, percent), "links")
            done = pairs if done is None else done.union(pairs)
        else:  # all that is left
            found = common.stored(_block_links(now.join(reps.select("doc_id", "slots", "bands"), "doc_id"), sets, percent, hot), "links")
        if not turn or not found.isEmpty():
            links = found if links is None else links.union(found)
            groups = components(links if groups is None else groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
    whole = of_class.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("doc_id").alias("__id"), F.coalesce("component", "rep").alias("__c")).groupBy("__id").agg(F.min("__c").alias("__c"))
    out = made.join(whole, made.doc_id == whole["__id"], "left").select("doc_id", "n_shingles", F.coalesce("__c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_superminhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents: shingles of 3 words, similarity 0.85."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), 3, 85)
