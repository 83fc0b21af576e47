"""Best-fit packing with large-item matching.

Pieces above a third of the capacity go at most two into a sequence: from the largest on, each takes the largest one left
that fits beside it. Smaller pieces then go, largest first, each into the sequence with the least gap that holds it. The
gaps are kept as one bit a size, so each step is a few operations on integers.

Pieces are packed in shards of about ``SHARD`` pieces, dealt by a hash of the document, so no task holds more, and a shard
leaves at most a few sequences less full than a single one over all would. Only ids' numbers and checksums move, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY, END, SHARD = 1024, 2, 16_000


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of 1 to ``capacity``: each one's sequence, from 0 on, and its offset there."""
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    of_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for k in np.argsort(-lengths, kind="stable")[::-1]:  # the last of each list comes first in the table
        of_size[lengths[k]].append(int(k))
    large = 0  # a bit a size of which pieces are left
    third = capacity // 3
    for size in range(third + 1, capacity + 1):
        large |= (1 << size) if of_size[size] else 0
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, count = 0, 0

    def take(size: int) -> int:
        nonlocal large
        k = of_size[size].pop()
        if not of_size[size]:
            large &= ~(1 << size)
        return k

    def leave(at: int, gap: int) -> None:
        nonlocal open_
        if gap:
            gaps[gap].append(at)
            open_ |= 1 << gap

    while large:
        size = large.bit_length() - 1
        sequence[take(size)] = count
        gap = capacity - size
        if partner := large & ((1 << (gap + 1)) - 1):
            second = partner.bit_length() - 1
            k = take(second)
            sequence[k], offset[k] = count, size
            gap -= second
        leave(count, gap)
        count += 1
    for size in range(min(third, capacity), 0, -1):
        for k in reversed(of_size[size]):
            if fits := open_ >> size:
                gap = size + (fits & -fits).bit_length() - 1
                at = gaps[gap].pop()
                if not gaps[gap]:
                    open_ &= ~(1 << gap)
            else:
                at, gap, count = count, capacity, count + 1
            sequence[k], offset[k] = at, capacity - gap
            leave(at, gap - size)
    return sequence, offset


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece of each document: doc_id, copy (a number of the row), piece, start, length, ids_crc32. The first piece of a long document is the short one."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.coder(tokenizer)
        for frame in frames:
            ids, texts = frame.column(0), frame.column(2)
            for part in tokens.batches(texts):
                flat, counts = coder.encode_all(texts[part], end)
                ends = np.cumsum(counts)
                n = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = counts - (n - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                begin = (ends - counts)[row] + start
                at = pa.array(row + part.start)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), frame.column(1).take(at), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([tokens.crc(flat[a : a + m]) for a, m in zip(begin, length, strict=True)], pa.int64())],
                    ["doc_id", "copy", "piece", "start", "length", "ids_crc32"],
                )

    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("copy"), "text")
    return rows.mapInArrow(common.tidied(run), "doc_id long, copy long, piece int, start long, length long, ids_crc32 long")


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Packs all rows of ``documents`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of the end id. Repeated rows are packed as often as they come, a null doc_id is kept.
    An empty table gives an empty result. Other columns are not read.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        sequence, offset = pack(group["length"].to_numpy(), capacity)
        group = group.append_column("sequence_id", pa.array(sequence * n_shards + group["shard"].to_numpy())).append_column("offset", pa.array(offset))
        return group.select(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    made = common.stored(pieces(documents, tokenizer, capacity), "pieces")
    n_shards = max(1, -(-made.count() // shard))
    dealt = made.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(n_shards)))
    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_large_item_matching(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids."""
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
