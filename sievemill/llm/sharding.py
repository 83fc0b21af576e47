"""Sharding by sampled splitters, law ``bytes``. DataFrame operations and one vectorised lookup.

Records are in order of (hash of the text, doc_id, row), so equal texts lie together. A sample of that key, drawn with chances
in proportion to size, gives splitters at its quantiles; ranges between them hold about as many bytes each. Ranges that
come out overfull are subdivided by splitters drawn from them again. Exact sums then carry on from range to range,
and a record's shard is its place in all bytes. A group of equal texts that is small beside a shard stays whole; a
larger one is cut where a shard is full.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHARDS = 24
#: Sampled keys a range, ranges at most to begin with (the bound of what is sent to every task: 24 bytes each), and a group's part of a shard up to which it stays whole.
OVERSAMPLE, MOST_RANGES, WHOLE = 16, 1 << 16, 1 / 64
_KEY = ["h", "k", "r"]


def _draw(rows: DataFrame, n: int, total: int) -> np.ndarray:
    """Keys (hash, doc_id, number of the row) of a sample of about ``n`` rows, each drawn by its size; the same rows draw the same sample."""
    luck = F.pmod(F.xxhash64("h", "k", "r", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = rows.where(luck < F.col("size") * F.lit(n / max(total, 1))).select(*_KEY, luck.alias("u")).orderBy("u", *_KEY).limit(4 * n).toPandas()
    return found[_KEY].sort_values(_KEY).to_numpy(np.int64)


def _range_of(splitters: np.ndarray) -> Column:
    """The number of splitters up to the key of a row: the range that holds it."""
    h, rest = splitters[:, 0], [tuple(x) for x in splitters[:, 1:].tolist()]

    @F.pandas_udf("long")
    def find(key: pd.Series, k: pd.Series, r: pd.Series) -> pd.Series:
        left, right = np.searchsorted(h, key, "left"), np.searchsorted(h, key, "right")
        out = left.astype(np.int64)
        for at in np.flatnonzero(left < right):
            out[at] = bisect_right(rest, (k.iloc[at], r.iloc[at]), left[at], right[at])
        return pd.Series(out)

    return find(*_KEY)


def shard(records: DataFrame, key: str, text: str, shards: int = SHARDS, ranges: int | None = None, whole: float = WHOLE) -> DataFrame:
    """Per row of ``records``: the key as doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    Size is the UTF-8 bytes of the text plus 8; null counts as none. Rows with equal keys and texts are kept one by one. A null key
    comes first among its text's. A group of equal texts stays in one shard where it weighs at most ``whole`` of one, which bounds
    what it can add to a shard; a heavier one is cut where a shard is full. A text longer than a shard has one to itself.
    Fewer records than shards leave shards empty. Ties are in order of the rows as written. An empty table gives an empty result. Other columns are not read.
    """
    spark = records.sparkSession
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = records.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("h"))
    rows = rows.withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("r", F.monotonically_increasing_id())
    rows = common.stored(rows, "records")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MOST_RANGES, ranges or max(4 * common.partitions(spark), shards * 4, -(-n // 200_000)))
    drawn = _draw(rows, OVERSAMPLE * ranges, total)
    splitters = drawn[np.linspace(0, len(drawn), ranges, endpoint=False).astype(int)[1:]] if len(drawn) else np.zeros((0, 3), np.int64)
    dealt = rows.withColumn("range", _range_of(splitters))
    while True:  # overfull ranges are subdivided; one that holds a single record can't be
        weights = dealt.groupBy("range").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        over = [r["range"] for r in weights.where((F.col("s") > F.lit(3 * total / ranges)) & (F.col("n") > 1)).collect()]  # a few of a bounded number of ranges
        if not over:
            break
        more = _draw(dealt.where(F.col("range").isin(over)), OVERSAMPLE * ranges, total)
        grown = np.unique(np.concatenate([splitters, more[:: max(1, OVERSAMPLE // 2)]]), axis=0)
        if len(grown) == len(splitters):  # a single heavy record and light ones beside it
            break
        splitters = grown
        dealt = rows.withColumn("range", _range_of(splitters))
    order = W.partitionBy("range").orderBy(*_KEY)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    local = common.stored(dealt.select("*", (F.row_number().over(order) - 1).alias("__r"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__s")), "ranges")
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    base = local.groupBy("range").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("__bs"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__bn"))
    placed = local.join(F.broadcast(base), "range").select("doc_id", "size", "text_crc32", "h", (F.col("__bs") + F.col("__s")).alias("__at"), (F.col("__bn") + F.col("__r")).alias("__row"))
    per = max(total / shards, 1.0)
    groups = common.stored(placed.groupBy("h").agg(F.min("__at").alias("__g"), F.sum("size").alias("__gs")), "groups")
    # of the groups heavier than a part of a shard there are few, so they are known everywhere and don't meet in a join
    heavy = groups.where(F.col("__gs") > F.lit(whole * per)).select("h")
    light = placed.join(F.broadcast(heavy), "h", "left_anti").join(groups, "h").withColumn("__middle", F.col("__g") + F.col("__gs") / 2)
    cut = placed.join(F.broadcast(heavy), "h", "left_semi").withColumn("__middle", F.col("__at") + F.col("size") / 2)
    columns = ["doc_id", "size", "text_crc32", "__row", F.least(F.lit(shards - 1), F.floor(F.col("__middle") / F.lit(per))).cast("int").alias("shard")]
    dealt = common.stored(light.select(*columns).union(cut.select(*columns)), "dealt")
    first = dealt.groupBy("shard").agg(F.min("__row").alias("__first"))
    return dealt.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__row") - F.col("__first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))  # a row a shard


def op10_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 of near equal bytes."""
    return shard(common.table(spark, sf_dir, "documents"), "doc_id", "text")
