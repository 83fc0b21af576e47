"""Mixing sources to target weights by systematic sampling. DataFrame operations only.

Targets: the sources share ``share`` of all sizes by weight; none gets more than ``most`` times its size, and what is over is
shared again by weight. That is the level l at which the sum of min(most * size, l * weight) is the total: sources in order
of size over weight reach their bound one after another, so running sums find l without a loop.

Within a source each document expects target / size copies. Documents are in order of size, the prefix sums of these
copies get one random offset a source, and a document comes once for each integer boundary that its step crosses. Because
the sums of copies are never off by more than one and sizes fall along the order, the words taken are within one
document's size of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in turn (fixed values), the share of all sizes, and the bound in a source's size.
WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, 17


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source (source, source_size): target. One row a source; null comes last in the order of weights."""
    numbered = sizes.withColumn("__k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighted = numbered.withColumn("__w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__k") % len(weights) + 1).cast("int")))
    weighted = weighted.withColumn("__bound", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy(F.col("__bound") / F.col("__w"), "__k")
    run = weighted.select("*", F.sum("__bound").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("__full"), F.sum("__w").over(order.rowsBetween(0, W.unboundedFollowing)).alias("__left"), F.sum("source_size").over(W.partitionBy()).alias("__all"))
    level = (F.lit(float(share)) * F.col("__all") - F.coalesce("__full", F.lit(0.0))) / F.col("__left")
    # the level that holds is the first one under its own source's bound; all sources before that one are at theirs
    held = run.withColumn("__l", level).withColumn("__hold", F.min(F.when(F.col("__l") * F.col("__w") <= F.col("__bound"), F.struct(F.col("__bound") / F.col("__w"), F.col("__k"), F.col("__l")))).over(W.partitionBy()))
    return held.select("source", "source_size", F.when(F.col("__hold").isNull(), F.col("__bound")).otherwise(F.least(F.col("__bound"), F.col("__hold")["__l"] * F.col("__w"))).alias("target"))


def mix(documents: DataFrame, size: str, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``documents`` (with source, doc_id and the long column ``size``) and source_size, target and copies of each row.

    Null sources are a source of their own. Documents of equal size are in order of doc_id, then of the hash of all columns; rows
    that are wholly equal may change places, which gives the same table. A source without words has target 0 and no copies.
    The same input gives the same copies, however it is dealt out. Columns of ``documents`` that are named like the added ones give way to them.
    """
    names = [c for c in documents.columns if c not in ("source_size", "target", "copies")]
    rows = documents.select("source", "doc_id", F.col(size).alias("size"), F.struct(*[F.col(c) for c in names]).alias("__row"))  # other columns can't clash
    aim = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumnRenamed("source", "__source")
    placed = _within(rows, [-F.col("size"), F.col("doc_id"), F.xxhash64("__row")])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = F.coalesce(F.concat(F.lit(f"{seed}:"), F.col("source")), F.lit(str(seed)))
    offset = F.conv(F.substring(F.sha2(named, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    joined = placed.join(aim, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__rate", rate).withColumn("__offset", offset)
    copies = F.floor((F.col("__rank") + 1) * F.col("__rate") + F.col("__offset")) - F.floor(F.col("__rank") * F.col("__rate") + F.col("__offset"))
    return joined.select("__row.*", "source_size", "target", copies.alias("copies"))


def _within(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Adds ``__rank``, the rows of the same source before a row in the order of ``keys``."""
    source = F.struct(F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("name"))
    rows = common.ordered(rows, [source, *keys], {}, "mixing")
    first = rows.groupBy("source").agg(F.min("row_no").alias("__first")).withColumnRenamed("source", "__of")
    return rows.join(first, F.col("source").eqNullSafe(F.col("__of"))).withColumn("__rank", F.col("row_no") - F.col("__first")).drop("__of", "__first", "row_no")


def op8_systematic(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "source", common.n_words(F.col("text")).alias("size"))
    documents = common.stored(documents, "sizes")  # the mix reads the sizes several times, the texts once
    return mix(documents, "size").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies"))
