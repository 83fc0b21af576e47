"""What several operators share: shared-folder tables, ordered prefix sums, ASCII words."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import scratch, table  # noqa: F401  the operators take table from here

#: A word: a run of anything but the six ASCII white-space characters (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


_CLAIMS: dict = {}
_PATHS: WeakKeyDictionary = WeakKeyDictionary()


def claim(name: str, clear: Callable[[], None]) -> None:
    """Makes ``name`` the one that keeps a cache in this Python worker: those of other operators, which a reused worker still holds, are cleared."""
    others = [x for x in _CLAIMS if x != name]
    for other in others:
        _CLAIMS.pop(other)()
    if others:
        tidy()
    _CLAIMS[name] = clear


def tidy() -> None:
    """Gives memory that nothing uses back to the system: a worker outlives its tasks, and its libraries keep what they have had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(of: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``of``, a function from batches to batches, that tidies up when a task ends."""

    @functools.wraps(of)
    def run(frames: Iterator) -> Iterator:
        yield from of(frames)
        tidy()

    return run


#: Rows of an Arrow batch that a task and its Python worker exchange while a table is written: rows may be long, and several copies of a batch are held at a time.
BATCH = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors. ``dropped`` deletes it."""
    spark = df.sparkSession
    path = scratch(spark, what)
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ROWS, before)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def dropped(df: DataFrame) -> None:
    """Deletes a table of ``stored`` that no result needs any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ordered(df: DataFrame, keys: list[Column], sums: dict[str, Column], what: str = "ordered") -> DataFrame:
    """Adds, in the order of ``keys`` over the whole table, ``row_no`` (rows before) and for each of ``sums`` its total over the rows before.

    Range partitions are written once, so that their numbers stay as they are; each is summed on its own, and only one
    row a partition meets in the window that carries the totals on. No task holds more than its own range, whatever the keys.
    ``keys`` have to order rows completely, but for rows that are wholly equal.
    """
    n = partitions(df.sparkSession)
    columns = df.columns
    df = df.select("*", *[x.alias(f"__s_{k}") for k, x in sums.items()], *[x.alias(f"__k{i}") for i, x in enumerate(keys)])
    order = [F.col(f"__k{i}") for i in range(len(keys))]
    dealt = stored(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), what)
    totals = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__s_{k}").alias(f"__t_{k}") for k in sums])
    ahead = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__b"), *[F.coalesce(F.sum(f"__t_{k}").over(ahead), F.lit(0)).alias(f"__b_{k}") for k in sums])
    within = W.partitionBy("__part").orderBy(*order)
    before = within.rowsBetween(W.unboundedPreceding, -1)
    local = dealt.select("__part", *columns, (F.row_number().over(within) - 1).alias("__r"), *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__l_{k}") for k in sums])
    return local.join(base, "__part").select(*columns, (F.col("__r") + F.col("__b")).alias("row_no"), *[(F.col(f"__l_{k}") + F.col(f"__b_{k}")).alias(k) for k in sums])
