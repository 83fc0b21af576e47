"""Sample-level control flow: unique ids, first-wins duplicates, error rows, resume."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def require_empty(rows: DataFrame, what: str, show: int = 5) -> None:
    """Fails with a few of ``rows`` if there are any. A look-ahead with a limit, never a full count."""
    found = rows.limit(show).collect()
    if found:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict(recursive=True)) for r in found))


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, or an error if a key comes twice."""
    require_empty(rows.groupBy(*keys).count().where("count > 1").select(*keys), f"duplicate {', '.join(keys)}")
    return rows


def guarded(rows: DataFrame, column: str, of: Callable, kind: str, value: str = "value") -> DataFrame:
    """Adds ``value`` (of the type ``kind``), what ``of`` makes of a column's value, and ``error``: an exception is an error of its row, not of the run (C4).

    Null values are given to ``of``, too. Rows come in Arrow batches; ``of`` is called for each value.
    """

    @F.pandas_udf(f"struct<value:{kind},error:string>")
    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                out.append((of(v), None))
            except Exception as e:  # noqa: BLE001  whatever it is, it belongs to the row
                out.append((None, f"{type(e).__name__}: {e}"))
        frame = pd.DataFrame({"value": pd.Series([v for v, _ in out], dtype=object), "error": [e for _, e in out]})
        return frame

    return rows.withColumn("__g", run(column)).select("*", F.col("__g.value").alias(value), F.col("__g.error").alias("error")).drop("__g")


def first_wins(rows: DataFrame, digest: str, order: str, key: str, able: Column | None = None) -> DataFrame:
    """Adds ``duplicate_of``: the key of the first row in ``order`` with the same digest among the able ones, null for that row itself.

    The first one is a minimum by digest, taken before the shuffle, so a digest that many rows share is no burden; rows that aren't
    able (errors, say) neither are duplicates nor have any.
    """
    able = F.lit(True) if able is None else able
    marked = rows.withColumn("__able", F.coalesce(able, F.lit(False)) & F.col(digest).isNotNull())
    first = marked.where("__able").groupBy(F.col(digest).alias("__d")).agg(F.min_by(key, F.struct(order, key)).alias("__first"))
    joined = marked.join(first, F.col("__able") & (F.col(digest) == F.col("__d")), "left")
    return joined.withColumn("duplicate_of", F.when(F.col("__first") != F.col(key), F.col("__first"))).drop("__able", "__d", "__first")


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key: an upsert of a union. Of equally new ones the least by a hash of all columns, so the choice doesn't go by partitions."""
    order = W.partitionBy(key).orderBy(F.desc(version), F.xxhash64(*rows.columns))
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def upsert(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``state`` with the rows of ``new`` in place of those with their keys (K5)."""
    return state.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def resume(records: DataFrame, state: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """``records`` with ``action``: skip what is complete and intact, redo errors and lost outputs, new ones; a finished row whose fingerprint changed is "changed", on which a run has to stop.

    ``state`` has key, fingerprint, state and intact.
    """
    known = state.select(F.col(key).alias("__k"), F.col(fingerprint).alias("__f"), F.col("state").alias("__s"), F.col("intact").alias("__i"))
    action = F.when(F.col("__k").isNull(), "new").when(F.col("__s") == "error", "retry").when(F.col("__f") != F.col(fingerprint), "changed").when(~F.coalesce("__i", F.lit(False)), "redo").otherwise("skip")
    return records.join(known, F.col(key) == F.col("__k"), "left").withColumn("action", action).drop("__k", "__f", "__s", "__i")


def size_error(width: Column, height: Column, out_width: Column, out_height: Column, slack: float = 1.01) -> Column:
    """Why a restored image doesn't fit its original, or null: smaller, or of another shape by more than ``slack`` pixels."""
    expected = out_width * height / width
    return F.when((out_width < width) | (out_height < height), "smaller_than_input").when(F.abs(expected - out_height) > slack, "aspect_ratio_changed")


def exit_code(statuses: DataFrame) -> int:
    """2 where any row is an error, else 0."""
    return 2 if statuses.where("status = 'error'").limit(1).count() else 0


def resolved(path: Column, folder: str) -> Column:
    """Absolute paths as they are, others from the manifest's folder."""
    return F.when(F.startswith(path, F.lit("/")) | path.rlike(r"^[a-z0-9]+://"), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))


def all_done(inputs: DataFrame, outputs: DataFrame, stem: str) -> bool:
    """Whether there are inputs and each has an output."""
    return inputs.limit(1).count() > 0 and inputs.join(outputs, stem, "left_anti").limit(1).count() == 0


def partition_errors(blocks: DataFrame, width: int) -> DataFrame:
    """Blocks whose lists of indices aren't unique, within range and apart from each other (X20). ``blocks``: block, part, index."""
    return blocks.groupBy("block").agg(F.count("index").alias("n"), F.count_distinct("index").alias("d"), F.min("index").alias("lo"), F.max("index").alias("hi")).where((F.col("n") != F.col("d")) | (F.col("lo") < 0) | (F.col("hi") >= width))
