"""Writers: status folders, pairs, lists, state, reports, metric logs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder of each status (fixed values).
FOLDERS = {"accepted": "accepted", "review": "review", "rejected": "rejected", "error": "errors"}


def by_status(rows: DataFrame, path: str, key: str) -> None:
    """JSON lines in a folder for each status, sorted by key within each file (K1, T1). The committer makes it all or nothing."""
    named = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    out = rows.withColumn("folder", named[F.col("status")])
    out.repartitionByRange("folder", key).sortWithinPartitions("folder", key).write.mode("errorifexists").partitionBy("folder").json(path)


def pairs(rows: DataFrame) -> DataFrame:
    """One row for each variant of an accepted crop, with its place."""
    return rows.where("status = 'accepted'").select("split", "key", "hr_path", F.posexplode("variants").alias("variant_no", "variant")).select("split", "key", "variant_no", "hr_path", "variant.*")


def write_pairs(rows: DataFrame, path: str) -> None:
    pairs(rows).write.mode("errorifexists").partitionBy("split").json(path)


def path_list(rows: DataFrame, column: str, path: str) -> None:
    """One path a line (K3)."""
    rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).write.mode("errorifexists").text(path)


def report_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """A small report as one CSV file with these columns; others are left out (K7, K6: it never replaces one)."""
    rows.select(*columns).coalesce(1).write.mode("errorifexists").csv(path, header=True)


def detail_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Appends rows of step and numbers; texts are left out."""
    numeric = [c for c, kind in rows.dtypes if kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal")]
    rows.select(*numeric).write.mode("append").json(path)


def replace_table(rows: DataFrame, path: str, version: int) -> str:
    """Writes a new version beside the old ones and returns its folder; readers take the greatest one that has _SUCCESS."""
    target = f"{path.rstrip('/')}/version={version:08d}"
    rows.write.mode("errorifexists").parquet(target)
    return target


def packed_shards(items: DataFrame, size: str, order: str, limit: int) -> DataFrame:
    """Adds ``shard``: items in order fill shards below ``limit``; one larger than that has a shard to itself.

    What a shard holds depends on all before, so a list is filled in one task, which holds its keys and sizes and goes over them
    once; lists (``list``) are filled side by side.
    """
    rows = items.select("list", order, F.col(size).cast("long").alias(size))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        shards, shard, used = [], 0, 0
        for n in group[size].to_pylist():
            if used and used + n > limit:
                shard, used = shard + 1, 0
            used += n
            shards.append(shard)
        return group.append_column("shard", pa.array(shards, pa.int32()))

    return rows.groupBy("list").applyInArrow(fill, f"list {kinds['list']}, `{order}` {kinds[order]}, `{size}` bigint, shard int")


def newest_valid(checkpoints: DataFrame) -> DataFrame:
    """The checkpoint of the greatest step that is complete (W6, X15). ``checkpoints``: path, complete; steps are the last number of a path."""
    step = F.regexp_extract("path", r"(\d+)\D*$", 1).cast("long")
    return checkpoints.withColumn("step", step).where("complete").orderBy(F.desc("step")).limit(1)
