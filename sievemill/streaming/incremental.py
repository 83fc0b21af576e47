"""Incremental curation: files that arrive are keyed, deduplicated against what is committed, and appended once.

Batches are idempotent: each has a folder by its number, and a batch that is run again finds what it wrote. Within a batch
the first record in manifest order wins; across batches, what is committed wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import curation


def commit_batch(batch: DataFrame, number: int, state: str, schema: str) -> None:
    """Appends the batch's records to the state table (digest, key, id, source, state, duplicate_of, batch): complete ones, duplicates and errors.

    A record without id, source or content is an error. A digest that a complete row has makes a duplicate of that row; a key that
    another batch has committed is one that was there before, and the run stops (C1).
    """
    spark = batch.sparkSession
    known = spark.read.schema(schema).parquet(state).where(F.col("batch") != number) if _exists(spark, state) else spark.createDataFrame([], schema)
    lacking = F.coalesce(*[F.when(F.col(c).isNull(), f"missing_{c}") for c in ("id", "source", "content")])
    rows = curation.deduplicated(curation.identified(curation.unique_ids(batch)).withColumn("error", lacking))
    first = known.where("state = 'complete'").select(F.col("digest").alias("__d"), F.col("key").alias("__first"))
    rows = rows.join(first, (F.col("digest") == F.col("__d")) & (F.col("state") != "error"), "left")
    earlier = F.col("__first").isNotNull()
    again = known.select(F.col("key").alias("__k")).distinct()
    rows = rows.join(again, F.col("key") == F.col("__k"), "left")
    fault = F.raise_error(F.concat(F.lit("committed before: "), F.to_json(F.struct("source", "id")))).cast("boolean")
    rows = rows.where(F.when(F.col("__k").isNotNull() & (F.col("state") != "error"), fault).otherwise(F.lit(True)))
    out = rows.select(
        "digest", "key", "id", "source",
        F.when(earlier, "duplicate").otherwise(F.col("state")).alias("state"),
        F.when(earlier, F.col("__first")).otherwise(F.col("duplicate_of")).alias("duplicate_of"),
        F.lit(number).cast("long").alias("batch"),
    )
    out.write.mode("overwrite").parquet(f"{state.rstrip('/')}/batch={number}")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


STATE = "digest string, key string, id string, source string, state string, duplicate_of string, batch long"


def curate_stream(spark: SparkSession, incoming: str, state: str, checkpoint: str) -> StreamingQuery:
    """Runs over all manifest files that are there and not yet done, then ends (availableNow). Records: id, source, content, line_no."""
    rows = spark.readStream.schema("id string, source string, content string, line_no long").json(incoming)
    return rows.writeStream.foreachBatch(lambda batch, number: commit_batch(batch, number, state, STATE)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metric_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: counts and sums by event time window and type, late rows dropped by the watermark. ``events``: ts, event_type, value."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
