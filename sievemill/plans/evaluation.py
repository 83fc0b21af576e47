"""Paired evaluation from aligned runs to a report by height bin with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, metrics


def evaluate(students: list[DataFrame], teachers: list[DataFrame], edges: list[float], *, allow_intersection: bool = False, samples: int = 0, least: int = 2, seed: int = 0) -> DataFrame:
    """Metrics by height bin of runs that are aligned by (stem, index) and averaged over runs, and an interval of the difference of error rates that resamples images."""
    rows = align.paired_rows(align.aligned(students, teachers, ["stem", "index"], allow_intersection))
    mean = metrics.seed_average(rows.withColumnRenamed("size", "height"), "stem", "index", "height")
    out = metrics.height_bins(mean, "height", edges)
    binned = metrics.in_bins(mean, "height", edges).withColumn("difference", F.col("student_edits") - F.col("teacher_edits"))
    interval = metrics.bootstrap(binned, "bin", "stem", "difference", "label_length", samples=samples, least=least, seed=seed)
    return out.join(interval.select("bin", F.col("low").alias("cer_delta_low"), F.col("high").alias("cer_delta_high"), "status"), "bin", "left").withColumn("status", F.coalesce("status", F.lit("empty_bin")))
