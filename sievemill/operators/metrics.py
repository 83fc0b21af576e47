"""Text metrics, size buckets, paired bins and clustered bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import edit_distance
from ..session import written


def text_measures(text: Column, label: Column) -> dict[str, Column]:
    """Per pair: exact, edits, characters of the label, and the distance over the longer one (0 for two empty ones)."""
    edits = edit_distance(text, label)
    a, b = F.length(F.coalesce(text, F.lit(""))), F.length(F.coalesce(label, F.lit("")))
    return {"exact": (edits == 0).cast("int"), "edits": edits, "characters": b, "distance": F.coalesce(F.try_divide(edits, F.greatest(a, b)), F.lit(0.0))}


def scores() -> list[Column]:
    """OCR accuracy, the pooled character error rate (a ratio of sums), and 1-NED (a mean of ratios) of rows with the measures."""
    return [F.count(F.lit(1)).alias("n"), F.avg("exact").alias("accuracy"), F.try_divide(F.sum("edits"), F.sum("characters")).alias("cer"), (1 - F.avg("distance")).alias("one_minus_ned")]


def text_scores(rows: DataFrame, text: str, label: str, *by: str) -> DataFrame:
    """The scores of all rows or by group."""
    measured = rows.select(*by, *[c.alias(k) for k, c in text_measures(F.col(text), F.col(label)).items()])
    return measured.groupBy(*by).agg(*scores())


def size_bucket(value: Column, edges: list[float]) -> Column:
    """"lo-hi" with the upper bound open; below the first edge from 0, above the last without end."""
    bounds = [0, *edges]
    out = F.when(value < bounds[0], None)
    for lo, hi in zip(bounds, [*edges, None], strict=True):
        out = out.when((value >= lo) & (value < hi), f"{lo:g}-{hi:g}") if hi is not None else out.when(value >= lo, f"{lo:g}+")
    return out


def bucket_scores(rows: DataFrame, text: str, label: str, size: str, edges: list[float]) -> DataFrame:
    """Scores by size bucket; buckets without rows don't appear (A10)."""
    return text_scores(rows.withColumn("bucket", size_bucket(F.col(size), edges)), text, label, "bucket")


#: The sums that all paired metrics follow from.
PAIRED = ("instances", "characters", "teacher_edits", "student_edits", "teacher_correct", "student_correct", "joint_correct", "teacher_distance", "student_distance", "student_present", "teacher_present")


def paired_totals(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of paired rows (label_length, teacher_edits, student_edits, teacher_correct, student_correct, joint_correct, teacher_distance, student_distance) by group."""
    total = lambda c: F.sum(F.col(c).cast("double"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("instances"), F.sum("label_length").alias("characters"), *[total(c).alias(c) for c in PAIRED[2:7]], total("teacher_distance").alias("teacher_distance"), total("student_distance").alias("student_distance"),
        F.count("student_distance").alias("student_present"), F.count("teacher_distance").alias("teacher_present"),
    )


def paired_metrics(totals: DataFrame) -> DataFrame:
    """The ten metrics of totals; null where a denominator is 0, and 1-NED where a prediction is missing."""
    n, c = F.col("instances"), F.col("characters")
    ratio = lambda a, b: F.try_divide(a, b)
    ned = lambda who: F.when(F.col(f"{who}_present") == n, 1 - ratio(F.col(f"{who}_distance"), n))
    teacher, student = ratio(F.col("teacher_edits"), c), ratio(F.col("student_edits"), c)
    right, learned = ratio(F.col("teacher_correct"), n), ratio(F.col("student_correct"), n)
    keep = [x for x in totals.columns if x not in PAIRED]
    return totals.select(
        *keep, n.alias("instances"), teacher.alias("teacher_cer"), student.alias("student_cer"), (student - teacher).alias("cer_delta"), right.alias("teacher_accuracy"), learned.alias("student_accuracy"),
        (learned - right).alias("accuracy_delta"), ned("teacher").alias("teacher_one_minus_ned"), ned("student").alias("student_one_minus_ned"), (ned("student") - ned("teacher")).alias("one_minus_ned_delta"), ratio(F.col("joint_correct"), F.col("teacher_correct")).alias("retention"),
    )


def seed_average(rows: DataFrame, *key: str) -> DataFrame:
    """Means over runs of edits, correctness, joint correctness and distance; a distance only where all runs have it."""
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)).alias(c)
    return rows.groupBy(*key).agg(F.max("label_length").alias("label_length"), *[F.avg(F.col(c).cast("double")).alias(c) for c in PAIRED[2:7]], whole("teacher_distance"), whole("student_distance"))


def bin_table(edges: list[float]) -> list[tuple[str, float, float]]:
    """Bins between the edges, and two that overlap them: all, and what is below 64."""
    bounds = [0.0, *edges, float("inf")]
    return [(f"{lo:g}-{hi:g}" if hi < float("inf") else f"{lo:g}+", lo, hi) for lo, hi in zip(bounds, bounds[1:], strict=False)] + [("all", 0.0, float("inf")), ("<64", 0.0, 64.0)]


def in_bins(rows: DataFrame, height: str, edges: list[float]) -> DataFrame:
    """Rows once for each bin that holds them, by an array in the row: no join."""
    hits = F.array_compact(F.array(*[F.when((F.col(height) >= lo) & (F.col(height) < hi), name) for name, lo, hi in bin_table(edges)]))
    return rows.withColumn("bin", F.explode(hits))


def height_bins(rows: DataFrame, height: str, edges: list[float]) -> DataFrame:
    """Paired metrics by height bin; bins without rows are kept, with nulls."""
    bins = rows.sparkSession.createDataFrame([(name,) for name, _, _ in bin_table(edges)], "bin string")
    totals = paired_totals(in_bins(rows, height, edges), "bin")
    return paired_metrics(bins.join(totals, "bin", "left").fillna(0, ["instances", "characters", "student_present", "teacher_present"]))


def percentiles(rows: DataFrame, value: str, at: list[float], *by: str) -> DataFrame:
    """Linear between the neighbours of position (n - 1) q (A16): by, percentiles. Null values are passed over; a group without any has none.

    Exact, and no group has to fit into a task: equal values are counted, the counts are dealt out in their order and written once,
    and only one row a group and part carries the positions on. Of the rest the two values next to each position are read.
    """
    v = F.col(value).cast("double")
    counts = rows.where(v.isNotNull()).groupBy(*by, v.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    dealt = written(counts.repartitionByRange(*[F.col(c) for c in by], F.col("__v")).withColumn("__part", F.spark_partition_id()), "percentiles")
    parts = dealt.groupBy(*by, "__part").agg(F.sum("__n").alias("__m"))
    ahead = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = parts.select(*by, "__part", F.coalesce(F.sum("__m").over(ahead), F.lit(0)).alias("__b"), F.sum("__m").over(W.partitionBy(*by)).alias("__all"))
    base = base.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__in"), "__b", "__all")
    same = F.col("__part") == F.col("__in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    before = W.partitionBy(*by, "__part").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("__l", F.coalesce(F.sum("__n").over(before), F.lit(0))).join(base, same)
    start = F.col("__b") + F.col("__l")
    position = lambda q: (F.col("__all") - 1) * F.lit(float(q))
    value_at = lambda place: F.max(F.when((start <= place) & (place < start + F.col("__n")), F.col("__v")))
    found = placed.groupBy(*by).agg(
        F.max("__all").alias("__all"),
        *[value_at(F.floor(position(q))).alias(f"__lo{k}") for k, q in enumerate(at)],
        *[value_at(F.ceil(position(q))).alias(f"__hi{k}") for k, q in enumerate(at)],
    )
    between = [F.col(f"__lo{k}") + (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * (position(q) - F.floor(position(q))) for k, q in enumerate(at)]
    return found.select(*by, F.array(*between).alias("percentiles"))


#: The probabilities of a Poisson count of mean 1 up to 0, 1, 2 and so on.
_POISSON = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(16)])


def _times(hashes: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """How often each cluster counts in each replicate (clusters, samples): from a hash of (seed, cluster, replicate) alone."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(31))) + np.arange(1, samples + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) * 2.0**-53, side="right")


def replicates(rows: DataFrame, group: str, cluster: str, totals: list[str], samples: int, seed: int) -> DataFrame:
    """Per group and replicate the sums of ``totals`` over clusters that are resampled with replacement: group, replicate, totals.

    Clusters are summed before anything moves. A replicate gives each cluster a Poisson count, which many clusters make the same as
    drawing with replacement. A task adds up its clusters for all replicates at once, so what moves then is a row for each
    group, replicate and task, and no group has to fit into one.
    """
    per = rows.groupBy(group, cluster).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in totals])
    hashed = per.select(group, F.xxhash64(cluster).alias("__h"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in totals])
    kind = hashed.schema[group].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for frame in frames:
            values = np.stack([frame.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(totals))])
            hashes, codes = frame.column(1).to_numpy().view(np.uint64), frame.column(0).dictionary_encode()
            if isinstance(codes, pa.ChunkedArray):
                codes = codes.combine_chunks()
            index, names = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False), [*codes.dictionary.to_pylist(), None]
            for code in np.unique(index):
                some = np.flatnonzero(index == code)
                total = held.setdefault(names[code], np.zeros((len(totals), samples)))
                for k in range(0, len(some), 512):
                    part = some[k : k + 512]
                    total += values[:, part] @ _times(hashes[part], samples, seed)
        for name, total in held.items():
            columns = [pa.array([name] * samples, frame.schema.field(0).type), pa.array(np.arange(samples, dtype=np.int32)), *map(pa.array, total)]
            yield pa.RecordBatch.from_arrays(columns, [group, "replicate", *totals])

    each = hashed.mapInArrow(run, f"`{group}` {kind}, replicate int, " + ", ".join(f"`{c}` double" for c in totals))
    return each.groupBy(group, "replicate").agg(*[F.sum(c).alias(c) for c in totals])


def _interval_status(samples: int, least: int) -> Column:
    few = F.concat(F.lit("insufficient_images:"), F.col("clusters"), F.lit(f"<{least}"))
    return F.when(F.lit(samples <= 0), "disabled").when(F.col("clusters") < least, few).otherwise("paired_image_percentile")


def bootstrap(
    rows: DataFrame, group: str, cluster: str, numerator: str, denominator: str, *, samples: int = 1000, least: int = 2, level: float = 0.95, seed: int = 0
) -> DataFrame:
    """Percentile interval of a ratio of sums, resampling whole clusters (A15): group, clusters, estimate, low, high, valid_samples, status.

    Replicates without a denominator don't count. See ``replicates``.
    """
    x, y = F.col(numerator).cast("double"), F.col(denominator).cast("double")
    whole = rows.groupBy(group).agg(F.count_distinct(cluster).alias("clusters"), F.try_divide(F.sum(x), F.sum(y)).alias("estimate"))
    enough = whole.where((F.col("clusters") >= least) & F.lit(samples > 0)).select(F.col(group).alias("__g"))
    able = rows.select(group, cluster, x.alias("__x"), y.alias("__y")).join(enough, F.col(group).eqNullSafe(F.col("__g")), "left_semi")
    drawn = replicates(able, group, cluster, ["__x", "__y"], max(samples, 1), seed).select(F.col(group).alias("__g"), F.try_divide("__x", "__y").alias("r"))
    tail = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    interval = drawn.groupBy("__g").agg(F.percentile("r", tail).alias("p"), F.count("r").alias("v"))  # as many values as samples
    out = whole.join(interval, F.col(group).eqNullSafe(F.col("__g")), "left")
    bounds = [F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), F.coalesce("v", F.lit(0)).alias("valid_samples")]
    return out.select(group, "clusters", "estimate", *bounds, _interval_status(samples, least).alias("status"))


#: The ten paired metrics.
METRICS = (
    "teacher_cer", "student_cer", "cer_delta", "teacher_accuracy", "student_accuracy", "accuracy_delta",
    "teacher_one_minus_ned", "student_one_minus_ned", "one_minus_ned_delta", "retention",
)


def bootstrap_metrics(rows: DataFrame, group: str, cluster: str, *, samples: int = 1000, least: int = 2, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Intervals of all ten paired metrics at once (A15): group, clusters, status, and a row a metric: metric, estimate, low, high, valid_samples.

    A replicate counts for a metric where both it and the estimate are defined.
    """
    one = rows.select(
        group, cluster, F.lit(1.0).alias("instances"), F.col("label_length").alias("characters"), *PAIRED[2:9],
        *[F.col(f"{who}_distance").isNotNull().cast("double").alias(f"{who}_present") for who in ("student", "teacher")],
    )
    long = lambda frame: frame.select(group, *[c for c in frame.columns if c in ("replicate", "clusters")], F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
    sums = [F.sum(F.col(c).cast("double")).alias(c) for c in PAIRED]
    whole = paired_metrics(one.groupBy(group).agg(F.count_distinct(cluster).alias("clusters"), *sums))
    estimates = long(whole).withColumnRenamed("value", "estimate")
    enough = whole.where((F.col("clusters") >= least) & F.lit(samples > 0)).select(F.col(group).alias("__g"))
    able = one.join(enough, F.col(group).eqNullSafe(F.col("__g")), "left_semi")
    drawn = long(paired_metrics(replicates(able, group, cluster, list(PAIRED), max(samples, 1), seed)))
    tail = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    interval = drawn.groupBy(F.col(group).alias("__g"), F.col("metric").alias("__m")).agg(F.percentile("value", tail).alias("p"), F.count("value").alias("v"))
    out = estimates.join(interval, F.col(group).eqNullSafe(F.col("__g")) & (F.col("metric") == F.col("__m")), "left")
    defined = F.col("estimate").isNotNull()
    return out.select(
        group, "clusters", "metric", "estimate", F.when(defined, F.col("p")[0]).alias("low"), F.when(defined, F.col("p")[1]).alias("high"),
        F.when(defined, F.coalesce("v", F.lit(0))).otherwise(0).alias("valid_samples"), _interval_status(samples, least).alias("status"),
    )
