"""Summaries of a run: statuses, jobs, reasons, times, histograms, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_counts(rows: DataFrame) -> DataFrame:
    """Rows by source and status, by status, and in all: GROUPING SETS in one pass; ``level`` says which (A1)."""
    out = rows.groupingSets([["source", "status"], ["status"], []], "source", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__g"))
    return out.withColumn("level", F.when(F.col("__g") == 0, "source_status").when(F.col("__g") == 2, "status").otherwise("total")).drop("__g")


def job_states(jobs: DataFrame) -> DataFrame:
    """Jobs by source and state, where the source is that of a job's first record; jobs without records are passed over (A2). ``jobs``: key, state, records."""
    return jobs.where(F.size("records") > 0).groupBy(F.col("records")[0]["source"].alias("source"), "state").agg(F.count(F.lit(1)).alias("n"))


def reason_counts(rows: DataFrame) -> DataFrame:
    """How often each reason is given, by source (A3)."""
    return rows.select("source", F.explode("reasons").alias("reason")).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


def timing(rows: DataFrame, seconds: Column, *by: str) -> DataFrame:
    """Count, sum and mean of the seconds that are known; the mean of none is null (A4)."""
    return rows.groupBy(*by).agg(F.count(seconds).alias("n"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("total"), F.avg(seconds).alias("mean"))


def histogram(rows: DataFrame, value: Column, bins: int = 20) -> DataFrame:
    """Counts over equal bins of [0, 1], 1 in the last (A5)."""
    return rows.select(F.least(F.lit(bins - 1), F.floor(value * bins)).cast("int").alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def histogram_totals(rows: DataFrame, value: Column) -> DataFrame:
    """Count, sum and mean of the values that a histogram shows (A5); the sum of none is 0, the mean null."""
    return rows.agg(F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.avg(value).alias("mean"))


def metric_means(rows: DataFrame, names: list[str], *by: str) -> DataFrame:
    """Means over images of full-reference metrics, those that are known, and the number of images."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("images"), *[F.avg(n).alias(n) for n in names])


def joined_words(rows: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """Words of a line in their order, its box and its least confidence (A6). ``rows``: keys, order, text, bbox, confidence. A line's words are few."""
    words = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda w: w[text])
    edge = lambda f, k: f(F.col("bbox")[k])
    return rows.groupBy(*keys).agg(F.array_join(words, " ").alias("text"), F.array(edge(F.min, 0), edge(F.min, 1), edge(F.max, 2), edge(F.max, 3)).alias("bbox"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_words"))


def region_text(words: Column) -> Column:
    """struct(text, confidence) of the words read in a region; no word has confidence 0."""
    return F.struct(F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), F.coalesce(F.array_min(F.transform(words, lambda w: w["confidence"])), F.lit(0.0)).alias("confidence"))


def transcript_diagnostics(rows: DataFrame, *stages: str) -> DataFrame:
    """By source and stage sums of errors, reference characters, exact ones and transcripts; the error rate is null without characters.

    ``rows``: source, and a struct (edits, characters, exact) for each stage, null where it has none.
    """
    long = rows.select("source", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("m")) for s in stages])).alias("e")).select("source", "e.stage", "e.m.*")
    return long.where(F.col("edits").isNotNull()).groupBy("source", "stage").agg(F.sum("edits").alias("edit_errors"), F.sum("characters").alias("reference_characters"), F.sum(F.col("exact").cast("long")).alias("exact"), F.count(F.lit(1)).alias("transcripts"), F.try_divide(F.sum("edits"), F.sum("characters")).alias("cer"))


def import_counters(rows: DataFrame, lines: str, skipped: str, invalid: str) -> DataFrame:
    """One row of an import's totals."""
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c)
    return rows.agg(F.count(F.lit(1)).alias("indexed"), n(lines), n(skipped), n(invalid))


def charset(lines: DataFrame, glyphs: str) -> DataFrame:
    """The different characters of valid, aligned lines, sorted (A26); none at all is an error. ``lines``: valid, aligned and an array of glyphs."""
    found = lines.where("valid AND aligned").select(F.explode(glyphs).alias("character")).distinct()
    if not found.limit(1).count():
        raise ValueError("no character in valid, aligned lines")
    return found.orderBy("character")


def largest_variant(variants: Column) -> Column:
    """The variant of the greatest scale, the first of equals."""
    return F.element_at(F.array_sort(variants, lambda a, b: F.when(a["scale"] > b["scale"], -1).when(a["scale"] < b["scale"], 1).otherwise(0)), 1)
