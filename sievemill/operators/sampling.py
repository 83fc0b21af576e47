"""Sampling and mixtures, reproducible from (seed, key) and independent of partitions.

Draws are hashes of the seed and a row's key. Samples take the least hashes: with a limit over all rows, with a window by
group, whose group limit keeps few rows a task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import unit


def luck(seed: int, *key: Column) -> Column:
    """A row's place in a sample: a digest, equal in any engine."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]), 256)


def quotas(n: int, groups: int) -> list[int]:
    """``n`` shared evenly; the first groups take the rest."""
    return [n // groups + (k < n % groups) for k in range(groups)]


def sample_per_group(rows: DataFrame, group: str, key: str, n: int, seed: int, strict: bool = True) -> DataFrame:
    """A uniform sample without replacement of ``n`` rows in all, shared evenly by groups in their order.

    ``strict``: fails where a group has fewer rows than its share. Groups are numbered in a table of their own, a row a group, and
    no group's rows meet but within the window's limit.
    """
    everything = W.partitionBy()
    place = F.row_number().over(W.orderBy(group)) - 1
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).withColumn("__k", place).withColumn("__m", F.count(F.lit(1)).over(everything))
    share = F.floor(F.lit(n) / F.col("__m")) + (F.col("__k") < F.lit(n) % F.col("__m")).cast("int")
    sizes = sizes.select(F.col(group).alias("__g"), "__n", share.alias("__share"))
    short = [r["__g"] for r in sizes.where("__n < __share").limit(5).collect()] if strict else []
    if short:
        raise ValueError(f"fewer rows than the share of {group} {short}")
    order = W.partitionBy(group).orderBy(luck(seed, F.col(group), F.col(key)), key)
    ranked = rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n)
    return ranked.join(sizes, F.col(group).eqNullSafe(F.col("__g"))).where("__r <= __share").drop("__r", "__g", "__n", "__share")


def sample_rows(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A uniform sample of ``n`` rows, in order of the key (T3, T4): the contract of a reservoir, by a limit that keeps n rows a task."""
    return rows.withColumn("__l", luck(seed, F.col(key))).orderBy("__l", key).limit(n).drop("__l").orderBy(key)


def stratified(rows: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """Up to ``n`` rows of each stratum, with ``stratum_rank`` from 1 (T5)."""
    order = W.partitionBy(*strata).orderBy(luck(seed, F.col(key)), key)
    return rows.withColumn("stratum_rank", F.row_number().over(order)).where(F.col("stratum_rank") <= n)


def round_robin(rows: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in all, by turns from the strata in their order (T6). No stratum gives more than n, so the window keeps n of each."""
    return stratified(rows, strata, key, n, seed).orderBy("stratum_rank", *strata).limit(n)


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as ``times`` says, with ``repeat_no`` from 0; 0 drops it, negative or null is an error."""
    checked = F.when(F.col(times) >= 0, F.col(times)).otherwise(F.raise_error(F.concat(F.lit("invalid repeat: "), F.coalesce(F.col(times).cast("string"), F.lit("null")))).cast("int"))
    return rows.withColumn("__t", checked).where("__t > 0").withColumn("repeat_no", F.explode(F.sequence(F.lit(0), (F.col("__t") - 1).cast("int")))).drop("__t")


def weighted_mixture(sources: DataFrame, draws: DataFrame, seed: int, epoch: int) -> DataFrame:
    """For each draw (draw) a source by weight and a uniform item of it, with replacement.

    ``sources``: source, weight, items; those without weight or items are never drawn. They are a configuration's few rows, so their
    running shares are an array in the plan, in which each draw finds its place without a join.
    """
    able = sources.where("weight > 0 AND items > 0")
    total = able.agg(F.sum("weight").alias("w")).first()["w"]
    if not total:
        raise ValueError("no source has both weight and items")
    upto = W.orderBy("source").rowsBetween(W.unboundedPreceding, 0)
    ends = able.select("source", "items", (F.sum("weight").over(upto) / F.lit(float(total))).alias("upto")).orderBy("upto").collect()  # a row a source
    table = F.array(*[F.struct(F.lit(float(r["upto"])).alias("upto"), F.lit(r["source"]).alias("source"), F.lit(r["items"]).alias("items")) for r in ends])
    u, v = (unit(seed, F.concat_ws(":", F.lit(f"{epoch}:{k}"), F.col("draw").cast("string"))) for k in ("source", "item"))
    found = draws.withColumn("__s", F.coalesce(F.get(F.filter(table, lambda s: s["upto"] > u), F.lit(0)), F.element_at(table, -1)))
    return found.select("draw", F.col("__s.source").alias("source"), F.floor(v * F.col("__s.items")).cast("long").alias("item"))


def line_balanced(lines: DataFrame, images: DataFrame, draws: DataFrame, seed: int, p_line: float) -> DataFrame:
    """For each draw, with ``p_line`` a uniform line among all valid ones, else a uniform image (T10): draw, kind, no.

    ``lines`` and ``images`` have ``no`` from 0, dense; only their counts are needed to draw.
    """
    n_lines, n_images = lines.count(), images.count()
    pick = lambda name: unit(seed, F.concat(F.lit(f"{name}:"), F.col("draw").cast("string")))
    from_line = (pick("kind") < p_line) & F.lit(n_lines > 0)
    return draws.select("draw", F.when(from_line, "line").otherwise("image").alias("kind"), F.floor(pick("no") * F.when(from_line, F.lit(n_lines)).otherwise(F.lit(n_images))).cast("long").alias("no"))


def bucket(value: Column, edges: list[float]) -> Column:
    """How many edges a value reaches: 0 below the first (the right bisection)."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges[1:]), F.when(value >= edges[0], 1).otherwise(0)) if edges else F.lit(0)


def bucket_weighted(lines: DataFrame, height: str, edges: list[float], weights: list[float], draws: DataFrame, seed: int) -> DataFrame:
    """For each draw a height bucket by weight among those that have lines and weight, then a uniform line of it: draw, source (the bucket), item."""
    if len(weights) != len(edges) + 1:
        raise ValueError("one weight for each bucket is needed")
    counts = lines.groupBy(bucket(F.col(height), edges).alias("source")).agg(F.count(F.lit(1)).alias("items"))
    weighted = counts.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source") + 1).cast("int")))
    return weighted_mixture(weighted, draws, seed, 0)


def numbered(rows: DataFrame, shard: str, order: str) -> DataFrame:
    """Adds ``row_no``, the place in the order of (shard, order): counts of earlier shards and a rank within the own."""
    counts = rows.groupBy(F.col(shard).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    base = counts.select("__s", F.coalesce(F.sum("__n").over(W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # a row a shard
    local = rows.withColumn("__r", F.row_number().over(W.partitionBy(shard).orderBy(order)) - 1)
    return local.join(base, F.col(shard) == F.col("__s")).withColumn("row_no", (F.col("__b") + F.col("__r")).cast("long")).drop("__s", "__b", "__r")


def degradation(rows: DataFrame, key: str, seed: int, variants: int, scales: list[float], blur: tuple[float, float], noise: tuple[float, float], jpeg: tuple[int, int]) -> DataFrame:
    """The parameters of each variant, drawn from (seed, key, variant) alone (group G, X14)."""
    u = lambda name: unit(seed, F.concat_ws(":", F.lit(name), F.col(key).cast("string"), F.col("variant").cast("string")))
    between = lambda name, lo, hi: F.lit(float(lo)) + u(name) * F.lit(float(hi - lo))
    out = rows.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    scale = F.element_at(F.array(*[F.lit(float(s)) for s in scales]), (F.floor(u("scale") * len(scales)) + 1).cast("int"))
    return out.withColumn("scale", scale).withColumn("blur_sigma", between("blur", *blur)).withColumn("noise_std", between("noise", *noise)).withColumn("jpeg_quality", F.floor(between("jpeg", jpeg[0], jpeg[1] + 1)).cast("int"))
