"""Numeric kernels with relational shape: blending, distances, weights, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def nearest_prototype(vectors: DataFrame, prototypes: DataFrame, key: str, label: str) -> DataFrame:
    """Per vector (key, embedding, label) its greatest cosine to the prototypes (label, prototype) of its label; distance is 1 less that.

    A left join on the label, so vectors of unknown labels stay, with null: ``supported`` tells them apart (G20, J13). Prototypes are few a label.
    """
    near = vectors.join(prototypes.withColumnRenamed(label, "__label"), F.col(label) == F.col("__label"), "left")
    best = near.groupBy(key, label).agg(F.max(cosine(F.col("embedding"), F.col("prototype"))).alias("similarity"))
    return best.withColumn("distance", 1 - F.col("similarity")).withColumn("supported", F.col("similarity").isNotNull())


def psnr(mse: Column) -> Column:
    """Of values in [-1, 1]; the error is bounded from below."""
    return -10 * F.log10(F.greatest(mse / 4, F.lit(1e-12)))


def tile_weight(position: Column, length: int, sigma: float = 0.3) -> Column:
    """A Gaussian bump over a tile."""
    half = (length - 1) / 2
    return F.exp(-F.pow((position - half) / (sigma * length), 2) / 2)


def blended(tiles: DataFrame, pixel: list[str], value: str, weight: str) -> DataFrame:
    """Weighted means of overlapping tiles by pixel; pixels without weight are null."""
    return tiles.groupBy(*pixel).agg(F.sum(F.col(value) * F.col(weight)).alias("__v"), F.sum(weight).alias("__w")).select(*pixel, F.try_divide("__v", "__w").alias(value))


def weighted_mean(error: Column, weight: Column) -> Column:
    """Sum of error times weight over the weights, bounded from below."""
    return F.sum(error * weight) / F.greatest(F.sum(weight), F.lit(1e-12))


def line_balanced_mean(terms: DataFrame, line: str, value: str, weight: str) -> DataFrame:
    """Means by line first, then their mean weighted by line; 0 without lines."""
    lines = terms.groupBy(line).agg(F.avg(value).alias("v"), F.max(weight).alias("w"))
    return lines.agg(F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")), F.lit(0.0)).alias("mean"))


def stratified_weights(tokens: DataFrame, image: str, stratum: str, mass: dict[str, float]) -> DataFrame:
    """Adds ``weight``: each stratum's mass shared among its tokens of an image; masses of empty strata go to the others in proportion, the mean weight is 1.

    Tokens of strata without mass weigh 0; where no token of an image has mass, all weigh 1.
    """
    share = F.coalesce(F.create_map(*[F.lit(x) for kv in mass.items() for x in kv])[F.col(stratum)], F.lit(0.0))
    per = tokens.groupBy(image, stratum).agg(F.count(F.lit(1)).alias("__n")).withColumn("__m", share)
    over = W.partitionBy(image)
    per = per.withColumn("__all", F.sum("__n").over(over)).withColumn("__mass", F.sum("__m").over(over))
    weight = F.when(F.col("__mass") > 0, F.col("__m") / F.col("__mass") * F.col("__all") / F.col("__n")).otherwise(1.0)
    return tokens.join(per.select(image, stratum, weight.alias("weight")), [image, stratum])


def capacity_top(scores: DataFrame, image: str, score: str, probability: str, index: str) -> DataFrame:
    """The rows of each image that its budget keeps: floor(sum of probabilities + 0.5) best by score, ties by index."""
    budget = F.floor(F.sum(probability).over(W.partitionBy(image)) + 0.5)
    rank = F.row_number().over(W.partitionBy(image).orderBy(F.desc(score), F.col(index)))
    return scores.withColumn("__b", budget).withColumn("rank", rank).where(F.col("rank") <= F.col("__b")).drop("__b")


def protected_top(groups: DataFrame, retain: int, protect: int, a: str, b: str, index: str) -> DataFrame:
    """The ``retain`` best by ``a``, of which the ``protect`` best by ``b`` are marked (T7). Sorts with a limit, not a window over all."""
    kept = groups.orderBy(F.desc(a), index).limit(retain)
    marked = kept.orderBy(F.desc(b), index).limit(protect).select(F.col(index).alias("__i"))
    return kept.join(marked, F.col(index) == F.col("__i"), "left").withColumn("protected", F.col("__i").isNotNull()).drop("__i")


def price_for_budget(options: DataFrame, item: str, cost: str, loss: str, budget: float, rounds: int = 60) -> tuple[float, DataFrame]:
    """The least price at which each item's option of least loss + price * cost keeps to the budget, and those options.

    Bisection on the driver; each probe is one aggregate with a partial step, and only its total comes back (G19). The options are
    written once, three columns of them, and each probe reads that table.
    """
    options = written(options.select(item, cost, loss), "options")

    def choice(price: float) -> DataFrame:
        value = F.col(loss) + F.lit(price) * F.col(cost)
        return options.groupBy(item).agg(F.min_by(F.struct(cost, loss), F.struct(value, cost)).alias("o")).select(item, f"o.{cost}", f"o.{loss}")

    spent = lambda price: choice(price).agg(F.sum(cost)).first()[0] or 0.0
    if spent(0.0) <= budget:
        return 0.0, choice(0.0)
    low, high = 0.0, 1.0
    while spent(high) > budget:
        low, high = high, high * 4
        if high > 1e18:
            raise ValueError("no choice of options keeps to the budget")
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (low, middle) if spent(middle) <= budget else (middle, high)
        if high - low <= 1e-9 * max(1.0, high):
            break
    return high, choice(high)


def smoothed(values: Column, decay: float) -> Column:
    """The exponential moving average of an array, from its first value on."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), values[0].cast("double"), lambda s, x: s * decay + x * (1 - decay))


def divergence(p: Column, q: Column, temperature: float = 1.0) -> Column:
    """KL(p || q) of two distributions times the temperature squared; classes without mass in p add nothing."""
    term = F.zip_with(p, q, lambda a, b: F.when(a > 0, a * (F.ln(a) - F.ln(F.greatest(b, F.lit(1e-12))))).otherwise(0.0))
    return F.aggregate(term, F.lit(0.0), lambda s, x: s + x) * temperature**2


def pooled(pixels: DataFrame, image: str, size: int, value: str) -> DataFrame:
    """Means over squares of ``size`` pixels."""
    return pixels.groupBy(image, F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty")).agg(F.avg(value).alias(value))


def linear_schedule(step: Column, first: float, last: float, steps: int) -> Column:
    """From ``first`` to ``last`` over ``steps``, then constant."""
    return F.lit(first) + (last - first) * F.least(F.greatest(step / F.lit(float(max(steps, 1))), F.lit(0.0)), F.lit(1.0))
