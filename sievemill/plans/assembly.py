"""Training-set assembly: repeated lists and weighted mixtures (group F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import control, sampling


def repeated_dataset(lists: DataFrame, items: DataFrame) -> DataFrame:
    """Items of each list (path) as often as the list is repeated; an entry whose list has no items is an error."""
    control.require_empty(lists.where("repeat > 0").join(items, "path", "left_anti"), "list without items")
    return sampling.repeated(items.join(lists, "path"), "repeat")


def epoch(sources: DataFrame, items: DataFrame, seed: int, number: int, draws: int) -> DataFrame:
    """The rows of one epoch: draws from weighted sources (source, weight), joined with numbered items (source, item)."""
    counts = items.groupBy("source").agg(F.count(F.lit(1)).alias("items"))
    plan = sampling.weighted_mixture(sources.join(counts, "source", "left").fillna(0, ["items"]), sources.sparkSession.range(draws).withColumnRenamed("id", "draw"), seed, number)
    return plan.join(items, ["source", "item"])
