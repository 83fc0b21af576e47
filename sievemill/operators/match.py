"""Greedy matching of boxes by overlap. Which pairs match depends on the order, so it is a fold over arrays of one row, not a join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import geometry


def greedy_match(takers: Column, offered: Column, least: float) -> Column:
    """Per box of ``takers`` in their order the place (from 0) of the unused box of ``offered`` that it overlaps most, or -1.

    Ties go to the first. Below ``least`` nothing is matched, and the box stays free. JVM only: a fold that carries what is used.
    """
    nothing = F.array().cast("array<int>")

    def matched(boxes: Column) -> Column:
        def step(used: Column, box: Column) -> Column:
            score = lambda o, k: F.when(F.array_contains(used, k.cast("int")), F.lit(-1.0)).otherwise(geometry.iou(box, o))
            scored = F.transform(boxes, lambda o, k: F.struct(score(o, k).alias("s"), (-k).alias("k")))
            found = geometry.once(F.array_max(scored), lambda best: F.when(best["s"] >= least, (-best["k"]).cast("int")).otherwise(F.lit(-1)))
            return F.concat(used, F.array(found))

        return F.when(boxes.isNull() | (F.size(boxes) <= 0), F.transform(takers, lambda b: F.lit(-1))).otherwise(F.aggregate(takers, nothing, step))

    return F.when(takers.isNull(), nothing).otherwise(geometry.once(offered, matched))


@F.pandas_udf(ArrayType(IntegerType()))
def _long_match(takers: pd.Series, offered: pd.Series, least: pd.Series) -> pd.Series:
    def one(a, b, t):
        x, y = np.array([list(v) for v in a], float).reshape(-1, 4), np.array([list(v) for v in b], float).reshape(-1, 4)
        free, out = np.ones(len(y), bool), []
        size = lambda z: np.clip(z[..., 2] - z[..., 0], 0, None) * np.clip(z[..., 3] - z[..., 1], 0, None)
        for box in x:
            inter = np.clip(np.minimum(box[2], y[:, 2]) - np.maximum(box[0], y[:, 0]), 0, None) * np.clip(np.minimum(box[3], y[:, 3]) - np.maximum(box[1], y[:, 1]), 0, None)
            union = size(box) + size(y) - inter
            score = np.where(free, np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0), -1.0)
            k = int(score.argmax()) if len(score) else -1
            k = k if k >= 0 and score[k] >= t else -1
            if k >= 0:
                free[k] = False
            out.append(k)
        return out

    return pd.Series([one(a if a is not None else [], b if b is not None else [], t) for a, b, t in zip(takers, offered, least, strict=True)])


def greedy_match_long(takers: Column, offered: Column, least: float) -> Column:
    """``greedy_match`` for long lists: the same result by arrays in an Arrow UDF."""
    return _long_match(takers, offered, F.lit(least))


def contained(points: Column, boxes: Column) -> Column:
    """Per box, the inner boxes that it holds whole."""
    return F.transform(boxes, lambda b: F.filter(points, lambda p: geometry.contains(b, p)))
