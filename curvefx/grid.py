"""Levels and weights of quantile grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K = 25


def midpoint_levels(k: int = K) -> list[float]:
    """(i - 0.5) / k for i = 1 .. k."""
    return [(i - 0.5) / k for i in range(1, k + 1)]


def interior_levels(k: int = K, low: float = 0.1, span: float = 0.8) -> list[float]:
    """Midpoint levels pressed into (low, low + span)."""
    return [low + span * u for u in midpoint_levels(k)]


def equal_weights(k: int = K) -> list[float]:
    return [1.0 / k] * k


def array_of(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def grid_table(spark: SparkSession, levels: list[float], weights: list[float] | None = None) -> DataFrame:
    """k, u, wgt: one row for each level."""
    w = weights or equal_weights(len(levels))
    return spark.createDataFrame([(i + 1, float(u), float(x)) for i, (u, x) in enumerate(zip(levels, w))], "k int, u double, wgt double")


def check_levels(levels: list[float]) -> list[float]:
    """The levels, which must rise strictly inside (0, 1)."""
    if any(not 0 < u < 1 for u in levels) or any(b <= a for a, b in zip(levels, levels[1:])):
        raise ValueError("levels must rise strictly inside (0, 1)")
    return list(levels)
