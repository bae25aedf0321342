"""Running moments of a stream: windows of event time with late data dropped beyond a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count, sum and sum of squares by event-time window and keys; mergeable by operators.ledger.moments_summary."""
    v = F.col(value)
    g = events.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return g.agg(F.count(v).alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"))
