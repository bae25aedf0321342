"""Benchmark curves from published tables: monotone cubic interpolation by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_levels(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Knots with equal levels averaged."""
    return df.groupBy(*keys, x).agg(F.avg(y).alias(y))


def inner_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """The weighted harmonic mean of two secants with one sign, else 0."""
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 > 0, (w1 + w2) / (w1 / d0 + w2 / d1)).otherwise(F.lit(0.0))


def end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """The three-point slope at an end, kept to the secant's sign and three times its size."""
    s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(s * d0 <= 0, F.lit(0.0)).when((d0 * d1 <= 0) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)


def pchip_pieces(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, x0, x1, y0, y1, m0, m1 for each gap between knots; a key's knots are few and meet in one window.

    Slopes are those of the monotone piecewise cubic of Fritsch and Butland, with one-sided ends.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    d = df.select(*keys, F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y0")).withColumn("x1", F.lead("x0").over(Window.partitionBy(*keys).orderBy("x0"))).withColumn("y1", F.lead("y0").over(Window.partitionBy(*keys).orderBy("x0")))
    w = Window.partitionBy(*keys).orderBy("x0")
    d = d.withColumn("h", F.col("x1") - F.col("x0")).withColumn("s", (F.col("y1") - F.col("y0")) / F.col("h"))
    for c in ("h", "s"):
        d = d.withColumn(f"{c}p", F.lag(c).over(w)).withColumn(f"{c}n", F.lead(c).over(w)).withColumn(f"{c}pp", F.lag(c, 2).over(w))
    first, last = F.col("hp").isNull(), F.col("h").isNull()
    col = F.col
    slope = F.when(first & col("hn").isNull(), col("s")).when(first, end_slope(col("h"), col("hn"), col("s"), col("sn"))).when(last & col("hpp").isNull(), col("sp")).when(last, end_slope(col("hp"), col("hpp"), col("sp"), col("spp"))).otherwise(inner_slope(col("hp"), col("h"), col("sp"), col("s")))
    d = d.withColumn("m0", slope).withColumn("m1", F.lead("m0").over(w))
    return d.where("x1 IS NOT NULL").select(*keys, "x0", "x1", "y0", "y1", "m0", "m1")


def hermite(u: Column, derivative: bool = False) -> Column:
    """The piece's cubic, or its derivative, at u."""
    h = F.col("x1") - F.col("x0")
    t = (u - F.col("x0")) / h
    if derivative:
        return (6 * t * t - 6 * t) * F.col("y0") / h + (3 * t * t - 4 * t + 1) * F.col("m0") + (6 * t - 6 * t * t) * F.col("y1") / h + (3 * t * t - 2 * t) * F.col("m1")
    return (2 * t * t * t - 3 * t * t + 1) * F.col("y0") + (t * t * t - 2 * t * t + t) * h * F.col("m0") + (3 * t * t - 2 * t * t * t) * F.col("y1") + (t * t * t - t * t) * h * F.col("m1")


def pchip(df: DataFrame, keys: list[str], x: str, y: str, levels: list[float], derivative: bool = False) -> DataFrame:
    """keys, k, q at each level between the knots; levels beyond the ends take the end knot."""
    p = pchip_pieces(df, keys, x, y)
    ends = Window.partitionBy(*keys)
    p = p.withColumn("_lo", F.min("x0").over(ends)).withColumn("_hi", F.max("x1").over(ends))
    at = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(float(u)).alias("u")) for i, u in enumerate(levels)]))
    j = p.withColumn("e", at).withColumn("_u", F.greatest(F.least(F.col("e.u"), F.col("_hi")), F.col("_lo")))
    mine = (F.col("_u") > F.col("x0")) & (F.col("_u") <= F.col("x1")) | (F.col("_u") == F.col("_lo")) & (F.col("x0") == F.col("_lo"))
    return j.where(mine).select(*keys, F.col("e.k").alias("k"), hermite(F.col("_u"), derivative).alias("q"))


def pooled_benchmark(long: DataFrame, weight: str) -> DataFrame:
    """Weighted average of curves at each level."""
    return long.groupBy("k").agg((F.sum(F.col("q") * F.col(weight)) / F.sum(weight)).alias("q"))


def lorenz(shares: DataFrame, keys: list[str], group: str, share: str) -> DataFrame:
    """keys, p, l: the Lorenz curve's knots with its origin, from ordered group shares."""
    w = Window.partitionBy(*keys).orderBy(group)
    n = F.count("*").over(Window.partitionBy(*keys))
    pts = shares.select(*keys, (F.row_number().over(w) / n).alias("p"), (F.sum(share).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum(share).over(Window.partitionBy(*keys))).alias("l"))
    return pts.unionByName(shares.select(*keys).distinct().select(*keys, F.lit(0.0).alias("p"), F.lit(0.0).alias("l")))


def gini(knots: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gini by the trapezoid rule."""
    w = Window.partitionBy(*keys).orderBy("p")
    a = knots.withColumn("_a", (F.col("l") + F.lag("l").over(w)) / 2 * (F.col("p") - F.lag("p").over(w)))
    return a.groupBy(*keys).agg((1 - 2 * F.sum("_a")).alias("gini"))


def median_ratio(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: the median ratio of b over a and the largest relative deviation from it."""
    j = a.select(key, F.col("value").alias("_a")).join(b.select(key, F.col("value").alias("_b")), key).select((F.col("_b") / F.col("_a")).alias("t"))
    m = j.agg(F.percentile("t", 0.5).alias("ratio"))
    return j.crossJoin(F.broadcast(m)).groupBy("ratio").agg(F.max(F.abs(F.col("t") / F.col("ratio") - 1)).alias("largest"))  # one row
