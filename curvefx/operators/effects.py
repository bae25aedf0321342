"""Doubly robust effects of curve functionals, nuisances by strata, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 0.02, 0.98


def clipped(e: Column, low: float = LOW, high: float = HIGH) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), e))


def aipw(h: Column, a: Column, e: Column, mu0: Column, mu1: Column) -> Column:
    """mu1 - mu0 + a/e (h - mu1) - (1 - a)/(1 - e) (h - mu0)."""
    return mu1 - mu0 + a / e * (h - mu1) - (1 - a) / (1 - e) * (h - mu0)


def stratum_nuisances(df: DataFrame, strata: list[str], fold: str, arm: str, values: list[str]) -> DataFrame:
    """df with cross-fitted e and, for each value, mu0_v and mu1_v: stratum means over the rows of the other folds.

    Totals less the fold's own part give the out-of-fold means in one aggregation; a stratum arm without
    out-of-fold rows takes the overall out-of-fold mean.
    """
    a = F.col(arm)
    sums = [F.count("*").alias("n"), F.sum(a).cast("double").alias("n1")]
    for v in values:
        sums += [F.sum(F.when(a == k, F.col(v)).otherwise(0.0)).alias(f"s{k}_{v}") for k in (0, 1)]
    names = ["n", "n1", *[f"s{k}_{v}" for v in values for k in (0, 1)]]
    by_fold = df.groupBy(*strata, fold).agg(*sums)
    stratum = by_fold.groupBy(*strata).agg(*[F.sum(c).alias(f"T_{c}") for c in names])
    fold_all = by_fold.groupBy(fold).agg(*[F.sum(c).alias(f"F_{c}") for c in names])
    whole = by_fold.agg(*[F.sum(c).alias(f"W_{c}") for c in names])
    j = by_fold.join(stratum, strata).join(F.broadcast(fold_all), fold).crossJoin(F.broadcast(whole))  # a row for each fold; one row
    rest = lambda c: F.col(f"T_{c}") - F.col(c)
    far = lambda c: F.col(f"W_{c}") - F.col(f"F_{c}")
    count = {1: lambda f: f("n1"), 0: lambda f: f("n") - f("n1")}
    out = [F.coalesce(F.try_divide(rest("n1"), rest("n")), far("n1") / far("n")).alias("e")]
    for v in values:
        out += [F.coalesce(F.try_divide(rest(f"s{k}_{v}"), count[k](rest)), F.try_divide(far(f"s{k}_{v}"), count[k](far))).alias(f"mu{k}_{v}") for k in (0, 1)]
    return df.join(j.select(*strata, fold, *out), [*strata, fold])


def marginal(df: DataFrame, psi: str, keys: list[str] | None = None) -> DataFrame:
    """effect, if_se (population sd over root n) and n, overall or by keys."""
    n = F.count(psi)
    return df.groupBy(*(keys or [])).agg(F.avg(psi).alias("effect"), (F.stddev_pop(psi) / F.sqrt(n)).alias("if_se"), n.alias("n"))


def by_bin(df: DataFrame, psi: str, bins: int = 4, bin: str = "bin", keys: list[str] | None = None) -> DataFrame:
    """Effects for every bin; an empty one has nulls and n 0."""
    keys = keys or []
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias(bin))
    frame = df.select(*keys).distinct().crossJoin(F.broadcast(every)) if keys else every  # bins rows for each key
    got = frame.join(marginal(df, psi, [*keys, bin]), [*keys, bin], "left")
    return got.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def law_contrasts(means: DataFrame, units: DataFrame, value: str, bin: str = "bin") -> DataFrame:
    """bin, n, contrast: the arms' difference of a functional's mean under each unit's own laws, by bin and overall (bin -1).

    means has unit_id, arm and value; units with a law in one arm only are left out.
    """
    on = lambda k: F.max(F.when(F.col("arm") == k, F.col(value)))
    d = means.groupBy("unit_id").agg((on(1) - on(0)).alias("_d")).where("_d IS NOT NULL").join(units.select("unit_id", bin), "unit_id")
    both = d.select("_d", F.explode(F.array(F.col(bin), F.lit(-1))).alias(bin))
    return both.groupBy(bin).agg(F.count("*").alias("n"), F.avg("_d").alias("contrast"))


def calibrated_levels(law: DataFrame, units: DataFrame, source: list[float], target: list[float]) -> DataFrame:
    """k, n, effect, if_se: doubly robust effects of the curve's values at other levels, from stored out-of-fold laws.

    law has unit_id, arm, mass and q; units has unit_id, a, e and q, all curves at the source levels. An arm's regression
    value is the law's mean over its finite atoms, or where a unit has no such atom the mean over all units.
    """
    from ..functions import curves as C

    at = lambda q: F.posexplode(C.curve_resample(q, source, target)).alias("k", "v")
    finite = F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    means = law.where(finite).select("unit_id", "arm", "mass", at(F.col("q"))).groupBy("unit_id", "arm", "k").agg((F.sum(F.col("mass") * F.col("v")) / F.sum("mass")).alias("mu"))
    whole = means.groupBy("k").agg(*[F.avg(F.when(F.col("arm") == a, F.col("mu"))).alias(f"_w{a}") for a in (0, 1)])
    side = lambda a: means.where(F.col("arm") == a).select("unit_id", "k", F.col("mu").alias(f"_m{a}"))
    own = units.select("unit_id", "a", "e", at(F.col("q"))).withColumnRenamed("v", "_h")
    j = own.join(side(0), ["unit_id", "k"], "left").join(side(1), ["unit_id", "k"], "left").join(F.broadcast(whole), "k")  # a row for each level
    psi = aipw(F.col("_h"), F.col("a"), F.col("e"), F.coalesce("_m0", "_w0"), F.coalesce("_m1", "_w1"))
    return marginal(j.withColumn("_psi", psi), "_psi", ["k"]).select("k", "n", "effect", "if_se")


def overlap(df: DataFrame, e: str, arm: str, low: float = LOW, high: float = HIGH) -> DataFrame:
    c, a = F.col(e), F.col(arm)
    share = lambda x: F.avg(x.cast("double"))
    return df.agg(F.min(c).alias("lowest"), F.max(c).alias("highest"), F.avg(c).alias("mean"), share(c <= low).alias("at_low"), share(c >= high).alias("at_high"), share((c < 0.1) | (c > 0.9)).alias("outside"), F.avg(F.when(a == 1, c)).alias("treated"), F.avg(F.when(a == 0, c)).alias("control"))


def permuted(df: DataFrame, key: str, arm: str, seed: int) -> DataFrame:
    """df with its arms dealt anew: the arm at each key rank goes to the row of the same rank in a hashed order."""
    from .ordered import global_rank
    from .prep import seeded_order

    arms = global_rank(df.select(key, F.col(arm).alias("_arm")), [F.col(key)], "_r").select("_r", "_arm")
    rows = global_rank(df.withColumn("_h", seeded_order(seed, key)), [F.col("_h"), F.col(key)], "_r")
    return rows.join(arms, "_r").withColumn(arm, F.col("_arm")).drop("_r", "_h", "_arm")
