"""Decision rules over a ledger's cells: resolution, gates, ablations, propensity and alignment views, row-count guards.

Cells have dgp, method, metric, seed, n_grid, n_particles and value, lower values being better. A rule is declared as
a small plan table; the ledger is aggregated once and joined to it, and what the ledger lacks stays in the result as
not evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import paired_stats

Pair = tuple[int, int]


def table_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def tolerance_band(cells: DataFrame, designs: list[str], metrics: list[str], primary: Pair, alternatives: list[Pair], tolerance: float) -> DataFrame:
    """dgp, metric, n_grid, n_particles, primary_mean, other_mean, relative, evaluated, within: every alternative against the primary setting.

    relative is |other - primary| / primary, infinite where the primary mean is not positive. A setting without cells
    is not evaluated and not within.
    """
    means = cells.groupBy("dgp", "metric", "n_grid", "n_particles").agg(F.avg("value").alias("m"))
    wanted = table_of(cells.sparkSession, [(d, m, *a) for d in designs for m in metrics for a in alternatives], "dgp string, metric string, n_grid int, n_particles int")
    first = means.where((F.col("n_grid") == primary[0]) & (F.col("n_particles") == primary[1])).select("dgp", "metric", F.col("m").alias("primary_mean"))
    j = wanted.join(first, ["dgp", "metric"], "left").join(means.withColumnRenamed("m", "other_mean"), ["dgp", "metric", "n_grid", "n_particles"], "left")
    seen = F.col("primary_mean").isNotNull() & F.col("other_mean").isNotNull()
    gap = F.abs(F.col("other_mean") - F.col("primary_mean"))
    relative = F.when(seen, F.when(F.col("primary_mean") > 0, gap / F.col("primary_mean")).otherwise(F.lit(float("inf"))))
    out = j.withColumn("relative", relative).withColumn("evaluated", seen)
    return out.withColumn("within", F.coalesce(F.col("relative") <= tolerance, F.lit(False)))


def larger_gains(cells: DataFrame, designs: list[str], metrics: list[str], primary: Pair, larger: list[Pair], multiple: float) -> DataFrame:
    """dgp, metric, n_grid, n_particles, n, delta, se, evaluated, improves: paired gains of larger settings over the primary one.

    delta is primary less larger over common seeds; two pairs or more are needed. It improves where delta exceeds
    multiple standard errors.
    """
    keys = ["dgp", "metric", "seed"]
    wanted = table_of(cells.sparkSession, [(d, m, *a) for d in designs for m in metrics for a in larger], "dgp string, metric string, n_grid int, n_particles int")
    once = cells.groupBy(*keys, "n_grid", "n_particles").agg(F.avg("value").alias("v"))
    base = once.where((F.col("n_grid") == primary[0]) & (F.col("n_particles") == primary[1])).select(*keys, F.col("v").alias("a"))
    d = once.join(base, keys).withColumn("d", F.col("a") - F.col("v")).groupBy("dgp", "metric", "n_grid", "n_particles").agg(F.count("*").alias("n"), F.avg("d").alias("delta"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"))
    j = wanted.join(d, ["dgp", "metric", "n_grid", "n_particles"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    j = j.withColumn("evaluated", (F.col("n") >= 2) & F.col("se").isNotNull())
    return j.withColumn("improves", F.coalesce(F.col("evaluated") & (F.col("delta") > multiple * F.col("se")), F.lit(False)))


def resolution_rule(band: DataFrame, gains: DataFrame) -> DataFrame:
    """One row: missing, condition_a, improving, retain_primary, n_grid, n_particles and reason.

    Condition A: every record of the band is evaluated and within. A larger setting improves if all its records do; the
    recommended one has the largest mean gain, then the larger setting. The primary is retained if nothing is
    missing, A holds and nothing improves.
    """
    a = band.agg(F.count(F.when(~F.col("evaluated"), 1)).alias("missing"), F.coalesce(F.bool_and("within"), F.lit(False)).alias("condition_a"))
    per = gains.groupBy("n_grid", "n_particles").agg(F.bool_and("improves").alias("_all"), F.avg("delta").alias("_gain"))
    good = per.where("_all")
    best = good.agg(F.count("*").alias("improving"), F.max_by(F.struct("n_grid", "n_particles"), F.struct("_gain", "n_grid", "n_particles")).alias("_best"))
    one = a.crossJoin(best)  # single rows
    keep = (F.col("missing") == 0) & F.col("condition_a") & (F.col("improving") == 0)
    reason = F.when(F.col("missing") > 0, "records missing").when(keep, "primary retained").when(F.col("improving") > 0, "a larger setting improves everything").otherwise("an alternative leaves the band")
    return one.select("missing", "condition_a", "improving", keep.alias("retain_primary"), F.col("_best.n_grid").alias("n_grid"), F.col("_best.n_particles").alias("n_particles"), reason.alias("reason"))


def planned(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with n, mean_diff, se, kind and wins: claimant less comparator over common seeds and settings, for each row of the plan.

    plan has rule, dgp, metric, claimant and comparator. kind is accuracy, or capability where the comparator has no
    cell of the metric and design and the claimant has one, which counts as a win; absent where neither can be said.
    """
    spots = ["seed", "n_grid", "n_particles"]
    side = lambda who, v: cells.select("dgp", "metric", *spots, F.col("method").alias(who), F.col("value").alias(v))
    pairs = plan.join(side("claimant", "a"), ["dgp", "metric", "claimant"]).join(side("comparator", "b"), ["dgp", "metric", "comparator", *spots])
    keys = ["rule", "dgp", "metric", "claimant", "comparator"]
    stats = paired_stats(pairs.groupBy(*keys, "seed").agg(F.avg("a").alias("a"), F.avg("b").alias("b")).withColumn("d", F.col("a") - F.col("b")), keys)
    have = cells.select("dgp", "metric", "method").distinct()
    there = lambda who, flag: have.select("dgp", "metric", F.col("method").alias(who), F.lit(True).alias(flag))
    j = plan.join(stats.select(*keys, "n", "mean_diff", "se"), keys, "left").join(there("claimant", "_c"), ["dgp", "metric", "claimant"], "left").join(there("comparator", "_o"), ["dgp", "metric", "comparator"], "left")
    kind = F.when(F.col("n").isNotNull(), "accuracy").when(F.col("_c") & F.col("_o").isNull(), "capability").otherwise("absent")
    wins = F.when(kind == "capability", F.lit(True)).otherwise(F.coalesce(F.col("mean_diff") < -2 * F.col("se"), F.lit(False)))
    return j.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "mean_diff", "se", kind.alias("kind"), wins.alias("wins"))


def gates(compared: DataFrame, least: DataFrame) -> DataFrame:
    """rule, n_wins, n_accuracy, n_capability, passed, verdict from planned() rows and least (rule, min_wins); GO if all rules pass."""
    won = lambda k: F.count(F.when(F.col("wins") & (F.col("kind") == k), 1))
    g = compared.groupBy("rule").agg(F.count(F.when(F.col("wins"), 1)).alias("n_wins"), won("accuracy").alias("n_accuracy"), won("capability").alias("n_capability"))
    j = least.join(g, "rule", "left").select("rule", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_wins", "n_accuracy", "n_capability")], "min_wins")
    j = j.withColumn("passed", F.col("n_wins") >= F.col("min_wins"))
    whole = j.agg(F.when(F.bool_and("passed"), "GO").otherwise("NOT-GO").alias("verdict"))
    return j.drop("min_wins").crossJoin(whole)  # one row


def propensity_view(cells: DataFrame, base: str, variants: list[str], diagnostic: str) -> DataFrame:
    """dgp, metric, method, comparator, n_seeds, mean, delta, se, diagnostic_only: each method's mean, and base less each variant by seed.

    Rows of means have an empty comparator; diagnostic marks a variant that is no feasible competitor.
    """
    keys = ["dgp", "metric"]
    one = cells.where(F.col("method").isin(base, *variants)).groupBy(*keys, "method").agg(F.countDistinct("seed").alias("n_seeds"), F.avg("value").alias("mean"))
    means = one.select(*keys, "method", F.lit("").alias("comparator"), "n_seeds", "mean", F.lit(None).cast("double").alias("delta"), F.lit(None).cast("double").alias("se"))
    by = cells.groupBy(*keys, "method", "seed", "n_grid", "n_particles").agg(F.avg("value").alias("v"))
    a = by.where(F.col("method") == base).select(*keys, "seed", "n_grid", "n_particles", F.col("v").alias("a"))
    b = by.where(F.col("method").isin(*variants)).select(*keys, "seed", "n_grid", "n_particles", F.col("method").alias("comparator"), F.col("v").alias("b"))
    s = paired_stats(a.join(b, [*keys, "seed", "n_grid", "n_particles"]).withColumn("d", F.col("a") - F.col("b")), [*keys, "comparator"])
    paired = s.join(one.where(F.col("method") == base).select(*keys, "mean"), keys).select(*keys, F.lit(base).alias("method"), "comparator", F.col("n").alias("n_seeds"), "mean", F.col("mean_diff").alias("delta"), "se")
    return means.union(paired).withColumn("diagnostic_only", (F.col("method") == diagnostic) | (F.col("comparator") == diagnostic))


def alignment_view(cells: DataFrame, aligned: str, irrelevant: str, keys: list[str]) -> DataFrame:
    """keys, n, aligned_mean, irrelevant_mean, delta, se, p: two designs of the same method, paired by seed."""
    of = lambda d, c: cells.where(F.col("dgp") == d).groupBy(*keys, "seed").agg(F.avg("value").alias(c))
    pairs = of(aligned, "a").join(of(irrelevant, "b"), [*keys, "seed"]).withColumn("d", F.col("a") - F.col("b"))
    means = pairs.groupBy(*keys).agg(F.avg("a").alias("aligned_mean"), F.avg("b").alias("irrelevant_mean"))
    return means.join(paired_stats(pairs, keys).select(*keys, "n", F.col("mean_diff").alias("delta"), "se", "p"), keys)


def mean_of(cells: DataFrame, dgp: str, method: str) -> Column:
    """An aggregate: the mean value of one design and method."""
    return F.avg(F.when((F.col("dgp") == dgp) & (F.col("method") == method), F.col("value")))


def shared_gate(cells: DataFrame, shared: str, separate: str, plain: str, pooled: str, gain: float, loss: float) -> DataFrame:
    """One row: gain, loss, decision. The pooled method must gain on the shared design and lose little on the separate one."""
    m = cells.agg(mean_of(cells, shared, plain).alias("s0"), mean_of(cells, shared, pooled).alias("s1"), mean_of(cells, separate, plain).alias("t0"), mean_of(cells, separate, pooled).alias("t1"))
    g, x = (F.col("s0") - F.col("s1")) / F.col("s0"), (F.col("t1") - F.col("t0")) / F.col("t0")
    return m.select(g.alias("gain"), x.alias("loss"), F.when(g.isNull() | x.isNull(), "INDETERMINATE").when((g >= gain) & (x <= loss), "pooled").otherwise("plain only").alias("decision"))


def crossover(cells: DataFrame, null: str, separate: str, shared: str, ends: tuple[str, str], mixed: str, margin: float, tolerance: float) -> DataFrame:
    """One row: shared_gain, separate_gain, null_loss, decision and the retained method.

    The mixed method must gain margin over the first end on the shared design and over the second one on the separate
    design, and lose at most tolerance against the better end on the null design. Otherwise the method with the least
    mean over the three designs is retained.
    """
    names = {f"m{i}{j}": (d, m) for i, d in enumerate((null, separate, shared)) for j, m in enumerate((*ends, mixed))}
    v = cells.agg(*[mean_of(cells, *dm).alias(n) for n, dm in names.items()])
    c = F.col
    sg, eg = (c("m20") - c("m22")) / c("m20"), (c("m11") - c("m12")) / c("m11")
    best = F.least("m00", "m01")
    nl = (c("m02") - best) / best
    whole = sum((c(n).isNotNull().cast("int") for n in names), F.lit(0)) == len(names)
    passed = (sg >= margin) & (eg >= margin) & (nl <= tolerance)
    sums = [(c(f"m0{j}") + c(f"m1{j}") + c(f"m2{j}")) for j in range(3)]
    least = F.when((sums[0] <= sums[1]) & (sums[0] <= sums[2]), ends[0]).when(sums[1] <= sums[2], ends[1]).otherwise(mixed)
    return v.select(sg.alias("shared_gain"), eg.alias("separate_gain"), nl.alias("null_loss"), F.when(~whole, "INDETERMINATE").when(passed, "mixed").otherwise("strongest end").alias("decision"), F.when(whole & ~passed, least).alias("retained"))


def published_cell(cells: DataFrame, published: DataFrame, method: str, other: str, band: float) -> DataFrame:
    """metric, observed, published, within and the decision: REPRODUCED if all metrics lie in the band and are below the other method's."""
    m = cells.groupBy("metric").agg(F.avg(F.when(F.col("method") == method, F.col("value"))).alias("observed"), F.avg(F.when(F.col("method") == other, F.col("value"))).alias("_o"))
    j = published.join(m, "metric", "left").withColumn("within", F.coalesce(F.abs(F.col("observed") - F.col("published")) <= band * F.abs("published"), F.lit(False)))
    one = j.agg(F.when(F.bool_and(F.col("within") & F.coalesce(F.col("observed") < F.col("_o"), F.lit(True))), "REPRODUCED").otherwise("NOT-REPRODUCED").alias("decision"))
    return j.drop("_o").crossJoin(one)  # one row


def dimension_scaling(cells: DataFrame, dimension: str, cost: str, limit: float) -> DataFrame:
    """dimension, cells, mean_cost, max_cost, growth to the next smaller dimension, and VIABLE if no cell is above the limit."""
    from pyspark.sql import Window

    g = cells.groupBy(dimension).agg(F.count("*").alias("cells"), F.avg(cost).alias("mean_cost"), F.max(cost).alias("max_cost"))
    over = Window.partitionBy(F.lit(0)).orderBy(dimension)  # one row for each dimension
    one = g.agg(F.when(F.max("max_cost") <= limit, "VIABLE").otherwise("PROHIBITIVE").alias("decision"))
    return g.withColumn("growth", F.col("mean_cost") / F.lag("mean_cost").over(over)).crossJoin(one)  # one row


class RowCount(ValueError):
    pass


def exact_rows(df: DataFrame, expected: int) -> DataFrame:
    """df, which must have exactly so many rows."""
    if (n := df.count()) != expected:
        raise RowCount(f"{n} rows, not {expected}")
    return df
