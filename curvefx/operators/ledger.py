"""Metric ledgers: cells, replications, paired comparisons, audits and decisions, all as grouped DataFrames.

A ledger has one row per cell, metric and arm: coordinates (dgp, method, seed, n_grid, n_particles), cell_key, metric,
target_id, arm (nullable), value (nullable), status in ok, not_applicable, failed, failure_reason, wall_seconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.curves import normal_tail
from .ordered import stored

COORDINATES = ["dgp", "method", "seed", "n_grid", "n_particles"]


def usable_rows(ledger: DataFrame) -> DataFrame:
    """Rows with status ok and a value."""
    return ledger.where((F.col("status") == "ok") & F.col("value").isNotNull() & ~F.isnan("value"))


def cell_key(*columns: str) -> Column:
    """First 16 hex digits of the SHA-256 of the coordinates."""
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 16)


def cell_metrics(ledger: DataFrame) -> DataFrame:
    """Arms averaged within cell, metric and target, with their number and mean wall time."""
    return usable_rows(ledger).groupBy(*COORDINATES, "cell_key", "metric", "target_id").agg(F.avg("value").alias("value"), F.count("*").alias("n_arms"), F.avg("wall_seconds").alias("wall_seconds"))


def replication_summary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Seeds, mean, sd (n - 1), median and Monte Carlo standard error."""
    n, sd = F.countDistinct("seed"), F.stddev_samp("value")
    return cells.groupBy(*keys).agg(n.alias("n_seeds"), F.avg("value").alias("mean"), sd.alias("sd"), F.percentile("value", 0.5).alias("median"), (sd / F.sqrt(F.count("value"))).alias("mc_se"))


def failure_summary(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct failed cells and their sorted reasons, joined and cut at 600 characters."""
    bad = ledger.where("status = 'failed'")
    return bad.groupBy(*keys).agg(F.countDistinct("cell_key").alias("failed_cells"), F.substring(F.array_join(F.array_sort(F.collect_set("failure_reason")), "; "), 1, 600).alias("reasons"))


def failure_rates(ledger: DataFrame, keys: list[str]) -> DataFrame:
    failed = F.countDistinct(F.when(F.col("status") == "failed", F.col("cell_key")))
    return ledger.groupBy(*keys).agg(F.countDistinct("cell_key").alias("cells"), failed.alias("failed"), (failed / F.countDistinct("cell_key")).alias("rate"))


def cost_summary(ledger: DataFrame, keys: list[str], value: str = "wall_seconds") -> DataFrame:
    once = ledger.groupBy(*keys, "cell_key").agg(F.max(value).alias("v"))
    return once.groupBy(*keys).agg(F.percentile("v", 0.5).alias("median"), F.max("v").alias("largest"), F.count("*").alias("cells"))


def evaluated(laws: DataFrame, evaluators: dict[str, Callable[[DataFrame], DataFrame]], key: str) -> DataFrame:
    """key, metric, value, status and failure_reason: every evaluator's value (columns key and value) for each key of laws.

    An evaluator that raises marks its metric failed for all keys, with the reason; a key without a value is
    not_applicable. Each evaluator's result is stored at once, so that its faults show here and spare the others.
    """
    keys = stored(laws.select(key).distinct())
    out = None
    for metric, f in evaluators.items():
        try:
            got = stored(f(laws).select(key, F.col("value").cast("double").alias("value")))
            rows = keys.join(got, key, "left").select(key, F.lit(metric).alias("metric"), "value", F.when(F.col("value").isNull(), "not_applicable").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("failure_reason"))
        except Exception as fault:  # whatever a user's evaluator raises
            reason = f"{type(fault).__name__}: {fault}".partition("\n")[0][:600]
            rows = keys.select(key, F.lit(metric).alias("metric"), F.lit(None).cast("double").alias("value"), F.lit("failed").alias("status"), F.lit(reason).alias("failure_reason"))
        out = rows if out is None else out.unionByName(rows)
    return out


def rmse_delta(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Root mean square over replications and its delta-method standard error."""
    v2 = F.col("value") * F.col("value")
    g = cells.groupBy(*keys).agg(F.sqrt(F.avg(v2)).alias("rmse"), F.stddev_samp(v2).alias("_s"), F.count("*").alias("n"))
    return g.select(*keys, "rmse", F.try_divide(F.col("_s") / F.sqrt("n"), 2 * F.col("rmse")).alias("se"), "n")


def rmse_jackknife(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Seed mean squares first, then the root of their mean; the standard error leaves out one seed at a time."""
    by_seed = cells.groupBy(*keys, "seed").agg(F.avg(F.col("value") * F.col("value")).alias("ms"))
    tot = by_seed.groupBy(*keys).agg(F.sum("ms").alias("_s"), F.count("*").alias("_n"))
    left = by_seed.join(tot, keys).withColumn("loo", F.sqrt((F.col("_s") - F.col("ms")) / F.nullif(F.col("_n") - 1, F.lit(0))))
    n = F.first("_n")
    return left.groupBy(*keys).agg(F.sqrt(F.first("_s") / n).alias("rmse"), F.sqrt((n - 1) * F.var_pop("loo")).alias("se"), n.alias("n_seeds"))


def mean_or_rmse(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Root mean square for metrics named *_rmse, else the mean; keys hold metric."""
    return cells.groupBy(*keys).agg(F.when(F.col("metric").endswith("_rmse"), F.sqrt(F.avg(F.col("value") * F.col("value")))).otherwise(F.avg("value")).alias("summary"))


def pooled_by_family(cells: DataFrame, family: Column, keys: list[str]) -> DataFrame:
    """Squares averaged over a family's designs within seed before the root, then the jackknife."""
    fam = cells.withColumn("family", family).groupBy("family", *keys, "seed").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("value"))
    return rmse_jackknife(fam, ["family", *keys])


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner pairs of two slices by keys, duplicates averaged first; null keys match null keys. Columns a, b, d = a - b."""
    one = a.groupBy(*keys).agg(F.avg("value").alias("a"))
    two = b.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.avg("value").alias("b"))
    on = [one[k].eqNullSafe(two[f"_{k}"]) for k in keys]
    return one.join(two, on).select(*keys, "a", "b", (F.col("a") - F.col("b")).alias("d"))


def paired_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean difference, its SE, normal p-value (zero SE gives 0 or 1), win share of a (lower is better), relative %, ratio."""
    n, mean = F.count("*"), F.avg("d")
    se = F.stddev_samp("d") / F.sqrt(n)
    g = pairs.groupBy(*keys).agg(n.alias("n"), mean.alias("mean_diff"), se.alias("se"), F.avg((F.col("d") < 0).cast("double")).alias("win_share"), F.avg("b").alias("_b"))
    p = F.when(F.col("se") > 0, normal_tail(F.col("mean_diff") / F.col("se"))).when(F.col("mean_diff") == 0, F.lit(1.0)).when(F.col("se").isNotNull(), F.lit(0.0))
    return g.select(*keys, "n", "mean_diff", "se", p.alias("p"), "win_share", F.try_divide(100 * F.col("mean_diff"), F.abs("_b")).alias("relative"), F.try_divide(F.col("mean_diff"), F.col("se")).alias("ratio"))


def decided(stats: DataFrame, higher_is_better: Column | None = None, least: int = 3) -> DataFrame:
    """wins_a, wins_b or tie by two standard errors, and too_few below least pairs; the sign flips for higher-is-better metrics."""
    sign = F.when(higher_is_better, F.lit(-1.0)).otherwise(F.lit(1.0)) if higher_is_better is not None else F.lit(1.0)
    m = F.col("mean_diff") * sign
    verdict = F.when(F.col("n") < least, "too_few").when(m < -2 * F.col("se"), "wins_a").when(m > 2 * F.col("se"), "wins_b").otherwise("tie")
    return stats.withColumn("verdict", verdict)


def paired_rmse(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of two root mean squares over pairs, with a delta-method SE from variances and covariance, and a 95 % band."""
    a2, b2 = F.col("a") * F.col("a"), F.col("b") * F.col("b")
    g = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(a2)).alias("ra"), F.sqrt(F.avg(b2)).alias("rb"), F.var_samp(a2).alias("va"), F.var_samp(b2).alias("vb"), F.covar_samp(a2, b2).alias("cab"))
    var = F.col("va") / (4 * F.col("ra") * F.col("ra")) + F.col("vb") / (4 * F.col("rb") * F.col("rb")) - F.col("cab") / (2 * F.col("ra") * F.col("rb"))
    d = F.col("ra") - F.col("rb")
    se = F.sqrt(F.greatest(var, F.lit(0.0)) / F.col("n"))
    return g.select(*keys, "n", d.alias("diff"), se.alias("se"), (d - 1.96 * se).alias("low"), (d + 1.96 * se).alias("high"))


def method_pairs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of methods, in name order, within keys and seed."""
    a = cells.select(*keys, "seed", F.col("method").alias("left"), F.col("value").alias("a"))
    b = cells.select(*keys, "seed", F.col("method").alias("right"), F.col("value").alias("b"))
    return a.join(b, [*keys, "seed"]).where("left < right").withColumn("d", F.col("a") - F.col("b"))


def merge_audit(manifest: DataFrame, ledger: DataFrame, fields: list[str], shard: str = "shard") -> DataFrame:
    """One row of counts: missing, unknown and split keys, field mismatches, bad statuses, and PASS or FAIL.

    manifest has one row per cell_key with its fields.
    """
    seen = ledger.select("cell_key", *fields).distinct()
    both = seen.join(manifest.select("cell_key", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(1).alias("_in")), "cell_key", "full")
    wrong = F.lit(False)
    for f in fields:
        wrong = wrong | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    known = both.withColumn("_seen", F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull())
    keys = known.agg(F.count(F.when(~F.col("_seen"), 1)).alias("missing"), F.count(F.when(F.col("_in").isNull(), 1)).alias("unknown"), F.count(F.when(F.col("_seen") & F.col("_in").isNotNull() & wrong, 1)).alias("mismatched"))
    split = ledger.groupBy("cell_key").agg(F.countDistinct(shard).alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("split"))
    status = ledger.agg(F.count(F.when(~F.coalesce(F.col("status").isin("ok", "not_applicable", "failed"), F.lit(False)), 1)).alias("bad_status"))
    one = keys.crossJoin(split).crossJoin(status)  # three single rows
    good = (F.col("missing") == 0) & (F.col("unknown") == 0) & (F.col("mismatched") == 0) & (F.col("split") == 0) & (F.col("bad_status") == 0)
    return one.withColumn("verdict", F.when(good, "PASS").otherwise("FAIL"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def one_factor(cells: DataFrame, primary: tuple[int, int], keys: list[str]) -> DataFrame:
    """Paired differences of each (n_grid, n_particles) pair that changes one factor from the primary pair."""
    k, m = primary
    base = cells.where((F.col("n_grid") == k) & (F.col("n_particles") == m))
    other = cells.where(((F.col("n_grid") == k).cast("int") + (F.col("n_particles") == m).cast("int")) == 1)
    a = other.groupBy(*keys, "seed", "n_grid", "n_particles").agg(F.avg("value").alias("a"))
    b = base.groupBy(*keys, "seed").agg(F.avg("value").alias("b"))
    return paired_stats(a.join(b, [*keys, "seed"]).withColumn("d", F.col("a") - F.col("b")), [*keys, "n_grid", "n_particles"])


def full_factorial(cells: DataFrame, keys: list[str], pairs: int = 9) -> DataFrame:
    """Replication summaries of the groups that have every (n_grid, n_particles) pair."""
    whole = cells.groupBy(*keys).agg(F.countDistinct("n_grid", "n_particles").alias("_p")).where(F.col("_p") == pairs).select(*keys)
    return replication_summary(cells.join(whole, keys, "left_semi"), [*keys, "n_grid", "n_particles"])


def resolution_decision(stats: DataFrame, tolerance: float, gain: float) -> DataFrame:
    """For each pair: whether every metric stays within tolerance % of the primary (rule A) or some metric gains gain % (rule B), and a rank."""
    g = stats.groupBy("n_grid", "n_particles").agg(F.bool_and(F.col("relative") <= tolerance).alias("within"), F.bool_or(F.col("relative") <= -gain).alias("gains"), F.avg("relative").alias("mean_relative"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("within").desc(), "mean_relative", "n_grid", "n_particles")
    return g.withColumn("place", F.row_number().over(order))  # one row for each pair of settings


def expected_check(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """label, want, got, passes: expected values with a tolerance against computed ones; missing ones fail."""
    j = expected.join(found.select(F.col(key).alias("label"), F.col("value").alias("got")), "label", "left")
    return j.select("label", "want", "got", F.coalesce(F.abs(F.col("got") - F.col("want")) <= F.col("tol"), F.lit(False)).alias("passes"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old ledger with all rows of the new one's keys replaced."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def archived(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The failed old rows that a retry replaces."""
    return old.where("status = 'failed'").join(new.select(*keys).distinct(), keys, "left_semi")


def verdict(diff: Column, se: Column) -> Column:
    """claimant, comparator, tie or absent by two standard errors; lower is better."""
    return F.when(diff.isNull(), "absent").when(diff < -2 * se, "claimant").when(diff > 2 * se, "comparator").otherwise("tie")


def running_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable count, sum and sum of squares."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"))


def moments_summary(m: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and standard error of merged moments."""
    g = m.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    var = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    return g.select(*keys, "n", (F.col("s1") / F.col("n")).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0)) / F.col("n")).alias("se"))
