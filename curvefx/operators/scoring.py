"""Estimates against supplied truth: a row for every declared view, target and metric, with a status where there is no value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import stored

NO_TARGET, NO_TRUTH, BROKEN = "target not in the manifest", "no truth for this target", "estimates are not finite"


def target_rows(estimates: DataFrame, truth: DataFrame, declared: DataFrame) -> DataFrame:
    """view, target, metric, bin, status, value, failure_reason: estimates (view, target, unit_id, value) against truth (target, unit_id, bin, value).

    For every view and target of declared: tate_estimate, tate_oracle and tate_abs_error of the averages over units, and
    tcate_rmse over bins (bin -1); tcate_estimate and tcate_oracle by bin. An estimate counts at units that have a truth.
    A target without estimates of a view, or without truth, is not_applicable; one with null, NaN or infinite estimates
    has failed. Such a target has its rows of bin -1 with null values. One aggregation reads the estimates.
    """
    t = truth.select("target", "unit_id", "bin", F.col("value").alias("_t"))
    return rows_of_pairs(estimates.join(t, ["target", "unit_id"]), truth.select("target").distinct(), declared)


def wide_rows(units: DataFrame, estimates: dict[tuple[str, str], Column], truth: dict[str, Column], declared: DataFrame) -> DataFrame:
    """target_rows() where a unit's row holds its bin, its estimates by view and target, and its truths by target: nothing is joined."""
    pair = lambda view, target, v: F.struct(F.lit(view).alias("view"), F.lit(target).alias("target"), v.cast("double").alias("value"), truth[target].cast("double").alias("_t"))
    met = [pair(*k, v) for k, v in estimates.items() if k[1] in truth]
    empty = "array<struct<view: string, target: string, value: double, _t: double>>"
    pairs = units.select("bin", F.inline(F.array(*met) if met else F.array().cast(empty)))
    known = units.limit(1).select(F.explode(F.array(*map(F.lit, truth)).cast("array<string>")).alias("target"))  # no truth without units
    return rows_of_pairs(pairs, known, declared)


def rows_of_pairs(pairs: DataFrame, known: DataFrame, declared: DataFrame) -> DataFrame:
    """target_rows() of view, target, bin, value and _t, an estimate beside its truth; known has the targets that have any."""
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    g = stored(pairs.groupBy("view", "target", "bin").agg(F.count("*").alias("n"), F.sum(F.when(fine, F.col("value"))).alias("e"), F.sum("_t").alias("o"), F.count(F.when(~fine, 1)).alias("bad")))
    whole = g.groupBy("view", "target").agg(
        (F.sum("e") / F.sum("n")).alias("tate_estimate"), (F.sum("o") / F.sum("n")).alias("tate_oracle"), (F.abs(F.sum("e") - F.sum("o")) / F.sum("n")).alias("tate_abs_error"),
        F.sqrt(F.avg(F.pow((F.col("e") - F.col("o")) / F.col("n"), 2))).alias("tcate_rmse"), F.sum("bad").alias("bad"),
    )
    known = known.withColumn("_truth", F.lit(True))
    j = declared.select("view", "target").distinct().join(whole, ["view", "target"], "left").join(known, "target", "left")
    reason = F.when(F.col("_truth").isNull(), NO_TRUTH).when(F.col("bad").isNull(), NO_TARGET).when(F.col("bad") > 0, BROKEN)
    j = j.withColumn("failure_reason", reason).withColumn("status", F.when(reason.isNull(), "ok").when(reason == BROKEN, "failed").otherwise("not_applicable"))
    metrics = ["tate_estimate", "tate_oracle", "tate_abs_error", "tcate_rmse"]
    value = lambda m: F.when(F.col("status") == "ok", F.col(m))
    marginal = j.select("view", "target", "status", "failure_reason", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), value(m).alias("value")) for m in metrics]))).withColumn("bin", F.lit(-1))
    good = j.where("status = 'ok'").select("view", "target")
    by_bin = g.join(good, ["view", "target"]).select("view", "target", F.col("bin").cast("int").alias("bin"), F.inline(F.array(F.struct(F.lit("tcate_estimate").alias("metric"), (F.col("e") / F.col("n")).alias("value")), F.struct(F.lit("tcate_oracle").alias("metric"), (F.col("o") / F.col("n")).alias("value")))))
    names = ["view", "target", "metric", "bin", "status", "value", "failure_reason"]
    return marginal.select(names).unionByName(by_bin.withColumns({"status": F.lit("ok"), "failure_reason": F.lit(None).cast("string")}).select(names))


def resolved(payloads: DataFrame, targets: DataFrame) -> DataFrame:
    """target (the dense name), native and source: for each target the payload of least rank, then source, that holds its native name.

    payloads: source, rank, native; targets: target, native. Targets that no payload holds have a null source.
    """
    order = Window.partitionBy("target").orderBy(F.asc_nulls_last("rank"), "source")
    return targets.join(payloads, "native", "left").withColumn("_i", F.row_number().over(order)).where("_i = 1").select("target", "native", "source")


def dense_rows(estimates: DataFrame, truth: DataFrame, payloads: DataFrame, targets: DataFrame) -> DataFrame:
    """target_rows() of dense targets with the source that each was taken from: estimates have source and native in place of view and target."""
    chosen = resolved(payloads, targets)
    own = estimates.join(F.broadcast(chosen), ["source", "native"]).select(F.col("source").alias("view"), "target", "unit_id", "value")  # a row for each target
    rows = target_rows(own, truth, chosen.select(F.coalesce("source", F.lit("none")).alias("view"), "target"))
    return rows.withColumnRenamed("view", "source")


def dense_wide_rows(units: DataFrame, estimates: dict[tuple[str, str], Column], truth: dict[str, Column], payloads: DataFrame, targets: DataFrame) -> DataFrame:
    """dense_rows() where a unit's row holds its bin, its estimates by source and native target, and its truths by target."""
    chosen = resolved(payloads, targets).collect()  # a row for each target
    own = {(r["source"], r["target"]): estimates[r["source"], r["native"]] for r in chosen if (r["source"], r["native"]) in estimates}
    declared = units.sparkSession.createDataFrame([(r["source"] or "none", r["target"]) for r in chosen], "view string, target string")
    return wide_rows(units, own, truth, declared).withColumnRenamed("view", "source")


def long_values(df: DataFrame, keys: list[Column | str], values: dict[str, Column]) -> DataFrame:
    """keys, target and value, a row for each named value."""
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("target"), v.cast("double").alias("value")) for n, v in values.items()])))
