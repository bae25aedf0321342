"""Preparation of micro rows and unit tables: derivations, filters, joins, ranks, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def missing(c: Column) -> Column:
    """NaN and null as null."""
    return F.when(~F.isnan(c), c)


def numeric(c: Column) -> Column:
    """The number a string stands for, or null."""
    return c.try_cast("double")


def recode(c: Column, codes: dict, other: Column | None = None) -> Column:
    """Values by dictionary; other where the code is unknown."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), c)
    return F.coalesce(found, other) if other is not None else found


def min_group_size(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of groups with at least n rows. Sizes are aggregated first and joined back, so no group meets in a window."""
    big = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).drop("_n")
    return df.join(big, keys, "left_semi")


def splice(old: DataFrame, new: DataFrame, year: str, value: str, anchor: int) -> DataFrame:
    """The old index up to the anchor year, then the new one scaled to meet it there."""
    a = old.where(F.col(year) == anchor).agg(F.first(value).alias("_a"))
    b = new.where(F.col(year) == anchor).agg(F.first(value).alias("_b"))
    later = new.where(F.col(year) > anchor).crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).select(year, (F.col(value) * F.col("_a") / F.col("_b")).alias(value))  # one row each
    return old.where(F.col(year) <= anchor).select(year, value).union(later)


def trim(df: DataFrame, e: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(e).between(low, high))


def trim_report(df: DataFrame, e: str, low: float, high: float) -> DataFrame:
    """n, kept and the share kept."""
    inside = F.col(e).between(low, high)
    return df.agg(F.count("*").alias("n"), F.count(F.when(inside, 1)).alias("kept"), F.avg(inside.cast("double")).alias("share"))


def variants(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows of each named variant, in one pass over the units: a row appears once for each rule that it meets."""
    names = F.filter(F.array(*[F.when(rule, F.lit(n)) for n, rule in rules.items()]), lambda x: x.isNotNull())
    return df.select("*", F.explode(names).alias("variant"))


def first_known(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The first non-null value by order, per group."""
    return df.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))


def impute_median(df: DataFrame, c: str) -> DataFrame:
    """c with nulls replaced by the exact median, and c_imputed."""
    med = df.agg(F.median(c).alias("_m"))
    return df.crossJoin(F.broadcast(med)).withColumn(f"{c}_imputed", F.col(c).isNull()).withColumn(c, F.coalesce(c, "_m")).drop("_m")  # one row


def one_hot(df: DataFrame, c: str, levels: list, prefix: str) -> DataFrame:
    """0/1 columns of all levels but the first."""
    return df.select("*", *[(F.col(c) == v).cast("int").alias(f"{prefix}{i}") for i, v in enumerate(levels[1:], 1)])


def standardised(df: DataFrame, c: str, out: str, ddof: int = 0, by: list[str] | None = None) -> DataFrame:
    """(c - mean) / sd overall or by group; 0 where the sd is 0. Moments are aggregated and joined back."""
    sd = F.stddev_pop(c) if ddof == 0 else F.stddev_samp(c)
    m = df.groupBy(*(by or [])).agg(F.avg(c).alias("_mu"), sd.alias("_sd"))
    back = df.join(m, by) if by else df.crossJoin(F.broadcast(m))  # one row without groups
    return back.withColumn(out, F.when(F.col("_sd") > 0, (F.col(c) - F.col("_mu")) / F.col("_sd")).otherwise(F.when(F.col("_sd").isNotNull(), F.lit(0.0)))).drop("_mu", "_sd")


class KeyNotUnique(ValueError):
    pass


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise KeyNotUnique(f"rows share {keys}")
    return df


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose right keys must be unique."""
    return left.join(assert_unique(right, keys), keys, how)


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return assert_unique(left, keys).join(assert_unique(right, keys), keys, how)


def disagreements(left: DataFrame, right: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Matched keys and the number whose field differs, null-safely."""
    j = left.select(*keys, F.col(field).alias("_l")).join(right.select(*keys, F.col(field).alias("_r")), keys)
    return j.agg(F.count("*").alias("n"), F.count(F.when(~F.col("_l").eqNullSafe(F.col("_r")), 1)).alias("n_differ"))


def lagged(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The previous row's columns within group as lag_c; the previous row, not the previous period."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.select("*", *[F.lag(c).over(w).alias(f"lag_{c}") for c in columns])


def ecdf_moderator(df: DataFrame, value: str, key: str, out: str = "m") -> DataFrame:
    """2 (rank + 0.5) / n - 1 with a global rank from 0 by value, then key."""
    n = df.count()
    ranked = ordered.global_rank(df, [F.col(value), F.col(key)], "_rank")
    return ranked.withColumn(out, 2.0 * (F.col("_rank") + 0.5) / F.lit(max(n, 1)) - 1.0).drop("_rank")


def moderator_bin(m: Column) -> Column:
    """Number of the edges -0.5, 0, 0.5 at or below m."""
    return sum(((m >= e).cast("int") for e in (0.0, 0.5)), (m >= -0.5).cast("int"))


def rank_in_group(df: DataFrame, group: str, order: list[Column], out: str = "rank") -> DataFrame:
    """df with the row's place from 0 in its group: over sorted ranges with offsets, so that no group meets in one task."""
    ranked = ordered.ranges(df, [group], order)
    sizes = ranked.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_start"))
    row = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)) - 1
    placed = ranked.withColumn("_i", row).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    return placed.withColumn(out, (F.col("_i") + F.col("_start")).cast("long")).drop("_range", "_i", "_start", "_group", "_at")


def folds_by_rank(df: DataFrame, arm: str, order: list[Column], folds: int, out: str = "fold") -> DataFrame:
    """Round robin within arms over a global order, which should end with a unique key."""
    return rank_in_group(df, arm, order, out).withColumn(out, (F.col(out) % folds).cast("int"))


def seeded_order(seed: int, key: str) -> Column:
    """An order that depends on seed and key alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def folds_seeded(df: DataFrame, arm: str, key: str, seed: int, folds: int, out: str = "fold") -> DataFrame:
    return folds_by_rank(df.withColumn("_h", seeded_order(seed, key)), arm, [F.col("_h"), F.col(key)], folds, out).drop("_h")


def order_statistics(df: DataFrame, order: list[Column], m: int) -> DataFrame:
    """The rows at ranks floor((i + 0.5) n / m) for i = 0 .. m - 1, as atom_id i."""
    n = df.count()
    picks = [(i, int((i + 0.5) * n / m)) for i in range(m)]
    chosen = df.sparkSession.createDataFrame(picks, "atom_id int, rank long")
    return ordered.global_rank(df, order).join(F.broadcast(chosen), "rank").drop("rank")


def evenly_spaced(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """All rows, or most of them at evenly spaced ranks."""
    n = df.count()
    if n <= most:
        return df
    picks = sorted({int(i * (n - 1) / (most - 1)) for i in range(most)})
    chosen = df.sparkSession.createDataFrame([(p,) for p in picks], "rank long")
    return ordered.global_rank(df, order).join(F.broadcast(chosen), "rank").drop("rank")
