"""Weighted quantile curves of pools and units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..grid import array_of, check_levels, midpoint_levels
from ..shipping import ship
from . import ordered
from .pairs import lists, rows_of, whole_groups

ship(__name__)
ship(whole_groups.__module__)


def usable(y: str, w: str) -> Column:
    """Finite outcome and finite positive weight; NaN and null both mean missing."""
    yy, ww = F.col(y), F.col(w)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return finite(yy.cast("double")) & finite(ww.cast("double")) & (ww > 0)


def covered_levels(knots: DataFrame, keep: list[str], y: str, levels: list[float]) -> DataFrame:
    """keep, k, q: each knot row (c, c0, y, y0) emits the levels in (c0, c], interpolated from the row before."""
    u = array_of(levels)
    hit = F.filter(F.transform(u, lambda x, i: F.struct((i + 1).alias("k"), x.alias("u"))), lambda e: (e["u"] <= F.col("c")) & (F.col("c0").isNull() | (e["u"] > F.col("c0"))))
    rows = knots.select(*keep, F.col(y).cast("double").alias("_y"), "c", "c0", "y0", F.explode(hit).alias("e"))
    value = F.when(F.col("c0").isNull(), F.col("_y")).otherwise(F.col("y0") + (F.col("e.u") - F.col("c0")) / (F.col("c") - F.col("c0")) * (F.col("_y") - F.col("y0")))
    return rows.select(*keep, F.col("e.k").alias("k"), value.alias("q"))


#: Usable rows of one unit above which its cumulative sums run over sorted ranges instead of in one task; buckets that units are counted by first.
LARGE_UNIT, BUCKETS = 1_000_000, 1 << 16


def large_units(rows: DataFrame, unit: str, bound: int | None = None) -> DataFrame | None:
    """The units of more than bound rows, or None. Rows are counted by buckets of units first, then by unit in buckets above bound alone."""
    bound = bound or LARGE_UNIT
    keyed = rows.select(unit).withColumn("_b", F.pmod(F.xxhash64(unit), F.lit(BUCKETS)))
    full = [r["_b"] for r in keyed.groupBy("_b").count().where(F.col("count") > bound).collect()]  # at most one for bound rows, and BUCKETS
    if not full:
        return None
    hot = rows.sparkSession.createDataFrame([(b,) for b in full], "_b long")
    found = ordered.stored(keyed.join(F.broadcast(hot), "_b").groupBy(unit).count().where(F.col("count") > bound).select(F.col(unit).alias("_unit")))
    return None if found.isEmpty() else found


def totals(w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums of w inside each group, added one after another from its first row."""
    whole = np.cumsum(w)
    if whole[-1] < 2**53 and (w == np.rint(w)).all():  # whole numbers: any order gives the same
        return whole - np.repeat(np.concatenate([[0.0], whole])[starts[:-1]], np.diff(starts))
    size, out = np.diff(starts), np.empty_like(w)
    order = np.argsort(size, kind="stable")
    for g in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):  # groups of one size
        at = starts[g][:, None] + np.arange(size[g[0]])
        out[at] = np.cumsum(w[at], 1)
    return out


def group_curves(y: np.ndarray, w: np.ndarray, starts: np.ndarray, grids: list[list[float]]) -> list[np.ndarray]:
    """For each grid the curves (groups, levels) of groups of usable rows, each in order of y; covered_levels() for many groups at once."""
    run, last = totals(w, starts), starts[1:] - 1
    c = run / np.repeat(run[last], np.diff(starts))
    first = np.zeros(len(y), bool)
    first[starts[:-1]] = True
    out = []
    for levels in grids:
        u = np.array(levels)
        reached = np.searchsorted(u, c, side="right")  # levels at or below a row's share
        i = np.repeat(np.arange(len(y)), reached - np.where(first, 0, np.concatenate([[0], reached[:-1]])))
        j, u = np.maximum(i - 1, 0), np.tile(u, len(last))
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(first[i], y[i], y[j] + (u - c[j]) / (c[i] - c[j]) * (y[i] - y[j]))
        out.append(value.reshape(len(last), -1))
    return out


def spread_curves(rows: DataFrame, unit: str, levels: list[float]) -> DataFrame:
    """unit, q of units of any size, from cumulative sums over sorted ranges."""
    return as_arrays(covered_levels(ordered.running_share(rows, [unit], "y", "w", [F.col("y"), F.col("w")]), [unit], "y", levels), [unit])


def unit_curves_on(df: DataFrame, unit: str, y: str, w: str, grids: dict[str, list[float]], spread: bool | None = None) -> DataFrame:
    """unit and a curve for each named grid of levels, for every unit with a usable row.

    A row goes to its unit's task once; there rows are sorted by unit alone, put in order of y and w a few units at a time,
    and the curves of all grids are made from that one run. Units of more
    than LARGE_UNIT rows are too large for one task, and their sums run over sorted ranges; spread takes all or (False)
    none of the units so. The result is the same.
    """
    grids = {n: check_levels(levels) for n, levels in grids.items()}
    rows = df.where(usable(y, w)).select(F.col(unit), F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"))

    def over_ranges(part: DataFrame) -> DataFrame:
        out = None
        for n, levels in grids.items():
            one = spread_curves(part, unit, levels).select(F.col(unit).alias("_unit"), F.col("q").alias(n))
            out = one if out is None else out.join(one.withColumnRenamed("_unit", "_other"), F.col("_unit").eqNullSafe(F.col("_other"))).drop("_other")
        return out.withColumnRenamed("_unit", unit)

    if spread:
        return over_ranges(rows)
    large = large_units(rows, unit) if spread is None else None
    schema = T.StructType([rows.schema[unit], *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in grids]])
    kinds, levels_ = to_arrow_schema(schema), list(grids.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, [unit]):
            y_, w_ = t["y"].to_numpy(), t["w"].to_numpy()
            order = np.lexsort((w_, y_, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
            made = group_curves(y_[order], w_[order], starts, levels_)
            yield rows_of([t[unit].take(pa.array(starts[:-1])), *map(lists, made)], kinds)

    own = lambda part: part.repartition(unit).sortWithinPartitions(unit).mapInArrow(run, schema)
    if large is None:
        return own(rows)
    same = F.col(unit).eqNullSafe(F.col("_unit"))
    return own(rows.join(F.broadcast(large), same, "left_anti")).unionByName(over_ranges(rows.join(F.broadcast(large), same, "left_semi")))  # one for LARGE_UNIT rows


def unit_curves_long(df: DataFrame, unit: str, y: str, w: str, levels: list[float] | None = None, spread: bool | None = None) -> DataFrame:
    """unit, k, q for every unit with a usable row, as unit_curves() has them."""
    return as_long(unit_curves(df, unit, y, w, levels, spread), [unit])


def as_arrays(long: DataFrame, keys: list[str]) -> DataFrame:
    """keys, q ARRAY<DOUBLE> from the long form; interpolated order statistics rise with the levels by themselves."""
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda e: e["q"]).alias("q"))


def as_long(df: DataFrame, keys: list[str], q: str = "q") -> DataFrame:
    return df.select(*keys, F.posexplode(q).alias("_i", "q")).select(*keys, (F.col("_i") + 1).alias("k"), "q")


def unit_curves(df: DataFrame, unit: str, y: str, w: str, levels: list[float] | None = None, spread: bool | None = None) -> DataFrame:
    """One curve per unit; units without a usable row are dropped. spread is as for unit_curves_on()."""
    return unit_curves_on(df, unit, y, w, {"q": levels or midpoint_levels()}, spread)


def pool_quantiles(df: DataFrame, y: str, w: str, levels: list[float] | None = None, by: list[str] | None = None) -> DataFrame:
    """by, k, q of whole pools, each over sorted ranges."""
    levels = check_levels(levels or midpoint_levels())
    by = by or []
    rows = df.where(usable(y, w)).select(*by, F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"))
    return covered_levels(ordered.running_share(rows, by, "y", "w", [F.col("y"), F.col("w")]), by, "y", levels)


def average_curve(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Equal-weight average of curves at each level."""
    return long.groupBy(*(by or []), "k").agg(F.avg("q").alias("q"))


def exact_quantiles(ranged: DataFrame, value: str, levels: list[float]) -> DataFrame:
    """One row, quantiles: those (type 7) of a column without nulls, from ordered.ranges by it; only ranges with a wanted place are put in order."""
    counts = {x["_range"]: x["n"] for x in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # one row for each range
    n, before, starts = sum(counts.values()), 0, {}
    for x in sorted(counts):
        starts[x] = before
        before += counts[x]
    wanted = [(i, int(p * (n - 1)) + e, abs(1 - e - (p * (n - 1) - int(p * (n - 1))))) for i, p in enumerate(levels) for e in (0, 1) if n]
    wanted = [(i, min(at, n - 1), share) for i, at, share in wanted]
    picks = [(i, x, at - starts[x], share) for i, at, share in wanted for x in counts if starts[x] <= at < starts[x] + counts[x]]
    spark = ranged.sparkSession
    chosen = spark.createDataFrame(picks, "_i int, _range int, _at int, _share double")
    rows = ranged.where(F.col("_range").isin([x for _, x, _, _ in picks])).withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(value)) - 1)
    got = rows.join(F.broadcast(chosen), ["_range", "_at"]).groupBy("_i").agg(F.sum(F.col(value) * F.col("_share")).alias("v"))
    return got.agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "v"))), lambda e: e["v"]).alias("quantiles"))
