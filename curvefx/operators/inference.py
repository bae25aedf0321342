"""Regressions with clustered errors, weighted contrasts, balance, resampling and calibration, from grouped sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import draws
from ..functions.curves import curve_dist2
from ..grid import check_levels, midpoint_levels
from ..shipping import ship
from . import ordered, prep, quantiles
from .ordered import ranges
from .pairs import lists, rows_of, small_units, whole_groups
from .quantiles import LARGE_UNIT, group_curves, unit_curves, usable
from .trees import matrix

ship(__name__)
ship(draws.__name__)
ship(whole_groups.__module__)
ship(quantiles.__name__)

#: Units whose arms are dealt at a time, for all draws.
UNITS = 256


def ols_cluster(df: DataFrame, y: str, x: list[str], cluster: str, extra_df: int = 0) -> DataFrame:
    """term, coef, se: least squares of y on an intercept and x with CR1 errors.

    Spark sums the Gram matrix and each cluster's scores; only p x p numbers reach the driver. extra_df counts
    parameters that were partialled out before.
    """
    names = ["_one", *x]
    d = df.withColumn("_one", F.lit(1.0))
    prods = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    s = d.agg(F.count("*").alias("n"), F.countDistinct(cluster).alias("m"), *prods, *[F.sum(F.col(a) * F.col(y)).alias(f"v{i}") for i, a in enumerate(names)]).first()
    p = len(names)
    gram = np.array([[s[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    bread = np.linalg.pinv(gram)
    beta = bread @ np.array([s[f"v{i}"] for i in range(p)])
    resid = F.col(y) - sum(F.lit(float(b)) * F.col(c) for b, c in zip(beta[1:], x)) - F.lit(float(beta[0]))
    scores = d.withColumn("_u", resid).groupBy(cluster).agg(*[F.sum(F.col(c) * F.col("_u")).alias(f"s{i}") for i, c in enumerate(names)])
    m = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(p)]).first()
    meat = np.array([[m[f"m{i}_{j}"] for j in range(p)] for i in range(p)])
    k = p + extra_df
    scale = s["m"] / (s["m"] - 1) * (s["n"] - 1) / (s["n"] - k)
    se = np.sqrt(np.diag(bread @ meat @ bread) * scale)
    return df.sparkSession.createDataFrame([("intercept" if i == 0 else n, float(b), float(e)) for i, (n, b, e) in enumerate(zip(names, beta, se))], "term string, coef double, se double")


def demeaned(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """columns less their group means."""
    means = df.groupBy(by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    j = df.join(means, by)
    return j.select(*[c for c in df.columns if c not in columns], *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns])


def weighted_difference(df: DataFrame, y: str, w: str, arm: str, cluster: str) -> DataFrame:
    """diff, se of the weighted difference in means, influence values summed by cluster."""
    tot = df.groupBy(arm).agg(F.sum(w).alias("_W"), (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("_mu"))
    sign = F.when(F.col(arm) == 1, 1.0).otherwise(-1.0)
    psi = sign * F.col(w) / F.col("_W") * (F.col(y) - F.col("_mu"))
    c = df.join(F.broadcast(tot), arm).groupBy(cluster).agg(F.sum(psi).alias("_p"))  # two rows
    diff = tot.agg(F.sum(sign * F.col("_mu")).alias("diff"))
    return diff.crossJoin(c.agg(F.sqrt(F.sum(F.col("_p") * F.col("_p"))).alias("se"), F.count("*").alias("clusters")))  # single rows


def standardised_differences(df: DataFrame, arm: str, columns: dict[str, Column], ddof: int = 0) -> DataFrame:
    """feature, smd: mean difference over the root of the mean variance."""
    var = F.var_pop if ddof == 0 else F.var_samp
    names = list(columns)
    long = df.select(arm, *[c.cast("double").alias(n) for n, c in columns.items()]).unpivot([arm], names, "feature", "v")
    on = lambda k: F.when(F.col(arm) == k, F.col("v"))
    g = long.groupBy("feature").agg(F.avg(on(1)).alias("m1"), F.avg(on(0)).alias("m0"), var(on(1)).alias("v1"), var(on(0)).alias("v0"))
    return g.select("feature", F.try_divide(F.col("m1") - F.col("m0"), F.sqrt((F.col("v1") + F.col("v0")) / 2)).alias("smd"))


def permutation_test(df: DataFrame, key: str, y: str, arm: str, rounds: int, seed: int = 0) -> DataFrame:
    """observed, p_plus_one, p_share of the mean difference under seeded reassignments, rounds of them, with the same number treated in expectation.

    Each row makes its own assignment in every draw, so draws add up inside tasks; the table of units is read once.
    """
    share = df.agg(F.avg(F.col(arm).cast("double")).alias("_s"))
    u = draws.uniform(F.lit(seed), F.col("draw"), F.col(key))
    many = df.select(key, F.col(y).alias("_y"), F.col(arm).alias("_a")).crossJoin(F.broadcast(share)).withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(rounds - 1))))  # one row of share
    on = F.when(F.col("draw") < 0, F.col("_a") == 1).otherwise(u < F.col("_s"))
    d = many.groupBy("draw").agg((F.avg(F.when(on, F.col("_y"))) - F.avg(F.when(~on, F.col("_y")))).alias("d"))
    seen = d.where("draw < 0").select(F.col("d").alias("observed"))
    hits = F.sum((F.abs("d") >= F.abs("observed")).cast("long"))
    return d.where("draw >= 0").crossJoin(F.broadcast(seen)).agg(F.first("observed").alias("observed"), ((hits + 1) / (F.count("*") + 1)).alias("p_plus_one"), (hits / F.count("*")).alias("p_share"))  # one row


def permutation_tests(df: DataFrame, key: str, y: str, arm: str, rounds: int, bin: str | None = None, bins: int = 4, seed: int = 0) -> DataFrame:
    """scope, part, observed, p_plus_one, p_share of arm differences: of y's average (scope all), by bin, and by coordinate of y (an array).

    In every draw a unit is treated by its own seeded number, with the share of treated units as its chance. A task turns
    its units into a matrix of draws by scopes of sums and counts; those matrices alone travel, and meet by scope. key
    holds whole numbers of at least 0. Scopes without both arms have a null difference and no p.
    """
    share = df.agg(F.avg(F.col(arm).cast("double"))).first()[0]
    if share is None:
        return df.sparkSession.createDataFrame([], "scope string, part int, observed double, p_plus_one double, p_share double")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(arm).cast("int").alias("a"), F.col(y).alias("y"), (F.col(bin).cast("int") if bin else F.lit(-1)).alias("bin"))
    limit = int(share * draws.PRIME)
    n_bins = bins if bin else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = None, np.arange(rounds)[:, None]
        for b in batches:
            for at in range(0, b.num_rows, UNITS):
                c = b.slice(at, UNITS)
                ids, a, bin_ = (c.column(c.schema.get_field_index(n)).to_numpy() for n in ("key", "a", "bin"))
                q = matrix(c, "y")
                mean, inside = q.mean(1)[:, None], (bin_[:, None] == np.arange(n_bins)).astype(float)
                values = np.hstack([mean, mean * inside, q, np.ones_like(mean), inside])
                treated = np.vstack([(a == 1)[None], draws.mixed(seed, ids[None, :], number) < limit]).astype(float)
                part = np.stack([treated @ values, np.repeat(values.sum(0)[None], rounds + 1, 0)])
                total = part if total is None else total + part
        if total is not None:
            columns = np.moveaxis(total, 2, 0).reshape(total.shape[2], -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(columns)), pa.int32()), pa.array(list(columns), pa.list_(pa.float64()))], ["scope", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), matrix(b, "v")):
                sums[k] = sums[k] + v if k in sums else v.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["scope", "v"])

    kind = "scope int, v array<double>"
    got = {r["scope"]: np.array(r["v"]).reshape(2, -1) for r in rows.mapInArrow(deal, kind).repartition("scope").mapInArrow(add, kind).collect()}  # draws for each scope
    levels = len(got) - 2 - 2 * n_bins
    base = 1 + n_bins + levels  # where counts begin
    out = []
    for i in range(base):
        count = got[base + (i if i <= n_bins else 0)]
        with np.errstate(divide="ignore", invalid="ignore"):
            d = got[i][0] / count[0] - (got[i][1] - got[i][0]) / (count[1] - count[0])
        fine = np.isfinite(d[1:])
        hits = int((np.abs(d[1:][fine]) >= abs(d[0])).sum())
        name, part = ("all", -1) if i == 0 else ("bin", i - 1) if i <= n_bins else ("coordinate", i - 1 - n_bins)
        ok = np.isfinite(d[0]) and fine.any()
        out.append((name, part, float(d[0]) if np.isfinite(d[0]) else None, (hits + 1) / (int(fine.sum()) + 1) if ok else None, hits / int(fine.sum()) if ok else None))
    return df.sparkSession.createDataFrame(out, "scope string, part int, observed double, p_plus_one double, p_share double")


def bootstrap_rows(df: DataFrame, unit: str, key: list[str], seed: int, draw: Column | None = None) -> DataFrame:
    """A resample of each unit's rows of the same size: row i of a unit takes the row at a seeded place. Units may be of any size."""
    numbered = prep.rank_in_group(df, unit, [F.col(k) for k in key], "_row").withColumnRenamed("_row", "_i")
    size = df.groupBy(unit).agg(F.count("*").alias("_n"))
    place = numbered.select(unit, "_i").join(size, unit).select(unit, (draws.number(F.lit(seed), F.col(unit), F.col("_i"), *([draw] if draw is not None else [])) % F.col("_n")).alias("_i"))
    return place.join(numbered, [unit, "_i"]).drop("_i")


def bootstrap_curves(df: DataFrame, unit: str, y: str, w: str, key: list[str], seed: int, levels: list[float] | None = None, bound: int | None = None) -> DataFrame:
    """unit, q, again: each unit's curve and that of one resample of its rows, where both have a usable row.

    Row i of a unit, in the order of y, w and key, takes the row at a seeded place, as bootstrap_rows() has it; units are
    integers. A row goes to its unit's task once and both curves are made there from one sorted run of rows, as places in
    order are values in order. Units of more than bound rows are taken over sorted ranges.
    """
    levels = check_levels(levels or midpoint_levels())
    rows = df.where(F.col(unit).isNotNull()).select(unit, F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"), *key)
    large = quantiles.large_units(rows, unit, bound)
    schema = T.StructType([rows.schema[unit], *T.StructType.fromDDL("q array<double>, again array<double>").fields])
    kinds, md5 = to_arrow_schema(schema), hashlib.md5

    def places(units: list, size: np.ndarray) -> np.ndarray:
        """draws.number() of seed, unit and row, modulo the unit's rows; the number is the first six bytes of the hash."""
        each = [str(i).encode() for i in range(int(size.max()))]
        heads = [f"{seed}:{u}:".encode() for u in units]
        raw = b"".join([md5(h + i).digest() for h, n in zip(heads, size.tolist()) for i in each[:n]])
        wide = np.zeros((len(raw) // 16, 8), np.uint8)
        wide[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 16)[:, :6]
        return wide.view(">u8")[:, 0].astype(np.int64) % np.repeat(size, size)

    def curves(yy: np.ndarray, ww: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which groups have a usable row, and their curves."""
        fine = np.isfinite(yy) & np.isfinite(ww) & (ww > 0)
        n = np.add.reduceat(fine.astype(np.int64), starts[:-1])
        some = n > 0
        if not some.any():
            return some, np.zeros((0, len(levels)))
        return some, group_curves(yy[fine], ww[fine], np.concatenate([[0], np.cumsum(n[some])]), [levels])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, [unit]):
            yy, ww = (t[c].to_numpy().astype(float) for c in "yw")
            size, units = np.diff(starts), t[unit].take(pa.array(starts[:-1]))
            at = np.sort(np.repeat(starts[:-1], size) + places(units.to_pylist(), size))
            (one, q), (two, again) = curves(yy, ww, starts), curves(yy[at], ww[at], starts)
            both = one & two
            yield rows_of([units.filter(pa.array(both)), lists(q[both[one]]), lists(again[both[two]])], kinds)

    own = lambda part: part.repartition(unit).sortWithinPartitions(unit, "y", "w", *key).select(unit, "y", "w").mapInArrow(run, schema)
    if large is None:
        return own(rows)
    same = F.col(unit) == F.col("_unit")
    many = rows.join(F.broadcast(large), same, "left_semi")  # one for bound rows
    again = bootstrap_rows(many, unit, ["y", "w", *key], seed)
    c = lambda part, n: unit_curves(part, unit, "y", "w", levels, spread=True).withColumnRenamed("q", n)
    return own(rows.join(F.broadcast(large), same, "left_anti")).unionByName(c(many, "q").join(c(again, "again"), unit))


def half_curves(y: np.ndarray, w: np.ndarray, levels: list[float]) -> np.ndarray:
    """Curves of groups of rows in order of y: y of shape (groups, rows) and w, 0 for rows that are not used, of shape (groups, rows, curves). NaN without rows."""
    n = y.shape[1]
    c = np.cumsum(w, 1)
    c = c / np.where(c[:, -1:] > 0, c[:, -1:], np.nan)
    used = np.where(w > 0, np.arange(n)[None, :, None], -1)
    before = np.concatenate([np.full_like(used[:, :1], -1), np.maximum.accumulate(used, 1)[:, :-1]], 1)
    none = used.max(1) < 0
    out = np.full((len(y), w.shape[2], len(levels)), np.nan)
    at = lambda a, i: np.take_along_axis(a, i[:, None], 1)[:, 0]
    for k, u in enumerate(levels):
        i = np.minimum((c < u).sum(1), n - 1)
        j = at(before, i)
        here, c0, c1 = np.take_along_axis(y, i, 1), at(c, np.maximum(j, 0)), at(c, i)
        y0 = np.take_along_axis(y, np.maximum(j, 0), 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[:, :, k] = np.where(none, np.nan, np.where(j < 0, here, y0 + (u - c0) / (c1 - c0) * (here - y0)))
    return out


def split_halves(df: DataFrame, unit: str, y: str, w: str, keys: list[str], splits: int, levels: list[float] | None = None, bound: int | None = None) -> DataFrame:
    """unit, d2: for each split the mean squared distance between the curves of two halves of the unit's rows, null where a half has no usable row.

    A row's half in a split is the parity of the seeded number of split and keys. A row goes to its unit's task once;
    its halves and the curves of all splits are made there from one sorted run of rows. Units of more than bound rows are
    taken split by split over sorted ranges.
    """
    levels, bound = check_levels(levels or midpoint_levels()), bound or LARGE_UNIT
    ident = F.concat_ws(":", F.lit(""), *[F.col(k).cast("string") for k in keys])
    rows = df.where(usable(y, w)).select(F.col(unit), F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"), ident.alias("ident"))
    rows = rows.repartition(unit).withColumn("_n", F.count("*").over(Window.partitionBy(unit))).sortWithinPartitions(unit, "y", "w")
    md5, numbers = hashlib.md5, [str(i).encode() for i in range(splits)]
    schema = T.StructType([rows.schema[unit], *T.StructType.fromDDL("d2 array<double>, y double, w double, ident string").fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in small_units(batches, [unit], bound):
            if starts is None:
                yield rows_of([t[unit], None, t["y"], t["w"], t["ident"]], kinds)
                continue
            yy, ww = t["y"].to_numpy(), t["w"].to_numpy()
            idents = [x.encode() for x in t["ident"].to_pylist()]
            bits = np.frombuffer(bytes(md5(n + x).digest()[5] & 1 for x in idents for n in numbers), np.uint8).reshape(-1, splits)  # of twelve hexadecimal digits the last one is odd
            out = np.full((len(starts) - 1, splits), np.nan)
            for g, at, real in sized(starts, splits):
                for s in range(0, splits, max(1, min(splits, 4_000_000 // at.size))):
                    part = slice(s, s + max(1, min(splits, 4_000_000 // at.size)))
                    own = (ww[at] * real)[:, :, None]
                    b = bits[at][:, :, part]
                    out[g, part] = ((half_curves(yy[at], own * (b == 0), levels) - half_curves(yy[at], own * (b == 1), levels)) ** 2).mean(2)
            d2 = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * splits), pa.array(out.ravel(), mask=np.isnan(out.ravel())))
            yield rows_of([t[unit].take(pa.array(starts[:-1])), d2], kinds)

    def sized(starts: np.ndarray, splits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Units of much the same size, some at a time: their numbers, rows (padded with the last one) and which are real."""
        size = np.diff(starts)
        order = np.argsort(size, kind="stable")
        kind = (size[order] + 3) // 4
        for own in np.split(order, np.flatnonzero(np.diff(kind)) + 1):
            step = max(1, 1_000_000 // (int(size[own].max()) * splits))
            for at in range(0, len(own), step):
                g = own[at : at + step]
                place = np.arange(size[g].max())
                real = place < size[g][:, None]
                yield g, starts[g][:, None] + np.minimum(place, size[g][:, None] - 1), real

    first = ordered.stored(rows.mapInArrow(run, schema))
    done, large = first.where("y IS NULL").select(unit, "d2"), first.where("y IS NOT NULL")
    if large.isEmpty():
        return done
    many = large.select("*", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    digits = F.substring(F.md5(F.concat(F.col("split").cast("string"), "ident").cast("binary")), 1, 12)
    many = many.select(unit, "y", "w", "split", (F.conv(digits, 16, 10).cast("long") % 2).cast("string").alias("half"))
    keyed = many.withColumn("_u", F.concat_ws("|", F.col(unit).cast("string"), "split", "half"))
    names = keyed.select("_u", unit, "split", "half").distinct()
    c = unit_curves(keyed, "_u", "y", "w", levels).join(names, "_u")
    both = c.groupBy(unit, "split").agg(F.max(F.when(F.col("half") == "0", F.col("q"))).alias("x"), F.max(F.when(F.col("half") == "1", F.col("q"))).alias("z"))
    d = both.select(unit, "split", curve_dist2(F.col("x"), F.col("z")).alias("_v"))
    return done.unionByName(d.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("split", "_v"))), lambda e: e["_v"]).alias("d2")))


def auc(df: DataFrame, score: str, arm: str) -> DataFrame:
    """Rank-sum AUC with average ranks at ties, from counts of each score over sorted ranges."""
    g = df.groupBy(score).agg(F.sum(F.col(arm).cast("double")).alias("p"), F.sum((1 - F.col(arm)).cast("double")).alias("n"))
    r = ranges(g, [], [F.col(score)])
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = r.groupBy("_range").agg(F.sum("n").alias("n")).select("_range", earlier(Window.partitionBy(F.lit(0)).orderBy("_range")).alias("_start"))  # one row for each range
    c = r.withColumn("_in", earlier(Window.partitionBy("_range").orderBy(score))).join(F.broadcast(starts), "_range")
    below = F.col("_start") + F.col("_in")
    return c.agg((F.sum(F.col("p") * (below + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))
