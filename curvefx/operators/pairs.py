"""Sums over pairs of curves inside units, in blocks: each pair is met once, and no row leaves for a pair.

Points are rows of keys, masses and q. Rows of a unit meet in one sorted Arrow stream, after one exchange, or none where they
are dealt by some of the keys already. Small units are paired many at a time, larger ones by tiles of a matrix of distances,
from inner products of centred curves. A unit of more than BOUND rows is passed on and dealt over pairs of parts of about
BOUND rows, so that no task holds it and its tiles run side by side. Kernel values serve all masses of a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship
from .ordered import stored

ship(__name__)

#: Rows of a unit that a task holds; rows up to which units are paired many at a time; pairs made at once.
BOUND, SMALL, PAIRS = 2048, 96, 1_000_000
#: Squared distances below this share of the curves' squares are taken again from differences.
CLOSE = 1e-6


def smoothed(eps: float) -> Callable[[np.ndarray], np.ndarray]:
    """sqrt(d2 + eps^2) - eps of squared distances."""
    return lambda d2: np.sqrt(d2 + eps * eps) - eps


def gaussian(bandwidth: float) -> Callable[[np.ndarray], np.ndarray]:
    return lambda d2: np.exp(-d2 / (2.0 * bandwidth * bandwidth))


def dealt(points: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """points with _lo, _hi and _own: the pair of parts that a row goes to, and its own part; stored, and sorted by keys and parts."""
    points = stored(points.where("q IS NOT NULL")).withColumn("_row", F.monotonically_increasing_id())
    large = points.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > bound).withColumn("_parts", F.ceil(F.col("_rows") / bound).cast("int")).drop("_rows")
    d = points.join(large, keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    d = d.withColumn("_own", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int"))
    d = d.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    d = d.withColumn("_lo", F.least("_own", "_with")).withColumn("_hi", F.greatest("_own", "_with")).drop("_with", "_parts", "_row")
    return d.repartition(*keys, "_lo", "_hi").sortWithinPartitions(*keys, "_lo", "_hi")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], each: bool = False) -> Iterator[tuple[pa.Table, np.ndarray] | None]:
    """Runs of whole groups of equal keys, and where each group begins; one more entry is the end. With each, None where a batch ends no group."""
    held: list[pa.Table] = []

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in keys:
            c = t[k].combine_chunks()
            codes = c.dictionary_encode().indices if not pa.types.is_integer(c.type) or c.null_count else c
            v = codes.fill_null(-1).to_numpy(zero_copy_only=False) if codes.null_count else codes.to_numpy(zero_copy_only=False)
            new |= v[1:] != v[:-1]
            if c.null_count:  # a null is no key that its filler may equal
                none = c.is_null().to_numpy(zero_copy_only=False)
                new |= none[1:] != none[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    for b in batches:
        if not b.num_rows:
            if each:
                yield None
            continue
        t = pa.Table.from_batches([b])
        if held and held[0].slice(0, 1).select(keys).to_pylist() != t.slice(t.num_rows - 1).select(keys).to_pylist():
            t, held = pa.concat_tables([*held, t]), []
        elif held:
            held.append(t)
            if each:
                yield None
            continue
        at = starts(t)
        if at[-1]:
            yield t.slice(0, at[-1]), at
        elif each:
            yield None
        held = [t.slice(at[-1])]
    if held:
        t = pa.concat_tables(held)
        yield t, np.append(starts(t), t.num_rows)


def curves_of(t: pa.Table) -> np.ndarray:
    q = t["q"].combine_chunks()
    return q.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(q), -1) if len(q) else np.zeros((0, 1))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean squared differences of all rows of a and b, by inner products; close ones again by differences."""
    centre = a.mean(0)
    x, y = a - centre, b - centre
    size = (x * x).mean(1)[:, None] + (y * y).mean(1)
    out = size - 2 * (x @ y.T) / a.shape[1]
    i, j = np.nonzero(out <= CLOSE * size)
    out[i, j] = ((a[i] - b[j]) ** 2).mean(1)
    return out


def lots(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of up to SMALL rows and much the same size, about PAIRS pairs at a time: group numbers, row numbers of each (its first row again
    where it has no more) and which of them are real."""
    size = np.diff(starts)
    kind = np.where(size <= SMALL, (size + 3) // 4, 0)
    for k in np.unique(kind[kind > 0]).tolist():
        own = np.flatnonzero(kind == k)
        step = max(1, PAIRS // (16 * k * k))
        for at in range(0, len(own), step):
            g = own[at : at + step]
            place = np.arange(size[g].max())
            real = place < size[g][:, None]
            yield g, starts[g][:, None] + np.where(real, place, 0), real


def apart(q: np.ndarray) -> np.ndarray:
    """Mean squared differences of the rows of each group."""
    d2 = np.zeros((q.shape[0], q.shape[1], q.shape[1]))
    for c in range(q.shape[2]):
        x = np.ascontiguousarray(q[:, :, c])
        d = x[:, :, None] - x[:, None, :]
        d2 += d * d
    return d2 / q.shape[2]


def tiles(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of row numbers of a and b that hold every pair; of the same rows, only blocks on and above the diagonal."""
    step = int(np.sqrt(PAIRS))
    for s in range(0, len(a), step):
        for e in range(s if same else 0, len(b), step):
            yield a[s : s + step], b[e : e + step]


def met(points: DataFrame, keys: list[str]) -> DataFrame:
    """points with _n, the rows of their unit, in order of keys; the window moves no rows that are dealt by some of the keys already."""
    return points.where("q IS NOT NULL").withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).sortWithinPartitions(*keys)


def small_units(batches: Iterator[pa.RecordBatch], keys: list[str], bound: int) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
    """Runs of whole units of at most bound rows and where they begin; without such places, rows of larger ones, as they come."""
    large: list[pa.RecordBatch] = []

    def rest() -> Iterator[pa.RecordBatch]:
        for b in batches:
            over = b.column(b.schema.get_field_index("_n")).to_numpy() > bound
            if over.any():
                large.append(b.filter(pa.array(over)))
                b = b.filter(pa.array(~over))
            yield b

    for got in whole_groups(rest(), keys, each=True):
        while large:
            yield pa.Table.from_batches([large.pop()]), None
        if got is not None:
            yield got


def rows_of(columns: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch with nulls for the columns that are missing at the end or None."""
    n = len(columns[0])
    columns = [*columns, *[None] * (len(schema) - len(columns))]
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def matrix_of(t: pa.Table, name: str) -> np.ndarray:
    c = t[name].combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), -1)


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as an array of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))


def forms(points: DataFrame, keys: list[str], kernel: Callable[[np.ndarray], np.ndarray], bound: int | None = None) -> DataFrame:
    """keys, forms: for rows of keys, masses (an array of one length) and q, the matrix, row by row, of the sums over ordered
    pairs of rows of a mass of the one, a mass of the other and kernel(squared distance).

    Grid weights are equal. A row is a pair with itself, too. Rows without a curve are left out, repeated ones count
    each; units of any size are met whole, those of more than bound rows by parts. No rows give an empty result.
    """
    bound = bound or BOUND
    points = points.select(*keys, F.col("masses").cast("array<double>").alias("masses"), F.col("q").cast("array<double>").alias("q"))
    schema = T.StructType([*[points.schema[k] for k in keys], *T.StructType.fromDDL("forms array<double>, masses array<double>, q array<double>").fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in small_units(batches, keys, bound):
            if starts is None:
                yield rows_of([*[t[k] for k in keys], None, t["masses"], t["q"]], kinds)
                continue
            q, w = curves_of(t), matrix_of(t, "masses")
            out = np.zeros((len(starts) - 1, w.shape[1], w.shape[1]))
            for g, rows, real in lots(starts):
                m = w[rows] * real[:, :, None]
                out[g] = m.transpose(0, 2, 1) @ (kernel(apart(q[rows])) @ m)
            for g in np.flatnonzero(np.diff(starts) > SMALL).tolist():
                rows = np.arange(starts[g], starts[g + 1])
                out[g] = tiled(q, w, rows, rows, True)
            heads = t.select(keys).take(pa.array(starts[:-1]))
            yield rows_of([*[heads[k] for k in keys], lists(out.reshape(len(out), -1))], kinds)

    def tiled(q: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> np.ndarray:
        out = np.zeros((w.shape[1], w.shape[1]))
        for i, j in tiles(a, b, same):
            part = w[i].T @ (kernel(squares(q[i], q[j])) @ w[j])
            out += part if same and i[0] == j[0] else part + part.T
        return out

    def run_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, [*keys, "_lo", "_hi"]):
            own, lo, hi = (t[c].to_numpy() for c in ("_own", "_lo", "_hi"))
            q, w, out = curves_of(t), matrix_of(t, "masses"), []
            for s, e in zip(starts[:-1], starts[1:]):
                rows, same = np.arange(s, e), bool(lo[s] == hi[s])
                a, b = (rows, rows) if same else (rows[own[rows] == lo[s]], rows[own[rows] == hi[s]])
                out.append(tiled(q, w, a, b, same).ravel())
            heads = t.select(keys).take(pa.array(starts[:-1]))
            yield rows_of([*[heads[k] for k in keys], lists(np.array(out))], kinds)

    first = stored(met(points, keys).mapInArrow(run, schema))
    done, large = first.where("q IS NULL").select(*keys, "forms"), first.where("q IS NOT NULL")
    if large.isEmpty():
        return done
    parts = dealt(large.select(*keys, "masses", "q"), keys, bound).mapInArrow(run_parts, schema)
    added = parts.select(*keys, F.posexplode("forms").alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum("_v").alias("_v"))
    whole = added.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda e: e["_v"]).alias("forms"))
    return done.unionByName(whole)


def pair_sums(points: DataFrame, keys: list[str], kernel: Callable[[np.ndarray], np.ndarray], bound: int | None = None) -> DataFrame:
    """keys, s00, s01, s11: sums of mass, mass and kernel(squared distance) over ordered pairs within sides 0 and 1, and over pairs across, for rows of keys, side (0 or 1), mass and q."""
    mass = F.col("mass").cast("double")
    split = F.array(*[F.when(F.col("side") == s, mass).otherwise(F.lit(0.0)) for s in (0, 1)])
    f = forms(points.select(*keys, split.alias("masses"), "q"), keys, kernel, bound)
    return f.select(*keys, *[F.get("forms", F.lit(i)).alias(n) for n, i in (("s00", 0), ("s01", 1), ("s11", 3))])


def pull(points: DataFrame, keys: list[str], atom: str, eps: float, bound: int | None = None) -> DataFrame:
    """keys, atom, k, att, rep, m: for each row of side 0 the sums over rows of side 1 and of side 0 of (q - other) / (K |q - other|), smoothed by eps; m is the number of rows of side 0.

    A pair at no distance adds nothing. Units of any size as for forms.
    """
    bound = bound or BOUND
    points = points.select(*keys, atom, F.col("side").cast("int").alias("side"), F.col("q").cast("array<double>").alias("q"))
    schema = T.StructType([*[points.schema[k] for k in keys], points.schema[atom], *T.StructType.fromDDL("att array<double>, rep array<double>, m long, side int, q array<double>").fields])
    kinds = to_arrow_schema(schema)

    def weights(d2: np.ndarray, width: int) -> np.ndarray:
        norm = np.sqrt(d2 + eps * eps) * width
        return np.divide(1.0, norm, out=np.zeros_like(norm), where=norm > 0)

    def tiled(sums: np.ndarray, q: np.ndarray, side: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        for i, j in tiles(a, b, same):
            w = weights(squares(q[i], q[j]), q.shape[1])
            for x, y, v in ((i, j, w), (j, i, w.T)) if not (same and i[0] == j[0]) else ((i, j, w),):
                for z in (0, 1):
                    use = v * (side[y] == z)
                    sums[1 - z, x] += q[x] * use.sum(1)[:, None] - use @ q[y]

    def told(t: pa.Table, sums: np.ndarray, m: np.ndarray | None) -> pa.RecordBatch:
        mine = np.flatnonzero(t["side"].to_numpy() == 0)
        heads = t.select([*keys, atom]).take(pa.array(mine))
        return rows_of([*[heads[k] for k in (*keys, atom)], *[lists(x[mine]) for x in sums], None if m is None else pa.array(m[mine])], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in small_units(batches, keys, bound):
            if starts is None:
                yield rows_of([*[t[k] for k in (*keys, atom)], None, None, None, t["side"], t["q"]], kinds)
                continue
            side, q = t["side"].to_numpy(), curves_of(t)
            sums = np.zeros((2, *q.shape))
            for _, rows, real in lots(starts):
                x, s = q[rows], side[rows]
                w = weights(apart(x), q.shape[1])
                for z in (0, 1):
                    use = w * (real & (s == z))[:, None, :]
                    for c in range(q.shape[1]):
                        v = np.ascontiguousarray(x[:, :, c])
                        sums[1 - z, rows[real], c] = (use * (v[:, :, None] - v[:, None, :])).sum(2)[real]
            for g in np.flatnonzero(np.diff(starts) > SMALL).tolist():
                rows = np.arange(starts[g], starts[g + 1])
                tiled(sums, q, side, rows, rows, True)
            m = np.repeat(np.add.reduceat((side == 0).astype(np.int64), starts[:-1]), np.diff(starts))
            yield told(t, sums, m)

    def run_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, [*keys, "_lo", "_hi"]):
            side, own, lo, hi = (t[c].to_numpy() for c in ("side", "_own", "_lo", "_hi"))
            q = curves_of(t)
            sums = np.zeros((2, *q.shape))
            for s, e in zip(starts[:-1], starts[1:]):
                rows, same = np.arange(s, e), bool(lo[s] == hi[s])
                a, b = (rows, rows) if same else (rows[own[rows] == lo[s]], rows[own[rows] == hi[s]])
                tiled(sums, q, side, a, b, same)
            yield told(t, sums, None)

    first = stored(met(points, keys).mapInArrow(run, schema))
    by_level = lambda d, *more: d.select(*keys, atom, *more, F.posexplode(F.arrays_zip("att", "rep")).alias("k", "v"))
    done = by_level(first.where("q IS NULL"), "m").select(*keys, atom, "k", "v.att", "v.rep", "m")
    large = first.where("q IS NOT NULL")
    if large.isEmpty():
        return done
    parts = dealt(large.select(*keys, atom, "side", "q"), keys, bound).mapInArrow(run_parts, schema)
    added = by_level(parts).groupBy(*keys, atom, "k").agg(F.sum("v.att").alias("att"), F.sum("v.rep").alias("rep"))
    size = large.where("side = 0").groupBy(*keys).agg(F.count("*").alias("m"))
    return done.unionByName(added.join(size, keys))


def sums_at(points: DataFrame, keys: list[str], row: str, kernel: Callable[[np.ndarray], np.ndarray], bound: int | None = None) -> DataFrame:
    """keys, row, value: for each row (of keys, row, at, mass, q) with at, the sum over its unit's rows of mass and kernel(squared distance). Units of any size as for forms."""
    bound = bound or BOUND
    points = points.select(*keys, row, F.col("at").cast("boolean").alias("at"), F.col("mass").cast("double").alias("mass"), F.col("q").cast("array<double>").alias("q"))
    schema = T.StructType([*[points.schema[k] for k in keys], points.schema[row], *T.StructType.fromDDL("value double, at boolean, mass double, q array<double>").fields])
    kinds = to_arrow_schema(schema)

    def tiled(value: np.ndarray, q: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        for i, j in tiles(a, b, same):
            k = kernel(squares(q[i], q[j]))
            value[i] += k @ m[j]
            if not (same and i[0] == j[0]):
                value[j] += k.T @ m[i]

    def told(t: pa.Table, value: np.ndarray) -> pa.RecordBatch:
        mine = np.flatnonzero(t["at"].to_numpy())
        heads = t.select([*keys, row]).take(pa.array(mine))
        return rows_of([*[heads[k] for k in (*keys, row)], pa.array(value[mine])], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in small_units(batches, keys, bound):
            if starts is None:
                yield rows_of([*[t[k] for k in (*keys, row)], None, t["at"], t["mass"], t["q"]], kinds)
                continue
            q, m = curves_of(t), t["mass"].to_numpy()
            value = np.zeros(len(m))
            for _, rows, real in lots(starts):
                value[rows[real]] = (kernel(apart(q[rows])) @ (m[rows] * real)[:, :, None])[:, :, 0][real]
            for g in np.flatnonzero(np.diff(starts) > SMALL).tolist():
                rows = np.arange(starts[g], starts[g + 1])
                tiled(value, q, m, rows, rows, True)
            yield told(t, value)

    def run_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, [*keys, "_lo", "_hi"]):
            own, lo, hi = (t[c].to_numpy() for c in ("_own", "_lo", "_hi"))
            q, m = curves_of(t), t["mass"].to_numpy()
            value = np.zeros(len(m))
            for s, e in zip(starts[:-1], starts[1:]):
                rows, same = np.arange(s, e), bool(lo[s] == hi[s])
                a, b = (rows, rows) if same else (rows[own[rows] == lo[s]], rows[own[rows] == hi[s]])
                tiled(value, q, m, a, b, same)
            yield told(t, value)

    first = stored(met(points, keys).mapInArrow(run, schema))
    done, large = first.where("q IS NULL").select(*keys, row, "value"), first.where("q IS NOT NULL")
    if large.isEmpty():
        return done
    parts = dealt(large.select(*keys, row, "at", "mass", "q"), keys, bound).mapInArrow(run_parts, schema)
    return done.unionByName(parts.groupBy(*keys, row).agg(F.sum("value").alias("value")))


def mixtures(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, totals, sums: for rows of keys, masses (an array of one length) and q, the sum of each mass, and of each mass times q as arrays.

    A task holds one batch and the sums of the unit that goes on in the next one, so units may be of any size.
    """
    points = points.select(*keys, F.col("masses").cast("array<double>").alias("masses"), F.col("q").cast("array<double>").alias("q"))
    schema = T.StructType([*[points.schema[k] for k in keys], *T.StructType.fromDDL("totals array<double>, sums array<double>").fields])
    kinds = to_arrow_schema(schema)

    def told(heads: pa.Table, total: np.ndarray) -> pa.RecordBatch:
        return rows_of([*[heads[k] for k in keys], lists(total[:, :, 0]), lists(total[:, :, 1:].reshape(len(total), -1))], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, carry = None, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            new = np.zeros(t.num_rows - 1, bool)
            for k in keys:
                c = t[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                new |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            q, w = curves_of(t), matrix_of(t, "masses")
            total = np.add.reduceat(w[:, :, None] * np.concatenate([np.ones((len(q), 1)), q], 1)[:, None, :], starts, axis=0)
            heads = t.select(keys).take(pa.array(starts))
            if head is not None:
                if head.to_pylist() == heads.slice(0, 1).to_pylist():
                    total[0] += carry[0]
                else:
                    yield told(head, carry)
            if len(starts) > 1:
                yield told(heads.slice(0, len(starts) - 1), total[:-1])
            head, carry = heads.slice(len(starts) - 1), total[-1:]
        if head is not None:
            yield told(head, carry)

    sums = met(points, keys).mapInArrow(run, schema)
    width = (F.size("sums") / F.size("totals")).cast("int")
    return sums.select(*keys, "totals", F.transform(F.sequence(F.lit(0), F.size("totals") - 1), lambda i: F.slice("sums", i * width + 1, width)).alias("sums"))
