"""Embedding whitening: covariance of the distinct vectors in Spark, leading components by FEAST contour integration.

Spark reduces the vectors to sums and a matrix of d x d (d: dimensions; nothing else reaches the driver). Inertia counts of
shifted matrices find intervals with a known number of eigenvalues; on each, quadrature of complex shifted solves along a
circle projects a block of vectors onto the interval's eigenspace, and Rayleigh-Ritz extracts the components, repeated
until the residuals stop falling. A Ritz count that differs from the inertia count enlarges the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, stored, unused

ship(__name__)

#: Quadrature nodes on the half circle, eigenvalues searched in one interval, and rounds of refinement.
NODES, PER_INTERVAL, ROUNDS = 12, 16, 30
#: Eigenvalues below this share of the largest one count as zero: they can't be divided by.
ZERO = 1e-12


@dataclass
class Whitening:
    """What fit() learns: n distinct vectors of dim entries, their exact sums, eigenvalues and columns of components."""

    n: int = 0
    dim: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    @property
    def weights(self) -> np.ndarray:
        """Columns that whiten a centred vector; NaN where the eigenvalue is zero."""
        top = self.values.max(initial=0.0)
        ok = self.values > ZERO * top
        return np.where(ok, self.vectors / np.sqrt(np.where(ok, self.values, 1.0)), np.nan)

    @property
    def explained(self) -> list[float]:
        return [float(max(v, 0.0) / self.trace) if self.trace > 0 else 0.0 for v in self.values]


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole numbers floor(256 c) of the usable vectors of a column of lists, by length."""
    flat, ends = column.flatten(), np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    values = flat.to_numpy(zero_copy_only=False).astype(float)  # null entries become NaN
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    size = np.diff(ends)
    usable = (bad[ends[1:]] == bad[ends[:-1]]) & (size > 0)
    for d in np.unique(size[usable]):
        rows = np.flatnonzero(usable & (size == d))
        block = np.floor(values[ends[rows][:, None] + np.arange(d)] * 256)
        yield rows, np.where(block >= 2.0**63, np.int64(2**63 - 1), np.clip(block, -(2.0**63), 2.0**63 - 1024).astype(np.int64))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim and x of usable vectors: little-endian numbers of the least width of 2, 4 or 8 bytes that holds the vector."""
    for b in batches:
        for _, x in matrices(b.column(0)):
            top = np.maximum(x.max(1), -(x.min(1) + 1))
            for low, high, width in ((-1, 2**15, "<i2"), (2**15, 2**31, "<i4"), (2**31, 2**63, "<i8")):
                some = x[(top < high) & (top >= low)]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), x.shape[1], np.int32)), pa.array([r.tobytes() for r in some.astype(width)], pa.binary())], ["dim", "x"])


def unpacked(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for b in batches:
        by: dict[int, list[bytes]] = {}
        for x in b.column(0).to_pylist():
            by.setdefault(len(x) // dim, []).append(x)
        for width, rows in by.items():
            yield np.frombuffer(b"".join(rows), f"<i{width}").reshape(len(rows), dim).astype(np.int64)


def added(rows: DataFrame) -> list[tuple[int, list[float]]]:
    """The sum of rows (i, v) by i: matrices of the tasks meet row by row, in streams."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[i] = total[i] + np.array(v) if i in total else np.array(v)
        if total:
            yield as_rows(list(total), np.array(list(total.values())))

    return sorted((r["i"], r["v"]) for r in rows.repartition("i").mapInArrow(add, "i int, v array<double>").collect())


def as_rows(i: list[int], matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(list(matrix), pa.list_(pa.float64()))], ["i", "v"])


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed shift: the positive part of the inertia, by an LDL factorisation with full pivots."""
    b, positive = matrix - shift * np.eye(len(matrix)), 0
    while len(b):
        size = np.abs(b)
        r = int(np.argmax(np.diagonal(size)))
        p, q = np.unravel_index(int(np.argmax(size)), size.shape)
        if size[p, q] == 0:
            break
        pivots = [r] if size[r, r] >= 0.64 * size[p, q] else [int(p), int(q)]
        rest = np.delete(np.arange(len(b)), pivots)
        core, side = b[np.ix_(pivots, pivots)], b[np.ix_(rest, pivots)]
        positive += int(core[0, 0] > 0) if len(pivots) == 1 else 1  # a pivot of two rows has an eigenvalue of either sign
        b = b[np.ix_(rest, rest)] - side @ np.linalg.solve(core, side.T)
    return positive


def intervals(matrix: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """Intervals that hold the k largest eigenvalues, and the number of eigenvalues in each.

    The lowest end lies in the gap below the k-th eigenvalue; where it equals the next one, all equal ones are inside.
    """
    d, top = len(matrix), float(np.abs(matrix).sum(1).max()) * 1.001
    if k >= d:
        low, n = -top, d
    else:
        low, high, n = -top, top, d  # of the values above low there are at least k, above high fewer
        edge: float | None = None  # a shift with exactly k above
        for _ in range(60):
            mid = (low + high) / 2
            m = above(matrix, mid)
            if m == k:
                edge, n = mid, m
                break
            low, high, n = (mid, high, m) if m > k else (low, mid, n)
        if edge is not None:  # the gap's ends, roughly, and its middle
            a, b = (low, edge), (edge, high)
            for _ in range(8):
                mid = sum(a) / 2
                a = (mid, a[1]) if above(matrix, mid) > k else (a[0], mid)
                mid = sum(b) / 2
                b = (mid, b[1]) if above(matrix, mid) == k else (b[0], mid)
            low = (a[1] + b[0]) / 2
    todo, out = [(low, top, n, 0)], []
    while todo:
        a, b, n, beyond = todo.pop()
        mid = (a + b) / 2
        if n <= PER_INTERVAL or not a < mid < b or b - a < 1e-9 * top:
            out += [(a, b, n)] if n else []
        else:
            upper = above(matrix, mid) - beyond
            todo += [(a, mid, n - upper, beyond + upper), (mid, b, upper, beyond)]
    return out


def feast(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns, largest entry positive."""
    d = len(matrix)
    k = min(k, d)
    scale = float(np.abs(matrix).max(initial=0.0))
    if not k or scale == 0:
        return np.zeros(k), np.eye(d)[:, :k]
    a, made = matrix / scale, []
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (nodes + 1))
    for low, high, n in intervals(a, k):
        centre, radius = (low + high) / 2, (high - low) / 2
        inverse = [(0.5 * w * radius * t, np.linalg.inv((centre + radius * t) * np.eye(d) - a)) for w, t in zip(weights, turn)]
        size = min(d, n + max(8, n // 2))
        while True:
            y, last = np.random.default_rng(size).standard_normal((d, size)), np.inf
            for _ in range(ROUNDS):
                q = np.linalg.qr(sum((c * (s @ y)).real for c, s in inverse))[0]
                values, u = np.linalg.eigh(q.T @ a @ q)
                y = q @ u
                inside = (values > low) & (values <= high)
                worst = np.abs(a @ y[:, inside] - y[:, inside] * values[inside]).max(initial=0.0)
                if inside.sum() == n and worst >= 0.5 * last:
                    break
                last = worst if inside.sum() == n else np.inf
            if inside.sum() == n or size == d:
                break
            size = min(d, 2 * size)  # the inertia says that some are missing
        made.append(y[:, inside])
    q = np.linalg.qr(np.concatenate(made, 1))[0]  # one more Rayleigh-Ritz step over all intervals
    values, u = np.linalg.eigh(q.T @ a @ q)
    order = np.argsort(-values)[:k]
    vectors = (q @ u)[:, order]
    vectors /= np.linalg.norm(vectors, axis=0)
    return values[order] * scale, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])


def fit(df: DataFrame, vector: str = "embedding", components: int = 4) -> Whitening:
    """The whitening of the distinct usable vectors, as whole numbers floor(256 c).

    Null vectors, and those with null or non-finite entries or without any, are left out. Of vectors of several lengths,
    the commonest length among distinct ones counts (the longest of equally common ones). Repeated vectors count once, and
    are dropped inside tasks first, so that one common vector doesn't meet in one task. Entries beyond 2^63 / 256 count as
    the largest whole number. An empty table gives an empty model. The driver holds a matrix of dimensions squared.
    """
    fitted = stored(df.select(F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("v").isNotNull()).mapInArrow(packed, "dim int, x binary").distinct())
    sizes = fitted.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return Whitening()
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    rows = fitted.where(F.col("dim") == dim).select("x")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for x in unpacked(batches, dim):
            safe = np.abs(x.astype(float)).max() * len(x) < 2**62
            total = [t + int(s) for t, s in zip(total, (x if safe else x.astype(object)).sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["i", "s"])

    sums = rows.mapInArrow(summed, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    model = Whitening(n, dim, [int(r["s"]) for r in sorted(sums)])
    mean = model.mean

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for x in unpacked(batches, dim):
            y = x - mean
            total += y.T @ y
        yield as_rows(list(range(dim)), total)

    v = np.array([v for _, v in added(rows.mapInArrow(products, "i int, v array<double>"))]) / n
    v = (v + v.T) / 2
    model.trace = float(np.trace(v))
    model.values, model.vectors = feast(v, components)
    weights = model.weights[:, ~np.isnan(model.weights).any(0)]
    k = weights.shape[1]
    if k:

        def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k))
            for x in unpacked(batches, dim):
                z = (x - mean) @ weights
                total += z.T @ z
            yield as_rows(list(range(k)), total)

        made = np.array([v for _, v in added(rows.mapInArrow(squares, "i int, v array<double>"))]) / n
        model.identity_error = float(np.abs(made - np.eye(k)).max())
    return model


def whitened(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows of df with a usable vector of the model's length, with deviation and whitened (an entry for each component).

    deviation is the sum over dimensions of (n x - S)^2, exact, and null where it exceeds a long. An entry of whitened is
    null where the component's eigenvalue is zero. Rows repeat as they are; columns of df of those names are replaced.
    """
    keep = [c for c in df.columns if c not in (vector, "deviation", "whitened")]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vector}`").cast("array<double>").alias(unused(df, "_vector")))
    schema = T.StructType([*[df.schema[c] for c in keep], *T.StructType.fromDDL("deviation bigint, whitened array<double>").fields])
    n, dim, sums = model.n, model.dim, model.sums
    mean, weights = (model.mean, model.weights) if n else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in matrices(b.columns[-1]):
                if x.shape[1] == dim:
                    most = n * int(np.abs(x.astype(float)).max()) + max(map(abs, sums))
                    whole = x * n - np.array(sums) if dim * most**2 < 2**62 else x.astype(object) * n - np.array(sums, object)
                    dev = [int(v) if v < 2**63 else None for v in (whole * whole).sum(1)]
                    z = (x - mean) @ weights
                    cells = pa.array([[None if np.isnan(v) else v for v in r] for r in z.tolist()], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows)).columns[:-1], pa.array(dev, pa.int64()), cells], [*keep, "deviation", "whitened"])

    return src.mapInArrow(run, schema)
