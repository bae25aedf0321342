"""Particle boosters: laws of curves by unit and arm, moved along the energy score's gradient by shared trees.

All models (folds, penalties, seeds, placebos) train in lock step over one table with one row for each unit: unit_id, x, q,
and arrays with an entry for each model, a (arm), t (1 where it trains on the unit), and optionally e (propensity, for the
contrast rule). Every step is a fixed number of jobs for all models: a scan for each level of the trees, and one that tries
all step sizes. Particles are no columns: x, a and e, and the trees so far, give them, so tasks make them again in each scan,
once for all rows of a model that went to the same leaves, and neither they nor gradients are stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import monotone, ordered, trees
from .trees import Forest, Rules, matrix

ship(__name__)

#: Rows that are held as matrices at a time.
ROWS = 1024
project = monotone.pooled


#: Numbers that pairs of particles take up at a time.
PAIRS = 1_000_000


def in_parts(f: Callable[[np.ndarray], np.ndarray], p: np.ndarray) -> np.ndarray:
    """f of particles (n, M, K) with all their differences, for so many laws at a time that these are few."""
    size = max(1, PAIRS // max(1, p.shape[1] ** 2 * p.shape[2]))
    return np.concatenate([f(p[at : at + size]) for at in range(0, max(len(p), 1), size)])


def repulsion(p: np.ndarray, eps: float) -> np.ndarray:
    """What the pairs of a law's particles take from its energy score, (n,)."""
    return in_parts(lambda p: 0.5 * (np.sqrt(((p[:, :, None] - p[:, None]) ** 2).mean(3) + eps**2) - eps).mean((1, 2)), p)


def scores(p: np.ndarray, q: np.ndarray, eps: float, own: np.ndarray | None = None) -> np.ndarray:
    """Energy score of particles (n, M, K) at curves (n, K) under equal grid weights; own is repulsion() if it is known."""
    att = np.sqrt(((p - q[:, None]) ** 2).mean(2) + eps**2) - eps
    return att.mean(1) - (repulsion(p, eps) if own is None else own)


def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, and 0 where b is 0."""
    return np.divide(a, b, out=np.zeros_like(a), where=b > 0)


def push(p: np.ndarray, eps: float) -> np.ndarray:
    """What a law's other particles add to the descent of each, (n, M, K)."""

    def of(p):
        e = p[:, :, None] - p[:, None]
        return part(e, np.sqrt((e**2).mean(3) + eps**2)[..., None]).sum(2) / p.shape[1]

    return in_parts(of, p)


def descent(p: np.ndarray, q: np.ndarray, eps: float, own: np.ndarray | None = None) -> np.ndarray:
    """-M K times the score's gradient, (n, M, K); collisions add nothing; own is push() if it is known."""
    d = p - q[:, None]
    na = np.sqrt((d**2).mean(2) + eps**2)[..., None]
    return -(part(d, na) - (push(p, eps) if own is None else own))


TABLE = f"step int, size array<double>, start array<double>, contrast boolean, nodes array<struct<{trees.NODES.replace(' int', ': int').replace(' double', ': double').replace(' array', ': array')}>>"


@dataclass
class Booster:
    """Initial particles (models, particles, levels), steps (size by model, forest), and a trace of each step by model."""

    start: np.ndarray
    steps: list[tuple[np.ndarray, Forest]] = field(default_factory=list)
    trace: list[tuple] = field(default_factory=list)

    def only(self, models: list[int]) -> Booster:
        """The booster of some of the models, in that order."""
        cut = lambda f: Forest(f.root[models], f.feature, f.cut, f.low, f.high, f.share, f.value, f.contrast)
        return Booster(self.start[models], [(s[models], cut(f)) for s, f in self.steps])

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for the start (step -1) and each step, with its node table; small, and of plain types, to be written anywhere."""
        rows = [(-1, [float(n) for n in self.start.shape], self.start.ravel().tolist(), False, [])]
        rows += [(i, s.tolist(), None, f.contrast, f.rows()) for i, (s, f) in enumerate(self.steps)]
        return spark.createDataFrame(rows, TABLE)

    @classmethod
    def of_table(cls, table: DataFrame) -> Booster:
        first, *rows = table.orderBy("step").collect()
        shape = [int(n) for n in first["size"]]
        return cls(np.array(first["start"]).reshape(shape), [(np.array(r["size"]), Forest.of_rows(r["nodes"], shape[0], r["contrast"])) for r in rows])


def mapped(df: DataFrame, f: Callable[[Callable[[str], np.ndarray]], np.ndarray], out: str, rows: int = ROWS) -> DataFrame:
    """df with the array column out made by f from a function that gives a column of arrays as a matrix, for so many rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                c = b.slice(at, rows)
                made = f(lambda name, c=c: matrix(c, name))
                flat = np.ascontiguousarray(made.reshape(len(made), -1), float)
                col = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
                names = [n for n in c.schema.names if n != out]
                yield pa.RecordBatch.from_arrays([*[c.column(c.schema.get_field_index(n)) for n in names], col], [*names, out])

    kept = [c for c in df.columns if c != out]
    full = df.select(*kept, F.array(F.lit(0.0)).alias(out)).schema
    return df.mapInArrow(run, full)


def summed(df: DataFrame, f: Callable[[Callable[[str], np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum over rows of f's result, an array of one shape for any batch, added up inside tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                c = b.slice(at, ROWS)
                total = total + f(lambda name, c=c: matrix(c, name))
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([list(total.shape)], pa.list_(pa.int32())), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["shape", "v"])

    parts = df.mapInArrow(run, "shape array<int>, v array<double>").select("shape", F.posexplode("v").alias("k", "v"))
    got = parts.groupBy("shape", "k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    return np.array([r["v"] for r in got]).reshape(got[0]["shape"]) if got else np.zeros(0)


def start_particles(units: DataFrame, particles: int, order: str) -> np.ndarray:
    """(models, particles, levels): of each model's training curves by total, then order, those at ranks floor((i + 0.5) n / particles).

    Units are sorted once, over ranges; counts by range give every model's places.
    """
    keys = [F.col("_m"), F.col(order)]
    r = ordered.ranges(units.select("t", "q", order, F.aggregate("q", F.lit(0.0), lambda s, v: s + v).alias("_m")), [], keys)
    models = len(units.select("t").first()["t"])
    counts = {x["_range"]: x["v"] for x in r.groupBy("_range").agg(F.array(*[F.sum(F.get("t", F.lit(m)).cast("long")) for m in range(models)]).alias("v")).collect()}  # a row for each range
    total = np.sum(list(counts.values()), 0)
    before, at = {}, np.zeros(models, np.int64)
    for k in sorted(counts):
        before[k] = at.copy()
        at = at + np.array(counts[k])
    wanted = [{int((i + 0.5) * n / particles): None for i in range(particles)} for n in total]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            t, q, ranges = matrix(b, "t"), matrix(b, "q"), b.column("_range").to_numpy()
            out: list[list] = [[], [], []]
            for k in np.unique(ranges).tolist():
                own = np.flatnonzero(ranges == k)
                place = seen.get(k, before[k]) + np.cumsum(t[own], 0).astype(np.int64)
                seen[k] = place[-1]
                for m in range(models):
                    for i in np.flatnonzero((t[own, m] != 0) & np.isin(place[:, m] - 1, list(wanted[m]))):
                        for c, v in zip(out, (m, int(place[i, m]) - 1, q[own[i]].tolist())):
                            c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.float64()))], ["model", "rank", "q"])

    rows = r.repartition("_range").sortWithinPartitions("_range", *keys).select("t", "q", "_range").mapInArrow(pick, "model int, rank bigint, q array<double>").collect()  # models x particles
    by = {(x["model"], x["rank"]): x["q"] for x in rows}
    return np.array([[by[m, int((i + 0.5) * total[m] / particles)] for i in range(particles)] for m in range(models)])


def stepped(p: np.ndarray, change: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Particles moved by each model's size times change, projected; a model of size 0 stays."""
    go = np.flatnonzero(sizes)
    out = p.copy()
    if len(go):
        n, _, m, k = p.shape
        out[:, go] = project((p[:, go] + sizes[go][:, None, None] * change[:, go]).reshape(-1, k)).reshape(n, len(go), m, k)
    return out


@dataclass
class Laws:
    """Particles of rows: cell (rows, models) has each one's place in p (cells, M, K). Rows of a model share a cell while they have gone to the same leaves with the same arm."""

    cell: np.ndarray
    p: np.ndarray

    def divided(self, x: np.ndarray, a: np.ndarray, e: np.ndarray | None, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """New cells of the rows under a forest, and by new cell the old one, the model and the forest's change. Given propensities make every row a cell."""
        leaf = forest.route(x)
        if forest.contrast and e is not None:
            first = at = np.arange(leaf.size)
        else:
            key = (self.cell * (len(forest.feature) + 1) + leaf + 1) * 2 + a
            _, first, at = np.unique(key.ravel(), return_index=True, return_inverse=True)
        old, own_leaf, arm = (c.ravel()[first] for c in (self.cell, leaf, a))
        change = forest.values(own_leaf, arm, None if e is None else e.ravel()[first])
        return at.reshape(leaf.shape), old, first % leaf.shape[1], change.reshape(len(first), *self.p.shape[1:])

    def tried(self, old: np.ndarray, model: np.ndarray, change: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Particles of new cells after a step of each model's size."""
        return stepped(self.p[old][None], change[None], sizes[model])[0]


def replayed(start: np.ndarray, steps: list[tuple[np.ndarray, Forest]], x: np.ndarray, a: np.ndarray, e: np.ndarray | None = None) -> Laws:
    """The laws of rows with arms a (rows, models) after steps."""
    laws = Laws(np.repeat(np.arange(len(start))[None], len(x), 0), start)
    for sizes, forest in steps:
        cell, *new = laws.divided(x, a, e, forest)
        laws = Laws(cell, laws.tried(*new, sizes))
    return laws


def fit(units: DataFrame, particles: int = 5, steps: int = 5, rate: float = 0.5, eps: float = 1e-3, rules: Rules = Rules(), halvings: int = 6, order: str = "unit_id") -> tuple[Booster, DataFrame]:
    """A booster over units (unit_id, x, q, a, t and optionally e, arrays over models), and all rows with p as followed() makes it.

    Units are read again for each scan, so they should be stored, or made from what is stored row by row. Trees and risks
    use the rows that a model trains on; the laws of the others follow from the same trees, so held-out laws come with the
    fit. A model stops when no tried step size lowers its risk. e is for the contrast rule, which without it uses leaf shares.
    """
    start = start_particles(units, particles, order)
    models = len(start)
    cuts = trees.cut_points(units, len(units.select("x").first()["x"]))
    has_e = "e" in units.columns
    rows = units.select("x", "a", "t", "q", *(["e"] if has_e else []), *([F.zip_with("a", "e", lambda a, e: a - e).alias("w")] if has_e and rules.rule == "contrast" else []))
    book, alive = Booster(start), np.ones(models, bool)
    sizes = [0.0, *[rate / 2**i for i in range(halvings)]]
    laws_of = lambda get, taken: replayed(start, taken, get("x"), get("a").astype(np.int64), get("e") if has_e else None)
    for number in range(steps):
        if not alive.any():
            break

        def view(get, alive=alive, taken=list(book.steps)):  # noqa: B006
            def gradient():
                laws, q = laws_of(get, taken), get("q")
                own, v = push(laws.p, eps), np.zeros((len(q), *start.shape))
                for m in np.flatnonzero(alive):
                    at = laws.cell[:, m]
                    v[:, m] = descent(laws.p[at], q, eps, own[at])
                return v

            return lambda name: gradient() if name == "v" else get("t").astype(float) if name == "mass" else get(name)

        forest = trees.grow(rows, models, cuts, rules, np.flatnonzero(alive).tolist(), None, view, ROWS)

        def tried(get, forest=forest, alive=alive, taken=list(book.steps)):  # noqa: B006
            """Training rows and sums of their scores before and after every step size, by model."""
            q, t, laws = get("q"), get("t"), laws_of(get, taken)
            cell, *new = laws.divided(get("x"), get("a").astype(np.int64), get("e") if has_e else None, forest)  # once for all sizes
            made = [laws.tried(*new, np.where(alive, s, 0.0)) for s in sizes]
            made = [(p, repulsion(p, eps)) for p in made]
            out = np.zeros((models, len(sizes) + 1))
            for m in np.flatnonzero(alive):
                own = np.flatnonzero(t[:, m])
                at = cell[own, m]
                out[m] = [len(own), *[scores(p[at], q[own], eps, r[at]).sum() for p, r in made]]
            return out

        risk = summed(rows, tried)
        chosen = np.zeros(models)
        for m in np.flatnonzero(alive).tolist():
            r = risk[m, 1:] / risk[m, 0]
            ok = [i for i in range(1, len(sizes)) if r[i] <= r[0] + 1e-12]
            chosen[m] = sizes[ok[0]] if ok else 0.0
            book.trace.append((number, m, float(r[0]), float(r[ok[0]]) if ok else None, float(chosen[m]), ok[0] - 1 if ok else halvings))
        alive = chosen > 0
        if alive.any():
            book.steps.append((chosen, forest))
    return book, followed(book, units)


def followed(book: Booster, rows: DataFrame) -> DataFrame:
    """rows (x, a array; optionally e) with p: every model's particles at each row's own arm, in the order of the start."""
    has_e = "e" in rows.columns

    def flat(get):
        laws = replayed(book.start, book.steps, get("x"), get("a").astype(np.int64), get("e") if has_e else None)
        return laws.p[laws.cell]

    return mapped(rows, flat, "p")


def predict(book: Booster, rows: DataFrame, arm: int | None = None) -> DataFrame:
    """rows (unit_id, x, a array; optionally e) with p: every model's law of each row's arm, or of the given one, atoms in lexicographic order."""
    models, has_e = len(book.start), "e" in rows.columns

    def replay(get):
        x = get("x")
        a = get("a").astype(np.int64) if arm is None else np.full((len(x), models), arm)
        laws = replayed(book.start, book.steps, x, a, get("e") if has_e else None)
        order = np.lexsort(np.moveaxis(laws.p, 2, 0)[::-1], axis=-1)
        return np.take_along_axis(laws.p, order[:, :, None], 1)[laws.cell]

    return mapped(rows, replay, "p")


def held_out_risk(book: Booster, units: DataFrame, eps: float = 1e-3) -> np.ndarray:
    """Mean energy score by model of the rows (x, q, a, t and optionally e) that it was not trained on."""
    has_e, models = "e" in units.columns, len(book.start)

    def total(get):
        q, t, out = get("q"), get("t"), np.zeros((models, 2))
        laws = replayed(book.start, book.steps, get("x"), get("a").astype(np.int64), get("e") if has_e else None)
        pairs = repulsion(laws.p, eps)
        for m in range(models):
            own = np.flatnonzero(t[:, m] == 0)
            at = laws.cell[own, m]
            out[m] = scores(laws.p[at], q[own], eps, pairs[at]).sum(), len(own)
        return out

    s = summed(units.select("x", "q", "a", "t", *(["e"] if has_e else [])), total)
    return s[:, 0] / s[:, 1]


def law_of(model: Column | int, models: int, p: str = "p") -> Column:
    """One model's flat particles from the array of all."""
    size = (F.size(p) / models).cast("int")
    return F.slice(p, (model if isinstance(model, Column) else F.lit(model)) * size + 1, size)


def atoms_of(p: Column, k: int) -> Column:
    """Flat particles as an array of curves."""
    return F.transform(F.sequence(F.lit(0), (F.size(p) / k - 1).cast("int")), lambda i: F.slice(p, i * k + 1, k))


def as_law(state: DataFrame, k: int, arm: str = "a") -> DataFrame:
    """The long law table of one model's flat particles p: unit_id, arm, atom_id, mass, q."""
    rows = state.select("unit_id", F.col(arm).alias("arm"), (k / F.size("p")).alias("mass"), F.posexplode(atoms_of(F.col("p"), k)).alias("atom_id", "q"))
    return rows.select("unit_id", "arm", "atom_id", "mass", "q")


def trace_table(book: Booster, spark) -> DataFrame:
    return spark.createDataFrame(book.trace, "step int, model int, before double, after double, size double, backtracks int")
