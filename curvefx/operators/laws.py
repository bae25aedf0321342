"""Laws: weighted sets of curves per unit and arm, as long tables unit_id, arm, atom_id, mass, q.

Sums over pairs of atoms of a unit come from pairs.py, in blocks inside tasks; distances between the atoms of a shared
bank are computed once per bank, not per unit. Grid weights are equal unless given.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import curves as C
from ..functions import draws
from ..shipping import ship
from . import monotone, pairs
from .ordered import stored
from .prep import evenly_spaced

ship(__name__)
ship(draws.__name__)

KEYS = ["unit_id", "arm"]


def law_check(law: DataFrame, tol: float = 1e-9) -> DataFrame:
    """KEYS, atoms, mass and ok: finite curves, masses of at least 0 that add up to 1."""
    finite = F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    g = law.groupBy(*KEYS).agg(F.count("*").alias("atoms"), F.sum("mass").alias("mass"), F.min("mass").alias("_low"), F.bool_and(finite).alias("_fin"))
    return g.select(*KEYS, "atoms", "mass", ((F.abs(F.col("mass") - 1) <= tol) & (F.col("_low") >= 0) & F.col("_fin")).alias("ok"))


def uniform_law(particles: DataFrame) -> DataFrame:
    """A law of equal masses from KEYS and particles ARRAY<ARRAY<DOUBLE>>."""
    return particles.select(*KEYS, F.posexplode("particles").alias("atom_id", "q"), F.size("particles").alias("_m")).select(*KEYS, "atom_id", (1.0 / F.col("_m")).alias("mass"), "q")


def bank_law(bank: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights over shared atoms (KEYS, atom_id, mass) with the atoms' curves; zero weights are dropped."""
    return weights.where("mass > 0").join(bank, "atom_id").select(*KEYS, "atom_id", "mass", "q")


def expectation(law: DataFrame, **h: Column) -> DataFrame:
    """Mean of each functional of q under the law."""
    return law.groupBy(*KEYS).agg(*[F.sum(F.col("mass") * c).alias(n) for n, c in h.items()])


def mean_curve(law: DataFrame) -> DataFrame:
    long = law.select(*KEYS, "mass", F.posexplode("q").alias("k", "v"))
    return long.groupBy(*KEYS, "k").agg(F.sum(F.col("mass") * F.col("v")).alias("q")).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda e: e["q"]).alias("q"))


def effective_support(law: DataFrame) -> DataFrame:
    return law.groupBy(*KEYS).agg((1.0 / F.sum(F.col("mass") * F.col("mass"))).alias("support"))


def sided(law: DataFrame, other: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Rows for pairs.pair_sums: a law is side 0, and other (keys, mass, q), at units that the law has, side 1."""
    rows = law.select(*keys, F.lit(0).alias("side"), "mass", "q")
    return rows if other is None else rows.unionByName(other.join(law.select(*keys).distinct(), keys, "left_semi").select(*keys, F.lit(1).alias("side"), "mass", "q"))


def self_term(law: DataFrame, kernel: Callable) -> DataFrame:
    """KEYS, own: sum over pairs of atoms of mass, mass and kernel (of squared distances)."""
    return pairs.pair_sums(sided(law), KEYS, kernel).select(*KEYS, F.col("s00").alias("own"))


def self_term_of_bank(bank: DataFrame, weights: DataFrame, kernel: Callable[[Column, Column], Column]) -> DataFrame:
    """The same for laws over one bank, whose pair values are computed once. Only pairs that some law uses are formed."""
    w = weights.where("mass > 0")
    used = w.select(*KEYS, F.col("atom_id").alias("i"), "mass").join(w.select(*KEYS, F.col("atom_id").alias("j"), F.col("mass").alias("_m")), KEYS)
    pairs = used.select("i", "j").distinct().join(bank.select(F.col("atom_id").alias("i"), F.col("q").alias("_a")), "i").join(bank.select(F.col("atom_id").alias("j"), F.col("q").alias("_b")), "j").select("i", "j", kernel(F.col("_a"), F.col("_b")).alias("_k"))
    return used.join(pairs, ["i", "j"]).groupBy(*KEYS).agg(F.sum(F.col("mass") * F.col("_m") * F.col("_k")).alias("own"))


def energy_score(law: DataFrame, observed: DataFrame, eps: float = 0.0) -> DataFrame:
    """KEYS, attraction, repulsion, score of a law at observed curves (KEYS, q): lower is better. Units without an observed curve have no row."""
    seen = observed.select(*KEYS, F.lit(1.0).alias("mass"), "q")
    return score_of(sided(law.join(seen.select(*KEYS).distinct(), KEYS, "left_semi"), seen), eps)


def score_of(points: DataFrame, eps: float = 0.0) -> DataFrame:
    """The same from points (KEYS, side, mass, q): a law's atoms on side 0 and its observed curve on side 1."""
    both = pairs.pair_sums(points, KEYS, pairs.smoothed(eps))
    return both.select(*KEYS, F.col("s01").alias("attraction"), (0.5 * F.col("s00")).alias("repulsion"), (F.col("s01") - 0.5 * F.col("s00")).alias("score"))


def energy_risk(law: DataFrame, truth: DataFrame, eps: float = 0.0, own: DataFrame | None = None) -> DataFrame:
    """KEYS, risk against a weighted reference law; own may hold the law's own term."""
    both = pairs.pair_sums(sided(law.join(truth.select(*KEYS).distinct(), KEYS, "left_semi"), truth), KEYS, pairs.smoothed(eps))
    both = both.withColumn("own", F.col("s00")) if own is None else both.join(own, KEYS)
    return both.select(*KEYS, (F.col("s01") - 0.5 * F.col("own")).alias("risk"))


def energy_gradient(law: DataFrame, observed: DataFrame, eps: float = 0.0) -> DataFrame:
    """KEYS, atom_id, k, g: the score's derivative in each coordinate of each atom of a uniform law with an observed curve; 0 at exact collisions without eps."""
    law = law.join(observed.select(*KEYS), KEYS, "left_semi")
    rows = law.select(*KEYS, "atom_id", F.lit(0).alias("side"), "q")
    seen = observed.join(law.select(*KEYS).distinct(), KEYS, "left_semi").select(*KEYS, F.lit(None).cast(law.schema["atom_id"].dataType).alias("atom_id"), F.lit(1).alias("side"), "q")
    return gradient_of(rows.unionByName(seen), eps)


def gradient_of(points: DataFrame, eps: float = 0.0) -> DataFrame:
    """The same from points (KEYS, atom_id, side, q): a law's atoms on side 0 and its observed curve on side 1."""
    g = F.col("att") / F.col("m") - F.col("rep") / (F.col("m") * F.col("m"))
    return pairs.pull(points, KEYS, "atom_id", eps).select(*KEYS, "atom_id", "k", g.alias("g"))


def gaussian(bandwidth: float) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.exp(-F.greatest(C.curve_dist2(a, b), F.lit(0.0)) / (2.0 * bandwidth * bandwidth))


def against(atoms: DataFrame, kernel: Callable) -> DataFrame:
    """unit_id, arm, own, cross, other: sums over pairs within a law, of it with its unit's reference weights, and within those.

    atoms are rows of unit_id, arms (1 for arm 0 and 2 for arm 1, added where the unit has both laws), masses (in arm 0, in
    arm 1, in the reference) and q, so that the kernel is computed once for both arms.
    """
    f = pairs.forms(atoms, ["unit_id", "arms"], kernel)
    at = lambda i, j: F.get("forms", F.lit(3 * i + j))
    one = lambda a: F.when(F.col("arms").bitwiseAND(1 << a) > 0, F.struct(F.lit(a).alias("arm"), at(a, a).alias("own"), at(a, 2).alias("cross"), at(2, 2).alias("other")))
    return f.select("unit_id", F.explode(F.array_compact(F.array(one(0), one(1)))).alias("v")).select("unit_id", "v.*")


def squared_mmd(law: DataFrame, truth: DataFrame, bandwidth: float) -> DataFrame:
    """KEYS, mmd2: squared kernel distance of two laws with the same keys, at least 0."""
    both = pairs.pair_sums(sided(law.join(truth.select(*KEYS).distinct(), KEYS, "left_semi"), truth), KEYS, pairs.gaussian(bandwidth))
    return both.select(*KEYS, F.greatest(F.col("s00") - 2 * F.col("s01") + F.col("s11"), F.lit(0.0)).alias("mmd2"))


def median_bandwidth(curves: DataFrame, key: str, most: int = 512) -> DataFrame:
    """One row: the median distance over pairs of curves, of which most are taken at evenly spaced places by key; 1 if that is 0."""
    curves = evenly_spaced(curves.select(key, "q"), [F.col(key)], most)
    a, b = curves.select(F.col(key).alias("i"), "q"), curves.select(F.col(key).alias("j"), F.col("q").alias("_q"))
    d = a.join(b, F.col("i") < F.col("j")).select(C.curve_distance(F.col("q"), F.col("_q")).alias("d"))
    m = F.percentile("d", 0.5)
    return d.agg(F.when(m > 0, m).otherwise(F.lit(1.0)).alias("bandwidth"))


def tail_probability(law: DataFrame, k: int, threshold: float) -> DataFrame:
    return expectation(law, tail=(C.curve_at(F.col("q"), k) > threshold).cast("double"))


def mode_coverage(law: DataFrame, centres: DataFrame, radius: float, floor: float) -> DataFrame:
    """KEYS, covered: share of centres (KEYS, centre_id, q) with at least floor mass (less 1e-9, so that a sum that is floor but for rounding counts) within radius."""
    near = C.curve_distance(F.col("q"), F.col("_c")) <= radius
    j = law.join(centres.select(*KEYS, "centre_id", F.col("q").alias("_c")), KEYS).groupBy(*KEYS, "centre_id").agg(F.sum(F.when(near, F.col("mass")).otherwise(0.0)).alias("_m"))
    return j.groupBy(*KEYS).agg(F.avg((F.col("_m") >= floor - 1e-9).cast("double")).alias("covered"))


def zero_mass(law: DataFrame, tol: float) -> DataFrame:
    return expectation(law, zero=C.is_zero_curve(F.col("q"), tol).cast("double"))


def centred(law: DataFrame, levels: int | None) -> DataFrame:
    """law with _m, its mean curve: joined, or from sums in a window, which moves no rows, if all curves have so many levels."""
    if levels is None:
        return law.join(mean_curve(law).withColumnRenamed("q", "_m"), KEYS)
    over = Window.partitionBy(*KEYS)
    return law.withColumn("_m", F.array(*[F.sum(F.col("mass") * F.get("q", F.lit(k))).over(over) for k in range(levels)]))


def radial_scale(law: DataFrame, factor: float, levels: int | None = None) -> DataFrame:
    """Atoms moved away from the law's mean curve by a factor, projected to rising curves; levels as for centred."""
    moved = F.zip_with(F.col("q"), F.col("_m"), lambda x, c: c + factor * (x - c))
    return centred(law, levels).select(*KEYS, "atom_id", "mass", C.project_monotone(moved).alias("q"))


def jitter(law: DataFrame, scale: float, copies: int, seed: int = 0) -> DataFrame:
    """Copies of each atom with Gaussian noise in rescaled coordinates, projected; noise depends on seed and ids alone."""
    many = law.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_c"))
    noisy = F.transform("q", lambda x, k: x + scale * F.sqrt(F.size("q")) * draws.normal(F.lit(seed), *[F.col(c) for c in KEYS], F.col("atom_id"), F.col("_c"), k))
    many = many.withColumn("_q", noisy)  # by itself: in one select, atom_id inside the lambda would mean the new one
    return many.select(*KEYS, (F.col("atom_id") * copies + F.col("_c")).alias("atom_id"), (F.col("mass") / copies).alias("mass"), C.project_monotone(F.col("_q")).alias("q"))


def tried_risks(points: DataFrame, scales: list[float], jitters: list[float], copies: int, seed: int = 0, bound: int | None = None) -> DataFrame:
    """i, risk: mean energy scores over laws of radial_scale() by each scale, then of jitter() by each scale.

    points: KEYS, atom_id, mass, q and seen, the unit's observed curve. A law's atoms go to a task once, with their noise,
    which serves all jitters; all candidates are made and scored there, and only sums leave. Laws of more than bound atoms are passed on
    and scored candidate by candidate.
    """
    bound = bound or pairs.BOUND
    tries = len(scales) + len(jitters)
    drawn = lambda c: F.transform("q", lambda x, k: draws.normal(F.lit(seed), *[F.col(n) for n in KEYS], F.col("atom_id"), F.lit(c), k))
    rows = points.withColumn("z", F.flatten(F.array(*[drawn(c) for c in range(copies)])))
    schema = T.StructType([*[points.schema[k] for k in (*KEYS, "atom_id")], *T.StructType.fromDDL("mass double, q array<double>, seen array<double>, n long, risks array<double>").fields])
    kinds = to_arrow_schema(schema)

    def moved(q: np.ndarray, w: np.ndarray, z: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Curves (laws, atoms, levels) and masses of each candidate; rows without mass are no atoms."""
        n, m, k = q.shape
        rising = lambda x: monotone.pooled(x.reshape(-1, k)).reshape(n, -1, k)
        centre = (w[:, :, None] * q).sum(1, keepdims=True)
        for f in scales:
            yield rising(centre + f * (q - centre)), w
        for s in jitters:
            noise = s * np.sqrt(k) * z.reshape(n, m, copies, k)
            yield rising((q[:, :, None] + noise).reshape(n, -1, k)), np.repeat(w / copies, copies, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, np.zeros(tries)
        for t, starts in pairs.small_units(batches, KEYS, bound):
            if starts is None:
                yield pairs.rows_of([*[t[c] for c in (*KEYS, "atom_id", "mass", "q", "seen")]], kinds)
                continue
            q, z, y, mass = pairs.curves_of(t), pairs.matrix_of(t, "z"), pairs.matrix_of(t, "seen"), t["mass"].to_numpy()
            large = [(np.array([g]), np.arange(starts[g], starts[g + 1])[None], np.ones((1, starts[g + 1] - starts[g]), bool)) for g in np.flatnonzero(np.diff(starts) > pairs.SMALL).tolist()]
            for g, at, real in itertools.chain(pairs.lots(starts), large):
                for i, (x, w) in enumerate(moved(q[at], mass[at] * real, z[at])):
                    att = np.sqrt(((x - y[starts[g]][:, None]) ** 2).mean(2))
                    own = ((w[:, None, :] @ (np.sqrt(pairs.apart(x)) @ w[:, :, None]))[:, 0, 0]) if len(g) > 1 or x.shape[1] <= pairs.SMALL else np.array([tiled(x[0], w[0])])
                    total[i] += ((w * att).sum(1) - 0.5 * own).sum()
            count += len(starts) - 1
        none = pa.nulls(1)
        yield pairs.rows_of([none, none, none, none, none, none, pa.array([count]), pa.array([total.tolist()])], kinds)

    def tiled(x: np.ndarray, w: np.ndarray) -> float:
        """The sum over ordered pairs of atoms of one law."""
        every = np.arange(len(x))
        return float(sum(w[i] @ np.sqrt(np.maximum(pairs.squares(x[i], x[j]), 0)) @ w[j] * (1 if i[0] == j[0] else 2) for i, j in pairs.tiles(every, every, True)))

    first = stored(pairs.met(rows, KEYS).mapInArrow(run, schema))
    sums = first.where("risks IS NOT NULL").select("n", F.posexplode("risks").alias("i", "s"))
    big = first.where("risks IS NULL").select(*KEYS, "atom_id", "mass", "q", "seen")
    if not big.isEmpty():
        law, seen = big.drop("seen"), big.select(*KEYS, F.col("seen").alias("q")).dropDuplicates(KEYS)
        made = [radial_scale(law, f) for f in scales] + [jitter(law, s, copies, seed) for s in jitters]
        for i, x in enumerate(made):
            sums = sums.unionByName(energy_score(x, seen).agg(F.count("*").alias("n"), F.lit(i).alias("i"), F.sum("score").alias("s")))
    return sums.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("risk")).where("risk IS NOT NULL")


def resampled(law: DataFrame, source: list[float], target: list[float]) -> DataFrame:
    return law.withColumn("q", C.curve_resample(F.col("q"), source, target))


def two_part(law: DataFrame, zero: DataFrame) -> DataFrame:
    """A law with a zero curve of mass p (KEYS, p; clipped to 1e-9 from 0 and 1) and the given atoms sharing the rest."""
    p = zero.select(*KEYS, F.greatest(F.lit(1e-9), F.least(F.col("p"), F.lit(1 - 1e-9))).alias("_p"))
    rows = law.join(p, KEYS).withColumn("_first", F.row_number().over(Window.partitionBy(*KEYS).orderBy("atom_id")) == 1)
    row = lambda atom, mass, q: F.struct(atom.alias("atom_id"), mass.alias("mass"), q.alias("q"))
    own = row(F.col("atom_id") + 1, F.col("mass") * (1 - F.col("_p")), F.col("q"))
    zero_ = row(F.lit(0).cast(law.schema["atom_id"].dataType) + 0, F.col("_p"), F.transform("q", lambda x: F.lit(0.0)))
    both = F.when(F.col("_first"), F.array(own, zero_)).otherwise(F.array(own))
    return rows.select(*KEYS, F.explode(both).alias("_a")).select(*KEYS, "_a.*")


def dispersion(law: DataFrame, star: Column, levels: int | None = None) -> DataFrame:
    """KEYS, spread (mean squared distance to the mean curve, rooted) and gap of the mean distance to star over the mean curve's; levels as for centred."""
    return centred(law, levels).groupBy(*KEYS).agg(F.sqrt(F.sum(F.col("mass") * C.curve_dist2(F.col("q"), F.col("_m")))).alias("spread"), (F.sum(F.col("mass") * C.curve_distance(F.col("q"), star)) - F.first(C.curve_distance(F.col("_m"), star))).alias("gap"))


def sampled(law: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """m draws per unit and arm by seeded uniforms on the cumulative mass, each found by a binary search.

    A law's atoms pass a task in order as identifiers and masses only; the curves of the atoms drawn are joined to them.
    A window asks for whole laws: a mere repartition is left out where a join has dealt rows by KEYS, and an adaptive join may
    then leave a law's rows in several tasks, each of which would draw. A uniform beyond the last sum, as rounding allows,
    draws the last atom.
    """
    kinds = {c: law.schema[c].dataType for c in (*KEYS, "atom_id")}
    schema = T.StructType([*[T.StructField(c, k) for c, k in kinds.items()], T.StructField("_d", T.IntegerType())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in pairs.whole_groups(batches, KEYS):
            mass, place, number = t["mass"].to_numpy(), [], []
            heads = t.select(KEYS).take(pa.array(starts[:-1])).to_pylist()
            for key, s, e in zip(heads, starts[:-1].tolist(), starts[1:].tolist()):
                u = [draws.uniform_of(seed, *key.values(), d) for d in range(m)]
                place.append(s + np.minimum(np.searchsorted(np.cumsum(mass[s:e]), u), e - s - 1))
                number += range(m)
            picked = t.select([*KEYS, "atom_id"]).take(pa.array(np.concatenate(place)))
            yield pa.RecordBatch.from_arrays([*[picked[c].combine_chunks() for c in kinds], pa.array(number, pa.int32())], [*kinds, "_d"])

    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("atom_id"))
    rows = law.select(*KEYS, "atom_id", F.col("mass").cast("double").alias("mass"), place.alias("_place"))
    return rows.mapInArrow(draw, schema).join(law.select(*KEYS, "atom_id", "q"), [*KEYS, "atom_id"]).select(*KEYS, F.col("_d").alias("atom_id"), F.lit(1.0 / m).alias("mass"), "q")


def witness(law: DataFrame, points: DataFrame, bandwidth: float) -> DataFrame:
    """unit_id, point_id, w: signed weights (arm 1 plus, arm 0 minus) through the kernel at evaluation curves (unit_id, point_id, q)."""
    signed = law.select("unit_id", F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), F.lit(False).alias("at"), (F.col("mass") * F.when(F.col("arm") == 1, 1.0).otherwise(-1.0)).alias("mass"), "q")
    return witness_of(signed.unionByName(points.select("unit_id", "point_id", F.lit(True).alias("at"), F.lit(0.0).alias("mass"), "q")), bandwidth).join(law.select("unit_id").distinct(), "unit_id", "left_semi")


def witness_of(points: DataFrame, bandwidth: float) -> DataFrame:
    """The same from rows of unit_id, point_id, at (whether it is a point of evaluation), mass (signed; 0 if it has none) and q."""
    return pairs.sums_at(points, ["unit_id"], "point_id", pairs.gaussian(bandwidth)).withColumnRenamed("value", "w")


def kernel_effect(law: DataFrame, bandwidth: float, keys: list[str] = ["unit_id"]) -> DataFrame:  # noqa: B006
    """keys, norm2: squared norm of the difference of the two arms' mean embeddings."""
    rows = law.select(*keys, (F.col("arm") == 1).cast("int").alias("side"), "mass", "q")
    return pairs.pair_sums(rows, keys, pairs.gaussian(bandwidth)).select(*keys, (F.col("s00") + F.col("s11") - 2 * F.col("s01")).alias("norm2"))


def kernel_effects(atoms: DataFrame, bandwidth: float) -> DataFrame:
    """unit_id, norms: the squared norm of kernel_effect for each entry of masses (signed, arm 1 plus and arm 0 minus), from kernel values computed once for a unit."""
    f = pairs.forms(atoms, ["unit_id"], pairs.gaussian(bandwidth))
    width = F.sqrt(F.size("forms")).cast("int")
    return f.select("unit_id", F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.get("forms", i * (width + 1))).alias("norms"))


def resampled_test(norms: DataFrame, alpha: float) -> DataFrame:
    """unit_id, value, critical, p from group -1 (observed) and resampled groups: quantile type 7 and the share at or above (less 1e-9, so that equal norms count)."""
    seen = norms.where("grp = -1").select("unit_id", F.col("norm2").alias("value"))
    re = norms.where("grp >= 0").join(seen, "unit_id").groupBy("unit_id").agg(F.first("value").alias("value"), F.percentile("norm2", 1 - alpha).alias("critical"), F.avg((F.col("norm2") >= F.col("value") - 1e-9).cast("double")).alias("p"))
    return re


def quantile_of(values: Column, p: float) -> Column:
    """The quantile (type 7) of an array."""

    def at(a: Column) -> Column:
        place = (F.size(a) - 1) * F.lit(float(p))
        low = F.floor(place).cast("int")
        below, above = F.get(a, low), F.get(a, F.ceil(place).cast("int"))
        return below + (place - low) * (above - below)

    return C.let(F.array_sort(values), at)


def resampled_tests(norms: DataFrame, alpha: float) -> DataFrame:
    """The columns of resampled_test from unit_id and norms, the observed one first."""
    d = norms.select("unit_id", F.get("norms", F.lit(0)).alias("value"), F.slice("norms", F.lit(2), F.size("norms") - 1).alias("_re"))
    share = F.size(F.filter("_re", lambda x: x >= F.col("value") - 1e-9)) / F.size("_re")
    return d.select("unit_id", "value", quantile_of(F.col("_re"), 1 - alpha).alias("critical"), share.alias("p"))


def uniform_bands(values: DataFrame, alpha: float) -> DataFrame:
    """The columns of uniform_band from unit_id and values, an array of curves of which the first is observed."""
    d = values.select("unit_id", F.get("values", F.lit(0)).alias("_o"), F.slice("values", F.lit(2), F.size("values") - 1).alias("_re"))
    worst = F.transform("_re", lambda c: F.array_max(F.zip_with(c, F.col("_o"), lambda x, y: F.abs(x - y))))
    d = d.select("unit_id", "_o", quantile_of(worst, 1 - alpha).alias("_h"))
    return d.select("unit_id", F.posexplode("_o").alias("point_id", "value"), "_h").select("unit_id", "point_id", "value", (F.col("value") - F.col("_h")).alias("low"), (F.col("value") + F.col("_h")).alias("high"))


def uniform_band(values: DataFrame, alpha: float) -> DataFrame:
    """unit_id, point_id, value, low, high from group -1 (observed) and resampled groups at points (unit_id, grp, point_id, value).

    A unit's half width is the quantile (type 7) over groups of the largest absolute deviation over its points.
    """
    seen = values.where("grp = -1").select("unit_id", "point_id", "value")
    off = values.where("grp >= 0").select("unit_id", "grp", "point_id", F.col("value").alias("_v")).join(seen, ["unit_id", "point_id"])
    worst = off.groupBy("unit_id", "grp").agg(F.max(F.abs(F.col("_v") - F.col("value"))).alias("_d"))
    half = worst.groupBy("unit_id").agg(F.percentile("_d", 1 - alpha).alias("_h"))
    return seen.join(half, "unit_id").select("unit_id", "point_id", "value", (F.col("value") - F.col("_h")).alias("low"), (F.col("value") + F.col("_h")).alias("high"))


def weight_violations(law: DataFrame, arm_of_atom: DataFrame) -> DataFrame:
    """Counts of laws not normalised, atoms of the other arm with mass, and negative masses."""
    sums = law.groupBy(*KEYS).agg(F.sum("mass").alias("_m")).agg(F.count(F.when(F.abs(F.col("_m") - 1) > 1e-9, 1)).alias("not_normalised"))
    rows = law.join(arm_of_atom.select("atom_id", F.col("arm").alias("_arm")), "atom_id").agg(F.count(F.when((F.col("arm") != F.col("_arm")) & (F.col("mass") > 0), 1)).alias("other_arm"), F.count(F.when(F.col("mass") < 0, 1)).alias("negative"))
    return sums.crossJoin(rows)  # single rows
