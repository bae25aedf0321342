"""The blocked pair kernel against all pairs one by one, for small, middle and large units."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvefx.operators import laws, pairs


def made(rng, sizes, k=4, key="unit_id"):
    rows = []
    for u, n in enumerate(sizes):
        for i in range(n):
            q = np.sort(rng.normal(size=k) * 3).tolist() if rng.random() < 0.8 or not rows else rows[-1][4]
            rows.append((u, u % 2, int(rng.integers(2)), float(rng.random()), q))
    return rows


def brute(rows, kernel):
    out = {}
    for u in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == u]
        q, m, s = np.array([r[4] for r in own]), np.array([r[3] for r in own]), np.array([r[2] for r in own])
        v = kernel(((q[:, None] - q) ** 2).mean(2)) * m[:, None] * m
        out[u] = [v[np.ix_(s == 0, s == 0)].sum(), v[np.ix_(s == 0, s == 1)].sum(), v[np.ix_(s == 1, s == 1)].sum()]
    return out


@pytest.mark.parametrize("bound,block", [(None, None), (None, 900), (40, 400), (7, 25)])
def test_pair_sums_equal_all_pairs(spark, monkeypatch, bound, block):
    if block:
        monkeypatch.setattr(pairs, "PAIRS", block)
    rows = made(np.random.default_rng(1), [1, 2, 3, 0, 5, 30, 95, 96, 97, 150, 260, 1, 1, 40])
    df = spark.createDataFrame(rows, "unit_id int, arm int, side int, mass double, q array<double>").repartition(5)
    for kernel in (pairs.smoothed(0.0), pairs.smoothed(0.5), pairs.gaussian(2.0)):
        got = {r["unit_id"]: [r["s00"], r["s01"], r["s11"]] for r in pairs.pair_sums(df, ["unit_id", "arm"], kernel, bound).collect()}
        want = brute(rows, kernel)
        assert got.keys() == want.keys() and all(np.allclose(got[u], want[u], rtol=1e-9) for u in want)


@pytest.mark.parametrize("bound", [None, 30])
def test_gradient_equals_differences_of_the_score(spark, bound, monkeypatch):
    if bound:
        monkeypatch.setattr(pairs, "BOUND", bound)
    rng = np.random.default_rng(2)
    units = {("a", 0): 3, ("a", 1): 1, ("b", 0): 120, ("c", 1): 40}
    atoms = [(*u, i, rng.normal(size=3).tolist()) for u, n in units.items() for i in range(n)]
    atoms += [(u, a, i + 500, q) for u, a, i, q in atoms[:2]]  # collisions
    seen = [(*u, rng.normal(size=3).tolist()) for u in units]
    law = spark.createDataFrame(atoms, "unit_id string, arm int, atom_id long, q array<double>").withColumn("mass", F.lit(1.0))
    got = {(r["unit_id"], r["arm"], r["atom_id"], r["k"]): r["g"] for r in laws.energy_gradient(law, spark.createDataFrame(seen, "unit_id string, arm int, q array<double>"), 0.1).collect()}
    assert len(got) == 3 * len(atoms)
    for u, a, y in seen:
        own = [(i, np.array(q)) for v, b, i, q in atoms if (v, b) == (u, a)]
        p = np.array([q for _, q in own])

        def score(p, y=np.array(y)):
            att = np.sqrt(((p - y) ** 2).mean(1) + 0.01).mean()
            return att - 0.5 * np.sqrt(((p[:, None] - p) ** 2).mean(2) + 0.01).mean()

        for j, (i, _) in list(enumerate(own))[:6]:
            for k in range(3):
                up, down = p.copy(), p.copy()
                up[j, k] += 1e-5
                down[j, k] -= 1e-5
                assert abs(got[u, a, i, k] - (score(up) - score(down)) / 2e-5) < 1e-6


def test_a_unit_of_twenty_thousand_atoms(spark):
    """Its 2 x 10^8 pairs run by parts; the sum is that of a plain loop over blocks."""
    n, rng = 20_000, np.random.default_rng(3)
    q = rng.normal(size=(n, 5))
    df = spark.createDataFrame([(0, 0, 1.0 / n, v) for v in q.tolist()], "unit_id int, side int, mass double, q array<double>").repartition(8)
    began = time.time()
    got = pairs.pair_sums(df, ["unit_id"], pairs.smoothed(0.0)).collect()[0]["s00"]
    assert time.time() - began < 90
    want = sum(np.sqrt(np.maximum((((q[s : s + 500, None] - q[None, e : e + 2000]) ** 2).mean(2)), 0)).sum() for s in range(0, 2000, 500) for e in range(0, n, 2000)) / 2000 / n
    assert abs(got / want - 1) < 0.02  # the first 2000 atoms stand for all
    parts = pairs.dealt(df.withColumn("unit_id", F.lit(0)), ["unit_id"], pairs.BOUND).groupBy("_lo", "_hi").count().collect()
    assert len(parts) == 55 and max(r["count"] for r in parts) < 3 * pairs.BOUND


def test_empty_and_null_rows(spark):
    kind = "unit_id int, side int, mass double, q array<double>"
    assert pairs.pair_sums(spark.createDataFrame([], kind), ["unit_id"], pairs.smoothed(0.0)).count() == 0
    rows = pairs.pair_sums(spark.createDataFrame([(None, 0, 1.0, [1.0]), (None, 1, 1.0, [3.0]), (2, 0, 1.0, None)], kind), ["unit_id"], pairs.smoothed(0.0)).collect()
    assert [tuple(r) for r in rows] == [(None, 0.0, 2.0, 0.0)]


@pytest.mark.parametrize("bound", [None, 20])
def test_candidate_laws_scored_together(spark, bound):
    """The risks of all scales and jitters in one pass are those of each candidate by itself, for small, tiled and passed-on laws."""
    rng, rows = np.random.default_rng(4), []
    for u, n in enumerate([1, 3, 12, 130]):
        mass = rng.random(n)
        seen = np.sort(rng.normal(size=5) * 900).tolist()
        rows += [(u, u % 2, i, float(m), np.sort(rng.normal(size=5) * 900).tolist(), seen) for i, m in enumerate(mass / mass.sum())]
    points = spark.createDataFrame(rows, "unit_id long, arm int, atom_id long, mass double, q array<double>, seen array<double>")
    got = {r["i"]: r["risk"] for r in laws.tried_risks(points, [1.0, 1.4], [160.0], 2, bound=bound).collect()}
    law, seen = points.drop("seen"), points.select("unit_id", "arm", F.col("seen").alias("q")).dropDuplicates(["unit_id", "arm"])
    tries = [laws.radial_scale(law, 1.0), laws.radial_scale(law, 1.4), laws.jitter(law, 160.0, 2)]
    want = [laws.energy_score(x, seen).agg(F.avg("score")).first()[0] for x in tries]
    assert sorted(got) == [0, 1, 2] and np.allclose([got[i] for i in range(3)], want)
