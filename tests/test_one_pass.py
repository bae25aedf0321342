"""Steps that once copied every row for each group, split or pair: the one-pass forms against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvefx.functions import draws
from curvefx.operators import inference, laws, ordered, pairs, quantiles


def test_a_mass_that_is_the_floor_but_for_rounding_counts(spark):
    """A sum of masses may fall just below 0.2 by the order of its terms; F6."""
    law = spark.createDataFrame([(1, 0, i, m, [0.0]) for i, m in enumerate([0.7, 0.1, 0.2 - 2e-16])], "unit_id long, arm int, atom_id long, mass double, q array<double>")
    centres = spark.createDataFrame([(1, 0, 7, [1.0])], "unit_id long, arm int, centre_id long, q array<double>")
    assert laws.mode_coverage(law.where("atom_id = 2"), centres, 5.0, 0.2).first()["covered"] == 1.0


@pytest.mark.parametrize("bound", [None, 4])
def test_split_halves_of_any_size_and_without_a_half(spark, bound):
    rng = np.random.default_rng(4)
    rows = [(u, i, float(rng.integers(20)), float(rng.integers(1, 5))) for u, n in enumerate([1, 2, 5, 9, 30]) for i in range(n)]
    df = spark.createDataFrame(rows + [(7, 1, None, 1.0)], "u long, i long, y double, w double").repartition(3)
    got = {r["u"]: r["d2"] for r in inference.split_halves(df, "u", "y", "w", ["u", "i"], 3, [0.1, 0.5, 0.9], bound).collect()}
    half = (draws.number(F.col("split"), F.col("u"), F.col("i")) % 2).alias("half")
    c = quantiles.unit_curves(df.withColumn("split", F.explode(F.array(*map(F.lit, range(3))))).withColumn("key", F.concat_ws("|", "u", "split", half)), "key", "y", "w", [0.1, 0.5, 0.9])
    want = {r["key"]: np.array(r["q"]) for r in c.collect()}
    assert set(got) == set(range(5))
    for u in range(5):
        for s in range(3):
            a, b, v = want.get(f"{u}|{s}|0"), want.get(f"{u}|{s}|1"), got[u][s]
            assert (v is None) == (a is None or b is None) and (v is None or abs(v - ((a - b) ** 2).mean()) < 1e-9)


def test_exact_quantiles_over_ranges(spark):
    x = np.random.default_rng(5).normal(size=1001)
    df = ordered.ranges(spark.createDataFrame([(float(v),) for v in x], "q double"), [], [F.col("q")], 7)
    got = quantiles.exact_quantiles(df, "q", [0.0, 0.25, 0.333, 0.75, 1.0]).first()["quantiles"]
    assert np.allclose(got, np.quantile(x, [0.0, 0.25, 0.333, 0.75, 1.0]), rtol=1e-12)


def atoms(rng, sizes):
    return [(u, i, rng.normal(size=2).tolist(), rng.normal(size=3).tolist()) for u, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("bound", [None, 20])
def test_forms_and_sums_at_equal_matrices(spark, bound):
    rows = atoms(np.random.default_rng(6), [1, 3, 40, 130])
    df = spark.createDataFrame(rows, "u long, i long, masses array<double>, q array<double>").repartition(3)
    kernel = pairs.gaussian(1.5)
    forms = {r["u"]: r["forms"] for r in pairs.forms(df, ["u"], kernel, bound).collect()}
    at = df.select("u", "i", (F.col("i") % 2 == 0).alias("at"), F.get("masses", F.lit(0)).alias("mass"), "q")
    sums = {(r["u"], r["i"]): r["value"] for r in pairs.sums_at(at, ["u"], "i", kernel, bound).collect()}
    mixed = {r["u"]: r for r in pairs.mixtures(df, ["u"]).collect()}
    for u in range(4):
        m, q = (np.array([r[k] for r in rows if r[0] == u]) for k in (2, 3))
        k = kernel(((q[:, None] - q) ** 2).mean(2))
        assert np.allclose(forms[u], (m.T @ k @ m).ravel(), rtol=1e-9)
        assert all(abs(sums[u, i] - (k @ m[:, 0])[i]) < 1e-9 for i in range(0, len(m), 2))
        assert np.allclose(mixed[u]["totals"], m.sum(0)) and np.allclose(mixed[u]["sums"], m.T @ q)
    assert len(sums) == sum((n + 1) // 2 for n in [1, 3, 40, 130]) and len(mixed) == 4
