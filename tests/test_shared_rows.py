"""Boosted means over rows that all models share: no joins between the steps of a learner, cuts found once, units sorted by key alone; F24."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvefx.operators import learners, quantiles, trees


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def units(spark, n=300):
    rng = np.random.default_rng(24)
    x, a, fold = rng.integers(0, 9, (n, 2)).astype(float), rng.integers(0, 2, n), rng.integers(0, 3, n)
    y = np.stack([x[:, 0] * 2 + a * (x[:, 1] > 4), x[:, 1] - a], 1) + rng.normal(size=(n, 2)) * 0.1
    rows = [(i, int(a[i]), x[i].tolist(), y[i].tolist(), int(fold[i])) for i in range(n)]
    return spark.createDataFrame(rows, "unit_id int, a int, x array<double>, y array<double>, fold int").repartition(3)


@pytest.mark.parametrize("weighted", [False, True])
def test_shared_rows_give_what_arrays_over_models_give(spark, weighted):
    u = units(spark).withColumn("w", F.col("a") - F.lit(0.4)) if weighted else units(spark)
    rules = trees.Rules(2, 10, 2, "r_loss", {m: float(m) for m in range(6)}) if weighted else trees.Rules(2, 10, 0, "forced")
    arrays = learners.with_models(u, 3, 2).withColumn("y", F.flatten(F.array_repeat("y", 6)))
    arrays = arrays.withColumn("w", F.array_repeat("w", 6)) if weighted else arrays.drop("a")
    want = {r["unit_id"]: r["f"] for r in learners.boost_mean(arrays, 2, rules=rules).collect()}
    got = learners.boost_mean(u, 2, rules=rules, folds=3, variants=2).collect()
    assert len(got) == len(want) == 300 and all(len(r["f"]) == 12 and len(r["y"]) == 2 for r in got)
    assert np.array([r["f"] for r in got]) == pytest.approx(np.array([want[r["unit_id"]] for r in got]), rel=1e-9, abs=1e-9)


def test_an_r_learner_joins_nothing_and_finds_cuts_once(spark, monkeypatch):
    found, made, cut, store = [], [], trees.cut_points, learners.stored
    monkeypatch.setattr(trees, "cut_points", lambda *args: found.append(1) or cut(*args))
    monkeypatch.setattr(learners, "stored", lambda d: made.append(plan(d)) or store(d))
    _, t = learners.r_learner(units(spark), [1.0, 40.0], 3, 2, per_column=True, given={"e": F.lit(0.5)})
    assert t.count() == 300 and len(found) == 1 and made and not any("Join" in p for p in [*made, plan(t)])


def test_cuts_of_few_and_many_values_with_a_null(spark):
    few, many = [float(i % 7) for i in range(400)], [float(i) for i in range(400)]
    df = spark.createDataFrame([([a, b],) for a, b in zip(few, many)] + [([3.0, None],)], "x array<double>").repartition(3)
    a, b = trees.cut_points(df, 2)
    assert a == [i + 0.5 for i in range(6)] and len(b) == 30 and np.isfinite(b).all() and (np.diff(b) > 0).all()


def test_units_are_sorted_by_key_alone_and_in_order_in_their_task(spark):
    rng = np.random.default_rng(3)
    rows = [(int(u), float(rng.integers(5)), float(rng.uniform(0.1, 2))) for u in rng.integers(0, 40, 900)]
    df = spark.createDataFrame(rows, "u int, y double, w double").repartition(4)
    curves = quantiles.unit_curves(df, "u", "y", "w", [0.1, 0.5, 0.9])
    assert "Sort [u#" in plan(curves) and "y#" not in plan(curves).split("Sort [")[1].split("]")[0]
    got = {r["u"]: r["q"] for r in curves.collect()}
    want = {r["u"]: r["q"] for r in quantiles.unit_curves(df, "u", "y", "w", [0.1, 0.5, 0.9], spread=True).collect()}
    assert got.keys() == want.keys() and all(got[u] == pytest.approx(want[u], rel=1e-9) for u in want)
