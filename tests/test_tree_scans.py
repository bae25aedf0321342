"""Trees read their rows once for each level: leaves are the sides of their parents' cuts; F23, F24."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvefx.operators import learners, trees


def training(spark, n=240, models=2):
    rng = np.random.default_rng(12)
    x, a, t = rng.integers(0, 9, (n, 3)).astype(float), rng.integers(0, 2, (n, models)), (rng.uniform(size=(n, models)) < 0.8).astype(int)
    v = np.concatenate([((x[:, :1] > 3) * 2.0 + (x[:, 1:2] > 5) * (1 + m) + a[:, m : m + 1]) * [1.0, -0.5] for m in range(models)], 1) + rng.normal(size=(n, 2 * models)) * 0.1
    mass = rng.uniform(0.5, 2, (n, models))
    rows = [(x[i].tolist(), a[i].tolist(), t[i].tolist(), v[i].tolist(), mass[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "x array<double>, a array<int>, t array<int>, v array<double>, mass array<double>").repartition(5), (x, a, t, v, mass)


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_leaves_are_sums_of_their_rows_and_levels_are_the_only_scans(spark, monkeypatch, depth):
    df, (x, a, t, v, mass) = training(spark)
    scans, plain = [], trees.histograms
    monkeypatch.setattr(trees, "histograms", lambda *args: scans.append(1) or plain(*args))
    forest = trees.grow(df, 2, [[c + 0.5 for c in range(8)]] * 3, trees.Rules(depth=depth, leaf=30, arm_leaf=5, rule="independent"))
    assert len(scans) <= max(depth, 1)
    leaf = forest.route(x)
    for m in range(2):
        for k in np.unique(leaf[t[:, m] != 0, m]):
            for arm in (0, 1):
                own = (leaf[:, m] == k) & (t[:, m] != 0) & (a[:, m] == arm)
                assert np.allclose(forest.value[k][arm], v[own, 2 * m : 2 * m + 2].sum(0) / mass[own, m].sum())


def test_boosted_means_store_a_state_for_each_step_and_no_training_rows(spark, monkeypatch):
    df, (x, a, t, v, _) = training(spark)
    rows = df.select(F.monotonically_increasing_id().alias("unit_id"), "x", "t", F.col("v").alias("y"))
    made, plain = [], learners.stored
    monkeypatch.setattr(learners, "stored", lambda d: made.append(1) or plain(d))
    state = learners.boost_mean(rows, 3).collect()
    assert len(made) == 1 + 3
    f, y, own = (np.array([r[c] for r in state]).reshape(len(state), 2, -1) for c in "fyt")
    error = lambda g: (((y - g) ** 2) * own).sum((0, 2)) / own.sum((0, 2))
    assert (error(f) < 0.6 * error((y * own).sum(0) / own.sum(0))).all()
