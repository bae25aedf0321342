"""Particles are made again from the trees in each scan, once for rows that share their leaves, and are not stored; F2."""

import os

import numpy as np
import pytest

from curvefx.operators import boost, learners, ordered, trees


@pytest.mark.parametrize("given", [False, True])
def test_laws_follow_from_the_trees_and_are_not_stored(spark, given):
    rng = np.random.default_rng(21)
    n = 80
    x, a, fold = rng.integers(0, 6, (n, 2)).astype(float), rng.integers(0, 2, n), rng.integers(0, 3, n)
    q = np.sort(rng.normal(size=(n, 4)), 1) + x[:, :1] + a[:, None] * (x[:, 1:] > 2)
    e = rng.uniform(0.2, 0.8, n)
    u = spark.createDataFrame([(i, int(a[i]), x[i].tolist(), q[i].tolist(), int(fold[i]), float(e[i])) for i in range(n)], "unit_id int, a int, x array<double>, q array<double>, fold int, e double").repartition(3)
    rows = learners.with_models(u if given else u.drop("e"), 3, 1)
    folder = f"{ordered.shared_folder(spark)}/curvefx"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    book, state = boost.fit(rows, particles=3, steps=3, halvings=3, rules=trees.Rules(leaf=8, arm_leaf=2, rule="contrast" if given else "ridge", shared=2.0))
    new = set(os.listdir(folder)) - before
    assert len(book.steps) == 3 and not any({"p", "v"} & set(spark.read.parquet(f"{folder}/{f}").columns) for f in new)
    arms, es = np.repeat(a[:, None], 3, 1), np.repeat(e[:, None], 3, 1) if given else None
    want = np.repeat(book.start[None], n, 0)
    for sizes, forest in book.steps:
        want = boost.stepped(want, forest.predict(x, arms, es).reshape(want.shape), sizes)
    laws = boost.replayed(book.start, book.steps, x, arms, es)
    assert (laws.p[laws.cell] == want).all() and (len(laws.p) == 3 * n if given else len(laws.p) < n)
    got = {r["unit_id"]: np.array(r["p"]).reshape(3, 3, 4) for r in state.collect()}
    assert all((got[i] == want[i]).all() for i in range(n))
    risk = [boost.scores(want[fold == m, m], q[fold == m], 1e-3).mean() for m in range(3)]
    assert boost.held_out_risk(book, rows) == pytest.approx(np.array(risk), rel=1e-9)
    assert np.allclose([t[2] for t in book.trace if t[0] == 0], [boost.scores(np.repeat(book.start[m][None], n, 0)[fold != m], q[fold != m], 1e-3).mean() for m in range(3)])
