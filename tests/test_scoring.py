"""Scoring against truth, payload choice, permutation tests and draws against slow definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvefx.functions import draws
from curvefx.operators import inference, laws, scoring


def test_target_rows_statuses_and_values(spark):
    truth = [("t", u, u % 2, float(u)) for u in range(8)] + [("other", 0, 0, 1.0)]
    est = [("a", "t", u, u + 1.0) for u in range(8)] + [("a", "t", 99, 5.0), ("b", "t", 0, float("nan")), ("c", "lost", 1, 2.0)]
    declared = [("a", "t"), ("a", "other"), ("b", "t"), ("c", "lost")]
    rows = scoring.target_rows(spark.createDataFrame(est, "view string, target string, unit_id int, value double"), spark.createDataFrame(truth, "target string, unit_id int, bin int, value double"), spark.createDataFrame(declared, "view string, target string")).collect()
    got = {(r["view"], r["target"], r["metric"], r["bin"]): (r["status"], r["value"], r["failure_reason"]) for r in rows}
    assert got["a", "t", "tate_estimate", -1][1] == 4.5 and got["a", "t", "tate_oracle", -1][1] == 3.5
    assert got["a", "t", "tate_abs_error", -1] == ("ok", 1.0, None) and got["a", "t", "tcate_rmse", -1][1] == 1.0
    assert got["a", "t", "tcate_estimate", 0][1] == 4.0 and got["a", "t", "tcate_oracle", 1][1] == 4.0
    assert {got["a", "other", m, -1] for m in ("tate_estimate", "tcate_rmse")} == {("not_applicable", None, scoring.NO_TARGET)}
    assert got["b", "t", "tcate_rmse", -1] == ("failed", None, scoring.BROKEN)
    assert got["c", "lost", "tate_oracle", -1] == ("not_applicable", None, scoring.NO_TRUTH)
    assert len(rows) == 4 * 4 + 4


def test_payloads_are_resolved_once_by_preference(spark):
    payloads = spark.createDataFrame([("x", 1, "m"), ("y", 0, "m"), ("x", 1, "s"), ("z", 1, "s"), ("n", None, "s")], "source string, rank int, native string")
    targets = spark.createDataFrame([("M", "m"), ("M2", "m"), ("S", "s"), ("Q", "q")], "target string, native string")
    assert {r["target"]: r["source"] for r in scoring.resolved(payloads, targets).collect()} == {"M": "y", "M2": "y", "S": "x", "Q": None}
    est = spark.createDataFrame([("x", "m", 1, 9.0), ("y", "m", 1, 1.0), ("x", "s", 1, 3.0)], "source string, native string, unit_id int, value double")
    truth = spark.createDataFrame([("M", 1, 0, 0.5), ("M2", 1, 0, 0.0), ("S", 1, 0, 3.0)], "target string, unit_id int, bin int, value double")
    got = {(r["source"], r["target"]): (r["status"], r["value"]) for r in scoring.dense_rows(est, truth, payloads, targets).where("metric = 'tate_abs_error'").collect()}
    assert got == {("y", "M"): ("ok", 0.5), ("y", "M2"): ("ok", 1.0), ("x", "S"): ("ok", 0.0), ("none", "Q"): ("not_applicable", None)}


def test_permutation_tests_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(inference, "UNITS", 7)
    rng = np.random.default_rng(3)
    n, rounds = 60, 300
    q, a, bin_ = rng.normal(size=(n, 3)), rng.integers(0, 2, n), rng.integers(0, 3, n)
    q[:, 1] += a
    df = spark.createDataFrame([(i, q[i].tolist(), int(a[i]), int(bin_[i])) for i in range(n)], "u long, q array<double>, a int, b int").repartition(5)
    got = {(r["scope"], r["part"]): r for r in inference.permutation_tests(df, "u", "q", "a", rounds, "b", 4, seed=5).collect()}
    assert len(got) == 1 + 4 + 3 and got["bin", 3]["observed"] is None and got["bin", 3]["p_share"] is None

    def mixed(key, draw):  # in plain whole numbers
        h = (key % draws.PRIME * 39373 + draw * 742938 + 5 * 950706 + 1) % draws.PRIME
        for factor, shift in draws.STEPS:
            h = (h * factor + 12345) % draws.PRIME
            h ^= h >> shift
        return h % draws.PRIME

    limit = int(a.mean() * draws.PRIME)
    dealt = np.array([[mixed(i, d) < limit for i in range(n)] for d in range(rounds)])
    assert abs(dealt.mean() - a.mean()) < 0.03 and abs(np.corrcoef(dealt[:, 0], dealt[:, 1])[0, 1]) < 0.2
    for (scope, part), r in got.items():
        if (scope, part) == ("bin", 3):
            continue
        use = bin_ == part if scope == "bin" else np.ones(n, bool)
        y = (q[:, part] if scope == "coordinate" else q.mean(1))[use]
        diff = lambda t, y=y: y[t].mean() - y[~t].mean()
        seen = diff(a[use] == 1)
        hits = sum(abs(diff(t[use])) >= abs(seen) for t in dealt)
        assert r["observed"] == pytest.approx(seen) and r["p_share"] == hits / rounds and r["p_plus_one"] == (hits + 1) / (rounds + 1)
    assert got["coordinate", 1]["p_plus_one"] < 0.05


def test_draws_by_search_equal_a_scan(spark):
    rng = np.random.default_rng(9)
    rows = []
    for u, arm, n in ((1, 0, 1), (1, 1, 5), (2, 0, 400)):
        m = rng.random(n)
        rows += [(u, arm, i, float(x), [float(i)]) for i, x in enumerate(m / m.sum())]
    law = spark.createDataFrame(rows, "unit_id long, arm int, atom_id long, mass double, q array<double>").repartition(6)
    got = {(r["unit_id"], r["arm"], r["atom_id"]): r["q"][0] for r in laws.sampled(law, 30, 2).collect()}
    uniform = {(r["u"], r["a"], r["d"]): r["x"] for r in law.select("unit_id", "arm").distinct().select(F.col("unit_id").alias("u"), F.col("arm").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("d")).withColumn("x", draws.uniform(F.lit(2), F.col("u"), F.col("a"), F.col("d"))).collect()}
    assert len(got) == 90
    for (u, a, d), x in uniform.items():
        total = 0.0
        for k, arm, i, m, _ in rows:
            if (k, arm) == (u, a):
                total += m
                if x <= total:
                    break
        assert got[u, a, d] == i and not math.isnan(x)
