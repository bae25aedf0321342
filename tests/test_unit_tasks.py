"""Steps that moved, sorted or joined every row more than once: the forms inside a unit's task against the slow ones; F18."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvefx.operators import quantiles, scoring


def unit_rows(spark, sizes, whole):
    rng = np.random.default_rng(8)
    rows = [(u, i, float(rng.integers(9)), float(rng.integers(1, 5)) if whole else float(rng.uniform(0.1, 3))) for u, n in sizes for i in range(n)]
    odd = [(4, 900, None, 1.0), (4, 901, float("nan"), 1.0), (4, 902, 3.0, 0.0), (4, 903, 3.0, None), (77, 0, None, 1.0), (77, 1, 2.0, -1.0)]
    return spark.createDataFrame(rows + odd, "u long, i long, y double, w double").repartition(3)


SIZES = [(None, 6), (-1, 4), (0, 1), (1, 2), (2, 3), (3, 3), (4, 25), (5, 40), (6, 90)]


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("large", [None, 20])
def test_curves_of_all_grids_from_one_run(spark, monkeypatch, whole, large):
    if large:
        monkeypatch.setattr(quantiles, "LARGE_UNIT", large)
        monkeypatch.setattr(quantiles, "BUCKETS", 3)
    df = unit_rows(spark, SIZES, whole)
    grids = {"q": [0.1, 0.5, 0.9], "p": [0.02, 0.3, 0.31, 0.32, 0.97]}
    got = {r["u"]: r for r in quantiles.unit_curves_on(df, "u", "y", "w", grids).collect()}
    assert set(got) == {u for u, _ in SIZES}
    for n, levels in grids.items():
        want = {r["u"]: r["q"] for r in quantiles.unit_curves(df, "u", "y", "w", levels, spread=True).collect()}
        assert all(np.allclose(got[u][n], want[u], rtol=1e-9) for u, _ in SIZES)


def test_curves_move_and_sort_rows_once(spark):
    plan = quantiles.unit_curves(unit_rows(spark, SIZES, True), "u", "y", "w", spread=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "HashAggregate" not in plan


def test_wide_rows_equal_target_rows_without_a_join(spark):
    u = spark.createDataFrame([(i, i % 2, float(i), i + 1.5, float("nan") if i == 3 else 2.0) for i in range(8)], "unit_id long, bin int, t double, e double, bad double")
    declared = spark.createDataFrame([("a", "t"), ("b", "t"), ("a", "lost"), ("c", "t")], "view string, target string")
    est = {("a", "t"): F.col("e"), ("b", "t"): F.col("bad"), ("a", "lost"): F.col("e")}
    long = None
    for (view, target), v in est.items():
        one = u.select(F.lit(view).alias("view"), F.lit(target).alias("target"), "unit_id", v.alias("value"))
        long = one if long is None else long.unionByName(one)
    rows = lambda df: sorted(map(str, df.collect()))
    got = rows(scoring.wide_rows(u, est, {"t": F.col("t")}, declared))
    assert got == rows(scoring.target_rows(long, scoring.long_values(u, ["unit_id", "bin"], {"t": F.col("t")}), declared)) and len(got) == 4 * 4 + 4
    none = u.where("false")
    assert {r["failure_reason"] for r in scoring.wide_rows(none, est, {"t": F.col("t")}, declared).collect()} == {scoring.NO_TRUTH}
    payloads = spark.createDataFrame([("a", 0, "m"), ("b", 1, "m")], "source string, rank int, native string")
    targets = spark.createDataFrame([("t", "m"), ("z", "n")], "target string, native string")
    dense = scoring.dense_wide_rows(u, {("a", "m"): F.col("e"), ("b", "m"): F.col("bad")}, {"t": F.col("t")}, payloads, targets)
    assert {(r["source"], r["target"], r["status"]) for r in dense.collect()} == {("a", "t", "ok"), ("none", "z", "not_applicable")}


WORKERS = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from curvefx.operators import inference, quantiles
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame([(u, i, float(i), 1.0) for u in range(3) for i in range(5)], "u long, i long, y double, w double")
print("rows", *[f.count() for f in (quantiles.unit_curves(df, "u", "y", "w"), inference.bootstrap_curves(df, "u", "y", "w", ["i"], 5), inference.split_halves(df, "u", "y", "w", ["u", "i"], 3))])
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", WORKERS.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 3 3 3" in got.stdout, got.stderr[-2000:]
