"""Invariants and slow definitions of the operators without SQL twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvefx.functions import curves as C
from curvefx.grid import check_levels, midpoint_levels
from curvefx.operators import boost, effects, inference, laws, learners, ledger, ordered, prep, quantiles, trees
from curvefx.sources import io
from curvefx.streaming import moments


def interp_curve(y, w, levels):
    o = np.argsort(y, kind="stable")
    c = np.cumsum(np.array(w)[o])
    return np.maximum.accumulate(np.interp(levels, c / c[-1], np.array(y)[o]))


@pytest.mark.parametrize("spread", [False, True])
def test_unit_curves_follow_linear_interpolation(spark, spread):
    rng = np.random.default_rng(0)
    rows = [(u, float(y), float(w)) for u in range(6) for y, w in zip(rng.normal(size=5 + 9 * u).round(1), rng.integers(1, 9, 5 + 9 * u))]
    odd = [(0, None, 1.0), (0, float("nan"), 1.0), (0, 1.0, 0.0), (0, 1.0, None), (99, None, 1.0), (0, float("inf"), 2.0)]
    d = spark.createDataFrame(rows + odd, "u int, y double, w double")
    got = {r["u"]: r["q"] for r in quantiles.unit_curves(d, "u", "y", "w", spread=spread).collect()}
    assert set(got) == set(range(6))
    for u in got:
        own = sorted((y, w) for k, y, w in rows if k == u)
        assert np.allclose(got[u], interp_curve([y for y, _ in own], [w for _, w in own], midpoint_levels()))
    assert quantiles.unit_curves(d.where("false"), "u", "y", "w").count() == 0


def test_levels_are_checked():
    with pytest.raises(ValueError):
        check_levels([0.5, 0.4])
    with pytest.raises(ValueError):
        check_levels([0.0, 0.5])


def test_global_rank_and_running_share(spark):
    d = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = [(r["v"], r["id"]) for r in ordered.global_rank(d, [F.col("v"), F.col("id")], parts=7).orderBy("rank").collect()]
    assert got == sorted(got)
    k = ordered.running_share(d.withColumn("w", F.lit(1.0)), [], "v", "w", [F.col("v"), F.col("id")], 7).orderBy("c").collect()
    assert [round(r["c"] * 1000) for r in k] == list(range(1, 1001)) and k[0]["c0"] is None and all(r["y0"] is not None for r in k[1:])


def test_projection_is_isotonic_regression(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(40, 9))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "i int, q array<double>")
    got = np.array([r["p"] for r in d.orderBy("i").select(C.project_monotone(F.col("q")).alias("p")).collect()])
    assert np.allclose(got, boost.project(q)) and (np.diff(got) >= -1e-12).all() and np.allclose(got.sum(1), q.sum(1))


def test_gradient_is_the_derivative_of_the_score():
    rng = np.random.default_rng(2)
    p, q, eps = rng.normal(size=(3, 4, 5)), rng.normal(size=(3, 5)), 0.1
    g = -boost.descent(p, q, eps) / (4 * 5)
    for idx in [(0, 0, 0), (1, 2, 3), (2, 3, 4)]:
        h = np.zeros_like(p)
        h[idx] = 1e-6
        assert np.isclose(((boost.scores(p + h, q, eps) - boost.scores(p - h, q, eps)) / 2e-6)[idx[0]], g[idx], atol=1e-6)
    same = np.zeros((1, 3, 2))
    assert np.isfinite(boost.descent(same, same[:, 0], 0.0)).all()


def test_tree_matches_exhaustive_search(spark):
    rng = np.random.default_rng(3)
    n = 120
    x, a = rng.integers(0, 8, (n, 2)).astype(float), rng.integers(0, 2, n)
    v = np.stack([(x[:, 0] > 4) * 3.0 + a, (x[:, 1] > 2) * 1.0], 1) + rng.normal(size=(n, 2)) * 0.1
    d = spark.createDataFrame([([int(a[i])], [1], x[i].tolist(), v[i].tolist(), [1.0]) for i in range(n)], "a array<int>, t array<int>, x array<double>, v array<double>, mass array<double>")
    cuts = trees.cut_points(d, 2)
    tree = trees.grow(d.repartition(5), 1, cuts, trees.Rules(depth=1, leaf=5, arm_leaf=2, shared=10.0))
    sse = lambda m: ((v[m] - v[m].mean(0)) ** 2).sum()
    best = min((sse(x[:, f] <= c) + sse(x[:, f] > c), f, c) for f in (0, 1) for c in cuts[f] if 5 <= (x[:, f] <= c).sum() <= n - 5)
    assert tree.splits()[1] == (best[1], best[2])
    left = x[:, best[1]] <= best[2]
    n0, n1 = (left & (a == 0)).sum(), (left & (a == 1)).sum()
    gap = v[left & (a == 1)].mean(0) - v[left & (a == 0)].mean(0)
    eff = n0 * n1 / (n0 + n1)
    assert np.allclose(tree.leaves()[2][1] - tree.leaves()[2][0], gap * eff / (eff + 10)) and np.allclose((n0 * tree.leaves()[2][0] + n1 * tree.leaves()[2][1]) / (n0 + n1), v[left].mean(0))


def unit_rows(spark, n=160, shift=2.0):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        m = float(rng.uniform(-1, 1))
        a = int(rng.uniform() < 0.5)
        rows.append((i, a, [m, float(rng.integers(0, 4))], sorted((rng.normal(size=4) * 0.3 + m + shift * a).tolist()), i % 2))
    return spark.createDataFrame(rows, "unit_id int, a int, x array<double>, q array<double>, fold int")


def test_booster_lowers_risk_and_replays(spark):
    u = unit_rows(spark).withColumns({"t": F.array(F.lit(1)), "a": F.array("a")})
    book, state = boost.fit(u, particles=3, steps=2, halvings=3, rules=trees.Rules(leaf=10, arm_leaf=3, shared=1.0))
    t = boost.trace_table(book, spark).orderBy("step").collect()
    assert len(t) == 2 and all(r["after"] <= r["before"] + 1e-12 for r in t) and t[-1]["after"] < t[0]["before"]
    again = boost.predict(book, state.select("unit_id", "a", "x"))
    want = {r["unit_id"]: sorted(map(tuple, np.array(r["p"]).reshape(3, 4).round(9).tolist())) for r in state.collect()}
    assert {r["unit_id"]: list(map(tuple, np.array(r["p"]).reshape(3, 4).round(9).tolist())) for r in again.collect()} == want


def test_cross_fitting_scores_each_unit_once_and_finds_the_effect(spark):
    u = unit_rows(spark)
    penalty, risks, state, book = learners.cross_fitted_laws(u, [0.0, 50.0], 2, particles=3, steps=2, halvings=3, rules=trees.Rules(leaf=10, arm_leaf=3))
    assert risks.count() == 2 and sorted(r["unit_id"] for r in state.collect()) == list(range(160))
    mu = learners.arm_means(state, book, {"mean": C.curve_mean}, 2).drop("run", "a", "fold")
    j = u.join(mu, "unit_id").withColumn("psi", effects.aipw(C.curve_mean(F.col("q")), F.col("a"), F.lit(0.5), F.col("mu0_mean"), F.col("mu1_mean")))
    assert abs(effects.marginal(j, "psi").first()["effect"] - 2.0) < 0.4


def test_laws(spark):
    rng = np.random.default_rng(5)
    rows = [(u, a, i, 0.25, sorted(rng.normal(size=3).tolist())) for u in range(3) for a in (0, 1) for i in range(4)]
    law = spark.createDataFrame(rows, "unit_id int, arm int, atom_id int, mass double, q array<double>")
    assert all(r["ok"] for r in laws.law_check(law).collect())
    assert max(abs(r["mmd2"]) for r in laws.squared_mmd(law, law, 1.0).collect()) < 1e-12
    own = {(r["unit_id"], r["arm"]): r["risk"] for r in laws.energy_risk(law, law).collect()}
    far = {(r["unit_id"], r["arm"]): r["risk"] for r in laws.energy_risk(law.withColumn("q", F.transform("q", lambda v: v + 1)), law).collect()}
    assert all(own[k] < far[k] for k in own)
    two = laws.two_part(law, law.select("unit_id", "arm").distinct().withColumn("p", F.lit(0.3)))
    assert all(r["ok"] for r in laws.law_check(two).collect()) and all(abs(r["zero"] - 0.3) < 1e-12 for r in laws.zero_mass(two, 0.0).collect())
    noisy = laws.jitter(law, 0.1, 3)
    assert noisy.count() == 72 and all(r["ok"] for r in laws.law_check(noisy).collect()) and noisy.where(~C.is_monotone(F.col("q"))).count() == 0
    assert sorted(map(str, laws.jitter(law.repartition(3), 0.1, 3).collect())) == sorted(map(str, noisy.collect()))


def test_placebo_keeps_arm_counts(spark):
    u = spark.range(101).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("a"))
    p = effects.permuted(u, "k", "a", 1)
    assert p.agg(F.sum("a")).first()[0] == 34 and p.select("k").distinct().count() == 101
    t = inference.permutation_test(u.withColumn("y", F.col("k") * 1.0), "k", "y", "a", 50).first()
    assert 0 < t["p_plus_one"] <= 1


def test_guards(spark, tmp_path):
    d = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(prep.KeyNotUnique):
        prep.join_many_to_one(d, d, ["k"])
    assert io.write_once(d, f"{tmp_path}/t") and not io.write_once(d.orderBy(F.desc("v")), f"{tmp_path}/t")
    with pytest.raises(ValueError):
        io.write_once(d.where("v = 2"), f"{tmp_path}/t")
    wide = spark.createDataFrame([("A,m,NO", "12 b", ":"), ("A,x,SE", "3", "4")], "`freq,unit,geo` string, `2019` string, `2020` string")
    got = {(r["geo"], r["year"]): (r["value"], r["flag"]) for r in io.wide_to_long(wide, ["freq", "unit", "geo"], unit="m").collect()}
    assert got == {("NO", 2019): (12.0, "b"), ("NO", 2020): (None, None)}


def test_merge_audit_finds_each_fault(spark):
    man = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "cell_key string, seed int")
    good = spark.createDataFrame([("a", 1, "ok", 0), ("b", 2, "ok", 0), ("c", 3, "failed", 1)], "cell_key string, seed int, status string, shard int")
    assert ledger.merge_audit(man, good, ["seed"]).first()["verdict"] == "PASS"
    bad = good.where("cell_key <> 'c'").union(spark.createDataFrame([("z", 9, "odd", 1), ("a", 7, "ok", 1)], good.schema))
    r = ledger.merge_audit(man, bad, ["seed"]).first()
    assert (r["missing"], r["unknown"], r["mismatched"], r["split"], r["bad_status"], r["verdict"]) == (1, 1, 1, 1, 1, "FAIL")


def test_streamed_moments_equal_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = moments.windowed_moments(s, "ts", ["event_type"], "value", late="60 days").writeStream.outputMode("update").format("memory").queryName("m").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("m").groupBy("window", "event_type").agg(F.max_by(F.struct("n", "s1", "s2"), "n").alias("x")).select("event_type", "x.*")
    a = {r["event_type"]: r["n"] for r in ledger.moments_summary(last, ["event_type"]).collect()}
    assert a == {r["event_type"]: r["count"] for r in src.groupBy("event_type").count().collect()}


def test_auc_counts_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(float(rng.integers(0, 20)), int(rng.integers(0, 2))) for _ in range(300)]
    pairs = [(a > b) + (a == b) / 2 for a, i in rows for b, j in rows if i == 1 and j == 0]
    assert np.isclose(inference.auc(spark.createDataFrame(rows, "e double, a int"), "e", "a").first()["auc"], np.mean(pairs))


def test_differences_make_their_curve_once(spark):
    """A curve that is itself an expression is not made again for each level."""
    d = spark.createDataFrame([([3.0, 1.0, 4.0, 2.0],), (None,), ([],)], "q array<double>").select(C.adjacent(C.running_max(F.col("q"))).alias("d"))
    assert [r["d"] for r in d.collect()] == [[0.0, 1.0, 0.0], None, []]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
