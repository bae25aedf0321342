"""Learner queries on the units of the curve queries. Those without SQL twins are held to slow definitions, row by row, in tests/test_learners.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves as C
from ..grid import midpoint_levels
from ..operators import boost, effects, laws, learners, ordered, prep, quantiles, trees
from .effect_queries import dr_sql, scored
from .roles import R, UNITS, micro, r, twin, units

QUERIES, ORACLES = {}, {}
K = 5


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rows(spark, d):
    """unit_id, a, x (moderator, size, brand number), q (5 levels), fold; stored."""
    u = prep.ecdf_moderator(units(spark, d), "moderator_raw", "unit_id")
    u = prep.folds_seeded(u, "a", "unit_id", 7, 3)
    q = quantiles.unit_curves(micro(spark, d), "unit_id", "y", "w", midpoint_levels(K))
    x = F.array(F.col("m"), F.col("size").cast("double"), F.regexp_extract("brand", r"(\d+)", 1).cast("double"))
    return ordered.stored(u.join(q, "unit_id").select("unit_id", "a", x.alias("x"), "q", "fold", "m"))


def single(u):
    """Units as rows of one model that trains on all of them."""
    return u.withColumns({"t": F.array(F.lit(1)), "a": F.array("a")})


def one_target(df, x, v, w=None):
    """Training rows of one tree with one feature and one target."""
    one = [F.array(F.lit(1)).alias("t"), F.array(F.lit(1.0)).alias("mass")]
    return df.select(F.array("a").alias("a"), F.array(x.cast("double")).alias("x"), F.array(v).alias("v"), *one, *([F.array(w).alias("w")] if w is not None else []))


FAST = {"particles": 5, "steps": 3, "halvings": 4}


@query("m1_shared_tree")
def m1(spark, d):
    """One shared tree on whole curves: leaf values of both arms."""
    t = single(rows(spark, d)).select("a", "x", "t", F.col("q").alias("v"), F.array(F.lit(1.0)).alias("mass"))
    tree = trees.grow(t, 1, trees.cut_points(t, 3), trees.Rules(depth=2, leaf=20, arm_leaf=5, shared=50.0))
    out = [(k, a, i, float(v)) for k, vals in tree.leaves().items() for a in (0, 1) for i, v in enumerate(vals[a])]
    return spark.createDataFrame(out, "leaf int, arm int, k int, value double").withColumn("value", r(F.col("value"), 3))


@query("m2_leaf_moments", twin(UNITS + ", g AS (SELECT size // 10 AS bin, a, count(*) AS n, sum(moderator_raw) AS s FROM units GROUP BY ALL), h AS (SELECT bin, coalesce(sum(n) FILTER (a = 1), 0)::DOUBLE AS n1, coalesce(sum(n) FILTER (a = 0), 0)::DOUBLE AS n0 FROM g GROUP BY bin)", f"SELECT bin::INT AS bin, a, n, {R('s')} AS s, {R('(n1 * n0 / (n1 + n0)) / (n1 * n0 / (n1 + n0) + 50)', 6)} AS ridge_factor FROM g JOIN h USING (bin)"))
def m2(spark, d):
    """Leaf counts and sums by arm, and the ridge rule's contrast factor."""
    from pyspark.sql import Window

    g = units(spark, d).groupBy(F.expr("size div 10").cast("int").alias("bin"), "a").agg(F.count("*").alias("n"), F.sum("moderator_raw").alias("s"))
    w = Window.partitionBy("bin")
    n1, n0 = (F.sum(F.when(F.col("a") == k, F.col("n")).otherwise(0)).over(w).cast("double") for k in (1, 0))
    eff = n1 * n0 / (n1 + n0)
    return g.select("bin", "a", "n", r(F.col("s")).alias("s"), r(eff / (eff + 50), 6).alias("ridge_factor"))


#: Counts, sums and squares of the price by size bin and arm, and the leaf rules' values for both arms.
LEAVES = """lg AS (SELECT (size // 10)::INT AS bin, count(*) FILTER (a = 0)::DOUBLE AS n0, count(*) FILTER (a = 1)::DOUBLE AS n1, coalesce(avg(moderator_raw) FILTER (a = 0), 0) AS m0, coalesce(avg(moderator_raw) FILTER (a = 1), 0) AS m1, avg(moderator_raw) AS p, var_samp(moderator_raw) FILTER (a = 0) / count(*) FILTER (a = 0) AS v0, var_samp(moderator_raw) FILTER (a = 1) / count(*) FILTER (a = 1) AS v1 FROM units GROUP BY 1),
lf AS (SELECT *, n1 / (n0 + n1) AS s, n0 * n1 / (n0 + n1) / (n0 * n1 / (n0 + n1) + 20) AS ridge, CASE WHEN m1 = m0 THEN 0 ELSE greatest(0, 1 - 2 * (coalesce(v0, 0) + coalesce(v1, 0)) / ((m1 - m0) * (m1 - m0))) END AS cut FROM lg),
lv AS (SELECT bin, 'forced' AS rule, p AS v0, p AS v1 FROM lf UNION ALL SELECT bin, 'independent', CASE WHEN n0 * n1 = 0 THEN p ELSE m0 END, CASE WHEN n0 * n1 = 0 THEN p ELSE m1 END FROM lf
UNION ALL SELECT bin, 'arm_shrinkage', CASE WHEN n0 * n1 = 0 THEN p ELSE (n0 * m0 + 20 * p) / (n0 + 20) END, CASE WHEN n0 * n1 = 0 THEN p ELSE (n1 * m1 + 20 * p) / (n1 + 20) END FROM lf
UNION ALL SELECT bin, 'ridge', CASE WHEN n0 * n1 = 0 THEN p ELSE p - s * ridge * (m1 - m0) END, CASE WHEN n0 * n1 = 0 THEN p ELSE p + (1 - s) * ridge * (m1 - m0) END FROM lf
UNION ALL SELECT bin, 'threshold', CASE WHEN n0 * n1 = 0 THEN p ELSE p - s * cut * (m1 - m0) END, CASE WHEN n0 * n1 = 0 THEN p ELSE p + (1 - s) * cut * (m1 - m0) END FROM lf)"""


@query("m2_leaf_rules", twin(UNITS + ", " + LEAVES, f"SELECT bin, rule, {R('v0', 3)} AS arm_0, {R('v1', 3)} AS arm_1 FROM lv"))
def m2_rules(spark, d):
    """The five leaf rules on the price by size bin; a row for each bin reaches the driver."""
    import numpy as np

    p = F.col("moderator_raw")
    g = units(spark, d).groupBy(F.expr("size div 10").cast("int").alias("bin")).agg(*[f(F.when(F.col("a") == k, v)).alias(f"{n}{k}") for k in (0, 1) for n, f, v in (("n", F.count, p), ("s", F.sum, p), ("q", F.sum, p * p))]).collect()
    out = []
    for x in g:
        n, s, q = (np.array([x[f"{c}0"] or 0, x[f"{c}1"] or 0], float) for c in "nsq")
        for rule, penalty in (("forced", 0.0), ("independent", 0.0), ("arm_shrinkage", 20.0), ("ridge", 20.0), ("threshold", 2.0)):
            v = trees.leaf_values(n, n, q, s[:, None], trees.Rules(rule=rule), penalty)
            out.append((x["bin"], rule, float(v[0][0]), float(v[1][0])))
    t = spark.createDataFrame(out, "bin int, rule string, arm_0 double, arm_1 double")
    return t.select("bin", "rule", r(F.col("arm_0"), 3).alias("arm_0"), r(F.col("arm_1"), 3).alias("arm_1"))


#: The gain of each cut of the brand number, in order, and the record holders of a scan over them.
CUTS = """bn AS (SELECT regexp_extract(brand, '(\\d+)', 1)::DOUBLE AS x, moderator_raw AS v FROM units), bs AS (SELECT x, count(*) AS n, sum(v) AS s FROM bn GROUP BY x),
cu AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER (ORDER BY x) AS ln, sum(s) OVER (ORDER BY x) AS ls, sum(n) OVER () AS tn, sum(s) OVER () AS ts FROM bs),
ga AS (SELECT (x + nx) / 2 AS cut, ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn AS gain FROM cu WHERE nx IS NOT NULL AND ln >= 5 AND tn - ln >= 5)"""


@query("w9_first_improvement", twin(UNITS + ", " + CUTS, "SELECT 0 AS feature, cut FROM (SELECT cut, gain, coalesce(max(gain) OVER (ORDER BY cut ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS before FROM ga) WHERE gain > before + 1e-15 ORDER BY cut DESC LIMIT 1"))
def w9(spark, d):
    """The cut that a scan for strict improvement over the brand number settles on."""
    t = one_target(units(spark, d), F.regexp_extract("brand", r"(\d+)", 1), F.col("moderator_raw"))
    tree = trees.grow(t, 1, trees.cut_points(t, 1), trees.Rules(depth=1, leaf=5, arm_leaf=0))
    return spark.createDataFrame([(f, float(c)) for f, c in tree.splits().values()], "feature int, cut double")


#: Gains of the cuts of the brand number by what b, or b + w d, explains of the mean on each side, and the values on each side of the first best cut.
CONTRAST = """cr AS (SELECT regexp_extract(brand, '(\\d+)', 1)::DOUBLE AS x, h, ps.a - e AS w FROM ps JOIN units USING (unit_id)),
cs AS (SELECT x, count(*) AS n, sum(h) AS g, sum(w) AS w, sum(w * w) AS ww, sum(w * h) AS wg FROM cr GROUP BY x),
ct AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER o AS n, sum(g) OVER o AS g, sum(w) OVER o AS w, sum(ww) OVER o AS ww, sum(wg) OVER o AS wg, sum(n) OVER () AS tn, sum(g) OVER () AS tg, sum(w) OVER () AS tw, sum(ww) OVER () AS tww, sum(wg) OVER () AS twg FROM cs WINDOW o AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
cg AS (SELECT (x + nx) / 2 AS cut, g * g / n + (tg - g) * (tg - g) / (tn - n) AS pooled, pow(wg - w * g / n, 2) / (ww - w * w / n) + pow((twg - wg) - (tw - w) * (tg - g) / (tn - n), 2) / ((tww - ww) - (tw - w) * (tw - w) / (tn - n)) AS more FROM ct WHERE nx IS NOT NULL AND n >= 20 AND tn - n >= 20),
cc AS (SELECT 'pooled' AS gain, first(cut ORDER BY pooled DESC, cut) AS cut FROM cg UNION ALL SELECT 'solve', first(cut ORDER BY pooled + more DESC, cut) FROM cg)"""


@query("m3_contrast_tree", twin(dr_sql("mean") + ",\n" + CONTRAST, f"SELECT gain, cut, (x > cut)::INT AS side, count(*) AS n, {R('avg(h) - avg(w) * regr_slope(h, w) * regr_sxx(h, w) / (regr_sxx(h, w) + 30)', 3)} AS b, {R('regr_slope(h, w) * regr_sxx(h, w) / (regr_sxx(h, w) + 30)', 3)} AS d FROM cr CROSS JOIN cc GROUP BY gain, cut, side"))
def m3_tree(spark, d):
    """A tree of one cut of the brand number whose leaves are b + (a - e) d, by either gain; the propensity is cross-fitted."""
    s = ordered.stored(scored(spark, d).join(units(spark, d).select("unit_id", F.regexp_extract("brand", r"(\d+)", 1).cast("double").alias("x")), "unit_id").select("a", "x", "mean", (F.col("a") - F.col("e")).alias("w")))
    t = one_target(s, F.col("x"), F.col("mean"), F.col("w"))
    cuts, out = trees.cut_points(t, 1), None
    for gain in ("pooled", "solve"):
        tree = trees.grow(t, 1, cuts, trees.Rules(depth=1, leaf=20, arm_leaf=0, rule="contrast", shared=30.0, gain=gain))
        cut, leaves = tree.splits()[1][1], tree.leaves()
        values = spark.createDataFrame([(gain, float(cut), k - 2, float(v[0][0]), float(v[1][0])) for k, v in leaves.items()], "gain string, cut double, side int, b double, d double")
        n = s.groupBy((F.col("x") > cut).cast("int").alias("side")).agg(F.count("*").alias("n"))
        one = values.join(n, "side").select("gain", "cut", "side", "n", r(F.col("b"), 3).alias("b"), r(F.col("d"), 3).alias("d"))
        out = one if out is None else out.unionByName(one)
    return out


@query("m3_contrast_booster")
def m3_booster(spark, d):
    """A particle booster with prognostic and contrast leaves: risk before and after each step, and the mean contrast of the laws' means, by propensity basis."""
    u, out = rows(spark, d), None
    e = learners.nuisances(u.withColumn("y", F.array(C.curve_mean(F.col("q")))), 3, 3).select("unit_id", "e")
    for basis, part in (("leaf_share", u), ("cross_fitted", ordered.stored(u.join(e, "unit_id")))):
        one = single(part).withColumn("e", F.array("e")) if "e" in part.columns else single(part)
        book, _ = boost.fit(one, rules=trees.Rules(leaf=20, arm_leaf=5, rule="contrast", shared=50.0), **FAST)
        mean = lambda arm, book=book, one=one: boost.predict(book, one, arm).agg(F.avg(F.aggregate("p", F.lit(0.0), lambda s, v: s + v) / F.size("p"))).first()[0]
        gap = mean(1) - mean(0)
        t = boost.trace_table(book, spark).select(F.lit(basis).alias("basis"), "step", r(F.col("before")).alias("before"), r(F.col("after")).alias("after"), r(F.lit(float(gap)), 2).alias("contrast"))
        out = t if out is None else out.unionByName(t)
    return out


@query("m4_m18_booster_trace")
def m4(spark, d):
    """Risk before and after every step of a particle booster."""
    book, _ = boost.fit(single(rows(spark, d)), rules=trees.Rules(leaf=20, arm_leaf=5, shared=50.0), **FAST)
    t = boost.trace_table(book, spark)
    return t.select("step", "model", "backtracks", *[r(F.col(c)).alias(c) for c in ("before", "after", "size")])


@query("m5_separate_arms")
def m5(spark, d):
    """A booster of each arm without sharing: the arm is the model."""
    u = rows(spark, d).withColumns({"own": F.col("a"), "t": F.array((F.col("a") == 0).cast("int"), F.col("a")), "a": F.array("a", "a")})
    _, state = boost.fit(u, rules=trees.Rules(leaf=20, arm_leaf=0, rule="forced"), **FAST)
    law = boost.as_law(state.select("unit_id", "own", boost.law_of(F.col("own"), 2).alias("p")), K, "own")
    return laws.expectation(law, mean=C.curve_mean(F.col("q"))).groupBy("arm").agg(F.count("*").alias("units"), r(F.avg("mean"), 2).alias("mean"))


@query("m7_predicted_laws")
def m7(spark, d):
    """Predicted laws of both arms for all units, from a booster written as node tables and read back: mean curve contrast by level."""
    u = single(rows(spark, d))
    fitted, _ = boost.fit(u, rules=trees.Rules(leaf=20, arm_leaf=5, shared=50.0), **FAST)
    book, both = boost.Booster.of_table(ordered.stored(fitted.table(spark))), None
    for arm in (0, 1):
        law = boost.as_law(boost.predict(book, u.select("unit_id", "x", "a"), arm).withColumn("arm", F.lit(arm)), K, "arm")
        both = law if both is None else both.unionByName(law)
    m = laws.mean_curve(both).select("unit_id", "arm", F.posexplode("q").alias("k", "q"))
    on = lambda k: F.avg(F.when(F.col("arm") == k, F.col("q")))
    return m.groupBy("k").agg(F.count("*").alias("n"), r(on(1) - on(0), 3).alias("contrast"))


@query("m8_e11_calibrated_run")
def m8(spark, d):
    """The whole run: penalty by held-out energy, out-of-fold laws, functionals, propensities, doubly robust effects by bin."""
    u = rows(spark, d)
    penalties, _, _, book = learners.cross_fitted_laws(u, [0.0, 50.0, 500.0], 3, rules=trees.Rules(leaf=20, arm_leaf=5), **FAST)
    hs = {"mean": C.curve_mean, "sd": C.curve_sd}
    mu = learners.arm_means(u, book, hs).drop("run", "a", "fold")
    e = learners.propensities(u, "logistic")
    j = u.join(mu, "unit_id").join(e, "unit_id").withColumn("bin", prep.moderator_bin(F.col("m")))
    long = None
    for n, h in hs.items():
        s = effects.by_bin(j.withColumn("psi", effects.aipw(h(F.col("q")), F.col("a"), F.col("e"), F.col(f"mu0_{n}"), F.col(f"mu1_{n}"))), "psi").withColumn("name", F.lit(n))
        long = s if long is None else long.unionByName(s)
    return long.select("name", "bin", "n", F.lit(float(penalties[0])).alias("penalty"), r(F.col("effect"), 2).alias("effect"), r(F.col("if_se"), 2).alias("if_se"))


@query("m9_m10_nuisances")
def m9(spark, d):
    """Out-of-fold e and m by boosted means: each unit scored once."""
    u = rows(spark, d).withColumn("y", F.array(C.curve_mean(F.col("q"))))
    n = learners.nuisances(u, 3, 5)
    return n.agg(F.count("*").alias("n"), F.countDistinct("unit_id").alias("units"), r(F.avg("e"), 3).alias("e"), r(F.avg(F.get("m", F.lit(0))), 2).alias("m"))


@query("m11_m13_r_learner")
def m11(spark, d):
    """Joint effects on mean and sd by the R-loss, with the penalty chosen on held-out loss."""
    u = rows(spark, d).withColumn("y", F.array(C.curve_mean(F.col("q")), C.curve_sd(F.col("q"))))
    penalty, t = learners.r_learner(u, [1.0, 50.0], 3, 4)
    g = lambda c, i: r(F.avg(F.get(c, F.lit(i))), 2)
    return t.agg(F.count("*").alias("n"), F.lit(penalty).alias("penalty"), g("tau", 0).alias("tau_mean"), g("tau", 1).alias("tau_sd"), g("mu0", 0).alias("mu0_mean"), g("mu1", 0).alias("mu1_mean"))


@query("m10_m16_new_rows")
def m10(spark, d):
    """Units of fold 2 as new rows: scored by the average of the models of the other folds, with both kinds of model."""
    u = rows(spark, d).withColumn("y", F.array(C.curve_mean(F.col("q"))))
    old, new = u.where("fold < 2"), u.where("fold = 2").select("unit_id", "x")
    n = learners.nuisances(old, 2, 4, new)
    e = learners.propensities(old, "logistic", 2, new=new).select("unit_id", F.col("e").alias("logistic"))
    return n.join(e, "unit_id").join(u.select("unit_id", "fold"), "unit_id").groupBy("fold").agg(F.count("*").alias("n"), r(F.avg("e"), 3).alias("boosted"), r(F.avg("logistic"), 3).alias("logistic"), r(F.avg(F.get("m", F.lit(0))), 2).alias("m"))


@query("m13_penalty_by_column")
def m13(spark, d):
    """Effects on mean and sd with a penalty for each; the propensity is given, not fitted."""
    u = rows(spark, d).withColumn("y", F.array(C.curve_mean(F.col("q")), C.curve_sd(F.col("q"))))
    chosen, t = learners.r_learner(u, [1.0, 50.0], 3, 3, per_column=True, given={"e": F.lit(0.5)})
    g = lambda i: r(F.avg(F.get("tau", F.lit(i))), 2)
    return t.agg(F.count("*").alias("n"), F.lit(chosen[0]).alias("penalty_mean"), F.lit(chosen[1]).alias("penalty_sd"), g(0).alias("tau_mean"), g(1).alias("tau_sd"))


@query("m15_forest_propensities")
def m15_forest(spark, d):
    """Out-of-fold propensities of a forest of 200 trees: overlap summaries."""
    u = rows(spark, d)
    o = effects.overlap(u.join(learners.propensities(u, "forest"), "unit_id"), "e", "a")
    return o.select(*[r(F.col(c), 3).alias(c) for c in o.columns])


@query("m12_x_learner")
def m12(spark, d):
    u = rows(spark, d).withColumn("y", F.array(C.curve_mean(F.col("q"))))
    t = learners.x_learner(u, 3, 4)
    return t.agg(F.count("*").alias("n"), r(F.avg(F.get("tau", F.lit(0))), 2).alias("tau"))


@query("m14_two_part_law")
def m14(spark, d):
    """Zero curves (units with few returns) by out-of-fold logistic models of each arm, mixed into laws that a booster fits on the other units."""
    from .roles import table

    u = rows(spark, d)
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("unit_id")).agg(F.count("*").alias("k"))
    z = ordered.stored(u.join(back, "unit_id", "left").withColumn("zero", F.coalesce("k", F.lit(0)) < 8))
    mixed = learners.two_part_laws(z, "zero", 3, rules=trees.Rules(leaf=20, arm_leaf=5, shared=50.0), **FAST)
    return laws.zero_mass(mixed, 1e-9).join(laws.expectation(mixed, mean=C.curve_mean(F.col("q"))), laws.KEYS).groupBy("arm").agg(F.count("*").alias("units"), r(F.avg("zero"), 3).alias("zero"), r(F.avg("mean"), 2).alias("mean"))


@query("m15_m16_propensities")
def m15(spark, d):
    """Out-of-fold propensities of logistic and boosted-tree models: overlap summaries."""
    u = rows(spark, d)
    out = None
    for kind in ("logistic", "boosted"):
        o = effects.overlap(u.join(learners.propensities(u, kind), "unit_id"), "e", "a").withColumn("kind", F.lit(kind))
        out = o if out is None else out.unionByName(o)
    return out.select("kind", *[r(F.col(c), 3).alias(c) for c in out.columns if c != "kind"])


@query("e12_e13_learner_runs")
def learner_runs(spark, d):
    """The whole estimator under three seeds and a placebo, all models in one fit: effects on mean and sd by run."""
    u = rows(spark, d)
    runs = learners.in_runs(u.select("unit_id", "a"), [1, 2, 3], [1])
    many = ordered.stored(u.drop("a", "fold").join(runs, "unit_id"))
    hs = {"mean": C.curve_mean, "sd": C.curve_sd}
    chosen, s = learners.calibrated_runs(many, [50.0, 500.0], hs, rules=trees.Rules(leaf=20, arm_leaf=5), **FAST)
    long = s.select("run", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"psi_{n}").alias("psi")) for n in hs])))
    table = spark.createDataFrame([(i, "placebo" if i == 3 else "seed", float(c)) for i, c in enumerate(chosen)], "run int, kind string, penalty double")
    e = effects.marginal(long, "psi", ["run", "name"]).join(table, "run")
    return e.select("run", "kind", "penalty", "name", "n", r(F.col("effect"), 2).alias("effect"), r(F.col("if_se"), 2).alias("if_se"))
