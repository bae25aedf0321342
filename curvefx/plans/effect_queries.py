"""Queries over treatment effects and classical inference; units are parts, functionals come from their curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves as C
from ..functions import draws
from ..grid import midpoint_levels
from ..operators import effects as E
from ..operators import inference as I
from ..operators import laws as L
from ..operators import ordered, prep, quantiles
from .curve_queries import designed
from .law_queries import LAW, law
from .roles import BINNED, CURVES, FULL, UNITS, R, knots_sql, micro, r, table, twin, units

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


FOLDS = "fl AS (SELECT unit_id, ((row_number() OVER (PARTITION BY a ORDER BY md5('7:' || unit_id::VARCHAR), unit_id) - 1) % 3)::INT AS fold FROM units)"


def nuisance_sql(value: str) -> str:
    """CTEs that end in sc(unit_id, a, bin, h, e, mu0, mu1, psi)."""
    return f"""base AS (SELECT f.unit_id, a, bin, type, fold, f.{value} AS h FROM func f JOIN binned USING (unit_id) JOIN fl USING (unit_id)),
bf AS (SELECT bin, type, fold, count(*) AS n, sum(a)::DOUBLE AS n1, sum(CASE WHEN a = 0 THEN h ELSE 0 END) AS s0, sum(CASE WHEN a = 1 THEN h ELSE 0 END) AS s1 FROM base GROUP BY ALL),
st AS (SELECT bin, type, sum(n) AS n, sum(n1) AS n1, sum(s0) AS s0, sum(s1) AS s1 FROM bf GROUP BY ALL),
fa AS (SELECT fold, sum(n) AS n, sum(n1) AS n1, sum(s0) AS s0, sum(s1) AS s1 FROM bf GROUP BY ALL),
wh AS (SELECT sum(n) AS n, sum(n1) AS n1, sum(s0) AS s0, sum(s1) AS s1 FROM bf),
nu AS (SELECT bf.bin, bf.type, bf.fold, CASE WHEN st.n > bf.n THEN (st.n1 - bf.n1) / (st.n - bf.n) ELSE (wh.n1 - fa.n1) / (wh.n - fa.n) END AS e,
CASE WHEN st.n - st.n1 > bf.n - bf.n1 THEN (st.s0 - bf.s0) / (st.n - st.n1 - bf.n + bf.n1) ELSE (wh.s0 - fa.s0) / (wh.n - wh.n1 - fa.n + fa.n1) END AS mu0,
CASE WHEN st.n1 > bf.n1 THEN (st.s1 - bf.s1) / (st.n1 - bf.n1) ELSE (wh.s1 - fa.s1) / (wh.n1 - fa.n1) END AS mu1 FROM bf JOIN st USING (bin, type) JOIN fa USING (fold) CROSS JOIN wh),
sc AS (SELECT unit_id, a, b.bin, h, least(greatest(e, 0.02), 0.98)::DOUBLE AS e, mu0, mu1 FROM base b JOIN nu ON nu.bin = b.bin AND nu.type = b.type AND nu.fold = b.fold),
ps AS (SELECT *, mu1 - mu0 + a / e * (h - mu1) - (1 - a) / (1 - e) * (h - mu0) AS psi FROM sc)"""


def dr_sql(value: str) -> str:
    return ",\n".join([FULL, FOLDS, nuisance_sql(value)])


def scored(spark, d):
    """Units with all functionals, cross-fitted stratum nuisances and psi for each functional."""
    names = list(C.FUNCTIONALS)
    u = designed(spark, d).select("unit_id", "a", "bin", "type", *C.functionals(F.col("q"), F.col("q_star")))
    folds = prep.folds_seeded(units(spark, d), "a", "unit_id", 7, 3).select("unit_id", "fold")
    n = E.stratum_nuisances(u.join(folds, "unit_id"), ["bin", "type"], "fold", "a", names).withColumn("e", E.clipped(F.col("e")))
    return n.select("*", *[E.aipw(F.col(v), F.col("a"), F.col("e"), F.col(f"mu0_{v}"), F.col(f"mu1_{v}")).alias(f"psi_{v}") for v in names])


def each_functional(select: str) -> str:
    """One statement for each functional, with its name as name, put together."""
    return "\nUNION ALL\n".join(f"SELECT * FROM ({twin(dr_sql(v), select.replace('$name', v))})" for v in C.FUNCTIONALS)


@query("e1_e3_marginal_effects", each_functional(f"SELECT '$name' AS name, count(*) AS n, {R('avg(psi)')} AS effect, {R('stddev_pop(psi) / sqrt(count(*))')} AS if_se FROM ps"))
def e1(spark, d):
    """All functionals at once: effect, influence-function SE, n."""
    long = scored(spark, d).select(*[F.col(f"psi_{v}").alias(v) for v in C.FUNCTIONALS]).unpivot([], list(C.FUNCTIONALS), "name", "psi")
    m = E.marginal(long, "psi", ["name"])
    return m.select("name", "n", r(F.col("effect")).alias("effect"), r(F.col("if_se")).alias("if_se"))


@query("e1_mean_effect", twin(dr_sql("mean"), f"SELECT {R('avg(psi)')} AS effect, {R('stddev_pop(psi) / sqrt(count(*))')} AS if_se, count(*) AS n FROM ps"))
def e1m(spark, d):
    return E.marginal(scored(spark, d), "psi_mean").select(r(F.col("effect")).alias("effect"), r(F.col("if_se")).alias("if_se"), "n")


@query("e4_bin_effects", twin(dr_sql("tail"), f"SELECT bin, {R('avg(psi)')} AS effect, {R('stddev_pop(psi) / sqrt(count(*))')} AS if_se, count(*) AS n FROM ps GROUP BY bin"))
def e4(spark, d):
    b = E.by_bin(scored(spark, d), "psi_tail")
    return b.select("bin", r(F.col("effect")).alias("effect"), r(F.col("if_se")).alias("if_se"), "n")


@query("e2_e5_supplied_propensity", twin(dr_sql("mean"), f"SELECT {R('avg(mu1 - mu0 + a / p * (h - mu1) - (1 - a) / (1 - p) * (h - mu0))')} AS effect FROM sc CROSS JOIN (SELECT avg(a) AS p FROM units)"))
def e5(spark, d):
    """The known treatment share as propensity."""
    p = units(spark, d).agg(F.avg("a").alias("p"))
    s = scored(spark, d).crossJoin(F.broadcast(p))  # one row
    psi = E.aipw(F.col("mean"), F.col("a"), E.clipped(F.col("p")), F.col("mu0_mean"), F.col("mu1_mean"))
    return s.agg(r(F.avg(psi)).alias("effect"))


@query("e8_bin_effects_for_rows", twin(dr_sql("mean"), f"SELECT unit_id, bin, {R('avg(psi) OVER (PARTITION BY bin)')} AS effect FROM ps"))
def e8(spark, d):
    s = scored(spark, d)
    return s.select("unit_id", "bin").join(E.by_bin(s, "psi_mean").select("bin", "effect"), "bin").select("unit_id", "bin", r(F.col("effect")).alias("effect"))


@query("e6_e7_plug_in", twin(dr_sql("mean"), f"SELECT bin, {R('avg(mu1 - mu0)')} AS plug_in, {R('avg(psi)')} AS aipw FROM ps GROUP BY bin"))
def e6(spark, d):
    """Plug-in and AIPW contrasts by bin, side by side."""
    return scored(spark, d).groupBy("bin").agg(r(F.avg(F.col("mu1_mean") - F.col("mu0_mean"))).alias("plug_in"), r(F.avg("psi_mean")).alias("aipw"))


#: Laws of parts by arm, and the bins of parts.
LAWS = LAW + ",\n" + UNITS + ",\n" + BINNED


@query("e6_law_contrasts", twin(LAWS + ", le AS (SELECT unit_id, arm, sum(mass * m) AS v FROM (SELECT unit_id, arm, atom_id, any_value(mass) AS mass, avg(q) AS m FROM lawk GROUP BY ALL) GROUP BY ALL), ld AS (SELECT unit_id, max(v) FILTER (arm = 1) - max(v) FILTER (arm = 0) AS d FROM le GROUP BY unit_id), lb AS (SELECT bin, d FROM ld JOIN binned USING (unit_id) WHERE d IS NOT NULL)", f"SELECT bin, count(*) AS n, {R('avg(d)')} AS contrast FROM (SELECT bin, d FROM lb UNION ALL SELECT -1, d FROM lb) GROUP BY bin"))
def e6_laws(spark, d):
    """Plug-in contrasts of the mean from each part's own laws of both arms, by bin and overall."""
    means = L.expectation(law(spark, d), mean=C.curve_mean(F.col("q")))
    u = prep.ecdf_moderator(units(spark, d), "moderator_raw", "unit_id").withColumn("bin", prep.moderator_bin(F.col("m")))
    return E.law_contrasts(means, u, "mean").select("bin", "n", r(F.col("contrast")).alias("contrast"))


#: The levels 0.2, 0.4, 0.6 and 0.8 lie halfway between two of the five source levels.
DENSE = "lq AS (SELECT unit_id, arm, atom_id, any_value(mass) AS mass, list(q ORDER BY k) AS q FROM lawk GROUP BY ALL), lm AS (SELECT unit_id, arm, j, sum(mass * (q[j] + q[j + 1]) / 2) / sum(mass) AS mu FROM lq CROSS JOIN (SELECT unnest(range(1, 5)) AS j) GROUP BY ALL), lw AS (SELECT j, avg(mu) FILTER (arm = 0) AS w0, avg(mu) FILTER (arm = 1) AS w1 FROM lm GROUP BY j)"
OWN5 = knots_sql("five", "micro", "unit_id", levels="(k::DOUBLE-0.5::DOUBLE)/5::DOUBLE", n=5)


@query("e9_calibrated_levels", twin(LAWS + ",\n" + OWN5 + ", " + DENSE + ", fq AS (SELECT unit_id, list(q ORDER BY k) AS q FROM five GROUP BY unit_id), pz AS (SELECT u.unit_id, a, lw.j, (SELECT avg(a) FROM units) AS e, (q[lw.j] + q[lw.j + 1]) / 2 AS h, coalesce(x.mu, w0) AS mu0, coalesce(y.mu, w1) AS mu1 FROM units u JOIN fq USING (unit_id) CROSS JOIN lw LEFT JOIN lm x ON x.unit_id = u.unit_id AND x.j = lw.j AND x.arm = 0 LEFT JOIN lm y ON y.unit_id = u.unit_id AND y.j = lw.j AND y.arm = 1), pq AS (SELECT j, mu1 - mu0 + a / e * (h - mu1) - (1 - a) / (1 - e) * (h - mu0) AS psi FROM pz)", f"SELECT (j - 1)::INT AS k, count(*) AS n, {R('avg(psi)')} AS effect, {R('stddev_pop(psi) / sqrt(count(*))')} AS if_se FROM pq GROUP BY j"))
def e9_levels(spark, d):
    """Doubly robust effects at levels between the stored ones, with the known treatment share."""
    u = units(spark, d)
    own = quantiles.unit_curves(micro(spark, d), "unit_id", "y", "w", midpoint_levels(5))
    share = u.agg(E.clipped(F.avg("a")).alias("e"))
    j = own.join(u.select("unit_id", "a"), "unit_id").crossJoin(F.broadcast(share))  # one row
    got = E.calibrated_levels(law(spark, d), j, midpoint_levels(5), [0.2, 0.4, 0.6, 0.8])
    return got.select("k", "n", r(F.col("effect")).alias("effect"), r(F.col("if_se")).alias("if_se"))


@query("e9_coordinate_effects", twin(",\n".join([FULL, "pt AS (SELECT bin, k, avg(q) FILTER (a = 1) - avg(q) FILTER (a = 0) AS d FROM curve JOIN binned USING (unit_id) GROUP BY ALL)"]), f"SELECT k, {R('sum(d * n) / sum(n)')} AS effect FROM pt JOIN (SELECT bin, count(*) AS n FROM binned JOIN func USING (unit_id) GROUP BY bin) USING (bin) GROUP BY k"))
def e9(spark, d):
    """Post-stratified arm difference at every level."""
    c = ordered.stored(quantiles.as_long(designed(spark, d).select("unit_id", "a", "bin", "q"), ["unit_id", "a", "bin"]))
    on = lambda k: F.avg(F.when(F.col("a") == k, F.col("q")))
    g = c.groupBy("bin", "k").agg((on(1) - on(0)).alias("d"), F.count("*").alias("n"))
    return g.groupBy("k").agg(r(F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("effect"))


@query("e10_overlap", twin(dr_sql("mean"), f"SELECT {R('min(e)')} AS lowest, {R('max(e)')} AS highest, {R('avg(e)')} AS mean, {R('avg((e <= 0.02)::INT)')} AS at_low, {R('avg((e >= 0.98)::INT)')} AS at_high, {R('avg((e < 0.1 OR e > 0.9)::INT)')} AS outside, {R('avg(e) FILTER (a = 1)')} AS treated, {R('avg(e) FILTER (a = 0)')} AS control FROM ps"))
def e10(spark, d):
    o = E.overlap(scored(spark, d), "e", "a")
    return o.select(*[r(F.col(c)).alias(c) for c in o.columns])


@query("p11_overlap_trim", twin(dr_sql("mean"), f"SELECT count(*) AS n, count(*) FILTER (e BETWEEN 0.45 AND 0.55) AS kept, {R('avg((e BETWEEN 0.45 AND 0.55)::INT)')} AS share FROM ps"))
def p11(spark, d):
    return prep.trim_report(scored(spark, d), "e", 0.45, 0.55).withColumn("share", r(F.col("share")))


PLACEBO = "pu AS (SELECT u.unit_id, v.a FROM (SELECT unit_id, row_number() OVER (ORDER BY md5('3:' || unit_id::VARCHAR), unit_id) AS rn FROM units) u JOIN (SELECT a, row_number() OVER (ORDER BY unit_id) AS rn FROM units) v USING (rn))"


@query("e13_e14_placebo", twin(",\n".join([FULL, PLACEBO]), f"SELECT {R('p.d')} AS placebo, {R('p.d / o.d', 6)} AS ratio FROM (SELECT avg(mean) FILTER (pu.a = 1) - avg(mean) FILTER (pu.a = 0) AS d FROM func JOIN pu USING (unit_id)) p CROSS JOIN (SELECT avg(mean) FILTER (a = 1) - avg(mean) FILTER (a = 0) AS d FROM func JOIN units USING (unit_id)) o"))
def e13(spark, d):
    """Contrast of the mean after the arms are dealt anew, and its ratio to the real one."""
    u = ordered.stored(designed(spark, d).select("unit_id", "a", C.curve_mean(F.col("q")).alias("mean")))
    diff = lambda x, n: x.agg((F.avg(F.when(F.col("a") == 1, F.col("mean"))) - F.avg(F.when(F.col("a") == 0, F.col("mean")))).alias(n))
    j = diff(E.permuted(units(spark, d).select("unit_id", "a"), "unit_id", "a", 3).join(u.drop("a"), "unit_id"), "p").crossJoin(diff(u, "o"))  # single rows
    return j.select(r(F.col("p")).alias("placebo"), r(F.col("p") / F.col("o"), 6).alias("ratio"))


@query("e16_moderator_choice", twin(FULL, f"SELECT type, {R('avg(CASE WHEN prefix(type, $$E$$) THEN size ELSE moderator_raw END)')} AS moderator, count(*) AS n FROM units JOIN func USING (unit_id) GROUP BY type"))
def e16(spark, d):
    """The moderator column by a per-dataset map: types in E use size, others price."""
    u = units(spark, d).join(quantiles.unit_curves(micro(spark, d), "unit_id", "y", "w").select("unit_id"), "unit_id")
    column = F.when(F.col("type").startswith("E"), 0).otherwise(1)
    return u.groupBy("type").agg(r(F.avg(F.get(F.array(F.col("size").cast("double"), "moderator_raw"), column))).alias("moderator"), F.count("*").alias("n"))


#: Micro rows with a regressor and clusters.
MIC = "m AS (SELECT l_suppkey AS cl, l_extendedprice AS y, l_quantity AS x, (l_returnflag = 'R')::INT AS a, year(l_shipdate)::INT AS yr, l_discount AS w FROM lineitem)"


def rows(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("cl"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("a"), F.year("l_shipdate").alias("yr"), F.col("l_discount").alias("w"))


@query("i1_ols_cluster", twin(MIC + ", s AS (SELECT count(*) AS n, count(DISTINCT cl) AS g, regr_slope(y, x) AS b, regr_intercept(y, x) AS c, avg(x) AS mx, var_pop(x) * count(*) AS sxx FROM m), u AS (SELECT cl, sum((x - mx) * (y - c - b * x)) AS sb, sum((y - c - b * x)) AS s0 FROM m CROSS JOIN s GROUP BY cl), v AS (SELECT sqrt(sum(sb * sb)) / any_value(sxx) AS se_b, sqrt(sum(pow(s0 / n - mx * sb / sxx, 2))) AS se_c FROM u CROSS JOIN s)", f"SELECT term, {R('coef', 3)} AS coef, {R('se', 3)} AS se FROM (SELECT 'x' AS term, b AS coef, se_b * sqrt(g / (g - 1) * (n - 1) / (n - 2)) AS se FROM s CROSS JOIN v UNION ALL SELECT 'intercept', c, se_c * sqrt(g / (g - 1) * (n - 1) / (n - 2)) FROM s CROSS JOIN v)"))
def i1(spark, d):
    o = I.ols_cluster(rows(spark, d), "y", ["x"], "cl")
    return o.select("term", r(F.col("coef"), 3).alias("coef"), r(F.col("se"), 3).alias("se"))


@query("i2_within_balance", twin(MIC + ", q AS (SELECT cl, y - avg(y) OVER (PARTITION BY cl) AS y, x - avg(x) OVER (PARTITION BY cl) AS x FROM m)", f"SELECT {R('sum(x * y) / sum(x * x)', 3)} AS coef FROM q"))
def i2(spark, d):
    """The slope within clusters."""
    q = I.demeaned(rows(spark, d), ["y", "x"], "cl")
    n = rows(spark, d).agg(F.countDistinct("cl")).first()[0]
    return I.ols_cluster(q, "y", ["x"], "cl", extra_df=n - 1).where("term = 'x'").select(r(F.col("coef"), 3).alias("coef"))


WITHIN = MIC + ", q AS (SELECT cl, y - avg(y) OVER (PARTITION BY cl) AS y, x - avg(x) OVER (PARTITION BY cl) AS x FROM m), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT cl) AS g FROM q), u AS (SELECT cl, sum(x * (y - b * x)) AS s FROM q CROSS JOIN b GROUP BY cl)"


@query("i2_within_cluster_error", twin(WITHIN, f"SELECT {R('any_value(b)', 3)} AS coef, {R('sqrt(sum(s * s)) / any_value(sxx) * sqrt(any_value(g / (g - 1) * (n - 1) / (n - g - 1)))', 4)} AS se FROM u CROSS JOIN b"))
def i2_error(spark, d):
    """The slope within clusters with its clustered error, on the degrees of freedom of the design with a dummy for each cluster."""
    q = I.demeaned(rows(spark, d), ["y", "x"], "cl")
    n = rows(spark, d).agg(F.countDistinct("cl")).first()[0]
    return I.ols_cluster(q, "y", ["x"], "cl", extra_df=n - 1).where("term = 'x'").select(r(F.col("coef"), 3).alias("coef"), r(F.col("se"), 4).alias("se"))

@query("i3_weighted_difference", twin(MIC + ", t AS (SELECT a, sum(w) AS tw, sum(w * y) / sum(w) AS mu FROM m GROUP BY a), p AS (SELECT cl, sum(CASE WHEN a = 1 THEN 1 ELSE -1 END * w / tw * (y - mu)) AS p FROM m JOIN t USING (a) GROUP BY cl)", f"SELECT {R('sum(CASE WHEN a = 1 THEN mu ELSE -mu END)', 3)} AS diff, {R('(SELECT sqrt(sum(p * p)) FROM p)', 3)} AS se, (SELECT count(*) FROM p) AS clusters FROM t"))
def i3(spark, d):
    w = I.weighted_difference(rows(spark, d), "y", "w", "a", "cl")
    return w.select(r(F.col("diff"), 3).alias("diff"), r(F.col("se"), 3).alias("se"), "clusters")


@query("i4_standardised_differences", twin(MIC, f"SELECT feature, {R('(m1 - m0) / sqrt((v1 + v0) / 2)', 6)} AS smd FROM (SELECT feature, avg(v) FILTER (a = 1) AS m1, avg(v) FILTER (a = 0) AS m0, var_pop(v) FILTER (a = 1) AS v1, var_pop(v) FILTER (a = 0) AS v0 FROM (SELECT a, unnest([{{'feature': 'x', 'v': x}}, {{'feature': 'x2', 'v': x * x}}, {{'feature': 'y', 'v': y}}, {{'feature': 'xw', 'v': x * w}}], recursive := true) FROM m) GROUP BY feature)"))
def i4(spark, d):
    c = F.col
    s = I.standardised_differences(rows(spark, d), "a", {"x": c("x"), "x2": c("x") * c("x"), "y": c("y"), "xw": c("x") * c("w")})
    return s.select("feature", r(c("smd"), 6).alias("smd"))


@query("i5_permutation_test", twin(FULL + f""", u AS (SELECT unit_id, a, mean FROM func JOIN units USING (unit_id)), s AS (SELECT avg(a) AS s FROM u),
d AS (SELECT draw, avg(mean) FILTER (dealt) - avg(mean) FILTER (NOT dealt) AS d FROM (SELECT draw, mean, CASE WHEN draw < 0 THEN a = 1 ELSE {draws.uniform_sql(0, 'draw', 'unit_id')} < s END AS dealt FROM u CROSS JOIN s CROSS JOIN (SELECT unnest(range(-1, 200)) AS draw)) GROUP BY draw),
o AS (SELECT d AS observed FROM d WHERE draw < 0)""", f"SELECT {R('any_value(observed)', 6)} AS observed, {R('(count(*) FILTER (abs(d) >= abs(observed)) + 1) / (count(*) + 1)', 6)} AS p_plus_one, {R('count(*) FILTER (abs(d) >= abs(observed)) / count(*)', 6)} AS p_share FROM d CROSS JOIN o WHERE draw >= 0"))
def i5(spark, d):
    u = designed(spark, d).select("unit_id", "a", C.curve_mean(F.col("q")).alias("mean"))
    t = I.permutation_test(u, "unit_id", "mean", "a", 200)
    return t.select(*[r(F.col(c), 6).alias(c) for c in t.columns])


DRAWS, COORDINATES = 10_000, (1, 7, 13, 19, 25)
#: Treated sums by draw of the mean (all, and by bin), of some coordinates and of counts; draw -1 has the real arms.
TESTS = f"""pw AS (SELECT unit_id, list(q ORDER BY k) AS q FROM curve GROUP BY unit_id),
pu AS (SELECT *, list_sum(q) / {len(COORDINATES)} AS y FROM (SELECT binned.unit_id, a, bin, [{", ".join(f"q[{k}]" for k in COORDINATES)}] AS q FROM pw JOIN binned USING (unit_id))),
ps2 AS (SELECT floor(avg(a) * {draws.PRIME})::BIGINT AS lim FROM pu),
pd AS (SELECT draw, {", ".join(f"sum(y) FILTER (t AND bin = {b}) AS y{b}, count(*) FILTER (t AND bin = {b}) AS n{b}" for b in range(4))}, sum(y) FILTER (t) AS ya, count(*) FILTER (t) AS na, {", ".join(f"sum(q[{k}]) FILTER (t) AS q{k}" for k in range(1, len(COORDINATES) + 1))} FROM (SELECT draw, q, y, bin, CASE WHEN draw < 0 THEN a = 1 ELSE {draws.mixed_sql(0, 'unit_id', 'draw')} < lim END AS t FROM pu CROSS JOIN ps2 CROSS JOIN (SELECT unnest(range(-1, {DRAWS})) AS draw)) GROUP BY draw),
pt AS (SELECT {", ".join(f"sum(y) FILTER (bin = {b}) AS ty{b}, count(*) FILTER (bin = {b}) AS tn{b}" for b in range(4))}, sum(y) AS tya, count(*) AS tna, {", ".join(f"sum(q[{k}]) AS tq{k}" for k in range(1, len(COORDINATES) + 1))} FROM pu),
pl AS ({" UNION ALL ".join(f"SELECT '{s}' AS scope, {i} AS part, draw, {v} / {n} - (t{v} - {v}) / (t{n} - {n}) AS d FROM pd CROSS JOIN pt" for s, i, v, n in [("all", -1, "ya", "na"), *[("bin", b, f"y{b}", f"n{b}") for b in range(4)], *[("coordinate", k - 1, f"q{k}", "na") for k in range(1, len(COORDINATES) + 1)]])})"""


@query("i5_permutation_tests", twin(FULL + ",\n" + TESTS, f"SELECT scope, part, {R('any_value(o)', 4)} AS observed, {R('(count(*) FILTER (abs(d) >= abs(o)) + 1) / (count(*) + 1)', 6)} AS p_plus_one, {R('count(*) FILTER (abs(d) >= abs(o)) / count(*)', 6)} AS p_share FROM pl JOIN (SELECT scope, part, d AS o FROM pl WHERE draw < 0) USING (scope, part) WHERE draw >= 0 GROUP BY scope, part"))
def i5_all(spark, d):
    """10,000 draws of the arms: tests of five coordinates, and of their mean over all units and by bin."""
    u = designed(spark, d).select("unit_id", "a", "bin", F.array(*[F.get("q", F.lit(k - 1)) for k in COORDINATES]).alias("y"))
    t = I.permutation_tests(u, "unit_id", "y", "a", DRAWS, "bin")
    return t.select("scope", "part", r(F.col("observed"), 4).alias("observed"), r(F.col("p_plus_one"), 6).alias("p_plus_one"), r(F.col("p_share"), 6).alias("p_share"))


#: Each part's line items in a full order, and for each place the row at a seeded place.
RESAMPLE = f"""mm AS (SELECT l_partkey AS unit_id, l_extendedprice AS y, l_quantity AS w, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_quantity, l_orderkey, l_linenumber, l_suppkey, l_shipdate) - 1 AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem),
re AS (SELECT a.unit_id, b.y, b.w FROM (SELECT unit_id, {draws.number_sql(5, 'unit_id', 'i')} % n AS i FROM mm) a JOIN mm b USING (unit_id, i))"""


@query("i6_bootstrap_curves", twin(",\n".join([CURVES, RESAMPLE, knots_sql("again", "re", "unit_id")]), f"SELECT k, {R('avg(abs(curve.q - again.q))')} AS change FROM curve JOIN again USING (unit_id, k) GROUP BY k"))
def i6(spark, d):
    """Curves of one resample of every part's rows: mean absolute change by level."""
    m = table(spark, d, "lineitem").select(F.col("l_partkey").alias("unit_id"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("w"), "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    b = I.bootstrap_curves(m, "unit_id", "y", "w", ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"], 5)
    j = b.select(F.posexplode(F.zip_with("q", "again", lambda x, z: F.abs(x - z))).alias("k", "d"))
    return j.groupBy((F.col("k") + 1).alias("k")).agg(r(F.avg("d")).alias("change"))


HALVED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
HALVES = f"hv AS (SELECT l_partkey || '|' || split || '|' || {draws.number_sql('split', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} % 2 AS hu, l_extendedprice AS y, l_quantity AS w FROM lineitem CROSS JOIN (SELECT unnest(range(0, 5)) AS split))"


@query("i7_split_half_noise", twin(HALVES + ",\n" + knots_sql("half", "hv", "hu") + ", hs AS (SELECT split_part(hu, '|', 1) AS unit_id, split_part(hu, '|', 2)::INT AS split, split_part(hu, '|', 3) AS h, k, q FROM half)", f"SELECT split, count(*) AS units, {R('avg(d)')} AS distance FROM (SELECT a.split, a.unit_id, sqrt(avg((a.q - b.q) * (a.q - b.q))) AS d FROM hs a JOIN hs b ON a.unit_id = b.unit_id AND a.split = b.split AND a.k = b.k WHERE a.h = '0' AND b.h = '1' GROUP BY a.split, a.unit_id) GROUP BY split"))
def i7(spark, d):
    """Mean distance between the curves of two hashed halves of every part's rows, over five splits."""
    v = I.split_halves(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice", "l_quantity", HALVED, 5)
    long = v.select(F.posexplode("d2").alias("split", "d2")).where("d2 IS NOT NULL")
    return long.groupBy("split").agg(F.count("*").alias("units"), r(F.avg(F.sqrt("d2"))).alias("distance"))


SPLITS = 40


@query("i7_implied_inflation", twin(FULL + ",\n" + HALVES.replace("range(0, 5)", f"range(0, {SPLITS})") + ",\n" + knots_sql("half", "hv", "hu") + """, hs AS (SELECT split_part(hu, '|', 1)::BIGINT AS unit_id, split_part(hu, '|', 2)::INT AS split, split_part(hu, '|', 3) AS h, list(q ORDER BY k) AS q FROM half GROUP BY hu),
hd AS (SELECT a.unit_id, avg(pow(list_distance(a.q, b.q), 2) / 25) / 4 AS v FROM hs a JOIN hs b ON a.unit_id = b.unit_id AND a.split = b.split AND a.h = '0' AND b.h = '1' GROUP BY a.unit_id)""", f"SELECT a, count(*) AS units, {R('avg(v)', 2)} AS variance, {R('avg(reference)', 2)} AS distance, {R('avg(v) / (2 * avg(reference))', 4)} AS inflation FROM hd JOIN func USING (unit_id) JOIN units USING (unit_id) GROUP BY a"))
def i7_inflation(spark, d):
    """A quarter of the mean squared distance between half-sample curves over 40 splits is a curve's variance; over twice the distance to the benchmark it is the distance's inflation, by arm."""
    halves = I.split_halves(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice", "l_quantity", HALVED, SPLITS)
    known = F.filter("d2", lambda x: x.isNotNull())
    v = halves.select(F.col("l_partkey").alias("unit_id"), known.alias("d2")).where(F.size("d2") > 0).select("unit_id", (C.total(F.col("d2")) / F.size("d2") / 4).alias("v"))
    j = designed(spark, d).select("unit_id", "a", C.curve_distance(F.col("q"), F.col("q_star")).alias("dist")).join(v, "unit_id")
    g = j.groupBy("a").agg(F.count("*").alias("units"), F.avg("v").alias("variance"), F.avg("dist").alias("distance"))
    return g.select("a", "units", r(F.col("variance"), 2).alias("variance"), r(F.col("distance"), 2).alias("distance"), r(F.col("variance") / (2 * F.col("distance")), 4).alias("inflation"))


@query("i12_propensity_calibration", twin(dr_sql("mean") + ", g AS (SELECT e, sum(a) AS p, sum(1 - a) AS n FROM ps GROUP BY e), h AS (SELECT *, coalesce(sum(n) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)", f"SELECT {R('(SELECT sum(p * (below + n / 2)) / (sum(p) * sum(n)) FROM h)', 3)} AS auc, {R('corr(e, a)', 6)} AS corr, {R('sqrt(avg((e - a) * (e - a)))', 6)} AS rmse FROM ps"))
def i12(spark, d):
    s = ordered.stored(scored(spark, d).select("e", "a"))
    c = s.agg(r(F.corr("e", "a"), 6).alias("corr"), r(F.sqrt(F.avg((F.col("e") - F.col("a")) * (F.col("e") - F.col("a")))), 6).alias("rmse"))
    return I.auc(s, "e", "a").select(r(F.col("auc"), 3).alias("auc")).crossJoin(c)  # single rows


@query("i13_coverage", twin(dr_sql("mean"), f"SELECT bin, abs(avg(psi) - (SELECT avg(psi) FROM ps)) <= 1.96 * stddev_pop(psi) / sqrt(count(*)) AS covered, abs(avg(psi)) > 1.96 * stddev_pop(psi) / sqrt(count(*)) AS rejected FROM ps GROUP BY bin"))
def i13(spark, d):
    """Whether each bin's interval holds the overall effect, and whether it rejects 0."""
    s = ordered.stored(scored(spark, d).select("bin", "psi_mean"))
    whole = s.agg(F.avg("psi_mean").alias("t"))
    b = E.by_bin(s, "psi_mean").crossJoin(F.broadcast(whole))  # one row
    return b.select("bin", (F.abs(F.col("effect") - F.col("t")) <= 1.96 * F.col("if_se")).alias("covered"), (F.abs("effect") > 1.96 * F.col("if_se")).alias("rejected"))
