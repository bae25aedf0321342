"""Queries of the decision rules over the ledger that is built from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import ledger as L
from .ledger_queries import JACK, LEDGER, cells, rounded, rsql
from .roles import R, r, twin

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


DESIGNS, METRICS, PRIMARY = ["click", "view"], ["level_rmse", "bias"], (25, 10)
ALTERNATIVES, LARGER = [(5, 10), (49, 10), (25, 5), (25, 25)], [(49, 10), (25, 25), (49, 25), (99, 10)]


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def wanted_sql(pairs) -> str:
    return f"(VALUES {values([(d, m, *p) for d in DESIGNS for m in METRICS for p in pairs])}) w(dgp, metric, n_grid, n_particles)"


OWN = "own AS (SELECT * FROM cells WHERE method = 'alpha'), mn AS (SELECT dgp, metric, n_grid, n_particles, avg(value) AS m FROM own GROUP BY ALL)"
BAND = f"""bd AS (SELECT w.*, p.m AS primary_mean, o.m AS other_mean, CASE WHEN p.m IS NOT NULL AND o.m IS NOT NULL THEN CASE WHEN p.m > 0 THEN abs(o.m - p.m) / p.m ELSE 'inf'::DOUBLE END END AS relative FROM {wanted_sql(ALTERNATIVES)} LEFT JOIN mn p ON p.dgp = w.dgp AND p.metric = w.metric AND p.n_grid = 25 AND p.n_particles = 10 LEFT JOIN mn o ON o.dgp = w.dgp AND o.metric = w.metric AND o.n_grid = w.n_grid AND o.n_particles = w.n_particles)"""
GAIN = f"""os AS (SELECT dgp, metric, seed, n_grid, n_particles, avg(value) AS v FROM own GROUP BY ALL),
dd AS (SELECT x.dgp, x.metric, x.n_grid, x.n_particles, count(*) AS n, avg(p.v - x.v) AS delta, stddev_samp(p.v - x.v) / sqrt(count(*)) AS se FROM os x JOIN os p ON p.dgp = x.dgp AND p.metric = x.metric AND p.seed = x.seed AND p.n_grid = 25 AND p.n_particles = 10 GROUP BY ALL),
gn AS (SELECT w.*, coalesce(n, 0) AS n, delta, se, coalesce(n, 0) >= 2 AND se IS NOT NULL AS evaluated, coalesce(coalesce(n, 0) >= 2 AND se IS NOT NULL AND delta > 2 * se, false) AS improves FROM {wanted_sql(LARGER)} LEFT JOIN dd USING (dgp, metric, n_grid, n_particles))"""


def band(spark, d):
    return D.tolerance_band(cells(spark, d).where("method = 'alpha'"), DESIGNS, METRICS, PRIMARY, ALTERNATIVES, 0.1)


def gains(spark, d):
    return D.larger_gains(cells(spark, d).where("method = 'alpha'"), DESIGNS, METRICS, PRIMARY, LARGER, 2.0)


@query("a10_tolerance_band", twin(", ".join([LEDGER, OWN, BAND]), f"SELECT dgp, metric, n_grid, n_particles, {rsql('primary_mean', 'other_mean')}, relative IS NOT NULL AS evaluated, coalesce(relative <= 0.1, false) AS within FROM bd"))
def a10_band(spark, d):
    """Every one-factor alternative against the primary setting, missing ones among them."""
    return rounded(band(spark, d).drop("relative"), ["dgp", "metric", "n_grid", "n_particles", "evaluated", "within"])


@query("a10_larger_gains", twin(", ".join([LEDGER, OWN, GAIN]), f"SELECT dgp, metric, n_grid, n_particles, n, {rsql('delta', 'se')}, evaluated, improves FROM gn"))
def a10_gains(spark, d):
    """Paired gains of larger settings, of which one is in no cell."""
    return rounded(gains(spark, d), ["dgp", "metric", "n_grid", "n_particles", "n", "evaluated", "improves"])


@query("a10_resolution_rule", twin(", ".join([LEDGER, OWN, BAND, GAIN]) + ", pr AS (SELECT n_grid, n_particles, bool_and(improves) AS good, avg(delta) AS gain FROM gn GROUP BY ALL), a AS (SELECT count(*) FILTER (relative IS NULL) AS missing, bool_and(coalesce(relative <= 0.1, false)) AS condition_a FROM bd), b AS (SELECT count(*) AS improving, arg_max(n_grid, (gain, n_grid, n_particles)) AS n_grid, arg_max(n_particles, (gain, n_grid, n_particles)) AS n_particles FROM pr WHERE good)", "SELECT missing, condition_a, improving, missing = 0 AND condition_a AND improving = 0 AS retain_primary, n_grid, n_particles, CASE WHEN missing > 0 THEN 'records missing' WHEN condition_a AND improving = 0 THEN 'primary retained' WHEN improving > 0 THEN 'a larger setting improves everything' ELSE 'an alternative leaves the band' END AS reason FROM a CROSS JOIN b"))
def a10_rule(spark, d):
    """The decision: what is missing, both conditions, the recommended setting and why."""
    return D.resolution_rule(band(spark, d), gains(spark, d))


#: Rule, design, metric, claimant, comparator; nobody has cells of delta or of the design none.
PLAN = [(rule, g, m, "alpha", o) for rule, m, o in (("law", "level_rmse", "beta"), ("transfer", "bias", "beta"), ("direct", "bias", "delta")) for g in ("click", "view", "purchase", "none")]
LEAST = [("law", 1), ("transfer", 0), ("direct", 2)]
KEYS = "rule, dgp, metric, claimant, comparator"


def planned_sql(plan: list[tuple]) -> str:
    return f"""pl AS (SELECT * FROM (VALUES {values(plan)}) p({KEYS})),
pp AS (SELECT {KEYS}, seed, avg(x.value) AS a, avg(y.value) AS b FROM pl JOIN cells x USING (dgp, metric) JOIN cells y USING (dgp, metric, seed, n_grid, n_particles) WHERE x.method = claimant AND y.method = comparator GROUP BY ALL),
ps AS (SELECT {KEYS}, count(*) AS n, avg(a - b) AS mean_diff, stddev_samp(a - b) / sqrt(count(*)) AS se FROM pp GROUP BY ALL),
hv AS (SELECT DISTINCT dgp, metric, method FROM cells),
pc AS (SELECT pl.*, coalesce(n, 0) AS n, mean_diff, se, CASE WHEN n IS NOT NULL THEN 'accuracy' WHEN EXISTS (SELECT 1 FROM hv WHERE hv.dgp = pl.dgp AND hv.metric = pl.metric AND hv.method = pl.claimant) AND NOT EXISTS (SELECT 1 FROM hv WHERE hv.dgp = pl.dgp AND hv.metric = pl.metric AND hv.method = pl.comparator) THEN 'capability' ELSE 'absent' END AS kind FROM pl LEFT JOIN ps USING ({KEYS})),
pw AS (SELECT *, kind = 'capability' OR coalesce(mean_diff < -2 * se, false) AS wins FROM pc)"""


def planned(spark, d, plan):
    return D.planned(cells(spark, d), D.table_of(spark, plan, "rule string, dgp string, metric string, claimant string, comparator string"))


@query("a11_gate_flags", twin(LEDGER + ", " + planned_sql(PLAN) + f", ls AS (SELECT * FROM (VALUES {values(LEAST)}) l(rule, min_wins)), gf AS (SELECT rule, count(*) FILTER (wins) AS n_wins, count(*) FILTER (wins AND kind = 'accuracy') AS n_accuracy, count(*) FILTER (wins AND kind = 'capability') AS n_capability, count(*) FILTER (wins) >= any_value(min_wins) AS passed FROM ls LEFT JOIN pw USING (rule) GROUP BY rule)", "SELECT *, CASE WHEN (SELECT bool_and(passed) FROM gf) THEN 'GO' ELSE 'NOT-GO' END AS verdict FROM gf"))
def a11_flags(spark, d):
    """Accuracy and capability wins by rule, and the verdict over all rules."""
    return D.gates(planned(spark, d, PLAN), D.table_of(spark, LEAST, "rule string, min_wins int"))


ABLATIONS = [(what, g, m, "alpha", o) for what, o in (("repulsion", "beta"), ("sharing", "gamma")) for g in ("click", "purchase") for m in ("level_rmse", "bias")]


@query("a12_mechanism_ablations", twin(LEDGER + ", " + planned_sql(ABLATIONS), f"SELECT {KEYS}, n, {rsql('mean_diff', 'se')}, kind, wins FROM pw"))
def a12_ablations(spark, d):
    """Declared comparisons of the full method with the one that lacks a mechanism."""
    return rounded(planned(spark, d, ABLATIONS), [*KEYS.split(", "), "n", "kind", "wins"])


@query("a8_propensity_view", twin(LEDGER + ", by4 AS (SELECT dgp, metric, method, seed, n_grid, n_particles, avg(value) AS v FROM cells GROUP BY ALL), one AS (SELECT dgp, metric, method, count(DISTINCT seed) AS n_seeds, avg(value) AS mean FROM cells GROUP BY ALL), vs AS (SELECT a.dgp, a.metric, b.method AS comparator, count(*) AS n, avg(a.v - b.v) AS delta, stddev_samp(a.v - b.v) / sqrt(count(*)) AS se FROM by4 a JOIN by4 b USING (dgp, metric, seed, n_grid, n_particles) WHERE a.method = 'alpha' AND b.method <> 'alpha' GROUP BY ALL)", f"SELECT dgp, metric, method, '' AS comparator, n_seeds, {rsql('mean')}, NULL::DOUBLE AS delta, NULL::DOUBLE AS se, method = 'gamma' AS diagnostic_only FROM one UNION ALL SELECT dgp, metric, 'alpha', comparator, n, {R('mean', 5)}, {R('delta', 5)}, {R('se', 5)}, comparator = 'gamma' FROM vs JOIN (SELECT dgp, metric, mean FROM one WHERE method = 'alpha') USING (dgp, metric)"))
def a8_propensity(spark, d):
    """alpha against its variants, of which gamma is a diagnostic only."""
    return rounded(D.propensity_view(cells(spark, d), "alpha", ["beta", "gamma"], "gamma"), ["dgp", "metric", "method", "comparator", "n_seeds", "diagnostic_only"])


@query("a8_alignment_view", twin(LEDGER + ", al AS (SELECT metric, n_grid, n_particles, seed, avg(value) FILTER (dgp = 'click') AS a, avg(value) FILTER (dgp = 'view') AS b FROM cells WHERE method = 'alpha' GROUP BY ALL)", f"SELECT metric, n_grid, n_particles, count(*) AS n, {rsql('avg(a) AS aligned_mean', 'avg(b) AS irrelevant_mean', 'avg(a - b) AS delta', 'stddev_samp(a - b) / sqrt(count(*)) AS se')} FROM al WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL"))
def a8_alignment(spark, d):
    """Two designs of one method, paired by seed within settings."""
    v = D.alignment_view(cells(spark, d).where("method = 'alpha'"), "click", "view", ["metric", "n_grid", "n_particles"])
    return rounded(v.drop("p"), ["metric", "n_grid", "n_particles", "n"])


def mean_sql(dgp: str, method: str) -> str:
    return f"avg(value) FILTER (dgp = '{dgp}' AND method = '{method}')"


LEVEL = "lv AS (SELECT * FROM cells WHERE metric = 'level_rmse')"


@query("a13_shared_gate", twin(", ".join([LEDGER, LEVEL]) + f", s AS (SELECT {mean_sql('click', 'alpha')} AS s0, {mean_sql('click', 'beta')} AS s1, {mean_sql('view', 'alpha')} AS t0, {mean_sql('view', 'beta')} AS t1 FROM lv)", f"SELECT {rsql('(s0 - s1) / s0 AS gain', '(t1 - t0) / t0 AS loss')}, CASE WHEN s0 - s1 IS NULL OR t1 - t0 IS NULL THEN 'INDETERMINATE' WHEN (s0 - s1) / s0 >= 0.0001 AND (t1 - t0) / t0 <= 0.02 THEN 'pooled' ELSE 'plain only' END AS decision FROM s"))
def a13_shared(spark, d):
    return rounded(D.shared_gate(cells(spark, d).where("metric = 'level_rmse'"), "click", "view", "alpha", "beta", 0.0001, 0.02), ["decision"])


CROSS = ", ".join(f"{mean_sql(g, m)} AS m{i}{j}" for i, g in enumerate(("view", "purchase", "click")) for j, m in enumerate(("alpha", "beta", "gamma")))


@query("a13_crossover", twin(", ".join([LEDGER, LEVEL]) + f", c AS (SELECT {CROSS} FROM lv), g AS (SELECT *, (m20 - m22) / m20 AS sg, (m11 - m12) / m11 AS eg, (m02 - least(m00, m01)) / least(m00, m01) AS nl, m00 + m10 + m20 AS e0, m01 + m11 + m21 AS e1, m02 + m12 + m22 AS e2 FROM c)", f"SELECT {rsql('sg AS shared_gain', 'eg AS separate_gain', 'nl AS null_loss')}, CASE WHEN sg + eg + nl IS NULL OR e0 + e1 + e2 IS NULL THEN 'INDETERMINATE' WHEN sg >= 0.001 AND eg >= 0.001 AND nl <= 0.05 THEN 'mixed' ELSE 'strongest end' END AS decision, CASE WHEN e0 + e1 + e2 IS NULL OR (sg >= 0.001 AND eg >= 0.001 AND nl <= 0.05) THEN NULL WHEN e0 <= e1 AND e0 <= e2 THEN 'alpha' WHEN e1 <= e2 THEN 'beta' ELSE 'gamma' END AS retained FROM g"))
def a13_crossover(spark, d):
    return rounded(D.crossover(cells(spark, d).where("metric = 'level_rmse'"), "view", "purchase", "click", ("alpha", "beta"), "gamma", 0.001, 0.05), ["decision", "retained"])


PUBLISHED = [("level_rmse", 28.0), ("bias", 0.5)]


@query("a13_published_cell", twin(LEDGER + f", pb AS (SELECT * FROM (VALUES {values(PUBLISHED)}) p(metric, published)), ob AS (SELECT metric, avg(value) FILTER (method = 'alpha') AS observed, avg(value) FILTER (method = 'beta') AS o FROM cells GROUP BY metric), j AS (SELECT metric, observed, published::DOUBLE AS published, coalesce(abs(observed - published) <= 0.2 * abs(published), false) AS within, o FROM pb LEFT JOIN ob USING (metric))", f"SELECT metric, {rsql('observed', 'published')}, within, CASE WHEN (SELECT bool_and(within AND coalesce(observed < o, true)) FROM j) THEN 'REPRODUCED' ELSE 'NOT-REPRODUCED' END AS decision FROM j"))
def a13_published(spark, d):
    p = D.table_of(spark, PUBLISHED, "metric string, published double")
    return rounded(D.published_cell(cells(spark, d), p, "alpha", "beta", 0.2), ["metric", "within", "decision"])


@query("a13_dimension_scaling", twin(LEDGER + ", sc AS (SELECT n_grid, count(*) AS cells, avg(wall_seconds) AS mean_cost, max(wall_seconds) AS max_cost FROM cells WHERE metric = 'level_rmse' GROUP BY n_grid)", f"SELECT n_grid, cells, {rsql('mean_cost', 'max_cost', 'mean_cost / lag(mean_cost) OVER (ORDER BY n_grid) AS growth')}, CASE WHEN (SELECT max(max_cost) FROM sc) <= 100 THEN 'VIABLE' ELSE 'PROHIBITIVE' END AS decision FROM sc"))
def a13_scaling(spark, d):
    return rounded(D.dimension_scaling(cells(spark, d).where("metric = 'level_rmse'"), "n_grid", "wall_seconds", 100.0), ["n_grid", "cells", "decision"])


@query("a1_extra_evaluators", twin(LEDGER, f"SELECT dgp, 'level' AS metric, {R('avg(value) FILTER (metric = $$level_rmse$$)', 5)} AS value, 'ok' AS status, NULL AS failure_reason FROM cells GROUP BY dgp UNION ALL SELECT dgp, 'of_click', {R('avg(value) FILTER (dgp = $$click$$)', 5)}, CASE WHEN dgp = 'click' THEN 'ok' ELSE 'not_applicable' END, NULL FROM cells GROUP BY dgp UNION ALL SELECT dgp, 'faulty', NULL, 'failed', 'ValueError: no such target' FROM cells GROUP BY dgp"))
def a1_extra(spark, d):
    """A user's evaluators beside each other: one for all designs, one for a single design, one that raises."""

    def faulty(c):
        raise ValueError("no such target")

    own = {"level": lambda c: c.where("metric = 'level_rmse'").groupBy("dgp").agg(F.avg("value").alias("value")), "of_click": lambda c: c.where("dgp = 'click'").groupBy("dgp").agg(F.avg("value").alias("value")), "faulty": faulty}
    return L.evaluated(cells(spark, d), own, "dgp").withColumn("value", r(F.col("value"), 5))


@query("a15_guarded_ledger", twin(LEDGER + ", " + JACK, f"SELECT dgp, method, metric, {R('avg(value)', 5)} AS mean, (SELECT count(*) FROM (SELECT DISTINCT dgp, method, metric FROM ledger)) AS expected FROM cells GROUP BY dgp, method, metric"))
def a15_guarded(spark, d):
    """One row for each design, method and metric of the ledger: exactly so many, or an error."""
    from .ledger_queries import ledger

    n = ledger(spark, d).select("dgp", "method", "metric").distinct().count()
    g = cells(spark, d).groupBy("dgp", "method", "metric").agg(r(F.avg("value"), 5).alias("mean"))
    return D.exact_rows(g, n).withColumn("expected", F.lit(n).cast("long"))


__all__ = ["ORACLES", "QUERIES"]
