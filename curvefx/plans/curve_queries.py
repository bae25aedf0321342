"""Queries over quantile curves: folding, functionals, projection, resampling, contrasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves as C
from ..functions import sql
from ..grid import array_of, interior_levels, midpoint_levels
from ..operators import monotone, ordered, prep, quantiles
from .roles import BINNED, CURVES, FULL, FUNCS, MICRO, STAR, UNITS, R, curves, curves_long, knots_sql, micro, r, table, twin, units

QUERIES, ORACLES = {}, {}
U = midpoint_levels()


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def star_of(c, u):
    """q_star: the average of the curves c of control units, one row."""
    long = quantiles.as_long(c.join(u.where("a = 0").select("unit_id"), "unit_id"), ["unit_id"])
    return quantiles.as_arrays(quantiles.average_curve(long).withColumn("g", F.lit(0)), ["g"]).select(F.col("q").alias("q_star"))


def designed(spark, d, c=None):
    """Units with curve, arm, moderator and bin, and the benchmark. Curves are made once and stored, if they aren't given."""
    u = units(spark, d)
    c = ordered.stored(curves(spark, d)) if c is None else c
    placed = prep.ecdf_moderator(u, "moderator_raw", "unit_id").withColumn("bin", prep.moderator_bin(F.col("m")))
    return c.join(placed, "unit_id").crossJoin(F.broadcast(star_of(c, u)))  # one benchmark row


@query("flagship", twin(FULL, f"""SELECT bin, name, count(*) AS n, {R("avg(v) FILTER (a = 1) - avg(v) FILTER (a = 0)")} AS contrast FROM (
SELECT bin, a, unnest([{{'name': 'mean', 'v': mean}}, {{'name': 'sd', 'v': sd}}, {{'name': 'skew', 'v': skew}}, {{'name': 'tail', 'v': tail}}, {{'name': 'reference', 'v': reference}}], recursive := true) FROM func JOIN binned USING (unit_id)) GROUP BY bin, name"""))  # fmt: skip
def flagship(spark, d):
    """Raw arm contrast of five functionals by moderator quartile."""
    q = designed(spark, d).select("bin", "a", *C.functionals(F.col("q"), F.col("q_star")))
    long = q.unpivot(["bin", "a"], list(C.FUNCTIONALS), "name", "v")
    return long.groupBy("bin", "name").agg(F.count("*").alias("n"), r(F.avg(F.when(F.col("a") == 1, F.col("v"))) - F.avg(F.when(F.col("a") == 0, F.col("v")))).alias("contrast"))


@query("q1_pool_quantiles", twin("pool AS (SELECT 0 AS g, l_extendedprice AS y, l_quantity AS w FROM lineitem),\n" + knots_sql("curve", "pool", "g"), f"SELECT k, {R('q')} AS q FROM curve"))
def q1(spark, d):
    return quantiles.pool_quantiles(micro(spark, d), "y", "w").select("k", r(F.col("q")).alias("q"))


@query("q2_unit_curves", twin(CURVES, f"SELECT unit_id, k, {R('q')} AS q FROM curve"))
def q2(spark, d):
    return curves_long(spark, d).select("unit_id", "k", r(F.col("q")).alias("q"))


@query("q2_unit_curves_spread", twin(MICRO + ",\n" + knots_sql("curve", "micro", "supp"), f"SELECT supp, k, {R('q')} AS q FROM curve"))
def q2_spread(spark, d):
    """Large units, over sorted ranges."""
    return quantiles.unit_curves_long(micro(spark, d), "supp", "y", "w", spread=True).select("supp", "k", r(F.col("q")).alias("q"))


@query("q3_pool_benchmarks", twin(MICRO + ",\n" + knots_sql("curve", "micro", "year"), f"SELECT year, k, {R('q')} AS q FROM curve UNION ALL SELECT -1, k, {R('avg(q)')} FROM curve GROUP BY k"))
def q3(spark, d):
    """Curves of yearly pools, and their equal-weight average as year -1."""
    pools = ordered.stored(quantiles.pool_quantiles(micro(spark, d), "y", "w", by=["year"]))
    both = pools.select("year", "k", "q").union(quantiles.average_curve(pools).select(F.lit(-1), "k", "q"))
    return both.select("year", "k", r(F.col("q")).alias("q"))


@query("q4_q5_functionals", twin(FULL, f"SELECT unit_id, {', '.join(f'{R(c)} AS {c}' for c in C.FUNCTIONALS)} FROM func"))
def q4(spark, d):
    return designed(spark, d).select("unit_id", *[r(c).alias(n) for n, c in zip(C.FUNCTIONALS, C.functionals(F.col("q"), F.col("q_star")))])


@query("q4_sql_functions", twin(FULL, f"SELECT unit_id, {', '.join(f'{R(c)} AS {c}' for c in C.FUNCTIONALS)}, {R('p90')} AS p90 FROM func JOIN (SELECT unit_id, max(q) FILTER (k = 23) AS p90 FROM curve GROUP BY unit_id) USING (unit_id)"))
def q4_sql(spark, d):
    """The functionals, and one of the user's own, as functions of SQL text."""
    sql.register(spark, {"curve_p90": "(q ARRAY<DOUBLE>) RETURNS DOUBLE RETURN q[22]"})
    shown = {"mean": "curve_mean(q)", "sd": "curve_sd(q)", "skew": "curve_skew(q)", "tail": "curve_tail(q)", "reference": "curve_distance(q, q_star)", "p90": "curve_p90(q)"}
    text = ", ".join(f"round({f} + 1.234e-6D, 4) AS {n}" for n, f in shown.items())
    return spark.sql(f"SELECT unit_id, {text} FROM {{units}}", units=designed(spark, d).select("unit_id", "q", "q_star"))


@query("q5_alternative_benchmarks", twin(FULL, f"""SELECT unit_id, {R("sqrt(avg(pow(q / mean - s / ms, 2)))", 8)} AS normalised, {R("sqrt(avg(pow(q - mean * (1 - (k::DOUBLE - 0.5) / 25), 2)))")} AS to_ramp FROM curve JOIN mom USING (unit_id) JOIN star USING (k) CROSS JOIN (SELECT avg(s) AS ms FROM star) GROUP BY unit_id"""))
def q5(spark, d):
    """Distance to the benchmark after both are divided by their means, and to a ramp."""
    q, s = F.col("q"), F.col("q_star")
    unit = lambda c: F.transform(c, lambda x: x / C.curve_mean(c))
    return designed(spark, d).select("unit_id", r(C.curve_distance(unit(q), unit(s)), 8).alias("normalised"), r(C.curve_distance(q, C.ramp(C.curve_mean(q), U))).alias("to_ramp"))


@query("q6_coordinates", twin(CURVES, f"SELECT unit_id, {R('max(q) FILTER (k = 3)')} AS p10, {R('max(q) FILTER (k = 23)')} AS p90, {R('max(q) FILTER (k = 23) - max(q) FILTER (k = 3)')} AS gap FROM curve GROUP BY unit_id"))
def q6(spark, d):
    """Single coordinates and a user functional."""
    q = F.col("q")
    return curves(spark, d).select("unit_id", r(C.curve_at(q, 2)).alias("p10"), r(C.curve_at(q, 22)).alias("p90"), r(C.curve_at(q, 22) - C.curve_at(q, 2)).alias("gap"))


@query("q7_capped_curve", twin(CURVES, f"SELECT unit_id, k, {R('least(q, cap)')} AS q FROM curve JOIN (SELECT unit_id, max(q) FILTER (k = 19) + (0.75::DOUBLE - 18.5::DOUBLE / 25) / (1::DOUBLE / 25) * (max(q) FILTER (k = 20) - max(q) FILTER (k = 19)) AS cap FROM curve GROUP BY unit_id) USING (unit_id)"))
def q7(spark, d):
    long = quantiles.as_long(curves(spark, d).select("unit_id", C.curve_cap(F.col("q"), U, 0.75).alias("q")), ["unit_id"])
    return long.select("unit_id", "k", r(F.col("q")).alias("q"))


@query("q8_rescaled", twin(FULL, f"SELECT unit_id, {R('sqrt(sum(pow(q / sqrt(25) - s / sqrt(25), 2)))')} AS euclidean, {R('sqrt(avg(pow(q - s, 2)))')} AS weighted, {R('sum(q / sqrt(25))')} AS z_sum FROM curve JOIN star USING (k) GROUP BY unit_id"))
def q8(spark, d):
    """Euclidean distance of rescaled curves equals the weighted distance; rescaling and back changes nothing."""
    q, s = F.col("q"), F.col("q_star")
    z = C.to_rescaled(q)
    diff = F.zip_with(z, C.to_rescaled(s), lambda a, b: (a - b) * (a - b))
    return designed(spark, d).select("unit_id", r(F.sqrt(C.total(diff))).alias("euclidean"), r(C.curve_distance(C.from_rescaled(z), s)).alias("weighted"), r(C.total(z)).alias("z_sum"))


#: The yearly curves of suppliers, and first differences to the previous year with a row.
def panel_sql(n: int) -> str:
    return MICRO + ", sy AS (SELECT supp * 10000 + year AS unit_id, y, w FROM micro),\n" + knots_sql("curve", "sy", "unit_id", levels=f"(k::DOUBLE-0.5::DOUBLE)/{n}::DOUBLE", n=n) + """,
lagged AS (SELECT c.unit_id // 10000 AS supp, c.unit_id % 10000 AS year, c.k, c.q - p.q AS d FROM (SELECT *, lag(unit_id) OVER (PARTITION BY unit_id // 10000, k ORDER BY unit_id) AS before FROM curve) c JOIN curve p ON p.unit_id = c.before AND p.k = c.k WHERE c.before // 10000 = c.unit_id // 10000)"""


PANEL = panel_sql(25)
PROJECT = """csum AS (SELECT supp, year, k, sum(d) OVER (PARTITION BY supp, year ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM lagged),
ij AS (SELECT a.supp, a.year, a.k AS i, b.k AS j, (b.s - a.s + a0.d) / (b.k - a.k + 1) AS m FROM csum a JOIN lagged a0 USING (supp, year, k) JOIN csum b ON a.supp = b.supp AND a.year = b.year AND b.k >= a.k),
mins AS (SELECT supp, year, i, j, min(m) OVER (PARTITION BY supp, year, i ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS lo FROM ij),
proj AS (SELECT supp, year, j AS k, max(lo) AS d FROM mins GROUP BY supp, year, j)"""


def panel(spark, d, levels=None):
    m = micro(spark, d).withColumn("unit_id", F.col("supp") * 10000 + F.col("year"))
    c = quantiles.unit_curves(m, "unit_id", "y", "w", levels or midpoint_levels()).select(F.expr("unit_id div 10000").alias("supp"), (F.col("unit_id") % 10000).alias("year"), "q")
    return prep.lagged(c, ["supp"], ["year"], ["q"]).where("lag_q IS NOT NULL").withColumn("raw", C.curve_minus(F.col("q"), F.col("lag_q")))


@query("q9_q12_projected_differences", twin(PANEL + ",\n" + PROJECT, f"SELECT supp, year::INT AS year, k, {R('d', 3)} AS q FROM proj"))
def q9(spark, d):
    """Monotone first differences of the yearly curves of all suppliers."""
    p = panel(spark, d).select("supp", "year", C.project_monotone(F.col("raw")).alias("q"))
    return quantiles.as_long(p, ["supp", "year"]).select("supp", F.col("year").cast("int").alias("year"), "k", r(F.col("q"), 3).alias("q"))


#: The same differences on 80 levels, and their projection as the largest, over starts, of the least average to an end, as lists.
MANY = panel_sql(80) + """, wl AS (SELECT supp, year, list(d ORDER BY k) AS d FROM lagged GROUP BY ALL),
ws AS (SELECT *, list_transform(range(0, 81), lambda j: coalesce(list_sum(d[1:j]), 0)) AS s FROM wl)"""


@query("q9_many_levels", twin(MANY, f"SELECT supp, year::INT AS year, k::INT AS k, {R('list_max(list_transform(range(1, k + 1), lambda i: list_min(list_transform(range(k, 81), lambda j: (s[j + 1] - s[i]) / (j - i + 1)))))', 3)} AS q FROM ws CROSS JOIN (SELECT unnest(range(1, 81, 8)) AS k)"))
def q9_many(spark, d):
    """Differences of curves of 80 levels made monotone by the stack, at every eighth level."""
    p = panel(spark, d, midpoint_levels(80)).select("supp", "year", F.col("raw").alias("q"))
    long = quantiles.as_long(monotone.projected(p, "q"), ["supp", "year"]).where("(k - 1) % 8 = 0")
    return long.select("supp", F.col("year").cast("int").alias("year"), "k", r(F.col("q"), 3).alias("q"))


@query("q10_projection_diagnostics", twin(PANEL + ",\n" + PROJECT + ", st AS (SELECT supp, year, count(*) FILTER (d < p) AS v FROM (SELECT *, lag(d) OVER (PARTITION BY supp, year ORDER BY k) AS p FROM lagged) GROUP BY ALL)", f"SELECT (SELECT count(*) FROM st) AS n_vectors, (SELECT count(*) FROM st WHERE v > 0) AS n_changed, (SELECT sum(v)::BIGINT FROM st) AS violations, {R('max(abs(proj.d - lagged.d))', 3)} AS max_adjustment, 0::BIGINT AS still_falling FROM proj JOIN lagged USING (supp, year, k)"))
def q10(spark, d):
    """Vectors changed, falling steps, and the largest adjustment."""
    p = panel(spark, d).select("raw", C.project_monotone(F.col("raw")).alias("p"))
    gap = F.array_max(F.transform(C.curve_minus(F.col("p"), F.col("raw")), F.abs))
    return p.agg(F.count("*").alias("n_vectors"), F.count(F.when(gap > 0, 1)).alias("n_changed"), F.sum(C.violations(F.col("raw"))).alias("violations"), r(F.max(gap), 3).alias("max_adjustment"), F.count(F.when(~C.is_monotone(F.col("p"), 1e-9), 1)).alias("still_falling"))


I9 = interior_levels(9)


@query("q11_resampled", twin(CURVES + ", t AS (SELECT j, 0.1::DOUBLE + 0.8::DOUBLE * ((j::DOUBLE - 0.5::DOUBLE) / 9) AS u FROM (SELECT unnest(range(1, 10)) AS j)), pt AS (SELECT j, u, floor(u * 25 + 0.5)::INT AS k FROM t), whole AS (SELECT unit_id, list(q ORDER BY k) AS q FROM curve GROUP BY unit_id)", f"SELECT unit_id, j::INT AS k, {R('q[pt.k] + (u - (pt.k - 0.5::DOUBLE) / 25) * 25 * (q[pt.k + 1] - q[pt.k])', 3)} AS q FROM whole CROSS JOIN pt"))
def q11(spark, d):
    long = quantiles.as_long(curves(spark, d).select("unit_id", C.curve_resample(F.col("q"), U, I9).alias("q")), ["unit_id"])
    return long.select("unit_id", "k", r(F.col("q"), 3).alias("q"))


@query("q13_monotone", twin(CURVES, "SELECT unit_id, bool_and(coalesce(q - p >= -1e-12, true)) AS monotone, count(*) FILTER (q IS NOT NULL AND isfinite(q)) AS n_finite FROM (SELECT *, lag(q) OVER (PARTITION BY unit_id ORDER BY k) AS p FROM curve) GROUP BY unit_id"))
def q13(spark, d):
    q = F.col("q")
    return curves(spark, d).select("unit_id", C.is_monotone(q).alias("monotone"), F.size(F.filter(q, lambda x: x.isNotNull() & ~F.isnan(x))).cast("long").alias("n_finite"))


@query("q14_raw_contrast_by_level", twin(",\n".join([CURVES, UNITS]), f"SELECT k, {R('avg(q) FILTER (a = 1)', 3)} AS treated, {R('avg(q) FILTER (a = 0)', 3)} AS control, {R('100 * (avg(q) FILTER (a = 1) / avg(q) FILTER (a = 0) - 1)')} AS percent FROM curve JOIN units USING (unit_id) GROUP BY k"))
def q14(spark, d):
    j = curves_long(spark, d).join(units(spark, d).select("unit_id", "a"), "unit_id")
    t, c = F.avg(F.when(F.col("a") == 1, F.col("q"))), F.avg(F.when(F.col("a") == 0, F.col("q")))
    return j.groupBy("k").agg(r(t, 3).alias("treated"), r(c, 3).alias("control"), r(100 * (t / c - 1)).alias("percent"))


ZERO = "zu AS (SELECT user_id, event_type, e.v FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT DISTINCT event_type FROM events) LEFT JOIN (SELECT user_id, event_type, max(value) AS v FROM events WHERE hour(ts) = 3 GROUP BY ALL) e USING (user_id, event_type))"


@query("q15_zero_share", twin(ZERO, f"SELECT event_type, user_id % 2 AS a, count(*) AS n, {R('avg((coalesce(v, 0) <= 0)::INT)', 6)} AS zero_share FROM zu GROUP BY ALL"))
def q15(spark, d):
    """Share of users whose night-hour curve of an event type is zero, by arm; combinations without events are zero."""
    e = table(spark, d, "events")
    levels = midpoint_levels(5)
    night = e.where(F.hour("ts") == 3).withColumn("u", F.concat_ws("|", "user_id", "event_type")).withColumn("w", F.lit(1.0))
    c = quantiles.unit_curves(night, "u", "value", "w", levels).select(F.split("u", r"\|")[0].cast("long").alias("user_id"), F.split("u", r"\|")[1].alias("event_type"), "q")
    kinds = e.select("event_type").distinct()  # a handful of types
    full = e.select("user_id").distinct().crossJoin(F.broadcast(kinds)).join(c, ["user_id", "event_type"], "left").withColumn("q", F.coalesce("q", array_of([0.0] * 5)))
    return full.groupBy("event_type", (F.col("user_id") % 2).alias("a")).agg(F.count("*").alias("n"), r(F.avg(C.is_zero_curve(F.col("q"), 1e-9).cast("double")), 6).alias("zero_share"))


@query("q16_density", twin(CURVES + """, s AS (SELECT count(*) AS n, stddev_samp(q) AS sd, quantile_cont(q, 0.75) - quantile_cont(q, 0.25) AS iqr FROM curve),
h AS (SELECT n, 0.9::DOUBLE * least(sd, iqr / 1.34::DOUBLE) * pow(n, -0.2::DOUBLE) AS h FROM s), x AS (SELECT i::INT AS i, 5000::DOUBLE * i AS x FROM (SELECT unnest(range(0, 21)) AS i))""", f"SELECT i, {R('1e6 * sum(exp(-pow((x - q) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 6)} AS density FROM curve CROSS JOIN h CROSS JOIN x GROUP BY i"))
def q16(spark, d):
    """Kernel density of pooled curve coordinates at 21 points, Silverman's bandwidth; per million."""
    q = ordered.ranges(curves_long(spark, d).select("q"), [], [F.col("q")])
    quarters = quantiles.exact_quantiles(q, "q", [0.25, 0.75])
    s = q.agg(F.count("*").alias("n"), F.stddev_samp("q").alias("sd")).crossJoin(quarters)  # single rows
    lo, hi = (F.get("quantiles", F.lit(i)) for i in (0, 1))
    h = s.select("n", (0.9 * F.least(F.col("sd"), (hi - lo) / 1.34) * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"))
    z = [(F.lit(i * 5000.0) - F.col("q")) / F.col("h") for i in range(21)]
    sums = q.crossJoin(F.broadcast(h)).agg(F.first("n").alias("n"), F.first("h").alias("h"), *[F.sum(F.exp(-x * x / 2)).alias(f"s{i}") for i, x in enumerate(z)])  # one row of h
    long = sums.select("n", "h", F.posexplode(F.array(*[f"s{i}" for i in range(21)])).alias("i", "s"))
    return long.where("n > 0").select("i", r(1e6 * F.col("s") / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi())), 6).alias("density"))


@query("w3_ecdf_bins", twin(UNITS + ", " + BINNED, f"SELECT unit_id, {R('m', 8)} AS m, bin FROM binned"))
def w3(spark, d):
    u = prep.ecdf_moderator(units(spark, d), "moderator_raw", "unit_id")
    return u.select("unit_id", r(F.col("m"), 8).alias("m"), prep.moderator_bin(F.col("m")).alias("bin"))


@query("w4_w5_adjacent", twin(CURVES, f"SELECT unit_id, {R('max(q - p)')} AS largest_step, count(*) FILTER (q - p < 0) AS violations FROM (SELECT *, lag(q) OVER (PARTITION BY unit_id ORDER BY k) AS p FROM curve) GROUP BY unit_id"))
def w5(spark, d):
    q = C.running_max(F.col("q"))
    return curves(spark, d).select("unit_id", r(F.array_max(C.adjacent(q))).alias("largest_step"), C.violations(q).cast("long").alias("violations"))


@query("t1_t2_canonical_order", twin(UNITS, "SELECT row_number() OVER (ORDER BY size, moderator_raw, a, unit_id) - 1 AS rank, unit_id FROM units"))
def t1(spark, d):
    return ordered.global_rank(units(spark, d), [F.col("size"), F.col("moderator_raw"), F.col("a"), F.col("unit_id")]).select("rank", "unit_id")


@query("t2_sorted_atoms", twin(",\n".join([CURVES, UNITS]), f"SELECT brand, row_number() OVER (PARTITION BY brand ORDER BY f) - 1 AS atom_id, {R('f', 3)} AS first FROM (SELECT brand, max(q) FILTER (k = 1) AS f FROM curve JOIN units USING (unit_id) GROUP BY brand, unit_id)"))
def t2(spark, d):
    """Atoms of each brand's law in lexicographic order, numbered over sorted ranges, shown by their first coordinates."""
    c = curves(spark, d).join(units(spark, d).select("unit_id", "brand"), "unit_id")
    ranked = prep.rank_in_group(c, "brand", [F.col("q")], "atom_id")
    return ranked.select("brand", "atom_id", r(F.get("q", F.lit(0)), 3).alias("first"))


@query("t3_initial_atoms", twin(FULL + ", o AS (SELECT unit_id, row_number() OVER (ORDER BY round(mean, 6), unit_id) - 1 AS rk, count(*) OVER () AS n FROM func)", "SELECT i::INT AS atom_id, unit_id FROM o JOIN (SELECT unnest(range(0, 10)) AS i) ON rk = floor((i + 0.5) * n / 10)"))
def t3(spark, d):
    """Ten evenly spaced order statistics of curves by mean."""
    c = curves(spark, d).select("unit_id", r(C.curve_mean(F.col("q")), 6).alias("mean"))
    return prep.order_statistics(c, [F.col("mean"), F.col("unit_id")], 10).select("atom_id", "unit_id")


@query("w7_w8_folds", twin(UNITS, "SELECT unit_id, a, ((row_number() OVER (PARTITION BY a ORDER BY size, moderator_raw, unit_id) - 1) % 3)::INT AS fold, ((row_number() OVER (PARTITION BY a ORDER BY md5('7:' || unit_id::VARCHAR), unit_id) - 1) % 3)::INT AS seeded FROM units"))
def w7(spark, d):
    u = units(spark, d)
    a = prep.folds_by_rank(u, "a", [F.col("size"), F.col("moderator_raw"), F.col("unit_id")], 3).select("unit_id", "a", "fold")
    b = prep.folds_seeded(u, "a", "unit_id", 7, 3, "seeded").select("unit_id", "seeded")
    return a.join(b, "unit_id")


@query("p17_shifted_log", twin(CURVES + ", f AS (SELECT min(q) - 0.05::DOUBLE * stddev_pop(q) AS f FROM curve)", f"SELECT unit_id, {R('avg(ln(q - f))', 6)} AS mean_log, {R('avg(exp(ln(q - f)) + f)', 3)} AS back FROM curve CROSS JOIN f GROUP BY unit_id"))
def p17(spark, d):
    long = curves_long(spark, d)
    f = long.agg((F.min("q") - 0.05 * F.stddev_pop("q")).alias("f"))
    z = C.shifted_log(F.col("q"), F.col("f"))
    return curves(spark, d).crossJoin(F.broadcast(f)).select("unit_id", r(C.curve_mean(z), 6).alias("mean_log"), r(C.curve_mean(C.unshifted_log(z, F.col("f"))), 3).alias("back"))  # one row of f


@query("p19_validation", twin(",\n".join([CURVES, UNITS]), "SELECT count(DISTINCT unit_id) AS units, count(*) FILTER (NOT isfinite(q)) AS not_finite, count(DISTINCT unit_id) FILTER (a = 0) AS controls, count(DISTINCT unit_id) FILTER (a = 1) AS treated, count(*) FILTER (a NOT IN (0, 1)) AS bad_arm FROM curve JOIN units USING (unit_id)"))
def p19(spark, d):
    j = curves(spark, d).join(units(spark, d).select("unit_id", "a"), "unit_id")
    bad = F.size(F.filter("q", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    return j.agg(F.count("*").alias("units"), F.sum(bad).alias("not_finite"), F.count(F.when(F.col("a") == 0, 1)).alias("controls"), F.count(F.when(F.col("a") == 1, 1)).alias("treated"), F.count(F.when(~F.col("a").isin(0, 1), 1)).alias("bad_arm"))


__all__ = ["FUNCS", "ORACLES", "QUERIES", "STAR", "designed", "query", "star_of"]
