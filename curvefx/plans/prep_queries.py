"""Queries that prepare micro rows, panels and benchmarks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import curves as C
from ..grid import midpoint_levels
from ..operators import benchmarks as B
from ..operators import ordered, prep, quantiles
from .roles import CURVES, MICRO, UNITS, R, curves, knots_sql, micro, r, table, twin, units

QUERIES, ORACLES = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("p1_numeric_coercion", f"SELECT event_id, {R('coalesce(try_cast(regexp_extract(props, $$: ([0-9]+)$$, 1) AS DOUBLE), -1)', 2)} AS k, try_cast(event_type AS DOUBLE) IS NULL AS not_a_number FROM events")
def p1(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", r(F.coalesce(prep.numeric(F.regexp_extract("props", ": ([0-9]+)", 1)), F.lit(-1.0)), 2).alias("k"), prep.numeric(c("event_type")).isNull().alias("not_a_number"))


@query("p2_population_filter", f"SELECT year(o_orderdate)::INT AS year, count(*) AS n, {R('sum(o_totalprice)', 2)} AS total FROM orders WHERE o_totalprice > 0 AND CASE WHEN year(o_orderdate) >= 1996 THEN o_orderstatus IN ('F', 'O') ELSE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') END GROUP BY ALL")
def p2(spark, d):
    era = F.when(F.year("o_orderdate") >= 1996, c("o_orderstatus").isin("F", "O")).otherwise(c("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW"))
    o = table(spark, d, "orders").where((c("o_totalprice") > 0) & era)
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("p3_recode", "SELECT coalesce(CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END, o_orderpriority) AS code, count(*) AS n FROM orders GROUP BY ALL")
def p3(spark, d):
    o = table(spark, d, "orders").select(prep.recode(c("o_orderstatus"), {"F": "filled", "O": "open"}, c("o_orderpriority")).alias("code"))
    return o.groupBy("code").agg(F.count("*").alias("n"))


WAGE = "wage AS (SELECT l_suppkey, year(l_shipdate)::INT AS year, CASE WHEN l_returnflag = 'R' AND l_extendedprice > 0 THEN l_extendedprice WHEN l_quantity > 0 AND l_extendedprice > 0 THEN l_extendedprice / l_quantity END AS y, (year(l_shipdate) < 1995 AND l_linenumber = 7) OR (year(l_shipdate) >= 1995 AND l_tax = 0.08) AS imputed FROM lineitem)"


def wages(spark, d):
    li = table(spark, d, "lineitem")
    y = F.when((c("l_returnflag") == "R") & (c("l_extendedprice") > 0), c("l_extendedprice")).when((c("l_quantity") > 0) & (c("l_extendedprice") > 0), c("l_extendedprice") / c("l_quantity"))
    year = F.year("l_shipdate")
    return li.select("l_suppkey", year.alias("year"), y.alias("y"), F.when(year < 1995, c("l_linenumber") == 7).otherwise(c("l_tax") == 0.08).alias("imputed"))


@query("p4_p5_conditional_outcome", twin(WAGE, f"SELECT year, count(*) AS n, count(*) FILTER (imputed) AS n_imputed, {R('avg(CASE WHEN NOT imputed THEN y END)')} AS mean FROM wage GROUP BY year"))
def p4(spark, d):
    w = wages(spark, d)
    return w.groupBy("year").agg(F.count("*").alias("n"), F.count(F.when(c("imputed"), 1)).alias("n_imputed"), r(F.avg(F.when(~c("imputed"), c("y")))).alias("mean"))


INDEX = "idx0 AS (SELECT year(o_orderdate)::INT AS year, avg(o_totalprice) AS v FROM orders GROUP BY ALL), idx1 AS (SELECT year(l_shipdate)::INT AS year, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL), idx AS (SELECT * FROM idx0 WHERE year <= 1996 UNION ALL SELECT i.year, i.v * a.v / b.v FROM idx1 i, (SELECT v FROM idx0 WHERE year = 1996) a, (SELECT v FROM idx1 WHERE year = 1996) b WHERE i.year > 1996)"


@query("p6_spliced_deflation", twin(INDEX, f"SELECT year, {R('v')} AS index, {R('(SELECT avg(y) FROM (SELECT l_extendedprice AS y FROM lineitem WHERE year(l_shipdate) = year)) / v * 100')} AS real FROM idx WHERE year IN (SELECT year(l_shipdate) FROM lineitem)"))
def p6(spark, d):
    old = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("v"))
    new = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.avg("l_extendedprice").alias("v"))
    idx = prep.splice(old, new, "year", "v", 1996)
    return idx.join(new.withColumnRenamed("v", "y"), "year").select("year", r(c("v")).alias("index"), r(c("y") / c("v") * 100).alias("real"))


@query("p7_usable_outcome", "SELECT count(*) FILTER (l_extendedprice IS NOT NULL AND isfinite(l_extendedprice) AND l_quantity > 10) AS usable, count(*) AS n FROM lineitem")
def p7(spark, d):
    li = table(spark, d, "lineitem").withColumn("w", c("l_quantity") - 10)
    return li.agg(F.count(F.when(quantiles.usable("l_extendedprice", "w"), 1)).alias("usable"), F.count("*").alias("n"))


@query("p8_minimum_group_size", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) >= 35")
def p8(spark, d):
    kept = prep.min_group_size(table(spark, d, "lineitem").select("l_partkey"), ["l_partkey"], 35)
    return kept.groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("p9_p10_policy_panel", f"SELECT n_nationkey, year, {R('d')} AS d, a1, a2, a3 FROM (SELECT *, d > 0 AS a1, d > 0.02 * p AS a2, d > 0 AND coalesce(lag(d) OVER (PARTITION BY n_nationkey ORDER BY year), 0) <= 0 AS a3 FROM (SELECT *, v - lag(v) OVER (PARTITION BY n_nationkey ORDER BY year) AS d, lag(v) OVER (PARTITION BY n_nationkey ORDER BY year) AS p FROM (SELECT c_nationkey AS n_nationkey, year(o_orderdate)::INT AS year, avg(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL))) WHERE d IS NOT NULL")
def p10(spark, d):
    """Treatments from changes of a panel value to the previous row; incomplete rows go."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), c("c_custkey") == c("o_custkey"))
    p = o.groupBy(c("c_nationkey").alias("n_nationkey"), F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("v"))
    p = prep.lagged(p, ["n_nationkey"], ["year"], ["v"]).withColumn("d", c("v") - c("lag_v"))
    p = prep.lagged(p, ["n_nationkey"], ["year"], ["d"]).dropna(subset=["d"])
    return p.select("n_nationkey", "year", r(c("d")).alias("d"), (c("d") > 0).alias("a1"), (c("d") > 0.02 * c("lag_v")).alias("a2"), ((c("d") > 0) & (F.coalesce("lag_d", F.lit(0.0)) <= 0)).alias("a3"))


@query("p12_variants", twin(",\n".join([CURVES, UNITS]), f"SELECT variant, count(*) AS n, {R('avg(mean)')} AS mean FROM (SELECT u.*, mean FROM units u JOIN (SELECT unit_id, avg(q) AS mean FROM curve GROUP BY unit_id) USING (unit_id)) JOIN (SELECT unnest(['no_economy', 'large', 'all']) AS variant) ON CASE variant WHEN 'no_economy' THEN type <> 'ECONOMY' WHEN 'large' THEN size > 40 ELSE true END GROUP BY variant"))
def p12(spark, d):
    u = curves(spark, d).join(units(spark, d), "unit_id").select("type", "size", C.curve_mean(c("q")).alias("mean"))
    v = prep.variants(u, {"no_economy": c("type") != "ECONOMY", "large": c("size") > 40, "all": F.lit(True)})
    return v.groupBy("variant").agg(F.count("*").alias("n"), r(F.avg("mean")).alias("mean"))


@query("p13_first_known", "SELECT user_id, arg_min(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY user_id")
def p13(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'")
    return prep.first_known(e, ["user_id"], "value", ["event_id"])


@query("p14_median_imputation", f"SELECT event_type, count(*) FILTER (value >= 300) AS imputed, {R('avg(coalesce(CASE WHEN value < 300 THEN value END, (SELECT median(value) FROM events WHERE value < 300)))')} AS mean FROM events GROUP BY event_type")
def p14(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(c("value") < 300, c("value")))
    return prep.impute_median(e, "v").groupBy("event_type").agg(F.count(F.when(c("v_imputed"), 1)).alias("imputed"), r(F.avg("v")).alias("mean"))


@query("p15_one_hot", "SELECT sum((p_type = 'LARGE')::INT) AS t1, sum((p_type = 'MEDIUM')::INT) AS t2, count(*) AS n FROM part")
def p15(spark, d):
    p = prep.one_hot(table(spark, d, "part"), "p_type", ["ECONOMY", "LARGE", "MEDIUM"], "t")
    return p.agg(F.sum("t1").alias("t1"), F.sum("t2").alias("t2"), F.count("*").alias("n"))


@query("p16_w6_standardised", f"SELECT p_partkey, {R('(p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER ()', 6)} AS z, {R('(ln(p_retailprice) - avg(ln(p_retailprice)) OVER (PARTITION BY p_type)) / stddev_samp(ln(p_retailprice)) OVER (PARTITION BY p_type)', 6)} AS z_type, 0.0::DOUBLE AS z_constant FROM part")
def p16(spark, d):
    p = table(spark, d, "part").withColumn("lp", F.log("p_retailprice")).withColumn("one", F.lit(1.0))
    z = prep.standardised(prep.standardised(prep.standardised(p, "p_size", "z"), "lp", "z_type", 1, ["p_type"]), "one", "z_constant")
    return z.select("p_partkey", r(c("z"), 6).alias("z"), r(c("z_type"), 6).alias("z_type"), "z_constant")


@query("p18_outcome_variants", f"SELECT event_type, {R('avg(ln(1 + value))')} AS log1p, {R('avg(value + user_id)')} AS total FROM events GROUP BY event_type")
def p18(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(r(F.avg(F.log1p("value"))).alias("log1p"), r(F.avg(c("value") + c("user_id"))).alias("total"))


@query("j1_j2_j5_validated_joins", f"SELECT r_name, count(*) AS n, {R('sum(s_acctbal)', 2)} AS balance FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def j1(spark, d):
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    j = prep.join_many_to_one(s, table(spark, d, "nation"), ["n_nationkey"]).withColumnRenamed("n_regionkey", "r_regionkey")
    j = prep.join_many_to_one(j, table(spark, d, "region"), ["r_regionkey"])
    return j.groupBy("r_name").agg(F.count("*").alias("n"), r(F.sum("s_acctbal"), 2).alias("balance"))


@query("j3_consistency", "SELECT count(*) AS n, count(*) FILTER (CASE WHEN p_size > 25 THEN 1 ELSE 0 END IS DISTINCT FROM CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END) AS n_differ FROM part")
def j3(spark, d):
    p = table(spark, d, "part")
    return prep.disagreements(p.select("p_partkey", (c("p_size") > 25).alias("a")), p.select("p_partkey", (c("p_retailprice") > 1000).alias("a")), ["p_partkey"], "a")


@query("j4_j6_panel_join", f"SELECT a.nation, a.year, {R('sales / bought', 6)} AS ratio FROM (SELECT s_nationkey AS nation, year(l_shipdate)::INT AS year, sum(l_extendedprice) AS sales FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL) a JOIN (SELECT c_nationkey AS nation, year(o_orderdate)::INT AS year, sum(o_totalprice) AS bought FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) b USING (nation, year) WHERE a.nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def j4(spark, d):
    a = table(spark, d, "lineitem").join(table(spark, d, "supplier"), c("s_suppkey") == c("l_suppkey")).groupBy(c("s_nationkey").alias("nation"), F.year("l_shipdate").alias("year")).agg(F.sum("l_extendedprice").alias("sales"))
    b = table(spark, d, "orders").join(table(spark, d, "customer"), c("c_custkey") == c("o_custkey")).groupBy(c("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("bought"))
    kept = table(spark, d, "nation").where("n_regionkey < 3").select(c("n_nationkey").alias("nation"))
    return a.join(b, ["nation", "year"]).join(kept, "nation", "left_semi").select("nation", "year", r(c("sales") / c("bought"), 6).alias("ratio"))


@query("g1_weighted_shares", f"SELECT l_suppkey, {R('sum(l_quantity * l_extendedprice) / sum(l_quantity)')} AS mean, {R('sum(CASE WHEN l_extendedprice < 20000 THEN l_quantity ELSE 0 END) / sum(l_quantity)', 6)} AS below, {R('avg((l_returnflag = $$R$$)::INT)', 6)} AS returned FROM lineitem GROUP BY l_suppkey")
def g1(spark, d):
    w = c("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(r(F.sum(w * c("l_extendedprice")) / F.sum(w)).alias("mean"), r(F.sum(F.when(c("l_extendedprice") < 20000, w).otherwise(0)) / F.sum(w), 6).alias("below"), r(F.avg((c("l_returnflag") == "R").cast("double")), 6).alias("returned"))


@query("g2_g3_compositions", f"SELECT c_nationkey, count(*) AS n, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS known, {R('count(*) FILTER (c_acctbal > 5000)::DOUBLE / nullif(count(*) FILTER (c_acctbal > 0), 0)', 6)} AS share FROM customer GROUP BY c_nationkey")
def g2(spark, d):
    """Shares with their own non-null denominators."""
    bal = F.when(c("c_acctbal") > 0, c("c_acctbal"))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count(bal).alias("known"), r(F.try_divide(F.count_if(bal > 5000), F.count(bal)), 6).alias("share"))


@query("g4_missing_share", f"SELECT p_type, p_size > 25 AS a, {R('avg((p_retailprice > 1500)::INT)', 6)} AS missing FROM part GROUP BY ALL")
def g4(spark, d):
    p = table(spark, d, "part").withColumn("x", F.when(c("p_retailprice") <= 1500, c("p_retailprice")))
    return p.groupBy("p_type", (c("p_size") > 25).alias("a")).agg(r(F.avg(c("x").isNull().cast("double")), 6).alias("missing"))


@query("g5_bin_means", f"SELECT b::INT AS bin, {R('avg(p_retailprice)')} AS mean, count(p_partkey) AS n FROM (SELECT unnest(range(0, 7)) AS b) LEFT JOIN part ON p_size // 10 = b GROUP BY b")
def g5(spark, d):
    """All bins, the empty one with null."""
    bins = spark.range(7).select(c("id").cast("int").alias("bin"))
    g = table(spark, d, "part").groupBy(F.expr("p_size div 10").cast("int").alias("bin")).agg(F.avg("p_retailprice").alias("m"), F.count("*").alias("k"))
    return bins.join(g, "bin", "left").select("bin", r(c("m")).alias("mean"), F.coalesce("k", F.lit(0).cast("long")).alias("n"))


@query("g19_size_quantiles", f"SELECT {R('quantile_cont(n, 0.1)')} AS q10, {R('quantile_cont(n, 0.5)')} AS q50, {R('quantile_cont(n, 0.9)')} AS q90, count(*) FILTER (n >= 30) AS feasible FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)")
def g19(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return n.agg(F.percentile("n", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"), F.count_if(c("n") >= 30).alias("feasible")).select(*[r(c("q")[i]).alias(k) for i, k in enumerate(("q10", "q50", "q90"))], "feasible")


@query("g20_crosstab", "SELECT p_type, count(*) FILTER (p_size > 25) AS treated, count(*) FILTER (p_size <= 25) AS control FROM part GROUP BY p_type")
def g20(spark, d):
    p = table(spark, d, "part").withColumn("a", (c("p_size") > 25).cast("int"))
    return p.groupBy("p_type").pivot("a", [1, 0]).count().select("p_type", F.coalesce("1", F.lit(0)).alias("treated"), F.coalesce("0", F.lit(0)).alias("control"))


@query("g22_design_means", f"SELECT coalesce(year, -1)::INT AS year, {R('avg(v)')} AS mean, {R('avg((v >= 90000)::INT)', 6)} AS top_share FROM (SELECT year(l_shipdate) AS year, l_extendedprice AS v FROM lineitem) GROUP BY GROUPING SETS ((year), ())")
def g22(spark, d):
    li = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), c("l_extendedprice").alias("v"))
    g = li.rollup("year").agg(r(F.avg("v")).alias("mean"), r(F.avg((c("v") >= 90000).cast("double")), 6).alias("top_share"))
    return g.withColumn("year", F.coalesce("year", F.lit(-1)))


@query("w1_w2_panel_lags", f"SELECT l_suppkey, year, {R('v - lag(v) OVER w')} AS d, {R('sum(v) OVER (PARTITION BY l_suppkey ORDER BY year ROWS UNBOUNDED PRECEDING) / sum(v) OVER (PARTITION BY l_suppkey)', 6)} AS share FROM (SELECT l_suppkey, year(l_shipdate)::INT AS year, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_suppkey ORDER BY year)")
def w1(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.avg("l_extendedprice").alias("v"))
    over = Window.partitionBy("l_suppkey").orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = prep.lagged(p, ["l_suppkey"], ["year"], ["v"])
    return q.select("l_suppkey", "year", r(c("v") - c("lag_v")).alias("d"), r(F.sum("v").over(over) / F.sum("v").over(Window.partitionBy("l_suppkey")), 6).alias("share"))


@query("t6_evenly_spaced", twin(UNITS, "SELECT unit_id FROM (SELECT unit_id, row_number() OVER (ORDER BY moderator_raw, unit_id) - 1 AS rk, count(*) OVER () AS n FROM units) JOIN (SELECT unnest(range(0, 64)) AS i) ON rk = floor(i * (n - 1)::DOUBLE / 63)"))
def t6(spark, d):
    return prep.evenly_spaced(units(spark, d), [c("moderator_raw"), c("unit_id")], 64).select("unit_id")


@query("t7_union_of_grades", "SELECT grade, count(*) AS n, count(brand) AS branded FROM (SELECT 'a' AS grade, p_brand AS brand FROM part WHERE p_size < 10 UNION ALL SELECT 'b', NULL FROM part WHERE p_size >= 10) GROUP BY grade")
def t7(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_size < 10").select(F.lit("a").alias("grade"), c("p_brand").alias("brand"))
    b = p.where("p_size >= 10").select(F.lit("b").alias("grade"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("grade").agg(F.count("*").alias("n"), F.count("brand").alias("branded"))


# Benchmarks: decile shares of supplier sales by nation stand for published tables.
DEC = "sal AS (SELECT s_nationkey AS nation, l_extendedprice AS v, ntile(10) OVER (PARTITION BY s_nationkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS dec FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), sh AS (SELECT nation, dec, sum(v) AS s, avg(v) AS m, count(*) AS n FROM sal GROUP BY ALL)"
PCHIP_KNOTS = """kn AS (SELECT nation, (dec - 0.5::DOUBLE) / 10 AS x0, m AS y0 FROM sh),
"""
PCHIP_PIECES = """ka AS (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1 FROM kn WINDOW w AS (PARTITION BY nation ORDER BY x0)),
kb AS (SELECT *, x1 - x0 AS h, (y1 - y0) / (x1 - x0) AS s FROM ka),
kc AS (SELECT *, lag(h) OVER w AS hp, lag(s) OVER w AS sp, lead(h) OVER w AS hn, lead(s) OVER w AS sn, lag(h, 2) OVER w AS hpp, lag(s, 2) OVER w AS spp FROM kb WINDOW w AS (PARTITION BY nation ORDER BY x0)),
kd AS (SELECT *, CASE WHEN hp IS NULL THEN ((2 * h + hn) * s - h * sn) / (h + hn) WHEN h IS NULL THEN ((2 * hp + hpp) * sp - hp * spp) / (hp + hpp) WHEN sp * s > 0 THEN (3 * h + 3 * hp) / ((2 * h + hp) / sp + (h + 2 * hp) / s) ELSE 0 END AS raw, CASE WHEN hp IS NULL THEN s WHEN h IS NULL THEN sp END AS e0, CASE WHEN hp IS NULL THEN sn WHEN h IS NULL THEN spp END AS e1 FROM kc),
ke AS (SELECT *, CASE WHEN e0 IS NULL THEN raw WHEN raw * e0 <= 0 THEN 0 WHEN e0 * e1 <= 0 AND abs(raw) > 3 * abs(e0) THEN 3 * e0 ELSE raw END AS m0 FROM kd),
pc AS (SELECT *, lead(m0) OVER (PARTITION BY nation ORDER BY x0) AS m1 FROM ke)"""
PCHIP = PCHIP_KNOTS + PCHIP_PIECES + """,
lv AS (SELECT k::INT AS k, least(greatest((k::DOUBLE - 0.5::DOUBLE) / 25, 0.05::DOUBLE), 0.95::DOUBLE) AS u FROM (SELECT unnest(range(1, 26)) AS k)),
fit AS (SELECT nation, k, (2 * t * t * t - 3 * t * t + 1) * y0 + (t * t * t - 2 * t * t + t) * h * m0 + (3 * t * t - 2 * t * t * t) * y1 + (t * t * t - t * t) * h * m1 AS q FROM (SELECT pc.*, k, (u - x0) / h AS t FROM pc JOIN lv ON (u > x0 AND u <= x1) OR (u = 0.05 AND x0 = 0.05) WHERE x1 IS NOT NULL))"""


def deciles(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), c("s_suppkey") == c("l_suppkey"))
    w = Window.partitionBy("s_nationkey").orderBy("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return li.select(c("s_nationkey").alias("nation"), c("l_extendedprice").alias("v"), F.ntile(10).over(w).alias("dec")).groupBy("nation", "dec").agg(F.sum("v").alias("s"), F.avg("v").alias("m"), F.count("*").alias("n"))


def nation_curves(spark, d):
    kn = deciles(spark, d).select("nation", ((c("dec") - 0.5) / 10).alias("x"), c("m").alias("y"))
    return B.pchip(B.collapse_levels(kn, ["nation"], "x", "y"), ["nation"], "x", "y", midpoint_levels())


@query("b1_b6_pchip_curves", twin(DEC + ",\n" + PCHIP, f"SELECT nation, k, {R('q', 2)} AS q FROM fit"))
def b1(spark, d):
    return nation_curves(spark, d).select("nation", "k", r(c("q"), 2).alias("q"))


@query("b1_pooled_benchmark", twin(DEC + ",\n" + PCHIP, f"SELECT k, {R('sum(q * w) / sum(w)', 2)} AS q FROM fit JOIN (SELECT nation, sum(n) AS w FROM sh GROUP BY nation) USING (nation) GROUP BY k"))
def b1p(spark, d):
    """Population-weighted average of the nations' curves."""
    w = deciles(spark, d).groupBy("nation").agg(F.sum("n").alias("w"))
    return B.pooled_benchmark(nation_curves(spark, d).join(w, "nation"), "w").select("k", r(c("q"), 2).alias("q"))


@query("b2_lorenz_gini", twin(DEC + ", lo AS (SELECT nation, dec / 10::DOUBLE AS p, sum(s) OVER (PARTITION BY nation ORDER BY dec) / sum(s) OVER (PARTITION BY nation) AS l FROM sh UNION ALL SELECT DISTINCT nation, 0, 0 FROM sh)", f"SELECT nation, {R('1 - 2 * sum(a)', 6)} AS gini FROM (SELECT nation, (l + lag(l) OVER w) / 2 * (p - lag(p) OVER w) AS a FROM lo WINDOW w AS (PARTITION BY nation ORDER BY p)) GROUP BY nation"))
def b2(spark, d):
    g = B.gini(B.lorenz(deciles(spark, d), ["nation"], "dec", "s"), ["nation"])
    return g.select("nation", r(c("gini"), 6).alias("gini"))


LORENZ = DEC + ", kn AS (SELECT nation, dec / 10::DOUBLE AS x0, sum(s) OVER (PARTITION BY nation ORDER BY dec) / sum(s) OVER (PARTITION BY nation) AS y0 FROM sh UNION ALL SELECT DISTINCT nation, 0, 0 FROM sh),\n" + PCHIP_PIECES + ", fit AS (SELECT nation, (6 * t * t - 6 * t) * y0 / h + (3 * t * t - 4 * t + 1) * m0 + (6 * t - 6 * t * t) * y1 / h + (3 * t * t - 2 * t) * m1 AS q FROM (SELECT pc.*, (u - x0) / h AS t FROM pc JOIN (SELECT (k::DOUBLE - 0.5::DOUBLE) / 25 AS u FROM (SELECT unnest(range(1, 26)) AS k)) ON u > x0 AND u <= x1 WHERE x1 IS NOT NULL))"


@query("b2_lorenz_quantiles", twin(LORENZ, f"SELECT nation, {R('avg(q) * any_value(mean)', 2)} AS rebuilt, {R('any_value(mean)', 2)} AS mean FROM fit JOIN (SELECT nation, sum(s) / sum(n) AS mean FROM sh GROUP BY nation) USING (nation) GROUP BY nation"))
def b2q(spark, d):
    """Quantile curves as the derivative of a monotone Lorenz curve times the mean, with their mean beside the true one."""
    dec = ordered.stored(deciles(spark, d))
    knots = B.lorenz(dec, ["nation"], "dec", "s")
    q = B.pchip(knots, ["nation"], "p", "l", midpoint_levels(), derivative=True)
    mean = dec.groupBy("nation").agg((F.sum("s") / F.sum("n")).alias("mean"))
    j = q.join(mean, "nation").groupBy("nation").agg(F.avg(c("q") * c("mean")).alias("rebuilt"), F.first("mean").alias("mean"))
    return j.select("nation", r(c("rebuilt"), 2).alias("rebuilt"), r(c("mean"), 2).alias("mean"))


@query("b3_conversion_check", f"SELECT {R('ratio', 6)} AS ratio, {R('max(abs(t / ratio - 1))', 6)} AS largest FROM (SELECT b / a AS t, median(b / a) OVER () AS ratio FROM (SELECT l_suppkey, avg(l_extendedprice) AS a, avg(l_extendedprice * (1 + l_tax)) AS b FROM lineitem GROUP BY ALL)) GROUP BY ratio")
def b3(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("a"), F.avg(c("l_extendedprice") * (1 + c("l_tax"))).alias("b"))
    m = B.median_ratio(g.select("l_suppkey", c("a").alias("value")), g.select("l_suppkey", c("b").alias("value")), "l_suppkey")
    return m.select(r(c("ratio"), 6).alias("ratio"), r(c("largest"), 6).alias("largest"))


@query("b4_b5_scaled_summary", twin(MICRO + ",\n" + knots_sql("curve", "micro", "year"), f"SELECT year, {R('avg(q)', 3)} AS mean, {R('max(q) FILTER (k = 13)', 3)} AS median, {R('max(q) FILTER (k = 23) / max(q) FILTER (k = 3)', 6)} AS p90_p10, {R('avg(q * 100 / med)', 4)} AS scaled_mean FROM curve JOIN (SELECT year, q AS med FROM curve WHERE k = 13) USING (year) GROUP BY year"))
def b4(spark, d):
    """Summary of yearly benchmark curves, and their mean once the median is scaled to 100."""
    q = quantiles.as_arrays(quantiles.pool_quantiles(micro(spark, d), "y", "w", by=["year"]), ["year"])
    med = C.value_at(c("q"), midpoint_levels(), 0.5)
    return q.select("year", r(C.curve_mean(c("q")), 3).alias("mean"), r(med, 3).alias("median"), r(C.curve_at(c("q"), 22) / C.curve_at(c("q"), 2), 6).alias("p90_p10"), r(C.curve_mean(F.transform("q", lambda x: x * 100 / med)), 4).alias("scaled_mean"))
