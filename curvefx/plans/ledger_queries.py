"""Queries over a metric ledger that is built from events: summaries, paired comparisons, audits, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.curves import normal_tail_sql
from ..operators import ledger as L
from .roles import R, r, table, twin

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


LEDGER = """cellv AS (SELECT event_type AS dgp, CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS method, ((user_id // 3) % 10)::INT AS seed, CASE hour(ts) % 3 WHEN 0 THEN 5 WHEN 1 THEN 25 ELSE 49 END AS n_grid, CASE (hour(ts) // 3) % 3 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 25 END AS n_particles, (event_id % 2)::INT AS arm, count(*) AS n, sqrt(avg(value * value)) AS rmse, avg(value) - 20 AS bias, sum(value) / 10 AS wall FROM events GROUP BY ALL),
ledger AS (SELECT dgp, method, seed, n_grid, n_particles, arm, substr(sha256(dgp || '|' || method || '|' || seed || '|' || n_grid || '|' || n_particles), 1, 16) AS cell_key, metric, 't0' AS target_id, CASE WHEN n > 1 THEN CASE metric WHEN 'level_rmse' THEN rmse ELSE bias END END AS value, CASE WHEN n > 1 THEN 'ok' WHEN metric = 'bias' THEN 'not_applicable' ELSE 'failed' END AS status, CASE WHEN n = 1 AND metric <> 'bias' THEN 'one event in arm ' || arm END AS failure_reason, wall AS wall_seconds, seed % 4 AS shard FROM cellv CROSS JOIN (SELECT unnest(['level_rmse', 'bias']) AS metric)),
cells AS (SELECT dgp, method, seed, n_grid, n_particles, cell_key, metric, target_id, avg(value) AS value, count(*) AS n_arms, avg(wall_seconds) AS wall_seconds FROM ledger WHERE status = 'ok' AND value IS NOT NULL GROUP BY ALL)"""


def ledger(spark, d):
    e = table(spark, d, "events")
    hour = F.hour("ts")
    cut = lambda c, a, b, z: F.when(c == 0, a).when(c == 1, b).otherwise(z)
    keys = [F.col("event_type").alias("dgp"), cut(F.col("user_id") % 3, "alpha", "beta", "gamma").alias("method"), (F.expr("user_id div 3") % 10).cast("int").alias("seed"), cut(hour % 3, 5, 25, 49).alias("n_grid"), cut(F.floor(hour / 3) % 3, 5, 10, 25).alias("n_particles"), (F.col("event_id") % 2).cast("int").alias("arm")]
    v = F.col("value")
    g = e.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(v * v)).alias("rmse"), (F.avg(v) - 20).alias("bias"), (F.sum(v) / 10).alias("wall"))
    one, many = F.col("n") == 1, F.col("n") > 1
    rows = g.select("*", F.explode(F.array(F.struct(F.lit("level_rmse").alias("metric"), F.col("rmse").alias("v")), F.struct(F.lit("bias").alias("metric"), F.col("bias").alias("v")))).alias("x"))
    bias = F.col("x.metric") == "bias"
    return rows.select(*L.COORDINATES, "arm", L.cell_key(*L.COORDINATES).alias("cell_key"), F.col("x.metric").alias("metric"), F.lit("t0").alias("target_id"), F.when(many, F.col("x.v")).alias("value"), F.when(many, "ok").when(bias, "not_applicable").otherwise("failed").alias("status"), F.when(one & ~bias, F.concat(F.lit("one event in arm "), F.col("arm").cast("string"))).alias("failure_reason"), F.col("wall").alias("wall_seconds"), (F.col("seed") % 4).alias("shard"))


def cells(spark, d):
    return L.cell_metrics(ledger(spark, d))


def rounded(df, exact: list[str], n: int = 5):
    return df.select(*exact, *[r(F.col(c), n).alias(c) for c in df.columns if c not in exact])


def rsql(*cols: str, n: int = 5) -> str:
    return ", ".join(f"{R(c.partition(' AS ')[0], n)} AS {c.partition(' AS ')[2] or c}" for c in cols)


@query("g6_cell_metrics", twin(LEDGER, f"SELECT cell_key, metric, n_arms, {rsql('value', 'wall_seconds')} FROM cells"))
def g6(spark, d):
    return rounded(cells(spark, d).select("cell_key", "metric", "n_arms", "value", "wall_seconds"), ["cell_key", "metric", "n_arms"])


@query("g7_replication_summary", twin(LEDGER, f"SELECT dgp, method, metric, n_grid, count(DISTINCT seed) AS n_seeds, {rsql('avg(value) AS mean', 'stddev_samp(value) AS sd', 'median(value) AS median', 'stddev_samp(value) / sqrt(count(value)) AS mc_se')} FROM cells GROUP BY ALL"))
def g7(spark, d):
    keys = ["dgp", "method", "metric", "n_grid"]
    return rounded(L.replication_summary(cells(spark, d), keys), [*keys, "n_seeds"])


@query("g8_failure_summary", twin(LEDGER, "SELECT dgp, method, count(DISTINCT cell_key) AS failed_cells, left(array_to_string(list_sort(list(DISTINCT failure_reason)), '; '), 600) AS reasons FROM ledger WHERE status = 'failed' GROUP BY ALL"))
def g8(spark, d):
    return L.failure_summary(ledger(spark, d), ["dgp", "method"])


@query("g9_failure_rates", twin(LEDGER, f"SELECT method, count(DISTINCT cell_key) AS cells, count(DISTINCT cell_key) FILTER (status = 'failed') AS failed, {rsql('count(DISTINCT cell_key) FILTER (status = $$failed$$)::DOUBLE / count(DISTINCT cell_key) AS rate')} FROM ledger GROUP BY method"))
def g9(spark, d):
    return rounded(L.failure_rates(ledger(spark, d), ["method"]), ["method", "cells", "failed"])


@query("g10_cost_summary", twin(LEDGER, f"SELECT method, n_grid, {rsql('median(v) AS median', 'max(v) AS largest')}, count(*) AS cells FROM (SELECT method, n_grid, cell_key, max(wall_seconds) AS v FROM ledger GROUP BY ALL) GROUP BY ALL"))
def g10(spark, d):
    return rounded(L.cost_summary(ledger(spark, d), ["method", "n_grid"]), ["method", "n_grid", "cells"])


@query("g11_method_means", twin(LEDGER, f"SELECT dgp, metric, method, {rsql('avg(v) AS mean', 'stddev_samp(v) / sqrt(count(*)) AS se')}, count(*) AS n FROM (SELECT dgp, metric, method, seed, avg(value) AS v FROM cells GROUP BY ALL) GROUP BY ALL"))
def g11(spark, d):
    keys = ["dgp", "metric", "method"]
    s = cells(spark, d).groupBy(*keys, "seed").agg(F.avg("value").alias("v")).groupBy(*keys).agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))
    return rounded(s, [*keys, "n"])


@query("g12_rmse_delta", twin(LEDGER, f"SELECT dgp, method, {rsql('sqrt(avg(value * value)) AS rmse', 'stddev_samp(value * value) / sqrt(count(*)) / (2 * sqrt(avg(value * value))) AS se')}, count(*) AS n FROM cells WHERE metric = 'bias' GROUP BY ALL"))
def g12(spark, d):
    return rounded(L.rmse_delta(cells(spark, d).where("metric = 'bias'"), ["dgp", "method"]), ["dgp", "method", "n"])


JACK = "js AS (SELECT dgp, method, seed, avg(value * value) AS ms FROM cells WHERE metric = 'bias' GROUP BY ALL), jt AS (SELECT *, sum(ms) OVER w AS s, count(*) OVER w AS n FROM js WINDOW w AS (PARTITION BY dgp, method)), loo AS (SELECT *, sqrt((s - ms) / (n - 1)) AS v FROM jt)"


@query("g13_rmse_jackknife", twin(LEDGER + ", " + JACK, f"SELECT dgp, method, {rsql('sqrt(any_value(s) / any_value(n)) AS rmse', 'sqrt((any_value(n) - 1) * var_pop(v)) AS se')}, any_value(n) AS n_seeds FROM loo GROUP BY ALL"))
def g13(spark, d):
    return rounded(L.rmse_jackknife(cells(spark, d).where("metric = 'bias'"), ["dgp", "method"]), ["dgp", "method", "n_seeds"])


@query("g14_mean_or_rmse", twin(LEDGER, f"SELECT metric, method, {rsql('CASE WHEN suffix(metric, $$_rmse$$) THEN sqrt(avg(value * value)) ELSE avg(value) END AS summary')} FROM cells GROUP BY metric, method"))
def g14(spark, d):
    return rounded(L.mean_or_rmse(cells(spark, d), ["metric", "method"]), ["metric", "method"])


@query("g15_family_pooled", twin(LEDGER + ", js AS (SELECT CASE WHEN dgp IN ('click', 'view') THEN 'browse' ELSE 'act' END AS family, method, seed, avg(value * value) AS ms FROM cells WHERE metric = 'bias' GROUP BY ALL), jt AS (SELECT *, sum(ms) OVER w AS s, count(*) OVER w AS n FROM js WINDOW w AS (PARTITION BY family, method)), loo AS (SELECT *, sqrt((s - ms) / (n - 1)) AS v FROM jt)", f"SELECT family, method, {rsql('sqrt(any_value(s) / any_value(n)) AS rmse', 'sqrt((any_value(n) - 1) * var_pop(v)) AS se')}, any_value(n) AS n_seeds FROM loo GROUP BY ALL"))
def g15(spark, d):
    family = F.when(F.col("dgp").isin("click", "view"), "browse").otherwise("act")
    return rounded(L.pooled_by_family(cells(spark, d).where("metric = 'bias'"), family, ["method"]), ["family", "method", "n_seeds"])


PAIRS = "pa AS (SELECT dgp, metric, seed, avg(value) AS a FROM cells WHERE method = 'alpha' GROUP BY ALL), pb AS (SELECT dgp, metric, seed, avg(value) AS b FROM cells WHERE method = 'beta' GROUP BY ALL), pairs AS (SELECT dgp, metric, seed, a, b, a - b AS d FROM pa JOIN pb USING (dgp, metric, seed))"
STATS = f"stats AS (SELECT dgp, metric, n, mean_diff, se, CASE WHEN se > 0 THEN {normal_tail_sql('mean_diff / se')} WHEN mean_diff = 0 THEN 1 WHEN se IS NOT NULL THEN 0 END AS p, win_share, 100 * mean_diff / abs(mb) AS relative, mean_diff / se AS ratio FROM (SELECT dgp, metric, count(*) AS n, avg(d) AS mean_diff, stddev_samp(d) / sqrt(count(*)) AS se, avg((d < 0)::INT) AS win_share, avg(b) AS mb FROM pairs GROUP BY ALL))"


def pairs(spark, d):
    c = cells(spark, d)
    return L.paired(c.where("method = 'alpha'"), c.where("method = 'beta'"), ["dgp", "metric", "seed"])


@query("g16_percent_change", twin(LEDGER + ", " + PAIRS, f"SELECT dgp, metric, {rsql('100 * avg(d) / abs(avg(b)) AS percent', '100 * stddev_samp(d) / sqrt(count(*)) / abs(avg(b)) AS se')} FROM pairs GROUP BY ALL"))
def g16(spark, d):
    b = F.abs(F.avg("b"))
    return rounded(pairs(spark, d).groupBy("dgp", "metric").agg((100 * F.avg("d") / b).alias("percent"), (100 * F.stddev_samp("d") / F.sqrt(F.count("*")) / b).alias("se")), ["dgp", "metric"])


@query("g17_ordered_values", twin(LEDGER, f"SELECT dgp, method, {rsql('avg(value) AS mean', 'stddev_samp(value) AS sd')}, array_to_string(list(seed ORDER BY seed), ',') AS seeds FROM (SELECT dgp, method, seed, avg(value) AS value FROM cells WHERE metric = 'bias' GROUP BY ALL) GROUP BY ALL"))
def g17(spark, d):
    s = cells(spark, d).where("metric = 'bias'").groupBy("dgp", "method", "seed").agg(F.avg("value").alias("value"))
    g = s.groupBy("dgp", "method").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.array_join(F.array_sort(F.collect_list("seed")), ",").alias("seeds"))
    return rounded(g, ["dgp", "method", "seeds"])


@query("g18_running_moments", f"SELECT event_type, n, {R('m', 5)} AS mean, {R('s', 5)} AS se FROM (SELECT event_type, count(value) AS n, avg(value) AS m, stddev_samp(value) / sqrt(count(value)) AS s FROM events GROUP BY event_type)")
def g18(spark, d):
    """Daily moments merged to one summary."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    daily = L.running_moments(e, ["event_type", "day"], "value")
    return rounded(L.moments_summary(daily, ["event_type"]), ["event_type", "n"])


@query("g21_pivot_by_method", twin(LEDGER, f"SELECT dgp, metric, {rsql('avg(value) FILTER (method = $$alpha$$) AS alpha', 'avg(value) FILTER (method = $$beta$$) AS beta', 'avg(value) FILTER (method = $$gamma$$) AS gamma')} FROM cells GROUP BY ALL"))
def g21(spark, d):
    return rounded(cells(spark, d).groupBy("dgp", "metric").pivot("method", ["alpha", "beta", "gamma"]).agg(F.avg("value")), ["dgp", "metric"])


@query("g23_null_design", twin(LEDGER, f"SELECT method, n_particles, {rsql('avg(value) AS mean', 'stddev_samp(value) AS sd', 'stddev_samp(value) / sqrt(count(*)) AS mc_se')}, count(*) AS n FROM cells WHERE suffix(dgp, 'w') GROUP BY ALL"))
def g23(spark, d):
    c = cells(spark, d).where(F.col("dgp").endswith("w"))
    g = c.groupBy("method", "n_particles").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("mc_se"), F.count("*").alias("n"))
    return rounded(g, ["method", "n_particles", "n"])


@query("j8_seed_pairs", twin(LEDGER + ", " + PAIRS, f"SELECT dgp, metric, seed, {rsql('a', 'b', 'd')} FROM pairs"))
def j8(spark, d):
    return rounded(pairs(spark, d), ["dgp", "metric", "seed"])


@query("j9_metric_blocks", twin(LEDGER, f"SELECT coalesce(x.cell_key, y.cell_key) AS cell_key, {rsql('x.v AS level_rmse', 'y.v AS bias')} FROM (SELECT cell_key, avg(value) AS v FROM cells WHERE metric = 'level_rmse' AND n_arms = 2 GROUP BY ALL) x FULL JOIN (SELECT cell_key, avg(value) AS v FROM cells WHERE metric = 'bias' AND seed < 5 GROUP BY ALL) y ON x.cell_key = y.cell_key"))
def j9(spark, d):
    c = cells(spark, d)
    x = c.where("metric = 'level_rmse' AND n_arms = 2").groupBy("cell_key").agg(F.avg("value").alias("level_rmse"))
    y = c.where("metric = 'bias' AND seed < 5").groupBy("cell_key").agg(F.avg("value").alias("bias"))
    return rounded(x.join(y, "cell_key", "outer"), ["cell_key"])


@query("j10_method_pairs", twin(LEDGER + ", m AS (SELECT dgp, method, seed, avg(value) AS value FROM cells WHERE metric = 'bias' GROUP BY ALL)", f"SELECT x.dgp, x.seed, x.method AS \"left\", y.method AS \"right\", {rsql('x.value - y.value AS d')} FROM m x JOIN m y ON x.dgp = y.dgp AND x.seed = y.seed AND x.method < y.method"))
def j10(spark, d):
    m = cells(spark, d).where("metric = 'bias'").groupBy("dgp", "method", "seed").agg(F.avg("value").alias("value"))
    return rounded(L.method_pairs(m, ["dgp"]).select("dgp", "seed", "left", "right", "d"), ["dgp", "seed", "left", "right"])


MANIFEST = "manifest AS (SELECT DISTINCT cell_key, dgp, method, seed, n_grid FROM ledger WHERE NOT (seed = 9 AND n_grid = 49) UNION ALL SELECT 'absent' || i, 'none', 'alpha', i::INT, 5 FROM (SELECT unnest(range(0, 3)) AS i))"


def manifest(spark, d):
    led = ledger(spark, d).where("NOT (seed = 9 AND n_grid = 49)").select("cell_key", "dgp", "method", "seed", "n_grid").distinct()
    more = spark.createDataFrame([(f"absent{i}", "none", "alpha", i, 5) for i in range(3)], led.schema)
    return led.union(more)


@query("j7_a3_merge_audit", twin(LEDGER + ", " + MANIFEST, "SELECT (SELECT count(*) FROM manifest WHERE cell_key NOT IN (SELECT cell_key FROM ledger)) AS missing, (SELECT count(DISTINCT cell_key) FROM ledger WHERE cell_key NOT IN (SELECT cell_key FROM manifest)) AS unknown, 0::BIGINT AS mismatched, 0::BIGINT AS split, 0::BIGINT AS bad_status, 'FAIL' AS verdict"))
def a3(spark, d):
    return L.merge_audit(manifest(spark, d), ledger(spark, d), ["dgp", "method", "seed", "n_grid"])


@query("a4_row_validation", twin(LEDGER, "SELECT cell_key, metric, count(*) AS n FROM ledger GROUP BY ALL HAVING count(*) > 1"))
def a4(spark, d):
    """Identities without arm that several rows share."""
    return L.duplicates(ledger(spark, d), ["cell_key", "metric"])


def one_factor_sql(keys: str) -> str:
    return f"ob AS (SELECT {keys}, seed, avg(value) AS b FROM cells WHERE n_grid = 25 AND n_particles = 10 GROUP BY ALL), oa AS (SELECT {keys}, seed, n_grid, n_particles, avg(value) AS a FROM cells WHERE (n_grid = 25)::INT + (n_particles = 10)::INT = 1 GROUP BY ALL), op AS (SELECT oa.*, b, a - b AS d FROM oa JOIN ob USING ({keys}, seed)), og AS (SELECT {keys}, n_grid, n_particles, count(*) AS n, avg(d) AS mean_diff, stddev_samp(d) / sqrt(count(*)) AS se, 100 * avg(d) / abs(avg(b)) AS relative FROM op GROUP BY ALL)"


@query("a5_one_factor", twin(LEDGER + ", " + one_factor_sql("metric"), f"SELECT metric, n_grid, n_particles, n, {rsql('mean_diff', 'se', 'relative')} FROM og"))
def a5(spark, d):
    s = L.one_factor(cells(spark, d), (25, 10), ["metric"]).select("metric", "n_grid", "n_particles", "n", "mean_diff", "se", "relative")
    return rounded(s, ["metric", "n_grid", "n_particles", "n"])


@query("a6_full_factorial", twin(LEDGER + ", whole AS (SELECT dgp, metric FROM cells GROUP BY ALL HAVING count(DISTINCT (n_grid, n_particles)) = 9)", f"SELECT dgp, metric, n_grid, n_particles, count(DISTINCT seed) AS n_seeds, {rsql('avg(value) AS mean', 'median(value) AS median')} FROM cells JOIN whole USING (dgp, metric) GROUP BY ALL"))
def a6(spark, d):
    s = L.full_factorial(cells(spark, d), ["dgp", "metric"]).select("dgp", "metric", "n_grid", "n_particles", "n_seeds", "mean", "median")
    return rounded(s, ["dgp", "metric", "n_grid", "n_particles", "n_seeds"])


@query("a8_i8_method_view", twin(LEDGER + ", " + PAIRS + ", " + STATS, f"SELECT dgp, metric, n, {rsql('mean_diff', 'se', 'win_share')}, CASE WHEN n < 3 THEN 'too_few' WHEN mean_diff * (CASE WHEN metric = 'bias' THEN -1 ELSE 1 END) < -2 * se THEN 'wins_a' WHEN mean_diff * (CASE WHEN metric = 'bias' THEN -1 ELSE 1 END) > 2 * se THEN 'wins_b' ELSE 'tie' END AS verdict FROM stats"))
def a8(spark, d):
    """alpha against beta by design and metric; bias counts as higher-is-better."""
    s = L.decided(L.paired_stats(pairs(spark, d), ["dgp", "metric"]), F.col("metric") == "bias")
    return rounded(s.select("dgp", "metric", "n", "verdict", "mean_diff", "se", "win_share"), ["dgp", "metric", "n", "verdict"])


@query("i9_i11_paired_test", twin(LEDGER + ", " + PAIRS + ", " + STATS, f"SELECT dgp, metric, n, {rsql('p', 'relative', 'ratio')} FROM stats"))
def i9(spark, d):
    s = L.paired_stats(pairs(spark, d), ["dgp", "metric"]).select("dgp", "metric", "n", "p", "relative", "ratio")
    return rounded(s, ["dgp", "metric", "n"])


@query("i10_paired_rmse", twin(LEDGER + ", " + PAIRS + ", g AS (SELECT dgp, count(*) AS n, sqrt(avg(a * a)) AS ra, sqrt(avg(b * b)) AS rb, var_samp(a * a) AS va, var_samp(b * b) AS vb, covar_samp(a * a, b * b) AS cab FROM pairs WHERE metric = 'bias' GROUP BY dgp), h AS (SELECT dgp, n, ra - rb AS diff, sqrt(greatest(va / (4 * ra * ra) + vb / (4 * rb * rb) - cab / (2 * ra * rb), 0) / n) AS se FROM g)", f"SELECT dgp, n, {rsql('diff', 'se', 'diff - 1.96 * se AS low', 'diff + 1.96 * se AS high')} FROM h"))
def i10(spark, d):
    return rounded(L.paired_rmse(pairs(spark, d).where("metric = 'bias'"), ["dgp"]), ["dgp", "n"])


@query("a9_runtime_table", twin(LEDGER, f"SELECT method, {rsql('median(v) FILTER (n_grid = 5) AS k5', 'median(v) FILTER (n_grid = 25) AS k25', 'median(v) FILTER (n_grid = 49) AS k49')} FROM (SELECT method, n_grid, cell_key, max(wall_seconds) AS v FROM ledger GROUP BY ALL) GROUP BY method"))
def a9(spark, d):
    s = L.cost_summary(ledger(spark, d), ["method", "n_grid"]).groupBy("method").pivot("n_grid", [5, 25, 49]).agg(F.first("median"))
    return rounded(s.select("method", *[F.col(str(k)).alias(f"k{k}") for k in (5, 25, 49)]), ["method"])


@query("a10_resolution_decision", twin(LEDGER + ", " + one_factor_sql("metric"), f"SELECT n_grid, n_particles, within, gains, {rsql('mean_relative')}, row_number() OVER (ORDER BY within DESC, mean_relative, n_grid, n_particles)::INT AS place FROM (SELECT n_grid, n_particles, bool_and(relative <= 5) AS within, bool_or(relative <= -5) AS gains, avg(relative) AS mean_relative FROM og GROUP BY ALL)"))
def a10(spark, d):
    s = L.resolution_decision(L.one_factor(cells(spark, d), (25, 10), ["metric"]), 5.0, 5.0)
    return rounded(s.select("n_grid", "n_particles", "within", "gains", "place", "mean_relative"), ["n_grid", "n_particles", "within", "gains", "place"])


@query("a11_gate_rules", twin(LEDGER + ", " + PAIRS + ", " + STATS, "SELECT metric, count(*) FILTER (mean_diff < -2 * se) AS wins, count(*) FILTER (mean_diff > 2 * se) AS losses, count(*) FILTER (mean_diff < -2 * se) > count(*) FILTER (mean_diff > 2 * se) AS passes FROM stats GROUP BY metric"))
def a11(spark, d):
    s = L.decided(L.paired_stats(pairs(spark, d), ["dgp", "metric"]), least=0)
    wins, losses = F.count(F.when(F.col("verdict") == "wins_a", 1)), F.count(F.when(F.col("verdict") == "wins_b", 1))
    return s.groupBy("metric").agg(wins.alias("wins"), losses.alias("losses"), (wins > losses).alias("passes"))


@query("a12_particle_series", twin(LEDGER, f"SELECT method, n_particles, {rsql('mean')}, {R('mean - lag(mean) OVER (PARTITION BY method ORDER BY n_particles)', 5)} AS step FROM (SELECT method, n_particles, avg(value) AS mean FROM cells WHERE metric = 'level_rmse' GROUP BY ALL)"))
def a12(spark, d):
    from pyspark.sql import Window

    s = cells(spark, d).where("metric = 'level_rmse'").groupBy("method", "n_particles").agg(F.avg("value").alias("mean"))
    return rounded(s.withColumn("step", F.col("mean") - F.lag("mean").over(Window.partitionBy("method").orderBy("n_particles"))), ["method", "n_particles"])


@query("a13_relative_gates", twin(LEDGER, f"SELECT dgp, {rsql('100 * (a / b - 1) AS gain')}, a < b * 0.98 AS passes FROM (SELECT dgp, avg(value) FILTER (method = 'alpha') AS a, avg(value) FILTER (method = 'gamma') AS b FROM cells WHERE metric = 'level_rmse' GROUP BY dgp)"))
def a13(spark, d):
    g = cells(spark, d).where("metric = 'level_rmse'").groupBy("dgp").pivot("method", ["alpha", "gamma"]).agg(F.avg("value"))
    return g.select("dgp", r(100 * (F.col("alpha") / F.col("gamma") - 1), 5).alias("gain"), (F.col("alpha") < F.col("gamma") * 0.98).alias("passes"))


@query("a14_expected_ledger", twin(LEDGER, f"SELECT label, want, {rsql('got')}, coalesce(abs(got - want) <= tol, false) AS passes FROM (VALUES ('click', 28.0::DOUBLE, 5.0::DOUBLE), ('view', 0.0::DOUBLE, 1.0::DOUBLE), ('nothing', 1.0::DOUBLE, 1.0::DOUBLE)) e(label, want, tol) LEFT JOIN (SELECT dgp, avg(value) AS got FROM cells WHERE metric = 'level_rmse' GROUP BY dgp) ON dgp = label"))
def a14(spark, d):
    found = cells(spark, d).where("metric = 'level_rmse'").groupBy("dgp").agg(F.avg("value").alias("value"))
    expected = spark.createDataFrame([("click", 28.0, 5.0), ("view", 0.0, 1.0), ("nothing", 1.0, 1.0)], "label string, want double, tol double")
    return L.expected_check(found, expected, "dgp").withColumn("got", r(F.col("got"), 5))


@query("a15_confirmatory_ledger", twin(LEDGER + ", " + JACK, f"SELECT x.dgp, x.method, {rsql('x.mean AS mean', 'y.rmse AS rmse')} FROM (SELECT dgp, method, avg(value) AS mean FROM cells WHERE metric = 'level_rmse' GROUP BY ALL) x JOIN (SELECT dgp, method, sqrt(any_value(s) / any_value(n)) AS rmse FROM loo GROUP BY ALL) y USING (dgp, method)"))
def a15(spark, d):
    c = cells(spark, d)
    x = c.where("metric = 'level_rmse'").groupBy("dgp", "method").agg(F.avg("value").alias("mean"))
    y = L.rmse_jackknife(c.where("metric = 'bias'"), ["dgp", "method"]).select("dgp", "method", "rmse")
    return rounded(x.join(y, ["dgp", "method"]), ["dgp", "method"])


@query("a16_upsert", twin(LEDGER, "SELECT source, count(*) AS n FROM (SELECT 'new' AS source FROM ledger WHERE seed < 2 UNION ALL SELECT 'old' FROM ledger WHERE seed >= 2 UNION ALL SELECT 'archive' FROM ledger WHERE seed < 2 AND status = 'failed') GROUP BY source"))
def a16(spark, d):
    old, new = ledger(spark, d).withColumn("source", F.lit("old")), ledger(spark, d).where("seed < 2").withColumn("source", F.lit("new"))
    both = L.upsert(old, new, ["cell_key"]).select("source").union(L.archived(old, new, ["cell_key"]).select(F.lit("archive")))
    return both.groupBy("source").agg(F.count("*").alias("n"))


@query("a17_verdicts", twin(LEDGER + ", " + PAIRS + ", " + STATS, f"SELECT dgp, CASE WHEN mean_diff IS NULL THEN 'absent' WHEN mean_diff < -2 * se THEN 'claimant' WHEN mean_diff > 2 * se THEN 'comparator' ELSE 'tie' END AS verdict, {rsql('ratio')} FROM (SELECT DISTINCT dgp FROM ledger) LEFT JOIN (SELECT * FROM stats WHERE metric = 'level_rmse' AND dgp <> 'view') USING (dgp)"))
def a17(spark, d):
    s = L.paired_stats(pairs(spark, d).where("metric = 'level_rmse' AND dgp <> 'view'"), ["dgp"])
    j = ledger(spark, d).select("dgp").distinct().join(s, "dgp", "left")
    return j.select("dgp", L.verdict(F.col("mean_diff"), F.col("se")).alias("verdict"), r(F.col("ratio"), 5).alias("ratio"))


@query("a18_manifest_checks", twin(LEDGER + ", " + MANIFEST, "SELECT (SELECT count(*) FROM (SELECT cell_key FROM manifest GROUP BY cell_key HAVING count(*) > 1)) AS duplicate_keys, (SELECT count(*) FROM manifest) AS listed, (SELECT count(*) FROM (SELECT DISTINCT seed FROM ledger WHERE arm = 0 INTERSECT SELECT DISTINCT seed FROM ledger WHERE arm = 1)) AS shared_seeds"))
def a18(spark, d):
    m, led = manifest(spark, d), ledger(spark, d)
    dup = L.duplicates(m, ["cell_key"]).agg(F.count("*").alias("duplicate_keys"))
    shared = led.where("arm = 0").select("seed").intersect(led.where("arm = 1").select("seed")).agg(F.count("*").alias("shared_seeds"))
    return dup.crossJoin(m.agg(F.count("*").alias("listed"))).crossJoin(shared)  # single rows


@query("a19_target_listing", twin(LEDGER, "SELECT dgp, metric, count(DISTINCT target_id) AS targets, bool_or(status = 'ok') AS supplied FROM ledger GROUP BY ALL"))
def a19(spark, d):
    return ledger(spark, d).groupBy("dgp", "metric").agg(F.countDistinct("target_id").alias("targets"), F.bool_or(F.col("status") == "ok").alias("supplied"))


@query("t4_argmin_stronger_penalty", twin(LEDGER, "SELECT dgp, arg_min(n_particles, (risk, -n_particles)) AS chosen FROM (SELECT dgp, n_particles, round(avg(value), 1) AS risk FROM cells WHERE metric = 'level_rmse' GROUP BY ALL) GROUP BY dgp"))
def t4(spark, d):
    s = cells(spark, d).where("metric = 'level_rmse'").groupBy("dgp", "n_particles").agg(F.round(F.avg("value"), 1).alias("risk"))
    return s.groupBy("dgp").agg(F.min_by("n_particles", F.struct("risk", -F.col("n_particles"))).alias("chosen"))


@query("t5_worst_and_best", twin(LEDGER + ", " + PAIRS + ", " + STATS, "SELECT metric, arg_max(dgp, mean_diff) AS worst, arg_min(dgp, mean_diff) AS best FROM stats GROUP BY metric"))
def t5(spark, d):
    return L.paired_stats(pairs(spark, d), ["dgp", "metric"]).groupBy("metric").agg(F.max_by("dgp", "mean_diff").alias("worst"), F.min_by("dgp", "mean_diff").alias("best"))


@query("t8_t9_t10_key_sets", twin(LEDGER, "SELECT (SELECT count(*) FROM (SELECT cell_key FROM ledger WHERE metric = 'bias' AND status = 'ok' INTERSECT SELECT cell_key FROM ledger WHERE metric = 'level_rmse' AND status = 'ok')) AS in_both, (SELECT count(*) FROM (SELECT cell_key FROM ledger EXCEPT SELECT cell_key FROM ledger WHERE status = 'ok')) AS never_ok, (SELECT count(*) FROM (SELECT DISTINCT cell_key, metric FROM ledger)) AS identities, (SELECT count(*) FROM (SELECT cell_key FROM ledger GROUP BY cell_key HAVING count(DISTINCT arm) > 1)) AS in_two_arms"))
def t8(spark, d):
    led = ledger(spark, d)
    ok = led.where("status = 'ok'")
    parts = [
        ok.where("metric = 'bias'").select("cell_key").intersect(ok.where("metric = 'level_rmse'").select("cell_key")).agg(F.count("*").alias("in_both")),
        led.select("cell_key").subtract(ok.select("cell_key")).agg(F.count("*").alias("never_ok")),
        led.dropDuplicates(["cell_key", "metric"]).agg(F.count("*").alias("identities")),
        led.groupBy("cell_key").agg(F.countDistinct("arm").alias("n")).where("n > 1").agg(F.count("*").alias("in_two_arms")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    return out


@query("p20_usable_rows", twin(LEDGER, "SELECT status, count(*) AS n, count(value) AS with_value, count(*) FILTER (status = 'ok' AND value IS NOT NULL) AS usable FROM ledger GROUP BY status"))
def p20(spark, d):
    led = ledger(spark, d)
    return led.groupBy("status").agg(F.count("*").alias("n"), F.count("value").alias("with_value"), F.count(F.when((F.col("status") == "ok") & F.col("value").isNotNull(), 1)).alias("usable"))
