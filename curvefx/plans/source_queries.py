"""Queries through the readers and writers: tables derived from the driver's go out to the shared folder and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import curves as C
from ..operators import ordered
from ..sources import io
from .curve_queries import designed
from .effect_queries import each_functional, scored
from .ledger_queries import LEDGER, ledger
from .roles import FULL, R, r, table, twin

QUERIES, ORACLES = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def place(spark) -> str:
    return f"{ordered.shared_folder(spark)}/curvefx/{uuid.uuid4().hex}"


@query("s1_delimited_scan", f"SELECT o_orderstatus, count(*) AS n, {R('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY ALL")
def s1(spark, d):
    path = place(spark)
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.csv(path, sep="\t", header=True)
    o = io.read_delimited(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double", ["o_orderstatus", "o_totalprice"], "\t")
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("s2_wide_statistics", "SELECT nation, unit, year, value::DOUBLE AS value, CASE WHEN value % 2 = 0 THEN 'b' END AS flag FROM (SELECT c_nationkey::VARCHAR AS nation, 'count' AS unit, year(o_orderdate)::INT AS year, count(*) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) WHERE year BETWEEN 1995 AND 1998")
def s2(spark, d):
    """Counts by nation and year, written wide with flags and read back long; missing cells are left out."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), c("c_custkey") == c("o_custkey"))
    n = o.groupBy(F.concat_ws(",", c("c_nationkey").cast("string"), F.lit("count")).alias("nation,unit"), F.year("o_orderdate").alias("year")).count()
    cell = n.withColumn("cell", F.concat(c("count").cast("string"), F.when(c("count") % 2 == 0, " b").otherwise("")))
    wide = cell.groupBy("nation,unit").pivot("year", [1995, 1996, 1997, 1998]).agg(F.first("cell")).fillna(":", ["1995", "1996", "1997", "1998"])
    path = place(spark)
    wide.write.csv(path, sep="\t", header=True)
    return io.read_wide_stat(spark, path, ["nation", "unit"], unit="count").where("value IS NOT NULL")


@query("s3_column_projection", "SELECT p_type, max(p_size) AS largest FROM part GROUP BY p_type")
def s3(spark, d):
    return io.read_micro(spark, f"{d}/part.parquet", ["p_type", "p_size", "no_such_column"]).groupBy("p_type").agg(F.max("p_size").alias("largest"))


@query("s4_s5_s6_ledger_shards", twin(LEDGER, f"SELECT metric, status, count(*) AS n, {R('sum(value)', 3)} AS total FROM ledger GROUP BY ALL"))
def s4(spark, d):
    """A ledger written as two shards with different columns and read as one; JSON lines give the same rows."""
    led, base = ledger(spark, d), place(spark)
    io.write_ledger([led.where("seed < 5").drop("failure_reason")], f"{base}/shard1")
    io.write_ledger([led.where("seed >= 5"), led.where("false").drop("target_id")], f"{base}/shard2")
    both = io.read_shards(spark, f"{base}/shard*")
    both.select("metric", "status", "value").write.json(f"{base}/rows.jsonl")
    return io.read_ledger(spark, f"{base}/rows.jsonl").groupBy("metric", "status").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))


@query("s7_unit_dataset", twin(FULL, "SELECT 'parts' AS study, count(*)::INT AS n, 25 AS k, count(*) FILTER (a = 1) AS n_treated, count(*) FILTER (a = 0) AS n_control, count(DISTINCT bin)::INT AS bins FROM func JOIN binned USING (unit_id)"))
def s7(spark, d):
    """Units saved with a manifest, loaded and held against it: the manifest's counts."""
    path = place(spark)
    io.save_units(designed(spark, d).select("unit_id", "a", "q", "bin"), path, "parts")
    units = io.load_units(spark, path)
    return io.unit_manifest(units, "parts").select("study", "n", "k", "n_treated", "n_control", F.size("bins").alias("bins"))


@query("s9_write_once", "SELECT count(*) AS n, true AS written, false AS again FROM nation")
def s9(spark, d):
    path, n = place(spark), table(spark, d, "nation")
    first, again = io.write_once(n, path), io.write_once(n, path)
    return spark.read.parquet(path).agg(F.count("*").alias("n")).select("n", F.lit(first).alias("written"), F.lit(again).alias("again"))


@query("s10_run_documents", each_functional(f"SELECT '$name' AS name, -1 AS bin, {R('avg(psi)')} AS effect FROM ps UNION ALL SELECT '$name', bin, {R('avg(psi)')} FROM ps GROUP BY bin"))
def s10(spark, d):
    """Effects of all functionals as a nested run document, read back and flattened to marginal and bin rows."""
    s = ordered.stored(scored(spark, d))
    names = list(C.FUNCTIONALS)
    long = s.select("bin", *[c(f"psi_{v}").alias(v) for v in names]).unpivot(["bin"], names, "name", "psi")
    m = long.groupBy("name").agg(F.avg("psi").alias("e"), (F.stddev_pop("psi") / F.sqrt(F.count("*"))).alias("s"))
    b = long.groupBy("name", "bin").agg(F.avg("psi").alias("e")).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "e"))), lambda x: x["e"]).alias("v"))
    pairs = lambda df, v: df.agg(F.map_from_entries(F.collect_list(F.struct("name", v))).alias("m"))  # noqa: E731  five names
    doc = pairs(m, "e").withColumnRenamed("m", "marginal_dr").crossJoin(pairs(m, "s").withColumnRenamed("m", "if_se")).crossJoin(pairs(b, "v").withColumnRenamed("m", "bin_contrasts_dr"))
    path = place(spark)
    doc.select(F.lit("parts").alias("study"), F.lit(0).alias("random_state"), "marginal_dr", "if_se", "bin_contrasts_dr").coalesce(1).write.json(path)
    runs = io.read_runs(spark, f"{path}/*.json")
    rows = io.marginals(runs).select("name", F.lit(-1).alias("bin"), "effect").unionByName(io.bin_contrasts(runs).select("name", "bin", "effect"))
    return rows.select("name", "bin", r(c("effect")).alias("effect"))


