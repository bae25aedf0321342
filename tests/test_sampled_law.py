"""Draws from laws whose masses come from a join on the laws' keys; F1."""

from pyspark.sql import functions as F

from curvefx.operators import laws


def test_a_law_is_drawn_from_once_after_an_adaptive_join(spark):
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # the totals alone are broadcast, by adaptive execution; few rows stay in several tasks
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        m = spark.range(0, 40000, 1, 8).select((F.col("id") % 2).cast("int").alias("unit_id"), (F.col("id") % 4).cast("int").alias("arm"), F.col("id").alias("atom_id"), (F.col("id") + 1).alias("m"))
        total = m.groupBy("unit_id", "arm").agg(F.sum("m").alias("t"))
        law = m.join(total, ["unit_id", "arm"]).select("unit_id", "arm", "atom_id", (F.col("m") / F.col("t")).alias("mass"), F.array(F.col("m").cast("double")).alias("q"))
        got = laws.sampled(law, 20).groupBy("unit_id", "arm").agg(F.count("*").alias("n"), F.sum("mass").alias("mass")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert {(r["unit_id"], r["arm"], r["n"], round(r["mass"], 9)) for r in got} == {(a % 2, a, 20, 1.0) for a in range(4)}
