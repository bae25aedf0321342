"""Law queries without a SQL twin over all line items."""

from curvefx import catalog

DATA = "/root/testdata/sf0.001"


def test_sampled_law_has_every_part_size_and_arm(spark):
    li, part = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("lineitem", "part"))
    keys = li.join(part, li["l_partkey"] == part["p_partkey"]).selectExpr("p_size", "cast(l_suppkey % 2 as int)").distinct()
    got = catalog.QUERIES["l21_sampled_law"](spark, DATA).collect()
    assert {(r["unit_id"], r["arm"]) for r in got} == {tuple(r) for r in keys.collect()} and len(got) > 24
