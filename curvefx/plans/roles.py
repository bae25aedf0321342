"""The driver's tables in the roles of the data model, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quantiles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micro(spark: SparkSession, d: str) -> DataFrame:
    """unit_id, y, w: line items by part."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("unit_id"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("w"), F.col("l_suppkey").alias("supp"), F.year("l_shipdate").alias("year"))


MICRO = "micro AS (SELECT l_partkey AS unit_id, l_extendedprice AS y, l_quantity AS w, l_suppkey AS supp, year(l_shipdate)::INT AS year FROM lineitem)"


def curves_long(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.unit_curves_long(micro(spark, d), "unit_id", "y", "w")


def curves(spark: SparkSession, d: str) -> DataFrame:
    """unit_id, q: one 25-level curve per part."""
    return quantiles.unit_curves(micro(spark, d), "unit_id", "y", "w")


def knots_sql(name: str, source: str, unit: str, y: str = "y", w: str = "w", levels: str = "(k::DOUBLE-0.5::DOUBLE)/25::DOUBLE", n: int = 25) -> str:
    """CTEs that end in name(unit, k, q): weighted quantiles of y by unit at n levels; the levels' expression is over k."""
    return f"""{name}_r AS (SELECT {unit}, {y} AS y, {w} AS w, row_number() OVER (PARTITION BY {unit} ORDER BY {y}, {w}) AS i, sum({w}) OVER (PARTITION BY {unit} ORDER BY {y}, {w} ROWS UNBOUNDED PRECEDING) / sum({w}) OVER (PARTITION BY {unit}) AS c FROM {source} WHERE {y} IS NOT NULL AND isfinite({y}) AND {w} > 0),
{name}_s AS (SELECT *, lag(c) OVER (PARTITION BY {unit} ORDER BY i) AS c0, lag(y) OVER (PARTITION BY {unit} ORDER BY i) AS y0 FROM {name}_r),
{name}_g AS (SELECT k, {levels} AS u FROM (SELECT unnest(range(1, {n + 1})) AS k)),
{name} AS (SELECT {unit}, k::INT AS k, CASE WHEN c0 IS NULL THEN y ELSE y0 + (u - c0) / (c - c0) * (y - y0) END AS q FROM {name}_s JOIN {name}_g ON u <= c AND (c0 IS NULL OR u > c0))"""


CURVES = MICRO + ",\n" + knots_sql("curve", "micro", "unit_id")


def units(spark: SparkSession, d: str) -> DataFrame:
    """unit_id, a, moderator_raw, size, brand, type: parts; the arm is set before outcomes are seen."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("unit_id"), (F.col("p_size") > 25).cast("int").alias("a"), F.col("p_retailprice").alias("moderator_raw"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))


UNITS = "units AS (SELECT p_partkey AS unit_id, (p_size > 25)::INT AS a, p_retailprice AS moderator_raw, p_size AS size, p_brand AS brand, p_type AS type FROM part)"

#: The benchmark curve: the average curve of the control arm.
STAR = "star AS (SELECT k, avg(q) AS s FROM curve JOIN units USING (unit_id) WHERE a = 0 GROUP BY k)"
#: moderator = 2 (rank + 0.5) / n - 1 with rank from 0, and its bin by the edges -0.5, 0, 0.5.
BINNED = "ranked AS (SELECT *, 2::DOUBLE * (row_number() OVER (ORDER BY moderator_raw, unit_id) - 1 + 0.5::DOUBLE) / count(*) OVER () - 1 AS m FROM units), binned AS (SELECT *, (m >= -0.5)::INT + (m >= 0)::INT + (m >= 0.5)::INT AS bin FROM ranked)"
#: Functionals of each unit's curve in long form.
FUNCS = """mom AS (SELECT unit_id, avg(q) AS mean FROM curve GROUP BY unit_id),
func AS (SELECT c.unit_id, any_value(mean) AS mean, sqrt(avg((q - mean) * (q - mean))) AS sd, CASE WHEN sqrt(avg((q - mean) * (q - mean))) > 1e-12 THEN avg((q - mean) * (q - mean) * (q - mean)) / pow(sqrt(avg((q - mean) * (q - mean))), 3) ELSE 0 END AS skew, avg(q) FILTER (k > 12) AS tail, sqrt(avg((q - s) * (q - s))) AS reference FROM curve c JOIN mom USING (unit_id) JOIN star USING (k) GROUP BY c.unit_id)"""
FULL = ",\n".join([CURVES, UNITS, STAR, BINNED, FUNCS])


def twin(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def R(c: str, n: int = 4) -> str:
    """Rounding as SQL; the small shift keeps exact halves from falling either way."""
    return f"round(({c}) + 1.234e-{n + 2}, {n})"


def r(c, n: int = 4):
    return F.round(c + 1.234 * 10.0 ** -(n + 2), n)
