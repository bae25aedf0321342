"""The curve functionals as SQL functions of a session, for queries written in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Signature and body of each function; curves are ARRAY<DOUBLE> with equal grid weights.
FUNCTIONS = {
    "curve_mean": "(q ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(q, 0D, (s, x) -> s + x) / size(q)",
    "curve_sd": "(q ARRAY<DOUBLE>) RETURNS DOUBLE RETURN transform(array(curve_mean(q)), m -> sqrt(aggregate(q, 0D, (s, x) -> s + (x - m) * (x - m)) / size(q)))[0]",
    "curve_skew": "(q ARRAY<DOUBLE>) RETURNS DOUBLE RETURN transform(array(struct(curve_mean(q) AS m, curve_sd(q) AS d)), t -> IF(t.d > 1e-12D, aggregate(q, 0D, (s, x) -> s + (x - t.m) * (x - t.m) * (x - t.m)) / size(q) / (t.d * t.d * t.d), 0D))[0]",
    "curve_tail": "(q ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(slice(q, size(q) div 2 + 1, size(q)), 0D, (s, x) -> s + x) / (size(q) - size(q) div 2)",
    "curve_distance": "(q ARRAY<DOUBLE>, r ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(q, r, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x) / size(q))",
}


def register(spark: SparkSession, more: dict[str, str] | None = None) -> list[str]:
    """Create the functions, and user-given ones of the same form, for this session; their names."""
    for name, body in {**FUNCTIONS, **(more or {})}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body}")
    return [*FUNCTIONS, *(more or {})]
