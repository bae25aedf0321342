"""Global ranks and running sums without a one-partition window.

Rows are range-partitioned by the sort keys and stored, so that both passes see the same ranges; a small table of
range totals gives each range its offset, and windows run inside (group, range) only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="curvefx-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/curvefx/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranges(df: DataFrame, group: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """df with _range, the number of its sorted range; stored."""
    keys = [F.col(f"`{g}`") for g in group] + order
    cut = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return stored(cut.withColumn("_range", F.spark_partition_id()))


def global_rank(df: DataFrame, order: list[Column], out: str = "rank", parts: int | None = None) -> DataFrame:
    """df with the row's place from 0 in the order, which should end with a unique key."""
    r = ranges(df, [], order, parts)
    sizes = r.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return r.withColumn("_i", inside).join(F.broadcast(starts), "_range").withColumn(out, (F.col("_i") + F.col("_start")).cast("long")).drop("_range", "_i", "_start")


def running_share(df: DataFrame, group: list[str], y: str, w: str, order: list[Column], parts: int | None = None) -> DataFrame:
    """df with c, the inclusive cumulative weight over the group's total, and the previous row's c0 and y0 (null in a first row).

    Groups may be of any size: one of a third of all rows is spread over as many ranges.
    """
    r = ranges(df, group, order, parts)
    g = [F.col(f"`{x}`") for x in group]
    part = r.groupBy(*g, "_range").agg(F.sum(w).alias("_w"), F.max(y).alias("_last"))
    over = Window.partitionBy(*(g or [F.lit(0)])).orderBy("_range")
    part = part.select(*g, "_range", F.coalesce(F.sum("_w").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_start"), F.lag("_last").over(over).alias("_prev"), F.sum("_w").over(Window.partitionBy(*(g or [F.lit(0)]))).alias("_all"))
    inside = Window.partitionBy(*g, "_range").orderBy(*order)
    rows = r.withColumn("_cum", F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_lag", F.lag(y).over(inside))
    part = part.select(*[x.alias(f"_at{i}") for i, x in enumerate(g)], F.col("_range").alias("_part"), "_start", "_prev", "_all")
    same = F.col("_range") == F.col("_part")
    for i, x in enumerate(g):  # a null is a group, too
        same = same & x.eqNullSafe(F.col(f"_at{i}"))
    rows = rows.join(part, same).drop("_part", *[f"_at{i}" for i in range(len(g))])
    c = (F.col("_start") + F.col("_cum")) / F.col("_all")
    first = F.col("_lag").isNull() & F.col("_prev").isNull()
    c0 = F.when(~first, (F.col("_start") + F.col("_cum") - F.col(w)) / F.col("_all"))
    return rows.withColumn("c", c).withColumn("c0", c0).withColumn("y0", F.coalesce("_lag", "_prev")).drop("_range", "_cum", "_lag", "_start", "_prev", "_all")
