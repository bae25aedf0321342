"""Readers, writers and guards of micro data, ledgers, unit datasets and run documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import numeric


def read_delimited(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """Delimited text with a header and a given schema; only the chosen columns are parsed."""
    df = spark.read.csv(path, sep=sep, header=True, schema=schema)
    return df.select(*columns) if columns else df


def read_micro(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """The wanted columns that a Parquet table has."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in wanted if c in df.columns])


def wide_to_long(wide: DataFrame, fields: list[str], **equal: str) -> DataFrame:
    """fields, year, value, flag from a wide statistical table.

    The first column holds the fields joined by commas, the others are years; ":" means missing and letters
    after a number are its flag. equal keeps rows whose fields have the given values.
    """
    first, years = wide.columns[0], [c for c in wide.columns[1:]]
    parts = F.split(F.col(f"`{first}`"), ",")
    head = wide.select(*[F.trim(parts[i]).alias(f) for i, f in enumerate(fields)], *[F.col(f"`{c}`").cast("string").alias(c.strip()) for c in years])
    for k, v in equal.items():
        head = head.where(F.col(k) == v)
    long = head.unpivot(fields, [c.strip() for c in years], "year", "raw")
    value = F.regexp_extract("raw", r"^\s*([-+0-9.]+)", 1)
    return long.select(*fields, F.col("year").cast("int").alias("year"), numeric(F.nullif(value, F.lit(""))).alias("value"), F.nullif(F.regexp_extract("raw", r"([A-Za-z]+)\s*$", 1), F.lit("")).alias("flag"))


def read_wide_stat(spark: SparkSession, path: str, fields: list[str], **equal: str) -> DataFrame:
    return wide_to_long(spark.read.csv(path, sep="\t", header=True), fields, **equal)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A metric ledger from JSON lines or Parquet by suffix; value and wall_seconds as numbers."""
    df = spark.read.json(path) if re.search(r"\.jsonl?(\.gz)?/?$", path) else spark.read.parquet(path)
    return df.select(*[numeric(F.col(c)).alias(c) if c in ("value", "wall_seconds") else F.col(c) for c in df.columns])


def read_shards(spark: SparkSession, glob: str) -> DataFrame:
    """All shards of a ledger with merged columns and the file of each row."""
    return spark.read.option("mergeSchema", True).parquet(glob).withColumn("shard_file", F.input_file_name())


def write_ledger(frames: list[DataFrame], path: str, mode: str = "errorifexists") -> None:
    """The union of the frames' columns, sorted by name, missing ones as nulls."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.select(*sorted(out.columns)).write.mode(mode).parquet(path)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free sum of row hashes."""
    r = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.coalesce(F.sum("h"), F.lit(0))).first()
    return int(r[0]), int(r[1])


def unit_manifest(units: DataFrame, study: str) -> DataFrame:
    """One row: counts, arm counts, bin counts and a content hash of a unit table with a, q and bin."""
    n, h = fingerprint(units)
    bins = units.groupBy("bin").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("bin").cast("string"), "count")))).alias("bins"))
    arms = units.agg(F.count_if(F.col("a") == 1).alias("n_treated"), F.count_if(F.col("a") == 0).alias("n_control"), F.max(F.size("q")).alias("k"))
    return arms.crossJoin(bins).select(F.lit(study).alias("study"), F.lit(n).alias("n"), "k", "n_treated", "n_control", "bins", F.lit(str(h)).alias("content"))  # single rows


def save_units(units: DataFrame, folder: str, study: str) -> None:
    units.write.mode("overwrite").parquet(f"{folder}/units")
    unit_manifest(units, study).write.mode("overwrite").parquet(f"{folder}/manifest")


def load_units(spark: SparkSession, folder: str) -> DataFrame:
    """The saved units, if their number and content still match the manifest."""
    units = spark.read.parquet(f"{folder}/units")
    want = spark.read.parquet(f"{folder}/manifest").first()
    n, h = fingerprint(units)
    if (n, str(h)) != (want["n"], want["content"]):
        raise ValueError(f"{folder}: units differ from their manifest")
    return units


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Small named tables as CSV with a header."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def write_once(df: DataFrame, path: str) -> bool:
    """Write a table; an existing one must be identical. True if it was written."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("errorifexists").parquet(path)
        return True
    if fingerprint(spark.read.parquet(path)) != fingerprint(df):
        raise ValueError(f"{path} holds other rows")
    return False


RUN = "study string, n int, n_treated int, n_control int, K int, random_state int, marginal_dr map<string,double>, if_se map<string,double>, bin_contrasts_dr map<string,array<double>>"


def read_runs(spark: SparkSession, glob: str) -> DataFrame:
    """Nested run documents, one JSON object a file."""
    return spark.read.schema(RUN).option("multiLine", True).json(glob)


def marginals(runs: DataFrame) -> DataFrame:
    """study, random_state, name, effect, if_se."""
    long = runs.select("study", "random_state", "if_se", F.explode("marginal_dr").alias("name", "effect"))
    return long.select("study", "random_state", "name", "effect", F.col("if_se")[F.col("name")].alias("if_se"))


def bin_contrasts(runs: DataFrame) -> DataFrame:
    """study, random_state, name, bin, effect."""
    long = runs.select("study", "random_state", F.explode("bin_contrasts_dr").alias("name", "v"))
    return long.select("study", "random_state", "name", F.posexplode("v").alias("bin", "effect"))
