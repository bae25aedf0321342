"""Helpers shared by the text operators: stored intermediates, row keys, Arrow streams."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module: str) -> None:
    """Send this module's functions to the workers by value, so workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="curvefx-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Folders of stored tables, in the order of writing, until removed() takes them.
STORED: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a short lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/curvefx/{uuid.uuid4().hex}"
    df.write.parquet(path)
    STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more, in whatever file system they are."""
    for path in paths:
        STORED.remove(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The named column cast to kind, or nulls where the table has no such column."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def byte_chars(text: Column) -> Column:
    """Text with A-Z lower-cased and one character for each UTF-8 byte.

    lower() on the Latin-1 reading changes A-Z and moves lead bytes C0-DE by 0x20. A moved lead byte keeps
    its number of continuation bytes, so different texts stay different, and no byte becomes ASCII.
    """
    return F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores that no column of df has."""
    while name in df.columns:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
