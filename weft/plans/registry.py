"""Named queries over the given tables, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df


TEXT_TABLES = ("documents", "conversations", "pages")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores is dealt out; a scan of many files is left alone.

    Text work costs far more than moving the text once, and one row group is one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def digest(c: str | Column, sep: str = " ") -> Column:
    """md5 of an array written as text: a whole array compared in one value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.md5(F.array_join(c.cast("array<string>"), sep))
