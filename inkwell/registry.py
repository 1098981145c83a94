"""Registry of queries: a name, a Spark function over tables, and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name: ``t.orders``, ``t.events``, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder
        small_batches(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose rows are much work, dealt out."""
        return dealt(getattr(self, name))


def dealt(df: DataFrame) -> DataFrame:
    """Where a table's files have fewer splits than the session has cores, its
    rows are dealt out first; else nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def query(sql: str | None = None):
    """Registers a function of ``Tables`` under its name; ``sql`` is the same
    query for DuckDB, None where SQL can't express it."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
