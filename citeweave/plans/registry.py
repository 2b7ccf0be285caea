"""Registered queries: each runs operators of the library over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.scans import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of one directory, read on first use by attribute name."""

    def __init__(self, spark: SparkSession, directory: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.directory = spark, directory

    def spread(self, name: str, key: str) -> DataFrame:
        """A table whose rows are expensive to process, dealt over all cores when its file
        has too few splits."""
        return spread(getattr(self, name), key)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a key, with its DuckDB counterpart."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, directory: fn(Tables(spark, directory))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
