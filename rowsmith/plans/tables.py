"""The input tables of the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """``t.orders`` reads ``orders.parquet``; columns and filters reach the scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Book:
    """Queries with their SQL, by name."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(fn: Callable[[Tables], DataFrame]) -> Callable:
            self.queries[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return register
