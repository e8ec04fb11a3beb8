"""How a query is registered: a function of the tables, and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The parquet tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Registry:
    def __init__(self):
        self.items: list[tuple[str, Callable[[Tables], DataFrame], str | None]] = []

    def __call__(self, sql: str | None = None):
        def add(fn: Callable[[Tables], DataFrame]):
            self.items.append((fn.__name__, fn, sql))
            return fn

        return add
