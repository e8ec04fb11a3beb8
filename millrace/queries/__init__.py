"""The queries of the library by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.queries import cells, columns, dates, groups, more, numbers, order, relations, tables, text, values
from millrace.queries.registry import Tables

MODULES = (relations, columns, groups, order, text, dates, numbers, values, more, cells, tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> function of (spark, sf_dir)."""
    return {name: (lambda spark, sf_dir, fn=fn: fn(Tables(spark, sf_dir))) for m in MODULES for name, fn, _ in m.QUERIES.items}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, _, sql in m.QUERIES.items if sql}
