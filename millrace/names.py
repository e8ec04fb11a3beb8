"""Column names that a table does not use yet; Spark compares names without case."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def free(taken: DataFrame | Iterable[str], name: str) -> str:
    """`name`, or `name` with as many underscores as it takes to be unlike all columns."""
    used = {c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)}
    while name.lower() in used:
        name += "_"
    return name


def free_prefix(taken: DataFrame | Iterable[str], prefix: str) -> str:
    """A prefix with which no column begins."""
    used = [c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)]
    while any(c.startswith(prefix.lower()) for c in used):
        prefix += "_"
    return prefix
