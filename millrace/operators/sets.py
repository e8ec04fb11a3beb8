"""Distinct rows and set operations; whole rows are compared, columns by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _folded(columns: Sequence[str], ignore_case: bool, df: DataFrame) -> list[Column]:
    kinds = dict(df.dtypes)
    return [F.lower(c) if ignore_case and kinds[c] == "string" else F.col(c) for c in columns]


def uniq_by(df: DataFrame, *columns: str, order: Sequence[str], keep_last: bool = False, count: bool = False, repeated: bool = False, unique: bool = False, ignore_case: bool = False) -> DataFrame:
    """One row for each value of the columns: the first (or last) under `order`.

    With `count` its number of rows; `repeated` keeps values that occur more than once, `unique` those
    that occur once. A minimum by key is kept while rows are read, so frequent values need no sort.
    """
    by = _folded(columns, ignore_case, df)
    keys = [c.alias(f"_k{i}") for i, c in enumerate(by)]
    best = (F.max_by if keep_last else F.min_by)(F.struct(*df.columns), F.struct(*order))
    out = df.groupBy(*keys).agg(best.alias("_row"), F.count("*").alias("_n"))
    if repeated:
        out = out.where("_n > 1")
    if unique:
        out = out.where("_n = 1")
    return out.select("_row.*", *([F.col("_n").alias("count")] if count else []))


def uniq(df: DataFrame, order: Sequence[str] = (), **options) -> DataFrame:
    """Distinct rows; see uniq_by for the options."""
    if not order and not options:
        return df.distinct()
    return uniq_by(df, *df.columns, order=order or df.columns, **options)


def union(df: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct rows of both tables."""
    return df.unionByName(other).distinct()


def intersect(df: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct rows that both tables have."""
    return df.intersect(other.select(*df.columns))


def difference(df: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct rows that only the first table has."""
    return df.subtract(other.select(*df.columns))


def concat(*tables: DataFrame, diagonal: bool = False, to_supertypes: bool = False) -> DataFrame:
    """Rows of all tables by column name; `diagonal` fills missing columns with null."""
    out = tables[0]
    for t in tables[1:]:
        if not to_supertypes:
            clash = [c for c, kind in t.dtypes if c in out.columns and dict(out.dtypes)[c] != kind]
            if clash:
                raise TypeError(f"types differ: {', '.join(clash)}")
        out = out.unionByName(t, allowMissingColumns=diagonal)
    return out
