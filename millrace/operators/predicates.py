"""Row filters, conditionals, and what is asked of whole columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.names import free, free_prefix
from millrace.order import IDX, indexed


def where(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true."""
    return df.where(condition)


def match(value: Column, *cases: tuple[object, object], otherwise=None) -> Column:
    """First case that fits: a value, a list of values, a (low, high) range or a condition."""
    out = None
    for pattern, result in cases:
        if isinstance(pattern, Column):
            test = pattern
        elif isinstance(pattern, tuple):
            test = value.between(*pattern)
        elif isinstance(pattern, list):
            test = value.isin(pattern)
        else:
            test = value.eqNullSafe(F.lit(pattern))
        result = result if isinstance(result, Column) else F.lit(result)
        out = F.when(test, result) if out is None else out.when(test, result)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def any_row(df: DataFrame, condition: Column, name: str = "any") -> DataFrame:
    """Whether the condition is true for some row; false for an empty table."""
    return df.agg(F.coalesce(F.bool_or(F.coalesce(condition, F.lit(False))), F.lit(False)).alias(name))


def all_rows(df: DataFrame, condition: Column, name: str = "all") -> DataFrame:
    """Whether the condition is true for every row; true for an empty table."""
    return df.agg(F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(True)).alias(name))


def all_false(df: DataFrame, condition: Column, name: str = "all_false") -> DataFrame:
    """Whether the condition is true for no row; true for an empty table."""
    return any_row(df, condition, name).select((~F.col(name)).alias(name))


def compact(df: DataFrame, *columns: str, empty: bool = False) -> DataFrame:
    """Rows whose cells are not null; with `empty`, not empty strings or lists either."""
    keep = F.lit(True)
    for c in columns or df.columns:
        keep = keep & ~is_empty(df, c) if empty else keep & F.col(f"`{c}`").isNotNull()
    return df.where(keep)


def is_empty(df: DataFrame, column: str) -> Column:
    """Null, an empty string, or an empty list."""
    cell, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return cell.isNull() | (cell == "")
    if isinstance(kind, T.ArrayType | T.MapType):
        return cell.isNull() | (F.size(cell) == 0)
    return cell.isNull()


def find(df: DataFrame, *terms: str, columns: Sequence[str] | None = None, regex: bool = False, ignore_case: bool = False, invert: bool = False) -> DataFrame:
    """Rows in which some cell, as text, contains a term or matches a pattern."""
    hit = F.lit(False)
    for c in columns or df.columns:
        cell = F.col(f"`{c}`").cast("string")
        for t in terms:
            if regex:
                test = cell.rlike(f"(?i){t}" if ignore_case else t)
            else:
                test = F.contains(F.lower(cell), F.lit(t.lower())) if ignore_case else F.contains(cell, F.lit(t))
            hit = hit | F.coalesce(test, F.lit(False))
    return df.where(~hit if invert else hit)


def is_in(column: Column, values: Sequence) -> Column:
    """Membership; null is a member where the list holds null, and the result is never null."""
    known = [v for v in values if v is not None]
    inside = F.coalesce(column.isin(known), F.lit(False)) if known else F.lit(False)
    return inside | column.isNull() if None in list(values) else inside


def is_duplicated(df: DataFrame, columns: Sequence[str] | None = None, name: str = "is_duplicated") -> DataFrame:
    """Mark rows that occur more than once.

    Counts are made before the join back, so a very frequent row costs one counter, not a window.
    """
    cols = list(columns or df.columns)
    own = free_prefix(df, "_k")
    counts = df.groupBy(*(F.col(c).alias(f"{own}{i}") for i, c in enumerate(cols))).agg((F.count("*") > 1).alias(f"{own}n"))
    same = [F.col(c).eqNullSafe(F.col(f"{own}{i}")) for i, c in enumerate(cols)]
    return df.join(counts, same, "left").select(*(c for c in df.columns if c != name), F.col(f"{own}n").alias(name))


def is_unique(df: DataFrame, columns: Sequence[str] | None = None, name: str = "is_unique") -> DataFrame:
    """Mark rows that occur once."""
    return is_duplicated(df, columns, name).withColumn(name, ~F.col(name))


def set_where(df: DataFrame, column: str, mask: Column, value) -> DataFrame:
    """Set cells where the mask is true."""
    return df.withColumn(column, F.when(mask, F.lit(value)).otherwise(F.col(column)))


def replace(column: Column, mapping: dict, strict: bool = False, default=None) -> Column:
    """Replace values; others stay, become `default`, or fail when `strict`."""
    out = None
    for old, new in mapping.items():
        test = column.eqNullSafe(F.lit(old))
        out = F.when(test, F.lit(new)) if out is None else out.when(test, F.lit(new))
    if strict:
        return out.otherwise(F.raise_error(F.concat(F.lit("no replacement for "), column.cast("string"))))
    return out.otherwise(column if default is None else F.lit(default))


def fill_null(df: DataFrame, value, *columns: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns or df.columns})


def fill_nan(df: DataFrame, value, *columns: str) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(F.isnan(c), F.lit(value)).otherwise(F.col(c)) for c in columns or floats})


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Position in a group, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def set_with_index(df: DataFrame, column: str, value, positions: Sequence[int], order: Sequence[str]) -> DataFrame:
    """Set the cells at some positions under `order`; positions beyond the table are an error."""
    idx = free(df, IDX)
    rows = indexed(df, order, idx)
    if positions and (min(positions) < 0 or max(positions) >= rows.count()):
        raise ValueError("a position lies outside the table")
    return set_where(rows, column, F.col(idx).isin(list(positions)), value).drop(idx)
