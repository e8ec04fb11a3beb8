"""Joins, by text-compared keys, typed keys, conditions, ranges and position."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.names import free, free_prefix
from millrace.order import IDX, indexed


def _free(name: str, taken: set[str], suffix: str) -> str:
    while name in taken:
        name += suffix
    taken.add(name)
    return name


def join(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None, how: str = "inner", prefix: str = "", suffix: str = "") -> DataFrame:
    """Join on one key that is compared as text, null like the empty string. The key stays once.

    how: inner, left, right, outer. Clashing right columns get `_` appended until they are free;
    prefix and suffix apply to all right columns but the key.
    """
    right_on = right_on or left_on
    key, key2, right_key = (free([*left.columns, *right.columns], c) for c in ("_key", "_key2", "_right_key"))
    k1 = left.withColumn(key, F.coalesce(F.col(left_on).cast("string"), F.lit("")))
    taken = {*left.columns, key, key2, right_key}
    names = {c: _free(f"{prefix}{c}{suffix}", taken, "_") for c in right.columns if c != right_on}
    k2 = right.select(F.coalesce(F.col(right_on).cast("string"), F.lit("")).alias(key2), F.col(right_on).alias(right_key), *(F.col(c).alias(n) for c, n in names.items()))
    out = k1.join(k2, F.col(key) == F.col(key2), {"outer": "full"}.get(how, how))
    mine = F.when(F.col(key).isNull(), F.col(right_key).cast(left.schema[left_on].dataType)).otherwise(F.col(left_on))
    return out.select(*(mine.alias(c) if c == left_on else F.col(c) for c in left.columns), *names.values())


def typed_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str] | None = None, how: str = "inner", suffix: str = "_x", nulls_equal: bool = False, coalesce: bool = False) -> DataFrame:
    """Equi-join on typed keys: inner, left, full, cross, semi or anti.

    Null keys meet only with `nulls_equal`. Clashing right columns get the suffix. A full
    join keeps both keys unless `coalesce`; the others keep the left ones.
    """
    right_on = list(right_on or left_on)
    left_on = list(left_on)
    own = free_prefix(left, "_r_")
    names = {c: f"{c}{suffix}" if c in left.columns else c for c in right.columns}
    other = right.select(*(F.col(c).alias(f"{own}{c}") for c in right.columns))
    if how == "cross":
        return left.crossJoin(other).select(*left.columns, *(F.col(f"{own}{c}").alias(names[c]) for c in right.columns))
    same = [F.col(a).eqNullSafe(F.col(f"{own}{b}")) if nulls_equal else F.col(a) == F.col(f"{own}{b}") for a, b in zip(left_on, right_on, strict=True)]
    out = left.join(other, same, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    if how in ("semi", "anti"):
        return out
    keys = dict(zip(left_on, right_on, strict=True))
    mine = [F.coalesce(F.col(c), F.col(f"{own}{keys[c]}")).alias(c) if coalesce and how == "full" and c in keys else F.col(c) for c in left.columns]
    theirs = [c for c in right.columns if c not in right_on or (how == "full" and not coalesce)]
    return out.select(*mine, *(F.col(f"{own}{c}").alias(names[c]) for c in theirs))


def join_where(left: DataFrame, right: DataFrame, *conditions: Column) -> DataFrame:
    """Inner join on any conditions. Equalities among them become the join's keys; see `range_join` for bounds alone."""
    test = conditions[0]
    for c in conditions[1:]:
        test = test & c
    return left.join(right, test, "inner")


def by_cells(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points and ranges with the columns, named last, on which each point meets every range that holds it.

    A range is copied to the cells of size width * 4**k that it touches, where k makes it one to
    four cells long: five copies at most, and most meetings are pairs. A point is copied once for
    each size that occurs; a first pass over `ranges` tells these, a handful by nature (doubles
    have lengths for some 1,050). Ranges without an end share one cell with all points.
    """
    size, cell = (free([*points.columns, *ranges.columns], c) for c in ("_size", "_cell"))
    place = lambda c: F.floor(F.col(c) / F.col(size))
    length = F.col(high).cast("double") - F.col(low).cast("double")
    # null where doubles cannot tell the bounds apart: one cell of any size holds both
    fit = F.coalesce(width * F.pow(F.lit(4.0), F.ceil((F.log2(length) - math.log2(width)) / 2) - 1), F.lit(float(width)))
    sized = ranges.where(F.col(low) < F.col(high)).withColumn(size, F.when(length < math.inf, F.greatest(fit, F.lit(sys.float_info.min))).otherwise(math.inf))
    spread = sized.withColumn(cell, F.explode(F.sequence(place(low), place(high))))
    sizes = [r[0] for r in sized.select(size).distinct().collect()]
    keyed = points.withColumn(size, F.explode(F.array(*map(F.lit, sizes)).cast("array<double>"))).withColumn(cell, place(point))
    return keyed, spread, [size, cell]


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, equal: Sequence[str] = ()) -> DataFrame:
    """Pairs with low <= point < high, by equi-join on cells whose sizes fit the ranges' lengths (see `by_cells`).

    The join shuffles by (keys, cell) and merges, so a cell's ranges lie together and none are
    broadcast for looking small before they are copied. `width` is the unit of the cells' sizes;
    a usual length is a good one, any other gives the same pairs. Rows with null bounds meet nothing.
    """
    keyed, spread, keys = by_cells(points, ranges, point, low, high, width)
    met = keyed.join(spread.hint("merge"), [*keys, *equal])
    return met.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop(*keys)


def zip_rows(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows of two tables side by side, by position under each order; stops at the shorter."""
    idx = free([*left.columns, *right.columns], IDX)
    a, b = indexed(left, left_order, idx), indexed(right, right_order, idx)
    taken = {*left.columns, idx}
    names = {c: _free(c, taken, "_") for c in right.columns}
    return a.join(b.select(idx, *(F.col(c).alias(n) for c, n in names.items())), idx).drop(idx)


def merge_tables(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Row by row, the right table's columns replace or extend the left ones; rows beyond the right table stay."""
    idx, own = free([*left.columns, *right.columns], IDX), free_prefix(left, "_r_")
    met = free([*left.columns, *(own + c for c in right.columns)], "_met")
    a, b = indexed(left, left_order, idx), indexed(right, right_order, idx)
    other = b.select(idx, *(F.col(c).alias(own + c) for c in right.columns), F.lit(True).alias(met))
    out = a.join(other, idx, "full")
    mine = [F.when(F.col(met), F.col(own + c)).otherwise(F.col(c)).alias(c) if c in right.columns else F.col(c) for c in left.columns]
    return out.orderBy(idx).select(*mine, *(F.col(own + c).alias(c) for c in right.columns if c not in left.columns))
