"""Row order at scale: global row numbers, and what is computed along them, without a one-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.names import free, free_prefix
from millrace.staging import stage

IDX = "_idx"  # usual name of the 0-based position in the global order
BLOCK = 100_000  # rows that a task numbers or frames together


def keys(order: Sequence[str | Column], nulls_last: bool = True, reverse: bool = False) -> list[Column]:
    """Sort keys; nulls come last ascending, and `reverse` turns the whole order round."""
    out = []
    for k in order:
        c = F.col(k) if isinstance(k, str) else k
        if reverse:
            out.append(c.desc_nulls_first() if nulls_last else c.desc_nulls_last())
        else:
            out.append(c.asc_nulls_last() if nulls_last else c.asc_nulls_first())
    return out


def positioned(df: DataFrame, name: str = "_pos") -> DataFrame:
    """Add an ascending (not gapless) number in the order in which the source is read; no shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered(sorted_df: DataFrame, name: str) -> DataFrame:
    """Number the rows of a sorted table from 0, gapless.

    The rows are written once with partition-local numbers; partition sizes, one row each, become offsets.
    """
    rows = stage(sorted_df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(name, 33)
    sizes = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    offsets, at = [], 0
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    if not offsets:
        return rows
    own = free_prefix(rows, "_part")
    before = F.broadcast(rows.sparkSession.createDataFrame(offsets, f"{own} long, {own}_before long"))
    local = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.join(before, part == F.col(own))
    return out.withColumn(name, F.col(f"{own}_before") + local).drop(own, f"{own}_before")


def indexed(df: DataFrame, order: Sequence[str | Column], name: str = IDX, reverse: bool = False) -> DataFrame:
    """Add the gapless global position under `order`, by a range-partitioned sort; it replaces a column of that name.

    Rows equal under `order` are numbered in any order.
    """
    return numbered(df.orderBy(*keys(order, reverse=reverse)), name)


def head_indexed(df: DataFrame, order: Sequence[str | Column], name: str, upto: int) -> DataFrame:
    """Like indexed, for the rows at positions up to `upto` at least; where these are few, tasks keep only so many rows."""
    few = df.orderBy(*keys(order)).limit(upto + 1) if 0 <= upto < BLOCK else df
    return indexed(few, order, name)


def framed(df: DataFrame, order: Sequence[str | Column], before: int, after: int = 0, reverse: bool = False, block: int | None = None) -> tuple[DataFrame, str, str, str]:
    """Rows with copies at the edges of blocks, so that every row frame fits in a block: (table, position, block, own).

    A block holds copies (`own` is false) of the `before` rows in front of it and the `after`
    rows behind it. Blocks grow with the frame, so that a row is copied twice at most. The last three are the names of
    the added columns.
    """
    block = max(block or BLOCK, before, after)
    idx, at, own = (free(df, c) for c in (IDX, "_block", "_own"))
    rows = indexed(df, order, idx, reverse)
    low, high = F.greatest(F.floor((F.col(idx) - after) / block), F.lit(0)), F.floor((F.col(idx) + before) / block)
    rows = rows.withColumn(at, F.explode(F.sequence(low, high))).withColumn(own, F.col(at) == F.floor(F.col(idx) / block))
    return rows, idx, at, own


def shifted(df: DataFrame, column: str, by: int, order: Sequence[str | Column], fill=None, name: str | None = None) -> DataFrame:
    """Value of `column` `by` rows before (negative: after) under `order`, `fill` outside."""
    rows, idx, at, own = framed(df, order, max(by, 0), max(-by, 0))
    w = Window.partitionBy(at).orderBy(idx)
    moved = F.lag(F.struct(F.col(column).alias("v")), by).over(w)  # a null in the place differs from no place
    out = rows.withColumn(own, F.when(F.col(own), F.struct(moved.alias("m"))))
    out = out.where(F.col(own).isNotNull())
    m = F.col(own)["m"]
    return out.withColumn(name or column, F.when(m.isNull(), F.lit(fill)).otherwise(m["v"])).drop(idx, at, own)


_RUNNING = {"sum": F.sum, "min": F.min, "max": F.max}


def running_before(totals: DataFrame, block: str, total: str, agg, name: str) -> DataFrame:
    """For each block, what the blocks before it add up to; one row a block of rows goes through one task."""
    return totals.withColumn(name, agg(total).over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1))).drop(total)


def cumulative(df: DataFrame, column: str, op: str, order: Sequence[str | Column], reverse: bool = False, name: str | None = None) -> DataFrame:
    """Running sum, min or max under `order`; with `reverse` from the last row on.

    Two levels: inside blocks of consecutive rows, and over one row a block; so no task holds all rows.
    """
    agg = _RUNNING[op]
    idx, block, total, before, here = (free(df, c) for c in (IDX, "_block", "_total", "_before", "_here"))
    rows = indexed(df, order, idx, reverse).withColumn(block, F.floor(F.col(idx) / BLOCK))
    inner = Window.partitionBy(block).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    earlier = running_before(rows.groupBy(block).agg(agg(column).alias(total)), block, total, agg, before)
    combine = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b)}[op]
    out = rows.withColumn(here, agg(column).over(inner)).join(earlier, block, "left")
    value = F.when(F.col(column).isNull(), None).otherwise(combine(F.col(here), F.col(before)))
    return out.withColumn(name or f"cumulative_{op}_{column}", value).drop(idx, block, here, before)


def rolling(df: DataFrame, column: str, op: str, size: int, order: Sequence[str | Column], name: str | None = None) -> DataFrame:
    """Aggregate over the last `size` rows under `order`; null until there are that many."""
    agg = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg}[op]
    rows, idx, at, own = framed(df, order, size - 1)
    w = Window.partitionBy(at).orderBy(idx).rowsBetween(1 - size, 0)
    full = F.count("*").over(w) == size
    none = F.count(F.when(F.col(column).isNull(), 1)).over(w) == 0
    value = F.when(full & none, agg(column).over(w))
    made = free([*df.columns, idx, at, own], "_rolled")
    out = rows.withColumn(made, value).where(own)
    return out.withColumn(name or f"{column}_rolling_{op}", F.col(made)).drop(idx, at, own, made)


def first_index(rows: DataFrame, condition: Column, idx: str = IDX) -> int | None:
    """Smallest position at which the condition is true; one aggregated number."""
    return rows.where(condition).agg(F.min(idx)).first()[0]
