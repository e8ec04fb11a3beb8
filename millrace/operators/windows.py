"""Frames along the rows of a table, and over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.names import free
from millrace.order import IDX, cumulative, framed, indexed, rolling, running_before, shifted

__all__ = ["chunk_by", "chunks", "cumulative", "over", "rolling", "rolling_time", "shifted", "sliding"]


def chunks(df: DataFrame, size: int, order: Sequence[str]) -> DataFrame:
    """Consecutive groups of `size` rows: `chunk` (from 0) and `items`; the last may be shorter."""
    idx = free(df, IDX)
    rows = indexed(df, order, idx)
    return _collected(rows, F.floor(F.col(idx) / size).alias("chunk"), idx, df.columns)


def _collected(rows: DataFrame, by: Column, idx: str, columns: Sequence[str]) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(idx, *columns)))
    return rows.groupBy(by).agg(F.transform(packed, lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias("items"))


def sliding(df: DataFrame, size: int, order: Sequence[str], stride: int = 1, remainder: bool = False) -> DataFrame:
    """Windows of `size` rows that start every `stride` rows: `start` and `items`. Short ones at the end only with `remainder`."""
    idx, start = free(df, IDX), free(df, "_start")
    rows = indexed(df, order, idx)
    last = F.floor(F.col(idx) / stride)
    first = F.greatest(F.lit(0), F.ceil((F.col(idx) - size + 1) / stride))
    starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    spread = rows.withColumn(start, F.explode(starts))
    out = _collected(spread, (F.col(start) * stride).alias("start"), idx, df.columns)
    return out if remainder else out.where(F.size("items") == size)


def islands(df: DataFrame, key: Column, order: Sequence[str], name: str = "chunk") -> DataFrame:
    """Number the runs of equal keys along the order, from 0.

    Each block of rows sees one row of the block before it; runs are then counted in two levels.
    """
    rows, run, added = _runs(df, key, order)
    made = free([*rows.columns, run], "_run")
    out = rows.withColumn(made, F.col(run)).drop(run, *added)
    return out.withColumn(name, F.col(made)).drop(*([made] if made != name else []))


def _runs(df: DataFrame, key: Column, order: Sequence[str]) -> tuple[DataFrame, str, list[str]]:
    """The rows with the number of their run: (table, that column, other columns added; the position is the first)."""
    k, new, n, before, run = (free(df, c) for c in ("_key", "_new", "_n", "_before", "_run"))
    rows, idx, at, own = framed(df.withColumn(k, key), order, 1)
    w = Window.partitionBy(at).orderBy(idx)
    changed = (F.row_number().over(w) > 1) & ~F.col(k).eqNullSafe(F.lag(k).over(w))
    marked = rows.withColumn(new, changed.cast("long")).where(own)
    inner = F.sum(new).over(w)
    earlier = running_before(marked.groupBy(at).agg(F.sum(new).alias(n)), at, n, F.sum, before)
    out = marked.withColumn(run, inner).join(earlier, at)
    out = out.withColumn(run, F.col(run) + F.coalesce(before, F.lit(0)))
    return out, run, [idx, at, own, k, new, before]


def chunk_by(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """Runs of rows with equal keys: `chunk` and `items`."""
    rows, run, added = _runs(df, key, order)
    return _collected(rows, F.col(run).alias("chunk"), added[0], df.columns)


def over(value: Column, *by: str) -> Column:
    """An aggregate of the row's group, beside the row. A group is the frame of one task; without keys that is the whole table."""
    return value.over(Window.partitionBy(*by))


def rolling_time(df: DataFrame, time: str, period: str, *aggregates: Column, by: Sequence[str] = (), closed: str = "left", offset: str = "0 seconds") -> DataFrame:
    """For each row, aggregates over the rows of its group within a period of time that starts `offset` from it.

    closed: left, right, both or none. Groups are frames of one task; give `by` keys that divide the table.
    """
    seconds = lambda s: df.sparkSession.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {s}"))).alias("x")).first()["x"]
    low, length = seconds(offset), seconds(period)
    a = low + (0 if closed in ("left", "both") else 1)
    b = low + length - (0 if closed in ("right", "both") else 1)
    w = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(a, b)
    names = [f"_a{k}" for k in range(len(aggregates))]
    return df.withColumns({n: g.over(w) for n, g in zip(names, aggregates, strict=True)})

