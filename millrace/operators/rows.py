"""Rows by position: first, last, skip, take, slices, sorts, rotations."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.names import free
from millrace.order import IDX, first_index, head_indexed, indexed, keys, numbered


def sort_by(df: DataFrame, *order: str, reverse: bool = False, ignore_case: bool = False, natural: bool = False, nulls_last: bool = True) -> DataFrame:
    """Sort; nulls last, and `reverse` turns the whole order. `natural` compares runs of digits as numbers."""
    cols = []
    for k in order:
        c = F.lower(F.col(k)) if ignore_case else F.col(k)
        if natural:  # pad runs of digits, so that text order is number order
            parts = F.regexp_extract_all(F.coalesce(c.cast("string"), F.lit("")), F.lit(r"(\d+|\D+)"), F.lit(1))
            c = F.when(c.isNotNull(), F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), ""))
        cols.append(c)
    return df.orderBy(*keys(cols, nulls_last, reverse))


def top(df: DataFrame, n: int, order: Sequence[str | Column], last: bool = False) -> DataFrame:
    """The first (or last) n rows under an order, sorted; each task keeps n rows."""
    return df.orderBy(*keys(order, reverse=last)).limit(n)


def first(df: DataFrame, n: int = 1, order: Sequence[str | Column] = (), strict: bool = False) -> DataFrame:
    """First n rows under an order, or as the source is read."""
    if strict and df.isEmpty():
        raise ValueError("no rows")
    return top(df, n, order) if order else df.limit(n)


def last(df: DataFrame, n: int = 1, order: Sequence[str | Column] = ()) -> DataFrame:
    """Last n rows under an order, in that order."""
    return top(df, n, order, last=True).orderBy(*keys(order))


def skip(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """All but the first n rows."""
    idx = free(df, IDX)
    return indexed(df, order, idx).where(F.col(idx) >= n).drop(idx)


def drop_last(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """All but the last n rows."""
    idx = free(df, IDX)
    return indexed(df, order, idx, reverse=True).where(F.col(idx) >= n).drop(idx)


def row_slice(df: DataFrame, start: int, stop: int | None, order: Sequence[str]) -> DataFrame:
    """Rows start to stop (inclusive); negative positions count from the end."""
    idx = free(df, IDX)
    rows = head_indexed(df, order, idx, stop if stop is not None and min(start, stop) >= 0 else -1)
    if start < 0 or (stop is not None and stop < 0):
        n = rows.count()
        start = start + n if start < 0 else start
        stop = stop + n if stop is not None and stop < 0 else stop
    keep = F.col(idx) >= start
    return rows.where(keep & (F.col(idx) <= stop) if stop is not None else keep).drop(idx)


def every(df: DataFrame, stride: int, order: Sequence[str], skip_: bool = False) -> DataFrame:
    """Every stride-th row from the first on, or all others."""
    idx = free(df, IDX)
    hit = F.col(idx) % max(1, stride) == 0
    return indexed(df, order, idx).where(~hit if skip_ else hit).drop(idx)


def nth(df: DataFrame, positions: Sequence[int], order: Sequence[str], drop: bool = False) -> DataFrame:
    """Rows at positions, or all others."""
    idx = free(df, IDX)
    hit = F.col(idx).isin(list(positions))
    return head_indexed(df, order, idx, -1 if drop else max(positions, default=0)).where(~hit if drop else hit).drop(idx)


def take_rows(df: DataFrame, positions: Sequence[int], order: Sequence[str]) -> DataFrame:
    """Rows at positions, in the order asked for, with repeats: `_at` is the place in the list; it must not be a column."""
    if "_at" in df.columns:
        raise ValueError("_at is a reserved name")
    idx = free(df, IDX)
    wanted = df.sparkSession.createDataFrame(list(enumerate(positions)), f"_at long, {idx} long")
    return head_indexed(df, order, idx, max(positions, default=0)).join(F.broadcast(wanted), idx).drop(idx)


def _edge(df: DataFrame, order: Sequence[str], stop: Column) -> tuple[DataFrame, int | None, str]:
    idx = free(df, IDX)
    rows = indexed(df, order, idx)
    return rows, first_index(rows, stop, idx), idx


def take_while(df: DataFrame, condition: Column, order: Sequence[str], include: int = 0) -> DataFrame:
    """Rows before the first that fails the condition, and `include` further ones."""
    rows, at, idx = _edge(df, order, ~F.coalesce(condition, F.lit(False)))
    return (rows if at is None else rows.where(F.col(idx) < at + include)).drop(idx)


def take_until(df: DataFrame, condition: Column, order: Sequence[str], include: int = 0) -> DataFrame:
    """Rows before the first that meets the condition, and `include` further ones."""
    rows, at, idx = _edge(df, order, condition)
    return (rows if at is None else rows.where(F.col(idx) < at + include)).drop(idx)


def skip_while(df: DataFrame, condition: Column, order: Sequence[str]) -> DataFrame:
    """Rows from the first that fails the condition on."""
    rows, at, idx = _edge(df, order, ~F.coalesce(condition, F.lit(False)))
    return rows.where(F.lit(False) if at is None else F.col(idx) >= at).drop(idx)


def skip_until(df: DataFrame, condition: Column, order: Sequence[str]) -> DataFrame:
    """Rows from the first that meets the condition on."""
    rows, at, idx = _edge(df, order, condition)
    return rows.where(F.lit(False) if at is None else F.col(idx) >= at).drop(idx)


def enumerate_rows(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """`index` from 0 and `item`, the row."""
    idx = free(df, IDX)
    return indexed(df, order, idx).select(F.col(idx).alias("index"), F.struct(*df.columns).alias("item"))


def reverse(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows in the opposite order."""
    return df.orderBy(*keys(order, reverse=True))


def roll_rows(df: DataFrame, by: int, order: Sequence[str]) -> DataFrame:
    """Rotate rows down by `by` (up if negative): `position` is the new place."""
    idx = free(df, IDX)
    rows = indexed(df, order, idx)
    n = rows.count()
    return rows.withColumn("position", F.pmod(F.col(idx) + by, F.lit(max(1, n)))).drop(idx)


def shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    """Rows in random order."""
    return df.orderBy(F.rand(seed))


def sample(df: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 0, replace: bool = False) -> DataFrame:
    """Exactly n random rows, or about a fraction of all."""
    if (n is None) == (fraction is None):
        raise ValueError("give n or fraction")
    return df.orderBy(F.rand(seed)).limit(n) if n is not None else df.sample(replace, fraction, seed)


def append(df: DataFrame, *others: DataFrame, order_column: str | None = None) -> DataFrame:
    """Rows of all tables; a column that is missing is null. `order_column` numbers the tables."""
    tables = [df, *others]
    if order_column:
        tables = [t.withColumn(order_column, F.lit(k)) for k, t in enumerate(tables)]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def prepend(df: DataFrame, *others: DataFrame, order_column: str | None = None) -> DataFrame:
    """Like append, with the others in front."""
    return append(*others, df, order_column=order_column)


def headers(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Use the first row as column names; null and empty cells give columnN."""
    row = df.orderBy(*keys(order)).first()
    names = [str(v) if v not in (None, "") else f"column{k}" for k, v in enumerate(row)]
    return skip(df, 1, order).toDF(*names)


def transpose(df: DataFrame, order: Sequence[str], name: str = "column0", limit: int = 1000) -> DataFrame:
    """Columns become rows and rows become columns (`column1`, ...); at most `limit` rows, since each becomes a column."""
    idx = free(df, IDX)
    rows = indexed(df, order, idx)
    n = rows.count()
    if n > limit:
        raise ValueError(f"{n} rows would become columns; the limit is {limit}")
    cells = F.array(*(F.struct(F.lit(k).alias("_k"), F.lit(c).alias(name), F.col(f"`{c}`").cast("string").alias("_v")) for k, c in enumerate(df.columns)))
    long = rows.select(idx, F.inline(cells))
    wide = long.groupBy("_k", name).pivot(idx, list(range(n))).agg(F.first("_v")).orderBy("_k").drop("_k")
    return wide.toDF(name, *(f"column{k + 1}" for k in range(n)))


def rotate(df: DataFrame, order: Sequence[str], counter: bool = False) -> DataFrame:
    """Turn a small table by 90 degrees: clockwise the last row becomes the first column."""
    turned = transpose(df, order, "_name")
    cells = turned.columns[1:]
    flipped = turned.select(*(F.col(c) for c in (cells if counter else cells[::-1])), F.col("_name"))
    out = flipped.select("_name", *cells) if counter else flipped
    return out.toDF(*(f"column{k}" for k in range(len(out.columns))))


def combinations(df: DataFrame, k: int, key: str) -> DataFrame:
    """All combinations of k rows by increasing key; (n choose k) rows, so for small tables."""
    out = df.select(*(F.col(c).alias(f"{c}_0") for c in df.columns))
    for j in range(1, k):
        other = df.select(*(F.col(c).alias(f"{c}_{j}") for c in df.columns))
        out = out.join(other, F.col(f"{key}_{j - 1}") < F.col(f"{key}_{j}"))
    return out


def permutations(values: Sequence) -> list[list]:
    """All orders of a short list."""
    return [list(p) for p in itertools.permutations(values)]


def arg_sort(df: DataFrame, column: str, order: Sequence[str], reverse: bool = False, nulls_last: bool = False) -> DataFrame:
    """Positions under `order` in the order of the column's values: `rank`, `arg_sort`."""
    rows = indexed(df, order, "arg_sort")
    c = F.col(column)
    key = (c.desc_nulls_last() if nulls_last else c.desc_nulls_first()) if reverse else (c.asc_nulls_last() if nulls_last else c.asc_nulls_first())
    return numbered(rows.orderBy(key, "arg_sort").select("arg_sort"), "rank")


def arg_unique(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Position of the first row of each value."""
    idx = free(df, IDX)
    return indexed(df, order, idx).groupBy(column).agg(F.min(idx).alias("arg_unique")).select("arg_unique")


def arg_extreme(df: DataFrame, column: str, order: Sequence[str], largest: bool = True) -> DataFrame:
    """Position of the first row with the largest (or smallest) value."""
    idx = free(df, IDX)
    rows = indexed(df, order, idx)
    best = F.max_by if largest else F.min_by
    place = F.struct(F.col(column), -F.col(idx)) if largest else F.struct(F.col(column), F.col(idx))
    return rows.where(F.col(column).isNotNull()).agg(best(idx, place).alias("arg_max" if largest else "arg_min"))


def arg_true(df: DataFrame, condition: Column, order: Sequence[str]) -> DataFrame:
    """Positions of the rows for which the condition is true."""
    idx = free(df, IDX)
    return indexed(df, order, idx).where(condition).select(F.col(idx).alias("arg_true"))


def permuted(df: DataFrame, key: str, limit: int = 9) -> DataFrame:
    """All orders of the rows of a short table: `k` and `items`, the keys in that order; n factorial rows, so `limit` rows at most."""
    items = [r[0] for r in df.select(key).orderBy(key).limit(limit + 1).collect()]
    if len(items) > limit:
        raise ValueError(f"more than {limit} rows to permute")
    kind = df.select(key).schema[0].dataType.simpleString()
    return df.sparkSession.createDataFrame(list(enumerate(permutations(items))), f"k int, items array<{kind}>")
