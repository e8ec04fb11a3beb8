"""Groups and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What `aggregate` computes unless told otherwise.
DEFAULT_OPS = ("min", "avg", "max", "sum")

_OPS = {"min": F.min, "max": F.max, "avg": F.avg, "mean": F.avg, "sum": F.sum, "count": F.count, "median": F.median, "stddev": F.stddev_pop, "variance": F.var_pop}


def group_lists(df: DataFrame, *by: str, keep_null: bool = True, order: Sequence[str] | None = None) -> DataFrame:
    """One row a group: the keys as text and `items`, the list of its rows. Use it for groups that fit in memory.

    Without `keep_null`, rows with a null key are left out. `order` sorts the items.
    """
    if "items" in by:
        raise ValueError("items is a reserved name")
    rows = df if keep_null else df.dropna(subset=list(by))
    front = list(order or [])
    item = F.struct(*front, *(c for c in df.columns if c not in front))
    packed = F.collect_list(item)
    packed = F.array_sort(packed) if front else packed
    plain = F.transform(packed, lambda x: F.struct(*(x[c].alias(c) for c in df.columns)))
    return rows.groupBy(*(F.col(c).cast("string").alias(c) for c in by)).agg(plain.alias("items"))


def aggregate(df: DataFrame, by: Sequence[str], columns: Sequence[str], ops: Sequence[str] = DEFAULT_OPS, count: bool = True) -> DataFrame:
    """Several aggregates of several columns in one pass: `column_op`, and the group's `count`."""
    out = [F.count("*").alias("count")] if count else []
    out += [_OPS[op](c).alias(f"{c}_{op}") for c in columns for op in ops]
    return df.groupBy(*by).agg(*out)


def histogram(df: DataFrame, column: str, frequency: str = "frequency", relative: bool = False, bar: bool = True) -> DataFrame:
    """Counts by value with their share of all rows, or of the largest count, sorted by count; null values do not count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value" if column in ("count", "quantile", "percentage", frequency) else column)).agg(F.count("*").alias("count"))
    total = counts.agg((F.max if relative else F.sum)("count").alias("_of"))
    share = F.col("count") / F.col("_of")
    out = counts.crossJoin(F.broadcast(total)).withColumn("quantile", share).withColumn("percentage", F.format_string("%.2f%%", share * 100)).drop("_of")
    if bar:
        out = out.withColumn(frequency, F.repeat(F.lit("*"), F.floor(100 * F.col("quantile")).cast("int")))
    return out


def value_counts(df: DataFrame, column: str, name: str = "count", normalize: bool = False) -> DataFrame:
    """Rows by value, null included; or their shares."""
    counts = df.groupBy(column).agg(F.count("*").alias(name))
    if not normalize:
        return counts
    total = df.agg(F.count("*").alias("_n"))
    return counts.crossJoin(F.broadcast(total)).withColumn(name, F.col(name) / F.col("_n")).drop("_n")


def _strict(value: Column, column: Column, what: str) -> Column:
    """Fail where there is nothing to aggregate."""
    return F.when(F.count(column) > 0, value).otherwise(F.raise_error(F.lit(f"{what} of no values")))


def math(df: DataFrame, op: str, *columns: str, by: Sequence[str] = (), sample: bool = False, strict: bool = False) -> DataFrame:
    """One aggregate of each column: sum, avg, min, max, product, median, stddev, variance.

    NaN is left out of the median. stddev and variance are of the population unless `sample`.
    No rows give null, or an error if `strict`.
    """
    funs = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "product": F.product, "median": lambda c: F.median(F.when(~F.isnan(c), c)), "stddev": F.stddev_samp if sample else F.stddev_pop, "variance": F.var_samp if sample else F.var_pop}
    out = []
    for c in columns:
        col = F.col(c).cast("double") if op == "median" else F.col(c)
        value = funs[op](col)
        out.append((_strict(value, col, op) if strict else value).alias(c))
    return df.groupBy(*by).agg(*out)


def mode(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """All most frequent values, sorted, as a list `mode`."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    top = counts.groupBy(*by).agg(F.max("_n").alias("_top"))
    best = counts.join(top, list(by)) if by else counts.crossJoin(F.broadcast(top))
    return best.where("_n = _top").groupBy(*by).agg(F.sort_array(F.collect_list(column)).alias("mode"))


def n_unique(column: str) -> Column:
    """Distinct values; null counts as one."""
    return F.count_distinct(column) + F.max(F.col(column).isNull().cast("int"))


def quantile(column: str, q: float) -> Column:
    """The value nearest to the quantile's position (ties go to the even position), as an aggregate of groups whose values fit a cell; see quantile_by_rank for whole tables."""
    ordered = F.array_sort(F.collect_list(column))
    return F.element_at(ordered, (F.rint((F.count(column) - 1) * q) + 1).cast("int"))


def quantile_by_rank(df: DataFrame, column: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """The same for tables and groups of any size, by global position under (by, column): no list of values, no frame a group."""
    from millrace.names import free
    from millrace.order import IDX, indexed

    idx = free([*by, column], IDX)
    known = indexed(df.where(F.col(column).isNotNull()).select(*by, column), [*by, column], idx)
    first, n = (free([*by, column, idx], c) for c in ("_first", "_count"))
    groups = known.groupBy(*by).agg(F.min(idx).alias(first), F.count("*").alias(n))
    wanted = groups.select((F.col(first) + F.rint((F.col(n) - 1) * q).cast("long")).alias(idx))
    return known.join(wanted, idx, "left_semi").select(*by, column)


def implode(*columns: str) -> list[Column]:
    """Values of a group as lists that keep nulls."""
    return [F.transform(F.collect_list(F.struct(F.col(c).alias("v"))), lambda x: x["v"]).alias(c) for c in columns]


def horizontal(op: str, *columns: str) -> Column:
    """Across the columns of a row: any, all, min, max, sum, mean; nulls are skipped."""
    cols = [F.col(c) for c in columns]
    if op in ("any", "all"):
        out = cols[0]
        for c in cols[1:]:
            out = out | c if op == "any" else out & c
        return out
    if op in ("min", "max"):
        return (F.least if op == "min" else F.greatest)(*cols)
    total = sum((F.coalesce(c, F.lit(0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0)))
    if op == "sum":
        return total
    if op == "mean":
        n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
        return F.when(n > 0, total / n)
    raise ValueError(op)


def summary(df: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Statistics of all numeric columns, one row a statistic; std is of the population, count has nulls too, quantiles are interpolated."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    stats = {"count": lambda c: F.count("*"), "sum": F.sum, "mean": F.avg, "median": F.median, "std": F.stddev_pop, "min": F.min, "max": F.max} | {f"{int(q * 100)}%": (lambda c, q=q: F.percentile(c, q)) for q in quantiles}
    row = df.agg(*(fn(F.col(c)).cast("double").alias(f"{s}\0{c}") for s, fn in stats.items() for c in numeric))
    lines = F.array(*(F.struct(F.lit(s).alias("descriptor"), *(F.col(f"`{s}\0{c}`").alias(c) for c in numeric)) for s in stats))
    return row.select(F.inline(lines))


def entropy(column: str, base: float = 2.718281828459045, normalize: bool = True) -> Column:
    """-sum(p log p) over a group; p is divided by its sum first if `normalize`."""
    import math as m

    p = F.col(column)
    if not normalize:
        return -F.sum(p * F.log(p)) / m.log(base)
    # sum (p/s) log(p/s) = sum(p log p)/s - log s
    return -(F.sum(p * F.log(p)) / F.sum(p) - F.log(F.sum(p))) / m.log(base)


def pivot(df: DataFrame, on: str, values: str, index: Sequence[str], agg: str = "first", on_values: list | None = None) -> DataFrame:
    """Long to wide. Give `on_values` to spare a pass over the table for the column names."""
    fun = {"first": F.first, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "count": F.count, "median": F.median, "last": F.last}[agg]
    return df.groupBy(*index).pivot(on, on_values).agg(fun(values))


def unpivot(df: DataFrame, index: Sequence[str], on: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(index), list(on), variable, value)


def cut(column: Column, breaks: Sequence[float], labels: Sequence[str] | None = None, left_closed: bool = False) -> Column:
    """The bin of a value among breaks, right-closed unless told otherwise."""
    text = lambda x: "inf" if x == float("inf") else "-inf" if x == float("-inf") else f"{x:g}"
    edges = [float("-inf"), *breaks, float("inf")]
    if labels is None:
        labels = [f"[{text(a)}, {text(b)})" if left_closed else f"({text(a)}, {text(b)}]" for a, b in zip(edges, edges[1:], strict=False)]
    out = None
    for b, name in zip(breaks, labels, strict=False):
        test = column < b if left_closed else column <= b
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return F.when(column.isNotNull(), out.otherwise(F.lit(labels[-1])))


def qcut(df: DataFrame, column: str, quantiles: Sequence[float], labels: Sequence[str], name: str = "category") -> DataFrame:
    """Bins at the quantiles of the column (interpolated, one aggregate for all)."""
    points = df.agg(F.percentile(column, list(quantiles)).alias("p")).first()["p"]
    return df.withColumn(name, cut(F.col(column), points or [], labels))


def dot(a: str, b: str) -> Column:
    """Sum of the products of two columns."""
    return F.sum(F.col(a) * F.col(b))


def count_null(*columns: str) -> list[Column]:
    """How many cells of each column are null."""
    return [F.count_if(F.col(c).isNull()).alias(c) for c in columns]


def group_positions(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "groups") -> DataFrame:
    """The positions under `order` of each group's rows, as a sorted list; for groups that fit a cell."""
    from millrace.names import free
    from millrace.order import IDX, indexed

    idx = free(df, IDX)
    return indexed(df, order, idx).groupBy(*by).agg(F.sort_array(F.collect_list(idx)).alias(name))
