"""Lists, records, matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_contains(c: Column, value) -> Column:
    """Whether a list has a value; false for null lists."""
    return F.coalesce(F.array_contains(c, F.lit(value)), F.lit(False))


def reduce(c: Column, start, step: Callable[[Column, Column], Column]) -> Column:
    """Left fold."""
    return F.aggregate(c, F.lit(start), step)


def scan(c: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """All intermediate values of a left fold, the start left out."""
    return F.slice(F.aggregate(c, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x)))), 2, F.greatest(F.size(c), F.lit(0)))


def intersperse(c: Column, separator) -> Column:
    """A separator between all items."""
    pairs = F.flatten(F.transform(c, lambda x: F.array(x, F.lit(separator))))
    return F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0)))


def find_index(c: Column, test: Callable[[Column], Column]) -> Column:
    """Position of the first item that passes, or -1."""
    return F.array_position(F.transform(c, lambda x: F.coalesce(test(x), F.lit(False))), True) - 1


def take_while(c: Column, test: Callable[[Column], Column]) -> Column:
    """Items before the first that fails."""
    stop = find_index(c, lambda x: ~test(x))
    return F.when(stop < 0, c).otherwise(F.slice(c, F.lit(1), stop.cast("int")))


def windows(c: Column, size: int, stride: int = 1) -> Column:
    """Sliding windows over a list; short ones are dropped."""
    last = F.size(c) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), lambda k: F.slice(c, k + 1, F.lit(size)))).otherwise(F.slice(F.array(c), 1, 0))


def chunks(c: Column, size: int) -> Column:
    """Consecutive pieces of a list; the last may be shorter."""
    n = F.size(c)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda k: F.slice(c, k + 1, F.lit(size)))).otherwise(F.slice(F.array(c), 1, 0))


def split_list(c: Column, separator) -> Column:
    """Pieces of a list between items that equal the separator."""
    marks = F.filter(F.sequence(F.lit(1), F.size(c)), lambda k: F.element_at(c, k) == F.lit(separator))
    edges = F.concat(F.array(F.lit(0)), marks, F.array(F.size(c) + 1))
    return F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: F.slice(c, F.element_at(edges, k) + 1, F.element_at(edges, k + 1) - F.element_at(edges, k) - 1))


def matrix_add(a: Column, b: Column, sign: int = 1) -> Column:
    """Sum (or difference) of two matrices, lists of rows."""
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: p + sign * q))


def matrix_scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda row: F.transform(row, lambda x: x * F.lit(k)))


def matrix_map(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(a, lambda row: F.transform(row, f))


def matrix_transpose(a: Column) -> Column:
    width = F.size(F.element_at(a, 1))
    return F.transform(F.sequence(F.lit(1), width), lambda j: F.transform(a, lambda row: F.element_at(row, j)))


def matrix_multiply(a: Column, b: Column) -> Column:
    """Product of two small matrices."""
    columns = matrix_transpose(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.transform(a, lambda row: F.transform(columns, lambda col: dot(row, col)))


def matrix_sum(a: Column, axis: int | None = None) -> Column:
    """Sum of all entries, of each column (axis 0) or of each row (axis 1)."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    if axis == 1:
        return F.transform(a, total)
    return F.transform(matrix_transpose(a), total) if axis == 0 else total(F.flatten(a))


def matrix_extreme(a: Column, largest: bool = True, axis: int | None = None) -> Column:
    best = F.array_max if largest else F.array_min
    if axis == 1:
        return F.transform(a, best)
    return F.transform(matrix_transpose(a), best) if axis == 0 else best(F.flatten(a))


def matrix_mean(a: Column) -> Column:
    return matrix_sum(a) / F.size(F.flatten(a))


def matrix_reshape(a: Column, columns: int) -> Column:
    """The same entries, row by row, in rows of another length."""
    return chunks(F.flatten(a), columns)


def matrix_row(a: Column, i: int) -> Column:
    return F.element_at(a, i + 1)


def matrix_column(a: Column, j: int) -> Column:
    return F.transform(a, lambda row: F.element_at(row, j + 1))


def matrix_set_row(a: Column, i: int, row: Column) -> Column:
    return F.transform(a, lambda x, k: F.when(k == i, row).otherwise(x))


def matrix_set_column(a: Column, j: int, column: Column) -> Column:
    return F.transform(a, lambda x, k: F.transform(x, lambda v, m: F.when(m == j, F.element_at(column, k + 1)).otherwise(v)))


def identity(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.when(i == j, 1.0).otherwise(0.0)))


def zeros(rows: int, columns: int) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(0.0), columns), rows)


def long_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two large matrices in long form (i, j, v): a join on the inner index and a sum by cell."""
    right = b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w"))
    return a.join(right, "j").groupBy("i", F.col("k").alias("_k")).agg(F.sum(F.col("v") * F.col("w")).alias("v")).withColumnRenamed("_k", "j")
