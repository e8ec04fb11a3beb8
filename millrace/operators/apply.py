"""Python functions over rows and batches, for what no expression can say; Arrow carries the batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.names import free
from millrace.order import IDX, first_index, indexed
from millrace.staging import stage


def each(df: DataFrame, change: Callable[[dict], dict | list[dict] | None], schema: str | T.StructType) -> DataFrame:
    """A row for each row: a function of a record that returns a record, several, or None for no row.

    Batches are converted once; prefer `each_column` where an expression will do.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for record in batch.to_pylist():
                made = change(record)
                if made is not None:
                    out += made if isinstance(made, list) else [made]
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, kind)


def each_column(df: DataFrame, name: str, value: Column, drop_null: bool = True) -> DataFrame:
    """The value of an expression for each row, as a one-column table; null results fall out unless told otherwise."""
    out = df.select(value.alias(name))
    return out.where(F.col(name).isNotNull()) if drop_null else out


def each_while(df: DataFrame, name: str, value: Column, order: Sequence[str]) -> DataFrame:
    """The values of an expression along the order, up to the first null."""
    idx = free([*df.columns, name], IDX)
    rows = indexed(df, order, idx).select(idx, value.alias(name))
    stop = first_index(rows, F.col(name).isNull(), idx)
    return (rows if stop is None else rows.where(F.col(idx) < stop)).select(name)


def flat_map(df: DataFrame, name: str, items: Column) -> DataFrame:
    """One row for each item of a list expression."""
    return df.select(F.explode(items).alias(name))


def map_batches(df: DataFrame, change: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """A function of pandas batches; a batch is what fits Arrow's limits, not the table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield change(batch)

    return df.mapInPandas(run, schema)


def only(df: DataFrame) -> DataFrame:
    """The table if it has exactly one row, else an error."""
    if df.limit(2).count() != 1:
        raise ValueError("exactly one row is expected")
    return df


def recurse(df: DataFrame, parent: str, child: str, start: Column, limit: int = 10_000) -> DataFrame:
    """All nodes under the starting ones by parent links, with their smallest depth; a loop of joins that ends when none is new.

    Each level is staged, so a round reads the level before it and does not compute it anew; `limit`
    only guards against a runaway loop and raises.
    """
    links = df.select(F.col(parent).alias("up"), F.col(child).alias("node"))
    level = stage(df.where(start).select(F.col(child).alias("node"), F.lit(0).alias("depth")).distinct(), "level")
    seen = level
    for depth in range(1, limit + 1):
        below = links.join(level.select(F.col("node").alias("up")), "up").select("node").distinct()
        level = stage(below.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth")), "level")
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)
    raise ValueError(f"deeper than {limit}")


def product(df: DataFrame, *others: DataFrame) -> DataFrame:
    """All combinations of the rows of small tables."""
    out = df
    for o in others:
        out = out.crossJoin(o)
    return out


def aggregate_function(fold: Callable[[pd.Series], object], kind: str):
    """An aggregate of one column by a Python function of a group's values, for groupBy().agg().

    Spark brings the values of a group to one task, so a group must fit in its memory.
    """

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> float:
        return fold(values)

    return run


def table_function(make: Callable[..., Iterator[tuple]], schema: str):
    """A table function for SQL and lateral joins: rows from a Python generator of its arguments."""

    class Rows:
        def eval(self, *args):
            yield from make(*args)

    return F.udtf(Rows, returnType=schema)
