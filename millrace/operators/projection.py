"""Columns: choose, add, change, rename, move, nest and unnest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _need(df: DataFrame, names: Sequence[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def select(df: DataFrame, *columns: str, optional: bool = False) -> DataFrame:
    """Only these columns, in this order. A name that ends in `?`, or any with `optional`, may be missing: null."""
    out = []
    for c in columns:
        name, may_miss = (c[:-1], True) if c.endswith("?") else (c, optional)
        if name not in df.columns and may_miss:
            out.append(F.lit(None).alias(name))
        else:
            _need(df, [name])
            out.append(F.col(f"`{name}`"))
    return df.select(*out)


def reject(df: DataFrame, *columns: str, optional: bool = False) -> DataFrame:
    """All but these columns."""
    if not optional:
        _need(df, columns)
    return df.drop(*columns)


def insert(df: DataFrame, name: str, value) -> DataFrame:
    """Add a column; it must be new."""
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, _as_column(value))


def update(df: DataFrame, name: str, value) -> DataFrame:
    """Replace a column; it must exist."""
    _need(df, [name])
    return df.withColumn(name, _as_column(value))


def upsert(df: DataFrame, name: str, value) -> DataFrame:
    """Replace or add a column."""
    return df.withColumn(name, _as_column(value))


def update_cells(df: DataFrame, change: Callable[[Column], Column], columns: Sequence[str] | None = None) -> DataFrame:
    """Apply one expression to every cell of the columns (all by default)."""
    chosen = set(df.columns if columns is None else columns)
    return df.select(*(change(F.col(f"`{c}`")).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns))


def rename(df: DataFrame, *names: str, columns: dict[str, str] | None = None, by: Callable[[str], str] | None = None) -> DataFrame:
    """New names by position, by old name, or by a function of the old name."""
    if by is not None:
        return df.toDF(*map(by, df.columns))
    if columns is not None:
        _need(df, list(columns))
        return df.withColumnsRenamed(columns)
    if len(names) > len(df.columns):
        raise ValueError("more names than columns")
    return df.toDF(*names, *df.columns[len(names) :])


def move(df: DataFrame, *columns: str, after: str | None = None, before: str | None = None, first: bool = False, last: bool = False) -> DataFrame:
    """Move columns next to another one, or to an end."""
    if sum(x is not None and x is not False for x in (after, before, first, last)) != 1:
        raise ValueError("give one of after, before, first, last")
    _need(df, [*columns, *(x for x in (after, before) if x)])
    rest = [c for c in df.columns if c not in columns]
    at = 0 if first else len(rest) if last else rest.index(before) if before else rest.index(after) + 1
    return df.select(*rest[:at], *columns, *rest[at:])


def drop_columns(df: DataFrame, n: int = 1, left: bool = False) -> DataFrame:
    """Drop n columns at the right end, or at the left."""
    return df.select(*(df.columns[n:] if left else df.columns[: max(0, len(df.columns) - n)]))


def column_slice(df: DataFrame, *ranges: tuple[int, int], drop: bool = False) -> DataFrame:
    """Columns whose positions lie in the half-open ranges, or all others."""
    inside = {k for a, b in ranges for k in range(a, b)}
    return df.select(*(c for k, c in enumerate(df.columns) if (k in inside) != drop))


def roll_columns(df: DataFrame, by: int = 1, right: bool = False, cells_only: bool = False) -> DataFrame:
    """Rotate the columns; with `cells_only` the names stay where they are."""
    n = len(df.columns)
    k = (-by if right else by) % n if n else 0
    turned = df.columns[k:] + df.columns[:k]
    out = df.select(*turned)
    return out.toDF(*df.columns) if cells_only else out


def default(df: DataFrame, value, *columns: str, empty: bool = False) -> DataFrame:
    """Fill null cells, and columns that are missing; with `empty` also empty strings and lists."""
    out = df
    for c in columns:
        if c not in df.columns:
            out = out.withColumn(c, _as_column(value))
            continue
        cell, kind = F.col(f"`{c}`"), df.schema[c].dataType
        missing = cell.isNull()
        if empty and isinstance(kind, T.StringType):
            missing = missing | (cell == "")
        elif empty and isinstance(kind, T.ArrayType | T.MapType):
            missing = missing | (F.size(cell) == 0)
        out = out.withColumn(c, F.when(missing, _as_column(value)).otherwise(cell))
    return out


def flatten(df: DataFrame, *columns: str, all_: bool = False) -> DataFrame:
    """Structs become columns (`parent_child` where a name is taken); one list column becomes rows.

    Rows with an empty or null list vanish. With `all_`, a list of structs becomes rows and columns.
    """
    chosen = columns or tuple(df.columns)
    lists = [c for c in chosen if isinstance(df.schema[c].dataType, T.ArrayType)]
    if len(lists) > 1:
        raise ValueError("one list column can be flattened at a time")
    out = df
    if lists:
        out = out.withColumn(lists[0], F.explode(F.col(f"`{lists[0]}`")))
    structs = [c for c in chosen if isinstance(out.schema[c].dataType, T.StructType) and (all_ or c not in lists)]
    taken = {c for c in out.columns if c not in structs}
    cols = []
    for c in out.columns:
        if c not in structs:
            cols.append(F.col(f"`{c}`"))
            continue
        for f in out.schema[c].dataType.names:
            name = f if f not in taken else f"{c}_{f}"
            taken.add(name)
            cols.append(F.col(f"`{c}`")[f].alias(name))
    return out.select(*cols)


def unnest(df: DataFrame, *columns: str, separator: str | None = None) -> DataFrame:
    """Put the fields of struct columns in their place, prefixed with the column's name if a separator is given."""
    cols = []
    for c in df.columns:
        if c in columns:
            cols += [F.col(f"`{c}`")[f].alias(f if separator is None else f"{c}{separator}{f}") for f in df.schema[c].dataType.names]
        else:
            cols.append(F.col(f"`{c}`"))
    return df.select(*cols)


def explode(df: DataFrame, *columns: str, empty_as_null: bool = False) -> DataFrame:
    """One row for each list item; several columns are exploded together. Empty and null lists give no row, or a null one."""
    zipped = F.arrays_zip(*(F.col(c) for c in columns)) if len(columns) > 1 else F.transform(F.col(columns[0]), lambda x: F.struct(x.alias(columns[0])))
    item = (F.explode_outer if empty_as_null else F.explode)(zipped)
    rest = [c for c in df.columns if c not in columns]
    rows = df.select(*rest, item.alias("_item"))
    return rows.select(*(F.col("_item")[c].alias(c) if c in columns else F.col(c) for c in df.columns))


def wrap(df: DataFrame, name: str) -> DataFrame:
    """A one-column table under a new name."""
    if len(df.columns) != 1:
        raise ValueError("wrap takes one column")
    return df.toDF(name)


def columns_frame(df: DataFrame) -> DataFrame:
    """The column names, as a table."""
    return df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")


def schema_frame(df: DataFrame) -> DataFrame:
    """Names and types of the columns, as a table."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "name string, type string")


def shape(df: DataFrame) -> DataFrame:
    """Numbers of rows and columns."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def items(df: DataFrame, *columns: str, name: str = "name", value: str = "value") -> DataFrame:
    """One row for each cell of the columns: all other columns, its name and its value as text."""
    chosen = list(columns or df.columns)
    rest = [c for c in df.columns if c not in chosen]
    pairs = F.array(*(F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("string").alias(value)) for c in chosen))
    return df.select(*rest, F.inline(pairs))


def merge_record(df: DataFrame, values: dict) -> DataFrame:
    """Set or add constant columns."""
    return df.withColumns({k: _as_column(v) for k, v in values.items()})


def merge_deep(left: Column, right: Column, left_type: T.DataType, right_type: T.DataType, lists: str = "overwrite") -> Column:
    """Merge two structs field by field; lists are overwritten, appended or prepended; other right values win unless null."""
    if isinstance(left_type, T.StructType) and isinstance(right_type, T.StructType):
        fields = []
        for f in left_type.fields:
            mine = left[f.name]
            fields.append((merge_deep(mine, right[f.name], f.dataType, right_type[f.name].dataType, lists) if f.name in right_type.names else mine).alias(f.name))
        fields += [right[f.name].alias(f.name) for f in right_type.fields if f.name not in left_type.names]
        return F.struct(*fields)
    if isinstance(left_type, T.ArrayType) and isinstance(right_type, T.ArrayType) and lists in ("append", "prepend"):
        a, b = F.coalesce(left, F.array()), F.coalesce(right, F.array())
        return F.concat(a, b) if lists == "append" else F.concat(b, a)
    return F.coalesce(right, left)


def dummies(df: DataFrame, *columns: str, values: dict[str, list], separator: str = "_", drop_first: bool = False) -> DataFrame:
    """One 0/1 column for each listed value of each column."""
    out = [F.col(c) for c in df.columns if c not in columns]
    for c in columns:
        for v in values[c][int(drop_first) :]:
            out.append(F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int").alias(f"{c}{separator}{v}"))
    return df.select(*out)


def values(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row a column: its name and `values`, all its cells as text in the order given; for tables that fit a cell."""
    packed = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("order"), F.struct(*(F.col(c).cast("string").alias(c) for c in df.columns)).alias("row"))))
    cells = lambda c: F.transform("all", lambda x: x["row"][c])
    lists = F.array(*(F.struct(F.lit(c).alias("column"), cells(c).alias("values")) for c in df.columns))
    return df.agg(packed.alias("all")).select(F.inline(lists))
