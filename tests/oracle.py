"""Comparing a Spark result with the result of SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def rows(table) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows in a fixed order."""
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    out = [tuple(map(plain, r)) for r in zip(*cols, strict=True)]
    return names, sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same rows, else what differs first."""
    a_names, a = rows(df.toArrow())
    b_names, b = rows(con.sql(sql).to_arrow_table())
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"row {x} and {y}"
    return ""
