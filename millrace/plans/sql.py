"""SQL over one frame or many, planned by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def query(df: DataFrame, sql: str, **others: DataFrame) -> DataFrame:
    """Run one SQL statement in which `df` names the frame, and further names other frames.

    All of Spark's SELECT is available. Statements that are not queries are refused.
    """
    text = sql.strip().rstrip(";")
    if not text.lower().startswith(("select", "with", "from", "values", "(")):
        raise ValueError("a query is expected")
    tables = {"df": df, **others}
    for name in tables:
        text = _bound(text, name)
    return df.sparkSession.sql(text, **tables)


def _bound(text: str, name: str) -> str:
    """Put `{name}` where a FROM or JOIN names the table, as spark.sql's keyword arguments want it."""
    import re

    return re.sub(rf"(?i)\b(from|join)(\s+){name}\b", rf"\1\2{{{name}}}", text)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register parquet tables of a folder as views."""
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
