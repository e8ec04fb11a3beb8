"""Generated rows and random values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def seq(spark: SparkSession, start: float, end: float, step: float = 1) -> DataFrame:
    """Numbers from start to end, both included."""
    if all(float(x).is_integer() for x in (start, end, step)):
        a, b, s = int(start), int(end), int(step)
        return spark.range(a, b + (1 if s > 0 else -1), s).toDF("value")
    n = int((end - start) / step + 1e-9) + 1
    return spark.range(n).select((F.lit(float(start)) + F.col("id") * float(step)).alias("value"))


def seq_char(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Characters from start to end."""
    return spark.range(ord(start), ord(end) + 1).select(F.char(F.col("id")).alias("value"))


def generate(spark: SparkSession, start: str, step: str, stop: str, kind: str = "bigint") -> DataFrame:
    """Values from `start` on, each by the SQL expression `step` of `value`, while `stop` is not true; a recursive query."""
    return spark.sql(f"WITH RECURSIVE g(value) AS (SELECT CAST({start} AS {kind}) UNION ALL SELECT CAST({step} AS {kind}) FROM g WHERE NOT ({stop})) SELECT value FROM g")


def random_bool(bias: float = 0.5, seed: int | None = None) -> Column:
    return (F.rand(seed) if seed is not None else F.rand()) < bias


def random_float(low: float = 0.0, high: float = 1.0, seed: int | None = None) -> Column:
    r = F.rand(seed) if seed is not None else F.rand()
    return r * (high - low) + low


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    """Whole numbers from low to high, both included."""
    r = F.rand(seed) if seed is not None else F.rand()
    return (F.floor(r * (high - low + 1)) + low).cast("long")


def random_chars(n: int, seed: int = 0) -> Column:
    return F.randstr(n, seed)


def random_binary(n: int, seed: int = 0) -> Column:
    """n random bytes, a fresh draw for each row."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.floor(F.rand(seed + k) * 256).cast("long")), 2, "0") for k in range(n))))


def random_uuid() -> Column:
    return F.expr("uuid()")


def choice(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random rows."""
    return df.orderBy(F.rand(seed)).limit(n)


def unfold(spark: SparkSession, start, step: Callable, limit: int) -> DataFrame:
    """Values by a Python function that returns (output, next) or None; runs on the driver, at most `limit` values."""
    out, state = [], start
    while state is not None and len(out) < limit:
        made = step(state)
        if made is None:
            break
        value, state = made
        out.append((value,))
    return spark.createDataFrame(out, ["value"])


def random_password(n: int, seed: int = 0, symbols: bool = True, numbers: bool = True, uppercase: bool = True) -> Column:
    """n characters drawn from the chosen kinds. Drawn by rand(), so not for secrets."""
    chars = "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * uppercase + "0123456789" * numbers + "!@#$%^&*()-_=+" * symbols
    draw = lambda k: F.substring(F.lit(chars), (F.floor(F.rand(seed + k) * len(chars)) + 1).cast("int"), F.lit(1))
    return F.concat(*(draw(k) for k in range(n)))


def dice(spark: SparkSession, count: int = 1, sides: int = 6, seed: int | None = None) -> DataFrame:
    """Throws of a die."""
    return spark.range(count).select(random_int(1, sides, seed).alias("value"))
