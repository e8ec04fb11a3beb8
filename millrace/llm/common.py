"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.names import free
from millrace.staging import shared_folder


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and return a reader of it.

    Cuts the lineage: what follows re-reads files instead of recomputing, so a lost
    executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def null_safe_text(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most `rows` rows; the bound is checked before it is broadcast."""
    return df.limit(rows + 1).count() <= rows


def without(df: DataFrame, id_col: str, gone: DataFrame, gone_col: str, broadcast_rows: int) -> DataFrame:
    """`df` without the rows whose id (null included) is among the distinct ids of `gone`, a staged table; these are broadcast only if they are few."""
    name = free(df, "_gone")
    gone = gone.select(F.col(gone_col).alias(name))
    gone = F.broadcast(gone) if small_enough(gone, broadcast_rows) else gone
    return df.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_anti")


_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (public-domain 64-bit avalanche mix)."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)
