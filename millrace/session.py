"""The Spark session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "millrace", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution. On a cluster leave `master` unset and take it from spark-submit."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
