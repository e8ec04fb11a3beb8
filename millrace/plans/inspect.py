"""What a frame is, and what it takes to run it."""

from __future__ import annotations

import contextlib
import io
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def describe(df: DataFrame) -> str:
    """The table's type in one line."""
    return "table<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in df.schema) + ">"


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """Spark's plan as text."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def timeit(df: DataFrame) -> float:
    """Seconds to compute all rows, written nowhere."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def ignore(df: DataFrame) -> None:
    """Compute all rows and drop them."""
    df.write.format("noop").mode("overwrite").save()


def observe(df: DataFrame, name: str = "rows"):
    """The frame with a row counter that is filled when it runs: (frame, observation)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def peek(df: DataFrame, n: int = 1) -> tuple[DataFrame, list]:
    """The frame as it is, and its first n rows."""
    return df, df.take(n)


def profile(df: DataFrame) -> DataFrame:
    """Run the frame and return what Spark measured: (place, depth, operator, metric, value), one row a counter that moved."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    rows: list[tuple] = []

    def walk(node, depth: int) -> None:
        place = len({r[0] for r in rows})
        name = node.nodeName()
        counters = node.metrics().iterator()
        while counters.hasNext():
            metric = counters.next()._2()
            if metric.value() > 0:
                rows.append((place, depth, name, metric.name().get(), metric.value()))
        inner = [node.plan()] if name.endswith("QueryStage") else [node.executedPlan()] if name == "AdaptiveSparkPlan" else []
        below = node.children()
        for child in inner or [below.apply(k) for k in range(below.size())]:
            walk(child, depth + 1)

    walk(execution.executedPlan(), 0)
    return df.sparkSession.createDataFrame(rows, "place int, depth int, operator string, metric string, value long")
