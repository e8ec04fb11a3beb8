"""Structured Streaming: watched folders, event-time windows, fan-out, background queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.staging import shared_folder


def watch(spark: SparkSession, path: str, schema, kind: str = "parquet", pattern: str | None = None, files_at_once: int | None = None) -> DataFrame:
    """A stream of the files that appear in a folder."""
    reader = spark.readStream.format(kind).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.load(path)


def interleave(*streams: DataFrame) -> DataFrame:
    """The rows of several streams or tables as one; order between them is not fixed."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def event_windows(df: DataFrame, time: str, width: str, *aggregates: Column, slide: str | None = None, late: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Aggregates by event-time window and keys; on a stream, rows later than `late` are dropped. Works on tables too."""
    rows = df.withWatermark(time, late) if df.isStreaming else df
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(window, *by).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(c for c in out.columns if c != "window"))


def sessions(df: DataFrame, time: str, gap: str, *aggregates: Column, late: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Aggregates by session: runs of events with pauses shorter than `gap`."""
    rows = df.withWatermark(time, late) if df.isStreaming else df
    out = rows.groupBy(F.session_window(time, gap), *by).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *(c for c in out.columns if c != "session_window"))


def deduplicated(df: DataFrame, *keys: str, time: str, late: str = "10 minutes") -> DataFrame:
    """The earliest row of each key; a stream keeps the first that arrives and forgets a key after `late`."""
    if not df.isStreaming:
        best = F.min_by(F.struct(*df.columns), F.col(time))
        return df.groupBy(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))).agg(best.alias("row")).select("row.*")
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def tee(df: DataFrame, *sinks: Callable[[DataFrame], None]) -> StreamingQuery:
    """Give each batch of a stream to several sinks; it is computed once."""

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch)
        batch.unpersist()

    return df.writeStream.foreachBatch(each).start()


def to_completion(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, and return its result as a table in the shared folder.

    Each batch is a folder of its own, so a batch that runs twice is written once. Each call starts afresh.
    With mode "complete" the result is the last batch, else all of them.
    """
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    done: list[str] = []

    def put(batch: DataFrame, number: int) -> None:
        done.append(f"{base}/batch-{number}")
        batch.write.mode("overwrite").parquet(done[-1])

    q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*(done[-1:] if mode == "complete" else dict.fromkeys(done)))


class Jobs:
    """Background queries by number."""

    def __init__(self):
        self.running: dict[int, tuple[StreamingQuery, str]] = {}

    def spawn(self, query: StreamingQuery, description: str = "") -> int:
        number = max(self.running, default=0) + 1
        self.running[number] = (query, description)
        return number

    def list(self) -> list[tuple[int, str, bool]]:
        return [(n, d, q.isActive) for n, (q, d) in self.running.items()]

    def kill(self, number: int) -> None:
        self.running.pop(number)[0].stop()
