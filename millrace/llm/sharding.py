"""Operator 4: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Only DataFrame expressions touch the rows. The driver draws one small matrix of counts
(source partitions x shards) from the partition counts.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import stage_table


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good items among `draws` drawn without replacement: inversion that walks outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = rng.random() - p
    down, up, below, above = mode, mode, p, p
    while left > 0 and (down > low or up < high):
        if down > low:
            below *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= below
            if left <= 0:
                return down
        if up < high:
            above *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= above
            if left <= 0:
                return up
    return mode


def communication_matrix(sources: Sequence[int], targets: Sequence[int], seed: int) -> list[list[int]]:
    """Rows that go from each source to each target under a uniform random permutation.

    Row sums are `sources`, column sums `targets`. Each source draws without replacement from
    the free places of the targets, target by target.
    """
    if sum(sources) != sum(targets):
        raise ValueError("sources and targets hold different numbers of rows")
    rng = random.Random(seed)
    free = list(targets)
    matrix = []
    for size in sources:
        row, rest = [], sum(free)
        for k, places in enumerate(free):
            rest -= places
            row.append(hypergeometric(rng, places, rest, size))
            size -= row[-1]
        free = [a - b for a, b in zip(free, row, strict=True)]
        matrix.append(row)
    return matrix


def shard(df: DataFrame, n_shards: int, *, seed: int = 17, max_sources: int = 16_384, slot_rows: int = 50_000) -> DataFrame:
    """Deal all rows of `df` into `n_shards` shards whose row counts differ by one at most.

    Every column is kept; `shard` (int) and `slot` (long, gapless from 0 in its shard) are
    added and replace columns of these names. Every assignment of rows to places is equally
    likely. Rows are placed by number, never by value: nulls, repeated rows and hot keys are
    like any other row; an empty table gives an empty table. The sources are the input's own
    partitions, merged where they are more than `max_sources`, which bounds the matrix. Each is
    put into a random order and staged with the place of every row in it, so a
    lost executor recomputes the same places. Rows are exchanged once, into ranges of about
    `slot_rows` slots of a shard, so no task holds a whole shard.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.select(F.struct(*names).alias("row"), F.rand(seed).alias("u"), F.rand(seed + 1).alias("v")).coalesce(max_sources)
    # local permutation: the number of a row in its shuffled source
    at = F.monotonically_increasing_id()
    rows = stage_table(rows.sortWithinPartitions("u").select("row", "v", at.alias("at")), "rows")
    part, rank = F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1) + 1
    counted = {r["part"]: r["count"] for r in rows.groupBy(part).count().collect()}  # at most max_sources rows
    n = sum(counted.values())
    if n == 0:
        return rows.select("row.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = sorted(counted)
    targets = [n // n_shards + (k < n % n_shards) for k in range(n_shards)]
    matrix = communication_matrix([counted[k] for k in parts], targets, seed)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    ends = spark.createDataFrame([(k, list(accumulate(row))) for k, row in zip(parts, matrix, strict=True)], schema)
    ends = F.broadcast(ends) if len(parts) * n_shards <= 4_000_000 else ends
    ranges = max(1, -(-targets[0] // slot_rows))

    def dealt(*columns: str) -> DataFrame:
        met = rows.select(*columns, "v", "at", part, rank.alias("rank")).join(ends, "part")
        to = F.size(F.filter("ends", lambda e: e < F.col("rank"))).alias("shard")
        return met.select(*columns, "v", "at", to, F.floor(F.col("v") * ranges).cast("int").alias("range"))

    # second permutation: ranges of a random key, numbered from the rows in the ranges before
    sizes = dealt().groupBy("shard", "range").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("shard", "range", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "range").orderBy("v", "at"))
    out = dealt("row").withColumn("place", place).join(F.broadcast(offsets) if ranges * n_shards <= 1_000_000 else offsets, ["shard", "range"])
    return out.select("row.*", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write a sharded table: one folder for each shard, rows in the order of their slots."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(documents: DataFrame, n_shards: int = 40, **options) -> DataFrame:
    """The digest of a sharding of whole documents: see `shard`. Sizes and checksums are those of the sharded texts. Null texts have size 16 and the checksum of no bytes."""
    out = shard(documents, n_shards, **options)
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    size, crc = (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    return out.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
