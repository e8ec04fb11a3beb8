"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_tables, stage_table


def connected_components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(id, component) for every id in `links` (a, b): the smallest id reachable, the id itself included.

    Each round lets every id point its larger neighbours, then its smaller ones, to the smallest
    id it knows, until nothing changes; the number of rounds grows with the logarithm of the
    longest path. Both steps are a minimum by key and a join of two staged tables, which Spark
    can split where one id has very many links. Nulls and links of an id to itself are dropped.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    edges = stage_table(links.where(F.col("a") != F.col("b")).select(hi, lo).distinct(), f"{name}-0")
    mark = None
    for k in range(1, rounds + 1):
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if seen == mark:
            break
        mark = seen
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo"), F.col("hi")))
        least = stage_table(both.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{k}a")
        wide = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
        wide = stage_table(wide.distinct(), f"{name}-{k}b")
        least2 = stage_table(wide.groupBy("hi").agg(F.min("lo").alias("m")), f"{name}-{k}c")
        met = wide.join(least2, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        fresh = stage_table(met.unionAll(least2.select("hi", F.col("m").alias("lo"))).distinct(), f"{name}-{k}")
        drop_tables(edges, least, wide, least2)
        edges = fresh
    roots = edges.select(F.col("lo").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("component")).unionByName(roots)


def spanning(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that links (x, y) connect it with."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            return root
        root = new
