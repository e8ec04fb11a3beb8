"""Labelled samples, monotone calibration and corpus counts for the two nearest-neighbour scorers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import slices


def held_out(id_col: str = "doc_id"):
    """True for the fold that is never learned from: crc32 of the id as text, modulo 5, is 0. False for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, per_class: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of labelled documents outside the held-out fold, `per_class` labels at most for each of 0 and 1.

    The sample is the labels with the smallest hash of their id, so it is the same at every
    run. An id labelled twice counts as 1 if any label is 1; of several texts with one id, the least
    counts. Ids and labels that are null do not count.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(some[0].unionByName(some[1]))  # 2 * per_class rows at most
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(sample, "_id").groupBy("_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def corpus_counts(df: DataFrame, text_col: str, size: int, make) -> tuple[np.ndarray, int]:
    """Over all rows: in how many texts each of `size` features occurs, and the number of texts.

    `make()` returns a function from a string array to a count of rows per feature. The result has
    `size` numbers, however large the corpus; tasks send partial sums.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, total, n = make(), np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                for at in range(0, part.num_rows, 256):
                    texts = part.slice(at, 256).column("text")
                    total[:size] += fn(texts.fill_null("") if texts.null_count else texts)
                    n += len(texts)
        total[size] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(total)], ["feature", "n"])

    rows = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "feature long, n long")
    out = np.zeros(size + 1, np.int64)
    for r in rows.groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]
    return out[:size], int(out[size])


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted monotone regression (pool adjacent violators) of y on x, as knots for np.interp."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # lowest x, highest x, weight, mean
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        if blocks and blocks[-1][1] == a:
            last = blocks[-1]
            last[3] = (last[3] * last[2] + b * c) / (last[2] + c)
            last[2] += c
        else:
            blocks.append([a, a, c, b])
        while len(blocks) > 1 and blocks[-2][3] >= blocks[-1][3]:
            high = blocks.pop()
            low = blocks[-1]
            low[3] = (low[3] * low[2] + high[3] * high[2]) / (low[2] + high[2])
            low[1], low[2] = high[1], low[2] + high[2]
    knots = [(k, b[3]) for b in blocks for k in ((b[0], b[1]) if b[1] > b[0] else (b[0],))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


def class_weights(y: np.ndarray, share: float) -> np.ndarray:
    """Weights that give label 1 the share it has among all labels."""
    ones = max(1, int(y.sum()))
    zeros = max(1, len(y) - int(y.sum()))
    return np.where(y == 1, share / ones, (1 - share) / zeros) * len(y)


def label_share(labels: DataFrame, label: str, id_col: str = "doc_id") -> float:
    """The share of 1 among the labels that may be learned from; 0 without any."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    return float(known.agg(F.avg((F.col(label) > 0).cast("double")).alias("m")).first()["m"] or 0.0)
