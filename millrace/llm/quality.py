"""Operator 10: quality by votes of the nearest labelled texts in a latent semantic space."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.labelled import class_weights, corpus_counts, held_out, label_share, labelled_sample, monotone
from millrace.llm.words import map_texts, plain_words, spaced_words, text_bytes, words_of

CLASSES = 39
EXTRA = 8
SURFACE = CLASSES * CLASSES + EXTRA
TERMS = 4096  # hashed words


def _byte_classes() -> np.ndarray:
    """Byte -> class: letters by case, digits, white space, non-ASCII bytes, other control bytes; each ASCII mark is its own class."""
    table = np.full(256, 6, np.uint8)
    table[[0x20, 0x09]] = 0
    table[[0x0A, 0x0D]] = 1
    table[97:123] = 2
    table[65:91] = 3
    table[48:58] = 4
    table[128:] = 5
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    table[marks] = np.arange(7, 7 + len(marks))
    return table


_TABLE = _byte_classes()


def surface_counts(texts: pa.Array) -> np.ndarray:
    """Row x feature counts: pairs of neighbouring byte classes, and how often words repeat."""
    raw, rows = text_bytes(texts)
    n = len(texts)
    out = np.zeros((n, SURFACE), np.float32)
    kinds = _TABLE[raw].astype(np.int32)
    row = np.repeat(np.arange(n), np.diff(rows))
    if len(raw) > 1:
        inside = row[1:] == row[:-1]
        key = row[1:][inside] * (CLASSES * CLASSES) + kinds[:-1][inside] * CLASSES + kinds[1:][inside]
        out[:, : CLASSES * CLASSES] = np.bincount(key, minlength=n * CLASSES * CLASSES).reshape(n, -1)
    words = words_of(texts, spaced_words())
    h, size = words.hash, np.diff(words.first)
    owner = np.repeat(np.arange(n), size)
    at = CLASSES * CLASSES
    for k, gap in enumerate((1, 2, 3)):  # a word equal to the one before it, before that, ...
        if len(h) > gap:
            same = (h[gap:] == h[:-gap]) & (owner[gap:] == owner[:-gap])
            out[:, at + k] = np.bincount(owner[gap:][same], minlength=n)
    order = np.lexsort((h, owner))
    again = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1]) if len(h) > 1 else np.empty(0, bool)
    out[:, at + 3] = np.bincount(owner[order][1:][again], minlength=n) if len(again) else 0
    out[:, at + 4] = size
    long = words.end - words.start
    out[:, at + 5] = np.bincount(owner[long >= 20], minlength=n)
    out[:, at + 6] = np.bincount(owner[long <= 2], minlength=n)
    out[:, at + 7] = size == 0
    return out


@dataclass
class Counts:
    """Features of some texts: surface counts (row x feature), and hashed words as (row, term, count) in the order of rows."""

    surface: np.ndarray
    row: np.ndarray
    term: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> "Counts":
        words = words_of(texts, plain_words())
        row = np.repeat(np.arange(len(texts)), np.diff(words.first))
        key, n = np.unique(row * TERMS + (words.hash >> np.uint64(20)).astype(np.int64) % TERMS, return_counts=True)
        return cls(surface_counts(texts), key // TERMS, key % TERMS, n)

    def present(self) -> np.ndarray:
        """The number of texts that have each feature: the surface ones, then the terms."""
        return np.concatenate([(self.surface > 0).sum(axis=0), np.bincount(self.term, minlength=TERMS)])


@dataclass
class Model:
    idf: np.ndarray  # of the surface features, then of the terms
    axes: np.ndarray  # feature x rank
    vectors: np.ndarray  # example x rank, unit length
    y: np.ndarray
    weight: np.ndarray
    k: int
    share: float
    knots: tuple[np.ndarray, np.ndarray]

    def surface(self, c: Counts) -> np.ndarray:
        """Log counts relative to the text's length, times idf; unit length."""
        length = np.maximum(c.surface.sum(axis=1, keepdims=True), 1)
        x = np.log1p(1000 * c.surface / length) * self.idf[:SURFACE]
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return (x / np.where(norm > 0, norm, 1)).astype(np.float32)

    def terms(self, c: Counts) -> np.ndarray:
        """TF-IDF weights of the terms, in the order of c.term; unit length by text."""
        w = (1 + np.log(c.n)) * self.idf[SURFACE + c.term]
        norm = np.sqrt(np.bincount(c.row, w * w, minlength=len(c.surface)))
        return (w / norm[c.row]).astype(np.float32)

    def projected(self, c: Counts, axes: np.ndarray, rows: int = 1 << 15) -> np.ndarray:
        """Both unit vectors of each text, one after the other, times `axes`."""
        z = self.surface(c) @ axes[:SURFACE]
        w = self.terms(c)
        for at in range(0, len(w), rows):
            row, part = c.row[at : at + rows], axes[SURFACE + c.term[at : at + rows]] * w[at : at + rows, None]
            cut = np.flatnonzero(np.diff(row, prepend=-1))
            z[row[cut]] += np.add.reduceat(part, cut)
        return z

    def latent(self, c: Counts) -> np.ndarray:
        z = self.projected(c, self.axes)
        norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
        return z / np.where(norm > 1e-6, norm, 1)

    def votes(self, z: np.ndarray, rows: int = 256, without: bool = False) -> np.ndarray:
        """Vote of the k nearest examples for each row, in blocks of exact cosine products.

        Cosines count to five decimals; all examples as near as the k-th vote.
        """
        out = np.full(len(z), self.share)
        k = min(self.k, len(self.vectors) - without)
        if k <= 0:
            return out
        for at in range(0, len(z), rows):
            cosine = np.round(z[at : at + rows] @ self.vectors.T, 5)
            if without:
                cosine[np.arange(len(cosine)), at + np.arange(len(cosine))] = -2
            r, near = np.nonzero(cosine >= np.partition(cosine, -k, axis=1)[:, -k][:, None])
            w = np.clip(cosine[r, near], 0, None) ** 8 * self.weight[near]  # far neighbours hardly count
            total, part = (np.bincount(r, x, minlength=len(cosine)) for x in (w, w * self.y[near]))
            out[at : at + rows] = (part + 1e-3 * self.share) / (total + 1e-3)
        return out


def singular_axes(model: Model, c: Counts, rank: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of the examples' weighted features, by subspace iteration from a fixed start."""
    surface, w = model.surface(c), model.terms(c)
    size, n = SURFACE + TERMS, len(surface)
    dense = np.zeros((n, size), np.float32)
    dense[:, :SURFACE] = surface
    dense[c.row, SURFACE + c.term] = w
    q = np.random.default_rng(5).normal(size=(size, min(rank + 16, n, size))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(dense.T @ (dense @ q))[0]
    left, values, right = np.linalg.svd(dense @ q, full_matrices=False)
    return (q @ right.T)[:, :rank].astype(np.float32)


def fit(df: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500, rank: int = 48, k: int = 20) -> Model:
    """Learn from at most `per_class` documents of each label (a documented bound); document counts of the features cover all texts."""
    sample = labelled_sample(df, labels, label, per_class, id_col=id_col, text_col=text_col)

    def make_counts():
        def lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values))

        def fn(texts):
            c = Counts.of(texts)
            surface = pa.FixedSizeListArray.from_arrays(pa.array(c.surface.ravel()), SURFACE).cast(pa.list_(pa.float32()))
            return [surface, lists(c.term.astype(np.int32), c.row, len(texts)), lists(c.n.astype(np.int32), c.row, len(texts))]

        return fn

    named = map_texts(sample.select(F.col("_id").cast("string").alias("_id"), "text", "y"), "text", ["_id", "y"], "counts array<float>, terms array<int>, n array<int>", make_counts)
    table = named.toArrow()
    table = table.take(np.argsort(np.array(table.column("_id").to_pylist(), dtype=str), kind="stable")).combine_chunks() if table.num_rows else table
    y = np.array(table.column("y").to_pylist(), np.float64)

    def make():
        def fn(texts):
            return Counts.of(texts).present()

        return fn

    seen, total = corpus_counts(df, text_col, SURFACE + TERMS, make)
    idf = np.log((1 + total) / (1 + seen)) + 1
    share = label_share(labels, label, id_col)
    model = Model(idf, np.zeros((SURFACE + TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, np.ones(len(y)), k, share, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    if not len(y):
        return model
    flat = {c: np.array(table.column(c).chunk(0).flatten()) for c in ("counts", "terms", "n")}
    sizes = np.array(table.column("terms").chunk(0).value_lengths())
    c = Counts(flat["counts"].reshape(len(y), SURFACE), np.repeat(np.arange(len(y)), sizes), flat["terms"].astype(np.int64), flat["n"])
    model.axes = singular_axes(model, c, rank)
    model.vectors = model.latent(c)
    model.weight = class_weights(y, share)
    model.knots = monotone(model.votes(model.vectors, without=True), y, model.weight)
    return model


def quality(df: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3, **options) -> DataFrame:
    """Score every whole text: the columns `keep` (all by default), score double, predicted int.

    Labelled examples are vectors in a latent space: singular vectors of their TF-IDF weighted
    words (hashed into 4096 terms) beside surface features (pairs of byte classes, repetition). Each
    text is compared with all of them by exact cosine products in blocks; the `k` nearest
    vote, weighted by similarity (all that tie with the k-th, to five decimals), and the vote is calibrated on the
    examples, each against the others. Null and empty texts are scored like any text
    without features: by the overall share. Without labels the score is 0. Null ids, repeated rows and further
    columns are kept; score and predicted replace columns of these names.
    """
    model = df.sparkSession.sparkContext.broadcast(fit(df, labels, label=label, id_col=id_col, text_col=text_col, **options))

    def make():
        m = model.value

        def fn(texts):
            score = np.clip(np.interp(m.votes(m.latent(Counts.of(texts))), *m.knots), 0.0, 1.0)
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return fn

    return map_texts(df, text_col, df.columns if keep is None else keep, "score double, predicted int", make)


def quality_scores(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = quality(documents, labels, keep=["doc_id"], **options)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
