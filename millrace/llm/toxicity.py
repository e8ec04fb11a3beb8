"""Operator 8: toxicity by the nearest labelled examples, with exact TF-IDF cosine and block-max inverted lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.labelled import class_weights, corpus_counts, held_out, label_share, labelled_sample, monotone
from millrace.llm.words import map_texts, plain_words, words_of

PREFIX = 5  # bytes; a word and its first bytes are both terms, so inflected forms meet


def row_terms(texts: pa.Array, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count), sorted by row and term. A term is a hash, or its place in a sorted vocabulary.

    With a vocabulary, the number of all words of the row is the count of one further term, numbered
    after it, which stands for the text's length; rows with no term of the vocabulary are left out.
    """
    words = words_of(texts, plain_words(), PREFIX)
    row = np.repeat(np.arange(len(texts)), np.diff(words.first))
    rows, terms = np.concatenate([row, row]), np.concatenate([words.hash, words.head])
    if vocabulary is not None:
        low = (vocabulary & np.uint64(0xFFFF)).astype(np.int64)
        sieve = np.zeros(1 << 16, bool)
        sieve[low] = True
        some = np.flatnonzero(sieve[(terms & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(vocabulary, terms[some])
        at[at == len(vocabulary)] = 0
        same = vocabulary[at] == terms[some] if len(vocabulary) else np.zeros(len(some), bool)
        size = len(vocabulary) + 1
        key, n = np.unique(rows[some][same] * size + at[same], return_counts=True)
        known = np.unique(key // size)
        rest = np.diff(words.first)[known]
        key, n = np.concatenate([key, known * size + size - 1]), np.concatenate([n, np.maximum(rest, 1)])
        order = np.argsort(key)
        return key[order] // size, key[order] % size, n[order]
    order = np.lexsort((terms, rows))
    rows, terms = rows[order], terms[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])])) if len(rows) else np.empty(0, np.int64)
    return rows[new], terms[new], np.diff(np.append(new, len(rows)))


@dataclass
class BlockMaxIndex:
    """Unit TF-IDF vectors of labelled examples, in blocks; for each term its weights by block and the largest of each block."""

    ids: list  # of the examples, in order
    y: np.ndarray
    blocks: list[tuple[int, np.ndarray, np.ndarray]]  # first example, sorted terms, weights (term x example)
    top: np.ndarray  # term x block

    @classmethod
    def build(cls, ids: list, y: np.ndarray, x: np.ndarray, size: int) -> "BlockMaxIndex":
        """Examples with the same leading term lie together, so that block maxima are tight."""
        lead = x[:, :-1].argmax(axis=1) if x.shape[1] > 1 else np.zeros(len(x), np.int64)
        order = np.lexsort((np.arange(len(x)), -x.max(axis=1, initial=0), lead))
        x, y, ids = x[order], y[order], [ids[k] for k in order]
        blocks, tops = [], []
        for at in range(0, len(x), size):
            part = x[at : at + size]
            terms = np.flatnonzero(part.any(axis=0))
            blocks.append((at, terms, part[:, terms].T.copy()))
            tops.append(part.max(axis=0))
        return cls(ids, y, blocks, np.array(tops).T.reshape(x.shape[1], len(blocks)))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, nearest first, ties by order. Blocks whose
        bound is below the k-th cosine so far are skipped; the rest are computed exactly."""
        bound = weights @ self.top[terms]
        which, cosine = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(cosine) == k and bound[b] < cosine[-1] - 1e-9:
                break
            at, own, lists = self.blocks[b]
            place = np.searchsorted(own, terms)
            place[place == len(own)] = 0
            have = own[place] == terms
            dot = weights[have] @ lists[place[have]]
            some = np.flatnonzero(dot > 0)
            some = some[some + at != without]
            which, cosine = np.concatenate([which, some + at]), np.concatenate([cosine, dot[some]])
            best = np.lexsort((which, -np.round(cosine, 12)))[:k]
            which, cosine = which[best], cosine[best]
        return which, cosine


@dataclass
class Model:
    vocabulary: np.ndarray
    idf: np.ndarray
    index: BlockMaxIndex
    one: float  # weight of a label 1 against a label 0, which gives both their shares among all labels
    k: int
    share: float  # of label 1
    none: float  # score of a text without terms
    knots: tuple[np.ndarray, np.ndarray]

    def vectors(self, texts: pa.Array):
        """Unit vectors of texts with known terms: (row, terms, weights)."""
        rows, terms, n = row_terms(texts, self.vocabulary)
        cut = np.flatnonzero(np.diff(rows)) + 1
        for r, t, c in zip(np.split(rows, cut), np.split(terms, cut), np.split(n, cut), strict=True):
            if len(r):
                w = (1 + np.log(c)) * self.idf[t]
                yield int(r[0]), t, w / np.sqrt(w @ w)

    def vote(self, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of label 1 among the neighbours, each weighted by how close it is; the overall share counts as a little of one neighbour."""
        which, cosine = self.index.nearest(terms, weights, self.k, without)
        y = self.index.y[which]
        w = cosine**4 * np.where(y == 1, self.one, 1.0)
        return float((w @ y + 0.01 * self.share) / (w.sum() + 0.01)), which, cosine


def _sample_terms(sample: DataFrame, vocabulary: np.ndarray):
    """(ids, y, document of each term, terms, counts) of the sampled documents over a vocabulary, in the order of their ids; made on the executors."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            texts = batch.column("text")
            rows, terms, counts = row_terms(texts.fill_null("") if texts.null_count else texts, vocabulary)
            cut = np.searchsorted(rows, np.arange(n + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), batch.column("y"), *lists], ["id", "y", "terms", "counts"])

    out = sample.select(F.col("_id").cast("string").alias("_id"), "text", "y").mapInArrow(run, "id string, y int, terms array<long>, counts array<long>")
    table = out.toArrow().combine_chunks()
    ids = table.column("id").to_pylist()
    order = np.argsort(np.array(ids, dtype=str), kind="stable")  # whatever order the tasks ended in
    if not len(ids):
        return [], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    table = table.take(order).combine_chunks()
    lists = table.column("terms").chunk(0)
    doc = np.repeat(np.arange(len(ids)), np.array(lists.value_lengths()))
    terms, counts = (np.array(table.column(c).chunk(0).flatten()).astype(np.int64) for c in ("terms", "counts"))
    return [ids[k] for k in order], np.array(table.column("y").to_pylist(), np.int64), doc, terms.view(np.uint64), counts


def term_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, documents with label 1, documents) of the sample's terms that three documents or more have; summed by Spark."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            rows, terms, _ = row_terms(texts.fill_null("") if texts.null_count else texts)
            key, at = np.unique(terms, return_inverse=True)
            ones = np.bincount(at, np.array(batch.column("y"))[rows], len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ones), pa.array(np.bincount(at, minlength=len(key)))], ["term", "ones", "n"])

    counted = sample.select("text", "y").mapInArrow(run, "term long, ones long, n long").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    table = counted.where("n >= 3").toArrow()
    term, ones, n = (np.array(table.column(c).to_numpy()).astype(np.int64) for c in ("term", "ones", "n"))
    return term.view(np.uint64), ones, n


def choose_terms(terms: np.ndarray, ones: np.ndarray, n: np.ndarray, n0: int, n1: int, least: float) -> np.ndarray:
    """The terms that tell the labels apart: those whose document counts have a log-likelihood ratio over `least`; sorted."""
    total = n0 + n1
    with np.errstate(divide="ignore", invalid="ignore"):
        cells = ((ones, n * n1 / total), (n - ones, n * n0 / total), (n1 - ones, (total - n) * n1 / total), (n0 - (n - ones), (total - n) * n0 / total))
        g = 2 * sum(np.where(o > 0, o * np.log(o / e), 0) for o, e in cells)
    return np.sort(terms[g > least])


def fit(df: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 2000, examples: int = 6000, least_ratio: float = 28.0, k: int = 15, block: int = 64) -> Model:
    """Choose terms on at most `per_class` documents of each label and index at most `examples` of each (documented
    bounds). Document counts of the terms cover all texts."""
    sample = labelled_sample(df, labels, label, per_class, id_col=id_col, text_col=text_col)
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    vocabulary = choose_terms(*term_counts(sample), sizes.get(0, 0), sizes.get(1, 0), least_ratio)

    def make():
        def fn(texts):
            return np.bincount(row_terms(texts, vocabulary)[1], minlength=len(vocabulary) + 1)

        return fn

    seen, total = corpus_counts(df, text_col, len(vocabulary) + 1, make)
    seen[-1] = total  # every text has a length
    idf = np.log((1 + total) / (1 + seen)) + 1
    ids, y, doc, terms, counts = _sample_terms(labelled_sample(df, labels, label, examples, id_col=id_col, text_col=text_col), vocabulary)
    x = np.zeros((len(y), len(idf)), np.float32)
    x[doc, terms.astype(np.int64)] = (1 + np.log(counts)) * idf[terms.astype(np.int64)]
    norm = np.sqrt((x * x).sum(axis=1))
    has = norm > 0
    share = label_share(labels, label, id_col)
    weight = class_weights(y, share) if len(y) else np.empty(0)
    none = float(weight[~has] @ y[~has] / weight[~has].sum()) if (~has).any() else share
    index = BlockMaxIndex.build([ids[j] for j in np.flatnonzero(has)], y[has], x[has] / norm[has][:, None], block)
    model = Model(vocabulary, idf, index, weight[y.argmax()] / weight[y.argmin()] if 0 < y.sum() < len(y) else 1.0, k, share, none, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    votes = []
    for first, own, lists in index.blocks:  # each example against the others
        for j in range(lists.shape[1]):
            some = lists[:, j] > 0
            votes.append(model.vote(own[some], lists[some, j], first + j)[0])
    if votes:
        model.knots = monotone(np.array(votes), index.y.astype(float), np.where(index.y == 1, model.one, 1.0))
    return model


def toxicity(df: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5, **options) -> DataFrame:
    """Score every whole text: the columns `keep` (all by default), score double, predicted int, evidence.

    The score is the share of label 1 among the `k` nearest labelled examples, weighted by TF-IDF
    cosine and calibrated on the examples themselves, each against the others. Terms are words
    and their first bytes, chosen by how well they tell the labels apart. evidence lists the
    nearest examples (id as text, cosine, label). Null, empty and term-free texts get the share
    of label 1 among such examples. Without labels every score is 0. Null ids, repeated rows
    and further columns are kept; score, predicted and evidence replace columns of these names.
    """
    model = df.sparkSession.sparkContext.broadcast(fit(df, labels, label=label, id_col=id_col, text_col=text_col, **options))

    def make():
        m = model.value

        def fn(texts):
            score, near = np.full(len(texts), m.none), [[] for _ in range(len(texts))]
            for r, terms, weights in m.vectors(texts):
                vote, which, cosine = m.vote(terms, weights)
                score[r] = np.interp(vote, *m.knots)
                near[r] = [{"id": m.index.ids[j], "cosine": c, "label": int(m.index.y[j])} for j, c in zip(which[:3].tolist(), cosine[:3].tolist(), strict=True)]
            score = np.clip(score, 0.0, 1.0)
            kind = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(near, kind)]

        return fn

    fields = "score double, predicted int, evidence array<struct<id string, cosine double, label int>>"
    return map_texts(df, text_col, df.columns if keep is None else keep, fields, make)


def toxicity_scores(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document."""
    out = toxicity(documents, labels, keep=["doc_id"], **options)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
