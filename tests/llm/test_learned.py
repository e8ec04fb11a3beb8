"""Operators 8 and 10: held-out accuracy, exact neighbours, odd rows; and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from millrace.llm import labelled
from millrace.llm.quality import SURFACE, TERMS, Counts, Model, quality, quality_scores, singular_axes
from millrace.llm.queries import queries
from millrace.llm.toxicity import BlockMaxIndex, row_terms, toxicity, toxicity_scores

from .helpers import ODD, documents


@pytest.fixture(scope="module")
def data(spark):
    return {t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels", "benchmark")}


@pytest.mark.parametrize(("score", "label", "least"), [(toxicity_scores, "toxic", 0.95), (quality_scores, "quality", 0.95)])
def test_held_out_accuracy(data, score, label, least):
    got = score(data["documents"], data["labels"]).join(data["labels"], "doc_id").where("held_out").collect()
    assert len(got) > 50
    right = [r["predicted"] == r[label] for r in got]
    assert sum(right) / len(right) >= least
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize(("score", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows_and_missing_labels(spark, score, label):
    docs = documents(spark, ODD)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    got = score(docs, none).collect()
    assert len(got) == len(ODD) and {r["score"] for r in got} == {0.0}
    few = spark.createDataFrame([(4, 1), (4, None), (6, 0), (7, 1), (8, 0), (9, 1), (None, 1)], f"doc_id long, {label} int")
    got = score(docs, few)
    assert set(docs.columns) <= set(got.columns) and got.schema["score"].dataType.simpleString() == "double"
    assert got.count() == len(ODD)
    assert score(docs.limit(0), few).count() == 0


def test_nearest_equals_all_cosines():
    rng = np.random.default_rng(2)
    x = rng.random((300, 40)) * (rng.random((300, 40)) < 0.1)
    x = x[x.any(axis=1)]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    index = BlockMaxIndex.build(list(range(len(x))), np.zeros(len(x), int), x, 16)
    for q in x[:50]:
        terms = np.flatnonzero(q)
        which, cosine = index.nearest(terms, q[terms], 9)
        want = np.sort((x @ q)[x @ q > 0])[::-1][:9]
        assert np.allclose(cosine, want)
        assert np.allclose([x[index.ids[j]] @ q for j in which], want)


def test_terms_of_rows():
    rows, terms, counts = row_terms(pa.array(["a b a", "", "longword longword"]))
    assert counts.sum() == 10 and set(rows.tolist()) == {0, 2}
    vocabulary = np.sort(np.unique(terms))[:2]
    rows, at, counts = row_terms(pa.array(["zzz", "a b a"]), vocabulary)
    assert 0 not in rows.tolist() and at.max() == 2


def test_monotone_regression():
    rnd = random.Random(1)
    x = np.array([rnd.random() for _ in range(200)])
    y = (x + np.array([rnd.random() for _ in range(200)]) > 1).astype(float)
    k, v = labelled.monotone(x, y, np.ones(200))
    assert (np.diff(v) >= 0).all() and (np.diff(k) >= 0).all()
    assert abs(np.interp(x, k, v).mean() - y.mean()) < 0.05


def test_held_out_rule(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long").withColumn("h", labelled.held_out())
    for r in df.collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def _quality_model(n: int = 40, dim: int = 6):
    rnd = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rnd.integers(0, 30, rnd.integers(0, 25))) + "!" * int(rnd.integers(0, 3)) for _ in range(n)]
    c = Counts.of(pa.array(texts))
    idf = 1 + rnd.random(SURFACE + TERMS)
    model = Model(idf, rnd.normal(size=(SURFACE + TERMS, dim)).astype(np.float32), np.zeros((0, dim)), rnd.integers(0, 2, n).astype(float), 1 + rnd.random(n), 5, 0.3, (np.array([0.0, 1.0]),) * 2)
    return texts, c, model


def test_hashed_words_are_counted():
    texts, c, _ = _quality_model()
    for r, t in enumerate(texts):
        assert c.n[c.row == r].sum() == len(t.replace("!", " ").split())
    assert len(Counts.of(pa.array([], pa.string())).row) == 0


def test_latent_vectors_by_hand():
    _, c, model = _quality_model()
    dense = np.zeros((len(model.y), SURFACE + TERMS))
    for r in range(len(dense)):
        length = max(1, c.surface[r].sum())
        x = np.log1p(1000 * c.surface[r] / length) * model.idf[:SURFACE]
        dense[r, :SURFACE] = x / (np.linalg.norm(x) or 1)
        some = c.row == r
        w = (1 + np.log(c.n[some])) * model.idf[SURFACE + c.term[some]]
        dense[r, SURFACE + c.term[some]] = w / (np.linalg.norm(w) or 1)
    assert np.allclose(model.projected(c, model.axes, rows=7), dense @ model.axes, atol=1e-4)
    axes = singular_axes(model, c, 3, rounds=40)
    want = np.linalg.svd(dense, full_matrices=False)[2][:3]
    assert np.allclose(np.abs(np.sum(axes.T * want, axis=1)), 1, atol=1e-3)


def test_votes_by_hand():
    _, c, model = _quality_model()
    model.vectors = model.latent(c)
    model.vectors[7] = model.vectors[3]  # a tie
    z = model.latent(c)
    got = model.votes(z, rows=9)
    for r, v in enumerate(z):
        cosine = np.round(model.vectors @ v, 5)
        near = cosine >= np.sort(cosine)[-model.k]
        w = np.clip(cosine, 0, None) ** 8 * model.weight * near
        assert np.isclose(got[r], (w @ model.y + 1e-3 * model.share) / (w.sum() + 1e-3), atol=1e-4)


def test_stages_with_odd_rows(spark):
    """Null, empty, repeated and word-free rows and null ids pass every stage; copies and only they go in the third."""
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, ODD).select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        out = stage(spark, docs, sf).collect()
        if name in ("toxicity", "decontamination", "bpe"):
            assert len(out) == len(ODD), name
        if name == "near_duplicates":  # one of 4 and 5 goes; both rows of one id stay
            assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == [1, 2, 3, 4, 6, 7, 7, 8, 9]
            assert sum(r["doc_id"] is None for r in out) == 1
        if name == "bpe":
            assert all(r["round_trip"] for r in out)


def test_one_text_an_id_is_learned_from(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in (1, 2)], "doc_id long, toxic int")
    got = labelled.labelled_sample(docs, labels, "toxic", 10).collect()
    assert len(got) == len({r["_id"] for r in got}) and {(r["_id"], r["text"]) for r in got} <= {(1, "a"), (2, "c")}


def test_pipeline(spark, data):
    docs = data["documents"]
    columns = docs.columns
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], "/root/testdata/sf0.01").cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            assert out.count() < kept[-1].count()
        kept.append(out)
    assert kept[-1].count() == kept[-2].count() and kept[-1].where("not round_trip").count() == 0
    n = [x.count() for x in kept]
    bad = data["labels"].where("toxic = 1 or quality = 0").count()
    assert n[0] - n[2] < 2.5 * bad  # clean documents stay


def test_all_queries_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
