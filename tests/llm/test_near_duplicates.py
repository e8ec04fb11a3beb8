"""Operators 3 and 6 against comparing all pairs."""

import random

import numpy as np
import pytest

from millrace.llm import minhash
from millrace.llm.components import connected_components
from millrace.llm.embedding_dedup import near_duplicate_vectors, rotation
from millrace.llm.minhash import drop_near_duplicates, near_duplicates

from .helpers import ODD, Groups, documents
from .helpers import near_duplicates as brute


def check(spark, rows, width):
    got = near_duplicates(documents(spark, rows), width=width).collect()
    want = brute(rows, width, 80)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_odd_rows_and_empty_table(spark):
    check(spark, ODD, 4)
    assert near_duplicates(documents(spark, ODD).limit(0), width=4).count() == 0
    kept = drop_near_duplicates(documents(spark, ODD), width=4)
    assert kept.columns == documents(spark, ODD).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 7, 8, 9]


def corpus(seed, n):
    """Copies, near copies in chains, a shared passage with long and short rests, and texts near the threshold."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(5000)}"
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(rnd.randrange(3, 160))] for _ in range(n // 8)]
    out = []
    for i in range(n):
        kind = rnd.randrange(6)
        if kind == 0:
            t = list(rnd.choice(base))
        elif kind in (1, 2):
            t = list(rnd.choice(base))
            for _ in range(rnd.randrange(1, 5)):
                t[rnd.randrange(len(t))] = word()
            if kind == 2:
                base.append(t)
        elif kind == 3:
            t = passage + [word() for _ in range(rnd.randrange(0, 40))]
        else:
            t = [word() for _ in range(rnd.randrange(1, 120))]
        out.append((i * 3, " ".join(t)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpus(spark, seed):
    check(spark, corpus(seed, 500), 4)


def test_long_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_LIST", 8)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    check(spark, corpus(7, 400), 4)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 161)} | {5: 5} | {k: 5 for k in range(200, 260)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(600):
        v = base[rng.integers(40)] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25, 0.6])
        rows.append((i * 2, v.astype(np.float32).tolist(), int(rng.integers(3))))
    rows += [(2001, None, 1), (2003, [], 1), (2005, [0.0] * 16, 1), (2007, [float("nan")] * 16, 1), (2009, rows[0][1], None), (2011, [None] * 16, 1), (2013, [1.0] * 8, 1), (2015, [1.0] * 8, 1), (2017, [float("inf")] * 16, 0), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(i, v, y, 1.0) for i, v, y in rows], "vec_id long, embedding array<float>, label int, m double")
    got = near_duplicate_vectors(df, block=64).collect()
    assert len(got) == len(rows)
    ok = [(i, np.array(v, float), y) for i, v, y in rows if i is not None and v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    groups, links = Groups(), {}
    for a, (i, u, y) in enumerate(ok):
        for j, v, z in ok[a + 1 :]:
            if y == z and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                groups.join(i, j)
    assert sum(links.values()) > 500
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        else:
            assert (r["n_links"], r["component_id"]) == (links.get(r["vec_id"], 0), groups.find(r["vec_id"])), r
            assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_rotation_is_orthogonal():
    q = rotation(24, 3)
    assert np.allclose(q @ q.T, np.eye(24))
