"""Words and hashes of Arrow batches against byte-wise Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import words as w

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def texts():
    rnd = random.Random(3)
    odd = ["", None, " a", "A b  C", "x" * 3000, "ab ba\x00c \n\t\x0b q ", "ñandú é", "end", "\n", "ÀB c"]
    return odd + ["".join(rnd.choice("ab \n,Zé9") for _ in range(rnd.randrange(60))) for _ in range(400)]


@pytest.mark.parametrize("segment", [1 << 10, 1 << 17])
def test_words_equal_split(monkeypatch, segment):
    monkeypatch.setattr(w, "SEGMENT", segment)
    w._powers.cache_clear()
    rows = [t for t in texts() if t is None or len(t) < segment]
    got = w.words_of(pa.array(rows), w.spaced_words(), prefix=2)
    seen, heads = {}, {}
    for r, t in enumerate(rows):
        want = (t or "").encode().translate(LOW).split()
        span = range(got.first[r], got.first[r + 1])
        assert len(span) == len(want)
        for k, word in zip(span, want, strict=True):
            assert seen.setdefault(word, got.hash[k]) == got.hash[k]
            assert heads.setdefault(word[:2], got.head[k]) == got.head[k]
    assert len(set(seen.values())) == len(seen)
    w._powers.cache_clear()


def test_plain_words_and_slices():
    rows = ["a-b_c9 É.x", "", "q"]
    got = w.words_of(pa.array(rows), w.plain_words())
    assert np.diff(got.first).tolist() == [5, 0, 1]
    batch = pa.record_batch({"text": pa.array(["x" * 10] * 7 + [None])})
    assert [s.num_rows for s in w.slices(batch, "text", 25)] == [2, 2, 2, 2]
    assert list(w.slices(batch.slice(0, 0), "text")) == []


def test_sliced_arrays_and_single_words():
    a = pa.array(["zz", "a b", "c"]).slice(1)
    got = w.words_of(a, w.spaced_words())
    assert got.first.tolist() == [0, 2, 3]
    assert w.word_hashes(["a", "a b", ""], w.spaced_words())[0] == got.hash[0]
    assert w.word_hashes(["a", "a b", ""], w.spaced_words())[1:].tolist() == [0, 0]


@pytest.mark.parametrize("segment", [8, 64, 1 << 10])
@pytest.mark.parametrize("table", [w.spaced_words, w.plain_words])
def test_words_longer_than_a_segment(monkeypatch, segment, table):
    rnd = random.Random(segment)
    long = "x7" * 700
    rows = [*texts(), long, " " + long + long, "a " + long + " " + "漢字" * 2000 + " b", "漢字" * 2000, "y" * segment, "z" * segment + " q", "y" * segment, "y" * 2 * segment, "y" * 3 * segment]
    rows += ["".join(rnd.choice("ab é漢") for _ in range(rnd.randrange(3 * segment))) for _ in range(50)]
    w._powers.cache_clear()
    whole = w.words_of(pa.array(rows), table(), prefix=5)
    w._powers.cache_clear()
    monkeypatch.setattr(w, "SEGMENT", segment)
    got = w.words_of(pa.array(rows), table(), prefix=5)
    w._powers.cache_clear()
    for name in ("start", "end", "hash", "first", "head"):
        assert getattr(got, name).tolist() == getattr(whole, name).tolist(), name


def test_a_word_of_several_segments_is_one_word(spark):
    from millrace.llm.license_scan import license_scan
    from millrace.llm.lm_score import lm_scores
    from millrace.llm.minhash import near_duplicates

    from .helpers import documents

    w._powers.cache_clear()
    long = "漢字" * 60_000
    got = w.words_of(pa.array(["a " + long, long + " b", "q" * 1_000_000]), w.spaced_words())
    assert np.diff(got.first).tolist() == [2, 2, 1]
    assert got.hash[1] == got.hash[2]
    df = documents(spark, [(1, long), (2, "b " + long + "\n" + "q" * 1_000_000)])
    assert {r["doc_id"]: r["n_words"] for r in license_scan(df).collect()} == {1: 1, 2: 3}
    assert {r["doc_id"]: r["n_words"] for r in lm_scores(df).collect()} == {1: 1, 2: 3}
    assert {r["doc_id"]: r["n_shingles"] for r in near_duplicates(df, width=4).collect()} == {1: 1, 2: 1}
