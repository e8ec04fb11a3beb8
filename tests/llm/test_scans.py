"""Operators 4, 5, 7 and 9 against brute force."""

import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import license_scan as lic
from millrace.llm import sharding
from millrace.llm.decontaminate import Index, Rules, contaminated, drop_contaminated, masks_of, overlap
from millrace.llm.lm_score import lm_scores, pack, unpack
from millrace.llm.queries import oracle_sql, op5_stupid_backoff
from millrace.llm.sharding import communication_matrix, hypergeometric, shard, shard_digest, write_shards
from millrace.llm.words import plain_words, words_of

from ..oracle import connection, difference
from .helpers import LOW, ODD, documents


# -- 4: sharding --------------------------------------------------------------------------


def test_shards_are_whole_and_even(spark):
    rows = [(i % 50, f"text {i % 7}") for i in range(997)] + ODD
    got = shard_digest(documents(spark, rows).repartition(9), 40, slot_rows=10, max_sources=7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_fewer_rows_than_shards_and_none(spark):
    got = shard(documents(spark, ODD[:3]), 5)
    assert sorted((r["shard"], r["slot"]) for r in got.collect()) == [(0, 0), (1, 0), (2, 0)]
    assert "text" in got.columns
    assert shard(documents(spark, ODD).limit(0), 5).count() == 0


def test_the_digest_is_of_sharded_texts(spark, monkeypatch):
    seen = []

    def spy(df, *args, **options):
        seen.append(df.columns)
        return shard(df, *args, **options).withColumn("text", F.concat("text", F.lit("!")))

    monkeypatch.setattr(sharding, "shard", spy)
    df = documents(spark, [(1, "é" * 300_000), (2, "b")])
    got = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in shard_digest(df, 3).collect()}
    assert seen == [df.columns]  # whole documents
    assert got == {i: (len(t) + 16, zlib.crc32(t)) for i, t in ((1, ("é" * 300_000 + "!").encode()), (2, b"b!"))}


def test_hypergeometric_has_its_law():
    rng = random.Random(1)
    n = 20_000
    seen = Counter(hypergeometric(rng, 6, 9, 5) for _ in range(n))
    for k in range(6):
        p = math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9
    assert hypergeometric(rng, 10**11, 10**11, 10**10) // 10**8 in range(45, 55)


def test_matrix_sums():
    m = communication_matrix([5, 0, 100, 17], [61, 61], 3)
    assert [sum(r) for r in m] == [5, 0, 100, 17] and [sum(c) for c in zip(*m, strict=True)] == [61, 61]
    with pytest.raises(ValueError):
        communication_matrix([1], [2], 0)


def test_ids_named_like_inner_columns(spark):
    docs = documents(spark, [(1, "a b c d e f g h i j k l m n"), (2, "other words")]).withColumnsRenamed({"lang": "_hit", "source": "_gone"})
    items = spark.createDataFrame([(7, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert [r["doc_id"] for r in drop_contaminated(docs, items).collect()] == [2]
    assert drop_contaminated(docs, items, broadcast_rows=0).columns == docs.columns


def test_a_benchmark_in_blocks(spark):
    docs = documents(spark, [(k, f"word{k} a{k} b{k} c{k} d{k} e{k}") for k in range(7)])
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    got = contaminated(docs, items, block_items=2).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(k, k) for k in range(7)]


def test_write_shards(spark, tmp_path):
    write_shards(shard(documents(spark, ODD), 3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ODD) and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_slots_do_not_follow_the_rows(spark):
    got = shard(documents(spark, [(k, "x") for k in range(3000)]).repartition(4, "doc_id"), 3, slot_rows=100).collect()
    for s in range(3):
        mine = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == s)
        ids = [i for _, i in mine]
        mean = sum(ids) / len(ids)
        assert abs(mean - 1500) < 150  # five standard deviations
        rising = sum(a < b for a, b in zip(ids, ids[1:], strict=False)) / len(ids)
        assert 0.4 < rising < 0.6


# -- 5: language model --------------------------------------------------------------------


def test_scores_equal_sql(spark, sf_dir):
    assert difference(op5_stupid_backoff(spark, sf_dir), connection(sf_dir), oracle_sql()["op5_stupid_backoff"]) == ""


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_scores_of_small_texts(spark, orders):
    rows = ODD + [(20, "a b c d"), (21, "a b c e"), (22, "b c d a b c")]
    got = lm_scores(documents(spark, rows), orders=orders, chunk_bytes=2000, bucket_bytes=3000).collect()
    texts = [(t or "").encode().translate(LOW).split() for _, t in rows]
    counts = [Counter(tuple(w[k : k + n]) for w in texts for k in range(len(w) - n + 1)) for n in range(1, 4)]
    total = sum(map(len, texts))

    def score(w, k):
        penalty = 0.0
        for n in range(min(orders, k + 1), 1, -1):
            gram = tuple(w[k - n + 1 : k + 1])
            if counts[n - 1][gram] >= 2:
                return math.log(counts[n - 1][gram] / counts[n - 2][gram[:-1]]) + penalty
            penalty += math.log(0.4)
        return math.log(counts[0][(w[k],)] / total) + penalty

    want = sorted((len(w), round(sum(score(w, k) for k in range(len(w))), 6)) for w in texts)
    assert sorted((r["n_words"], round(r["log_score"], 6)) for r in got) == want
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in got)


def test_no_texts_to_score(spark):
    assert lm_scores(documents(spark, ODD).limit(0)).count() == 0
    assert [r["n_words"] for r in lm_scores(documents(spark, ODD[:3])).collect()] == [0, 0, 0]


def test_packed_keys():
    for keys in ([], [0], [5, 6, 2**64 - 1], list(range(0, 10**6, 997))):
        a = np.array(keys, np.uint64)
        assert unpack(pack(a)).tolist() == a.tolist()


# -- 7: licences --------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def scan(text, threshold=0.8):
    """The contract, and every line against every template."""
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    words = WORD.findall(low)
    places, base = [], set()
    for phrase, label in lic.PHRASES:
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                base.add(label)
    labels, best = set(base), 0.0
    for line in low.split("\n"):
        have = set(WORD.findall(line))
        for label, t in lic.TEMPLATES:
            want = set(WORD.findall(t.lower()))
            if len(have & want) >= threshold * len(want) - 1e-9:
                labels.add(label)
                best = max(best, len(have & want) / len(want))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best


def test_license_scan(spark):
    rnd = random.Random(4)
    rows = list(ODD) + [(30, "Released under the MIT License."), (31, "mit\nlicense"), (32, "MIT license mit license CC BY-NC"), (33, "the license under released mit extra"), (34, "\n\nGNU General Public License v3\n")]
    for k in range(60):
        t = rnd.choice(lic.TEMPLATES)[1].split()
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(len(t))] = "zz"
        rnd.shuffle(t) if k % 3 == 0 else None
        rows.append((100 + k, "Some words.\n" + " ".join(t) + ("\nmore" if k % 2 else "")))
    got = lic.license_scan(documents(spark, rows)).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted(((i, *scan(t)) for i, t in rows), key=key)
    blocks = {r["doc_id"]: r["blocks"] for r in got}
    assert blocks[30][0]["label"] == "mit-release" and blocks[30][0]["word"] == 0
    assert lic.license_scan(documents(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("columns", [24, 72, 80])
def test_wrapped_notices_are_found(spark, columns):
    rows, want = [(-1, "\n".join(["Permission to use, copy, modify, and/or distribute", "", "this software for any purpose with or without fee is hereby granted"]))], {-1: ""}
    for k, (label, t) in enumerate(lic.TEMPLATES):
        for mark, before in (("", ""), ("# ", "# Copyright 2020 by the people of zz\n"), (" * ", "/*\n * zz zz\n *\n")):
            rows.append((100 * k + len(before), before + textwrap.fill(t, columns, initial_indent=mark, subsequent_indent=mark) + "\n zz\n"))
            want[rows[-1][0]] = label
    got = {r["doc_id"]: r for r in lic.license_scan(documents(spark, [(i, t) for i, (_, t) in enumerate(rows)])).collect()}
    for i, (key, t) in enumerate(rows):
        labels = {}
        for x in got[i]["blocks"]:
            labels[x["label"]] = max(x["containment"], labels.get(x["label"], 0))
        assert labels.get(want[key], 0) == 1.0 if want[key] else labels == {}, (t, labels)
        assert got[i]["score"] == (1.0 if want[key] else 0.0) and all(x["word"] >= 0 and x["block"] >= 0 for x in got[i]["blocks"])


# -- 9: decontamination -------------------------------------------------------------------


def brute_overlap(doc, item, rules):
    found = [o for s in range(-len(item), len(doc) + 1) if (o := overlap(doc, item, s, rules))]
    return max(found, key=lambda o: (o[1], o[0], -o[2]), default=None)


def hashes(text):
    return words_of(pa.array([text or ""]), plain_words()).hash


def test_leaks(spark):
    rnd = random.Random(9)
    word = lambda: f"q{rnd.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rnd.choice([3, 8, 12, 20, 50])))) for k in range(60)] + [(100, None), (101, ""), (102, "x"), (103, "é, ü!")]
    rows = list(ODD)
    for k in range(200):
        t = [word() for _ in range(rnd.randrange(80))]
        if k % 2:
            leak = rnd.choice(items[:60])[1].split()
            for _ in range(rnd.randrange(3)):
                leak[rnd.randrange(len(leak))] = "zz"
            leak = leak[: rnd.randrange(3, len(leak) + 1)]
            at = rnd.randrange(len(t) + 1)
            t[at:at] = leak
        rows.append((1000 + k, ", ".join(t).upper()))
    rows += [(5000, "and x too"), (5001, "ü é ü")]
    df, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["best_window"], r["n_equal"], r["first_word"]) for r in contaminated(df, bench).collect()}
    assert got == {(r["doc_id"], r["item_id"]): (r["best_window"], r["n_equal"], r["first_word"]) for r in contaminated(df, bench, block_items=7).collect()}
    rules = Rules()
    want = {}
    for d, t in rows:
        h = hashes(t)
        for i, b in items:
            item = hashes(b)
            if len(item) and (o := brute_overlap(h, item, rules)):
                want[d, i] = o
    assert set(got) <= set(want)
    exact = {k for k, o in want.items() if o[0] == min(13, len(hashes(dict(items)[k[1]])))}
    assert exact <= set(got)  # whole windows always hold a seed
    assert len(got) >= 0.9 * len(want) > 30
    clean = drop_contaminated(df, bench)
    assert clean.count() == len([1 for d, _ in rows if d not in {k[0] for k in got}])
    assert contaminated(df, bench.limit(0)).count() == 0 and contaminated(df.limit(0), bench).count() == 0


def test_any_one_substitution_in_a_window_is_found():
    item = hashes(" ".join(f"w{k}" for k in range(13)))
    index = Index([(0, " ".join(f"w{k}" for k in range(13)))])
    for a in range(13):
        doc = item.copy()
        doc[a] ^= np.uint64(1)
        assert len(index.hits(doc)[0]), a


@pytest.mark.parametrize("rules", [Rules(), Rules(window=9), Rules(share=0.7), Rules(window=20, share=0.9), Rules(share=1.0)])
def test_every_allowed_substitution_has_a_seed(rules):
    for n in range(1, 22):
        width = min(n, rules.window)
        most = width - math.ceil(rules.share * width - 1e-9)
        starts = [{s + p for p in m} for m in masks_of(n, rules) for s in range(width - m[-1])]
        for bad in itertools.combinations(range(width), most):
            assert any(s.isdisjoint(bad) for s in starts), (n, bad)


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(19)
    items = [(n, " ".join(f"i{n}w{k % (n - 1 or 1)}" for k in range(n))) for n in (*range(1, 16), 30)]
    rows = []
    for n, t in items:
        t, rules = t.split(), Rules()
        width = min(13, n)
        for bad in itertools.combinations(range(width), width - math.ceil(0.8 * width - 1e-9)):
            leak = ["zz" if k in bad else w for k, w in enumerate(t[:width])]
            rows.append((len(rows), " ".join([*(f"x{k}" for k in range(rnd.randrange(4))), *leak, "end"])))
    got = {(r["doc_id"], r["item_id"]): (r["best_window"], r["n_equal"], r["first_word"]) for r in contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    held = [(i, hashes(t)) for i, t in items]
    want = {(d, i): o for d, t in rows for h in [hashes(t)] for i, item in held if (o := brute_overlap(h, item, rules))}
    assert len(want) >= len(rows) and got == want
