"""Operator 7: licence scans by an exact set-similarity join of text blocks with licence templates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import field_type
from millrace.llm.words import merged, plain_words, slices, text_bytes, word_hashes, words_of

#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices of public licences, one label each.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-release", "Released under the MIT License"),
    ("mit-warranty", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib-notice", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
)


@dataclass
class Template:
    label: str
    tokens: frozenset[int]  # hashes of the distinct words
    size: int  # words


def templates(texts=TEMPLATES) -> list[Template]:
    words = words_of(pa.array([t for _, t in texts], pa.string()), plain_words())
    return [Template(label, frozenset(words.hash[words.first[k] : words.first[k + 1]].tolist()), int(words.first[k + 1] - words.first[k])) for k, (label, _) in enumerate(texts)]


def word_blocks(batch: pa.RecordBatch, text: str):
    """Words of a batch, and for each word the number of its block. A block is a line; a row starts a new one."""
    raw, rows = text_bytes(batch.column(text))
    words = words_of(batch.column(text), plain_words())
    breaks = merged(np.flatnonzero(raw == 10), rows)
    return words, np.searchsorted(breaks, words.start, "right")


def line_breaks(words, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words that start a line right after another line with words, words that start a paragraph). A line without words, or a new row, ends a paragraph."""
    step = np.diff(block, prepend=-2)
    step[words.first[:-1][np.diff(words.first) > 0]] = 2
    return np.flatnonzero(step == 1), np.flatnonzero(step > 1)


def token_order(df: DataFrame, text_col: str, wanted: list[Template]) -> dict[int, int]:
    """How many words of the whole corpus equal each template token. The result has one entry per template token, however large the corpus."""
    tokens = np.array(sorted({t for x in wanted for t in x.tokens}), np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                h = words_of(part.column("text"), plain_words()).hash
                at = np.searchsorted(tokens, h)
                at[at == len(tokens)] = 0
                total += np.bincount(at[tokens[at] == h], minlength=len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tokens))), pa.array(total)], ["token", "n"])

    counted = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    out = dict.fromkeys(tokens.tolist(), 0)
    out.update({int(tokens[r["token"]]): r["n"] for r in counted})
    return out


class Matcher:
    """Finds every block that contains at least `threshold` of a template's distinct words.

    Tokens are in ascending order of corpus frequency, so a block that holds ceil(t * |T|) tokens of T
    has one of the first |T| - ceil(t * |T|) + 1 of them (prefix filter). It needs that many
    distinct words (length filter), and as many as are missing can still come after the
    first match in the order (positional filter). Survivors are counted exactly.
    """

    def __init__(self, wanted: list[Template], counts: dict[int, int], threshold: float):
        self.wanted = wanted
        self.need = [max(1, math.ceil(threshold * len(t.tokens) - 1e-9)) for t in wanted]
        order = {t: k for k, t in enumerate(sorted(counts, key=lambda t: (counts[t], t)))}
        self.sorted = [sorted(t.tokens, key=order.__getitem__) for t in wanted]
        self.prefix: dict[int, list[tuple[int, int]]] = {}  # token -> (template, position)
        for k, tokens in enumerate(self.sorted):
            for p in range(len(tokens) - self.need[k] + 1 if tokens else 0):
                self.prefix.setdefault(tokens[p], []).append((k, p))
        self.keys = np.array(sorted(self.prefix), np.uint64)
        low = np.zeros(1 << 16, bool)  # a first sieve by the low bits
        low[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.low = low

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Positions in h of prefix tokens."""
        at = np.flatnonzero(self.low[(h & np.uint64(0xFFFF)).astype(np.int64)])
        return at[np.isin(h[at], self.keys)]

    def block(self, tokens: list[int]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the block meets."""
        have = set(tokens)
        tried: set[int] = set()
        found = []
        for token in have & self.prefix.keys():
            for k, p in self.prefix[token]:
                size, need = len(self.sorted[k]), self.need[k]
                if k in tried or len(have) < need:
                    continue
                tried.add(k)
                first = next(q for q, t in enumerate(self.sorted[k]) if t in have)
                if size - first < need:
                    continue
                common = len(have & self.wanted[k].tokens)
                if common >= need:
                    found.append((k, common / size))
        return found


    def wrapped(self, h: np.ndarray, breaks: np.ndarray, paragraphs: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float]]:
        """(template, start of the last stretch with all its words, containment) of templates that run over line breaks.

        The block of a break and a template holds as many words on either side as the template has, in
        one paragraph: every wrapped notice of that many words lies in the block of any break inside it.
        `at` has the positions of prefix tokens. Of blocks that overlap, the fullest is returned.
        """
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        ends = np.append(paragraphs, len(h))
        tried = set()
        for p in at.tolist():
            for k, _ in self.prefix[int(h[p])]:
                n = self.wanted[k].size
                for e in breaks[np.searchsorted(breaks, p - n, "right") : np.searchsorted(breaks, p + n, "right")].tolist():
                    if (k, e) in tried:
                        continue
                    tried.add((k, e))
                    j = int(np.searchsorted(ends, e, "right"))
                    lo, hi = max(e - n, int(ends[j - 1])), min(e + n, int(ends[j]))
                    tokens = h[lo:hi].tolist()
                    common = len(self.wanted[k].tokens.intersection(tokens))
                    if common >= self.need[k]:
                        last = {t: q for q, t in enumerate(tokens) if t in self.wanted[k].tokens}
                        found[k, e] = common / len(self.sorted[k]), lo + min(last.values()), hi
        out: list[tuple[int, int, float]] = []
        taken: list[tuple[int, int, int]] = []
        for (k, _), (share, lo, hi) in sorted(found.items(), key=lambda x: (-x[1][0], x[0])):
            if not any(k == t and lo < z and a < hi for t, a, z in taken):
                taken.append((k, lo, hi))
                out.append((k, lo, share))
        return out


def _phrase_places(words, phrases: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each phrase: (rows, word positions in the row) of all its places."""
    h, first = words.hash, words.first
    out = []
    for p in phrases:
        at = np.flatnonzero(h == p[0])
        at = at[at + len(p) <= len(h)]
        for j in range(1, len(p)):
            at = at[h[at + j] == p[j]]
        row = np.searchsorted(first, at, "right") - 1
        inside = at + len(p) <= first[row + 1]
        out.append((row[inside], (at - first[row])[inside]))
    return out


def license_scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, phrases=PHRASES, texts=TEMPLATES) -> DataFrame:
    """Scan every whole text for licence phrases and for blocks like licence notices: lines, and
    the words around each line break inside a paragraph, so that a hard-wrapped notice is found.

    Returns, per input row: id_col, n_words, n_base (places of all phrases), first_word and
    last_word (smallest and largest start, null without a place), base_labels, labels
    (phrase and template labels, distinct, sorted, comma-joined), score (1 with a phrase, else the
    largest containment found, else 0) and blocks (template label, block number, first word,
    containment of every block at or over `threshold`; for a notice over several lines the line and
    place where its words start, unless one of its lines has as much). Null and empty texts have no words and
    empty label strings; null ids and repeated rows are kept; other columns are ignored.
    The word order comes from one count over the whole corpus; templates are a fixed list,
    so all that is broadcast has a fixed size.
    """
    wanted = templates(texts)
    shared = df.sparkSession.sparkContext.broadcast((wanted, token_order(df, text_col, wanted)))
    phrase_hashes = [word_hashes(p.split(), plain_words()) for p, _ in phrases]
    id_type = field_type(df, id_col)
    schema = f"id {id_type.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label string, block long, word long, containment double>>"
    block_type = pa.list_(pa.struct([("label", pa.string()), ("block", pa.int64()), ("word", pa.int64()), ("containment", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*shared.value, threshold)
        for batch in batches:
            for part in slices(batch, "text"):
                words, block = word_blocks(part, "text")
                n = part.num_rows
                places: list[list[int]] = [[] for _ in range(n)]
                base: list[set[str]] = [set() for _ in range(n)]
                for (_, label), (row, at) in zip(phrases, _phrase_places(words, phrase_hashes), strict=True):
                    for r, p in zip(row.tolist(), at.tolist(), strict=True):
                        places[r].append(p)
                        base[r].add(label)
                found: list[list[dict]] = [[] for _ in range(n)]
                at = matcher.hits(words.hash)
                for b in np.unique(block[at]).tolist():
                    k0, k1 = np.searchsorted(block, b), np.searchsorted(block, b, "right")
                    r = int(np.searchsorted(words.first, k0, "right")) - 1
                    for k, share in matcher.block(words.hash[k0:k1].tolist()):
                        found[r].append({"label": wanted[k].label, "block": int(b - block[words.first[r]]), "word": int(k0 - words.first[r]), "containment": share})
                breaks, paragraphs = line_breaks(words, block)
                for k, w, share in matcher.wrapped(words.hash, breaks, paragraphs, at):
                    r = int(np.searchsorted(words.first, w, "right")) - 1
                    b, n_words = int(block[w] - block[words.first[r]]), wanted[k].size
                    label, w = wanted[k].label, int(w - words.first[r])
                    if not any(x["label"] == label and x["containment"] >= share and b <= x["block"] and x["word"] < w + 2 * n_words for x in found[r]):
                        found[r].append({"label": label, "block": b, "word": w, "containment": share})
                score = [1.0 if places[r] else max((x["containment"] for x in found[r]), default=0.0) for r in range(n)]
                columns = [
                    part.column("id"),
                    pa.array(np.diff(words.first)),
                    pa.array([len(x) for x in places], pa.int64()),
                    pa.array([min(x, default=None) for x in places], pa.int64()),
                    pa.array([max(x, default=None) for x in places], pa.int64()),
                    pa.array([",".join(sorted(x)) for x in base], pa.string()),
                    pa.array([",".join(sorted(x | {y["label"] for y in f})) for x, f in zip(base, found, strict=True)], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array([sorted(f, key=lambda y: (y["block"], y["label"])) for f in found], block_type),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_col)
