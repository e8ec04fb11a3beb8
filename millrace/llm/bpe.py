"""Operator 1: BPE encoding by a pair occurrence index, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe_vocab import Vocabulary, piece_words
from millrace.llm.common import field_type
from millrace.llm.pieces import Memo, Pieces, Ragged
from millrace.llm.words import slices

MANY = 32  # positions; longer lists are merged as arrays


def encode_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Encode many words at once: (ids of all words in order, number of ids of each word).

    All symbols of all words lie in one row of positions. An index maps each known pair to
    every position where it starts. Pairs are taken in ascending rank; each merge removes its
    right symbol and enters the two pairs that it forms into the index. Entries whose symbols
    have changed meanwhile are skipped when their list is read. Long lists are merged as
    arrays, short ones one by one.
    """
    raw = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    n = len(raw)
    if not n:
        return np.empty(0, np.int32), size
    first = (np.cumsum(size) - size)[size > 0]
    sym = vocab.byte_table[raw]
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    before[first] = -1
    after[np.append(first[1:], n) - 1] = -1
    rank = np.where(after[:-1] >= 0, vocab.byte_ranks[raw[:-1], raw[1:]], -1)
    where: dict[int, list[int]] = {}  # rank of a pair -> positions where it starts
    _enter(where, [], rank, np.arange(n - 1))
    active = list(where)
    heapify(active)
    rank_of, pairs, base, places_of = vocab.ranks.get, vocab.pairs, vocab.base, where.get
    sym_at, after_at, before_at = memoryview(sym), memoryview(after), memoryview(before)
    while active:
        rank = heappop(active)
        a, b, merged = pairs[rank]
        places = where.pop(rank)
        high = merged * base
        if a != b and len(places) >= MANY:
            p = np.array(places, np.int32)
            p.sort()
            j = after[p]
            fresh = (sym[p] == a) & (j >= 0) & (sym[j] == b)
            fresh[1:] &= p[1:] != p[:-1]
            p, j = p[fresh], j[fresh]
            sym[p], sym[j] = merged, -1
            k = after[j]
            after[p] = k
            right, left = k >= 0, before[p]
            k = k[right]
            before[k] = p[right]
            left = left[left >= 0]
            key = np.concatenate([high + sym[k].astype(np.int64), sym[left].astype(np.int64) * base + merged])
            _enter(where, active, vocab.rank_array(key), np.concatenate([p[right], left]))
            continue
        if a == b:
            places.sort()  # only such pairs can overlap; the leftmost goes first
        for i in places:
            j = after_at[i]
            if sym_at[i] != a or j < 0 or sym_at[j] != b:
                continue
            sym_at[i], sym_at[j] = merged, -1
            k = after_at[i] = after_at[j]
            if k >= 0:
                before_at[k] = i
                rank = rank_of(high + sym_at[k])
                if rank is not None:
                    there = places_of(rank)
                    if there is None:
                        where[rank] = [i]
                        heappush(active, rank)
                    else:
                        there.append(i)
            h = before_at[i]
            if h >= 0:
                rank = rank_of(sym_at[h] * base + merged)
                if rank is not None:
                    there = places_of(rank)
                    if there is None:
                        where[rank] = [h]
                        heappush(active, rank)
                    else:
                        there.append(h)
    left = sym >= 0
    upto = np.concatenate([[0], np.cumsum(left)])
    ends = np.cumsum(size)
    return sym[left], upto[ends] - upto[ends - size]


def _enter(where: dict[int, list[int]], active: list[int], rank: np.ndarray, at: np.ndarray) -> None:
    """Enter positions `at` into the index under the ranks of their pairs, -1 for none."""
    some = np.flatnonzero(rank >= 0)
    if not len(some):
        return
    order = some[np.argsort(rank[some], kind="stable")]
    rank, at = rank[order], at[order].tolist()
    cut = np.flatnonzero(np.diff(rank, prepend=-1)).tolist()
    for r, i, j in zip(rank[cut].tolist(), cut, [*cut[1:], len(at)], strict=True):
        there = where.get(r)
        if there is None:
            where[r] = at[i:j]
            heappush(active, r)
        else:
            there += at[i:j]


class Encoder:
    """Encodes string columns; remembers at most about `limit` ids of pieces and `limit` ids of words."""

    def __init__(self, vocab: Vocabulary, limit: int):
        self.vocab, self.limit = vocab, limit
        self.pieces = Memo(self._coded, limit)
        self.names: dict[str, int] = {}  # word -> its row in self.words
        self.words = Ragged()
        self.tokens = pa.array(vocab.tokens, pa.binary())

    def _coded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces; all their words that are not known yet share one pair occurrence index."""
        cut = [piece_words(p) for p in pieces]
        words = dict.fromkeys(chain.from_iterable(cut))
        if len(self.words.flat) + len(words) > self.limit:
            self.names.clear()
            self.words = Ragged()
        names, special = self.names, self.vocab.specials
        new = [w for w in words if w not in names]
        names.update(zip(new, range(len(self.words.size), len(self.words.size) + len(new)), strict=True))
        self.words.add(*encode_words([w.encode("utf-8", "surrogatepass") for w in new], self.vocab))
        ids, sizes = self.words.take(np.fromiter(map(names.__getitem__, chain.from_iterable(cut)), np.int64))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        size = np.diff(upto[ends], prepend=0)
        for k in [k for k, p in enumerate(pieces) if p in special] if special else ():  # a piece that is a special string
            at = int(size[:k].sum())
            ids, size[k] = np.concatenate([ids[:at], [special[pieces[k]]], ids[at + size[k] :]]), 1
        return ids, size

    def column(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; special strings inside a text become their own id, null gives an empty list."""
        ids, rows = self.pieces.of(Pieces(texts, self.vocab.specials))
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32()))

    def decoded(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids; bytes that are not UTF-8 become U+FFFD."""
        tokens = self.tokens.take(ids.flatten())
        ends = np.concatenate([[0], np.cumsum(np.array(ids.value_lengths().fill_null(0)))])
        _, offsets, data = tokens.buffers()
        at = np.frombuffer(offsets, np.int32, len(tokens) + 1, tokens.offset * 4)[ends] if len(tokens) else np.zeros(len(ends), np.int32)
        raw = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.astype(np.int32).tobytes()), data or pa.py_buffer(b"")])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())

    def texts(self, texts: list[str]) -> list[list[int]]:
        return self.column(pa.array(texts, pa.string())).to_pylist()


_kept: dict[tuple, Encoder] = {}


def encoder_of(vocab: Vocabulary, path: str, limit: int, keep: bool) -> Encoder:
    """An encoder; with `keep`, the one of this Python worker, which later tasks find with its memo."""
    found = _kept.pop((path, limit), None)
    _kept.clear()
    found = found or Encoder(vocab, limit)
    if keep:
        _kept[path, limit] = found
    return found


def decode_ids(ids: list[int], vocab: Vocabulary, skip_special: bool = False) -> str:
    """The text of a list of ids; bytes that are not UTF-8 become U+FFFD."""
    if skip_special:
        special = set(vocab.specials.values())
        ids = [i for i in ids if i not in special]
    return b"".join(map(vocab.tokens.__getitem__, ids)).decode("utf-8", "replace")


def encode(df: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", decode_too: bool = False, keep_text: bool = False, memo: int = 1_000_000, keep_memo: bool = False, batch_bytes: int = 1_000_000) -> DataFrame:
    """Encode every whole text.

    Returns (id_col, ids array<int>[, decoded string][, text_col]), one row per input row. With
    `decode_too` each list of ids is decoded again by the same task, which spares a second
    passage through Python. Null and empty texts give an empty list and an empty text; null
    ids and repeated rows are kept; other columns are ignored. No shuffle; memory is bounded
    by `memo` remembered ids and words and by `batch_bytes` bytes of text a step (one text at least; a
    single word of n bytes takes about 100 n bytes while it is merged). With `keep_memo` a Python worker
    keeps its memo for its next task, which spares much work where tasks have many words in common.
    """
    vocab = df.sparkSession.sparkContext.broadcast(Vocabulary.load(vocab_path))
    id_type = field_type(df, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocab.value, vocab_path, memo, keep_memo)
        for batch in batches:
            for part in slices(batch, "text", batch_bytes):
                ids = encoder.column(part.column(1))
                columns = [part.column(0), ids]
                if decode_too:
                    columns.append(encoder.decoded(ids))
                if keep_text:
                    columns.append(part.column(1))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "ids"] + ["decoded"] * decode_too + ["text"] * keep_text
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {id_type.simpleString()}, ids array<int>" + ", decoded string" * decode_too + ", text string" * keep_text)
    return out.toDF(id_col, *names[1:-1], *([text_col] if keep_text else names[-1:]))


def decode(df: DataFrame, vocab_path: str, *, id_col: str = "doc_id", ids_col: str = "ids", skip_special: bool = False) -> DataFrame:
    """Decode every list of ids: (id_col, decoded string). A null or empty list gives an empty text; null ids in a list are skipped."""
    vocab = df.sparkSession.sparkContext.broadcast(Vocabulary.load(vocab_path))
    id_type = field_type(df, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids([i for i in ids or [] if i is not None], vocab.value, skip_special) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"id {id_type.simpleString()}, decoded string").withColumnRenamed("id", id_col)
