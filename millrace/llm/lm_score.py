"""Operator 5: stupid-backoff language-model scores from n-gram count tables partitioned by hash."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import field_type
from millrace.llm.words import slices, spaced_words, text_bytes, words_of

_HEAD = struct.Struct("<BQ")  # planes, numbers
_ORDER = np.uint64(3)  # the two low bits of a key hold the order of its n-gram


def ngram_keys(words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of the n-gram that ends at each word, whether it lies in one row)."""
    n = len(words.hash)
    keys, whole = np.zeros(n, np.uint64), np.zeros(n, bool)
    made = words.windows(tuple(range(order)))
    if len(made):
        keys[order - 1 :] = (made & ~_ORDER) | np.uint64(order % 4)
        at = np.arange(n) - np.repeat(words.first[:-1], np.diff(words.first))
        whole = at >= order - 1
    return keys, whole


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers of at least 0, byte plane by byte plane, in as many planes as the largest needs, compressed."""
    values = values.astype("<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return _HEAD.pack(width, len(values)) + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b"")


def unpack_numbers(blob: bytes) -> np.ndarray:
    width, n = _HEAD.unpack_from(blob)
    full = np.zeros((n, 8), np.uint8)
    if n:
        raw = pa.decompress(blob[_HEAD.size :], decompressed_size=n * width, codec="zstd", asbytes=True)
        full[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return full.view("<u8").ravel()


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys, as differences."""
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(blob), dtype=np.uint64)


def bundles(rows: DataFrame) -> DataFrame:
    """(chunk, docs): the documents (id, text) of a batch that belong to one chunk, as compressed Arrow data."""

    def run(batches):
        for batch in batches:
            chunk = np.array(batch.column("chunk"))
            order = np.argsort(chunk, kind="stable")
            docs = batch.select(["id", "text"]).take(pa.array(order))
            names, starts = np.unique(chunk[order], return_index=True)
            blobs = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(docs.slice(a, b - a))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "docs"])

    return rows.select("id", "text", "chunk").mapInArrow(run, "chunk int, docs binary")


def opened(table: pa.Table) -> pa.Table:
    """The documents (id, text) of a chunk's bundles."""
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in table.column("docs").to_pylist()]).combine_chunks()


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the equal hash ranges begins in sorted keys; one more entry than ranges."""
    starts = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]])


class Chunk:
    """The n-grams of one chunk of documents, in levels: words and pairs, then triples both of whose pairs are known.

    A level's keys follow from the texts and the totals of the level before, so only totals have to come back, not keys.
    """

    def __init__(self, table: pa.Table, orders: int, buckets: int):
        docs = opened(table)
        self.ids, self.orders, self.buckets = docs.column("id"), orders, buckets
        self.words = words_of(pa.concat_arrays(docs.column("text").chunks), spaced_words())
        self.at = np.arange(len(self.words.hash)) - np.repeat(self.words.first[:-1], np.diff(self.words.first))
        made = [ngram_keys(self.words, k) for k in range(1, min(orders, 2) + 1)]
        self.totals: list[np.ndarray] = []  # by order: the total at each position, 0 for what is not known
        self._take(made)

    def _take(self, made: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.where = [whole for _, whole in made]
        flat = np.concatenate([keys[whole] for keys, whole in made])
        self.keys, self.inverse, self.counts = np.unique(flat, return_inverse=True, return_counts=True)
        self.edges = _edges(self.keys, self.buckets)

    def parts(self, chunk: int) -> pa.Table:
        """The level's keys and counts, packed by hash range."""
        some = np.flatnonzero(np.diff(self.edges)).tolist()
        spans = [slice(self.edges[b], self.edges[b + 1]) for b in some]
        return pa.table(
            {
                "bucket": pa.array(some, pa.int32()),
                "chunk": pa.array([chunk] * len(some), pa.int32()),
                "keys": pa.array([pack(self.keys[x]) for x in spans], pa.binary()),
                "counts": pa.array([pack_numbers(self.counts[x]) for x in spans], pa.binary()),
            }
        )

    def learn(self, buckets: list[int], blobs: list[bytes]) -> None:
        """Take the totals of the level's keys from all hash ranges."""
        total = np.zeros(len(self.keys), np.int64)
        for b, blob in zip(buckets, blobs, strict=True):
            total[self.edges[b] : self.edges[b + 1]] = unpack_totals(blob, int(self.edges[b + 1] - self.edges[b]))
        by_place, at = total[self.inverse], 0
        for whole in self.where:
            n = int(whole.sum())
            here = np.zeros(len(whole), np.int64)
            here[whole] = by_place[at : at + n]
            self.totals.append(here)
            at += n

    def next_level(self) -> None:
        """Triples can only be known where both their pairs are."""
        keys, whole = ngram_keys(self.words, 3)
        pair = self.totals[1] > 0
        whole = whole & pair
        whole[1:] &= pair[:-1]
        self._take([(keys, whole)])


def pack_totals(total: np.ndarray) -> bytes:
    """Totals as a bit for each that is not 0, and those that are not."""
    return np.packbits(total > 0).tobytes() + pack_numbers(total[total > 0])


def unpack_totals(blob: bytes, n: int) -> np.ndarray:
    size = (n + 7) // 8
    known = np.unpackbits(np.frombuffer(blob, np.uint8, size), count=n).astype(bool)
    out = np.zeros(n, np.int64)
    out[known] = unpack_numbers(blob[size:]).astype(np.int64)
    return out


def _count_chunk(orders: int, buckets: int):
    """Words and pairs of a chunk with their counts."""

    def run(key, table):
        return Chunk(table, orders, buckets).parts(key[0].as_py())

    return run


def _count_triples(buckets: int):
    """Triples of a chunk, given the totals of its words and pairs."""

    def run(key, left, right):
        chunk = Chunk(left, 3, buckets)
        chunk.learn(right.column("bucket").to_pylist(), right.column("totals").to_pylist())
        chunk.next_level()
        return chunk.parts(key[0].as_py())

    return run


def _sum_bucket(least: int, level: int):
    """Total counts of one hash range. Each chunk gets back the totals of its own n-grams, 0 for those that the model leaves out."""

    def run(key, table):
        keys = [unpack(b) for b in table.column("keys").to_pylist()]
        every = np.concatenate(keys)
        names, at = np.unique(every, return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack_numbers(b) for b in table.column("counts").to_pylist()]), len(names)).astype(np.int64)
        total[((names & _ORDER) != 1) & (total < least)] = 0
        back = np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])
        n = table.num_rows
        return pa.table({"chunk": table.column("chunk"), "level": pa.array([level] * n, pa.int32()), "bucket": table.column("bucket"), "totals": pa.array([pack_totals(x) for x in back], pa.binary())})

    return run


def corpus_size(rows: DataFrame) -> tuple[int, int]:
    """Bytes and words of all texts."""
    table = spaced_words() != 0

    def run(batches):
        size = n = 0
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = text_bytes(part.column("text"))
                on = table[raw]
                size += len(raw)
                begin = on[1:] & ~on[:-1]
                n += int(np.count_nonzero(begin))
                starts = at[:-1][np.diff(at) > 0]
                n += int(np.count_nonzero(on[starts]))  # a row's first byte starts a word, whatever stands before it
                inner = starts[starts > 0]
                n -= int(np.count_nonzero(begin[inner - 1]))
        yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([n])], ["size", "n"])

    r = rows.select("text").mapInArrow(run, "size long, n long").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).first()
    return r["size"] or 0, r["n"] or 0


def _score_chunk(orders: int, buckets: int, backoff: float, all_words: int):
    """Scores of the documents of one chunk from the totals of its n-grams."""

    def run(key, left, right):
        chunk = Chunk(left, orders, buckets)
        levels = np.array(right.column("level").to_pylist(), np.int64)
        for level in (0, 1)[: max(1, orders - 1)]:
            if level:
                chunk.next_level()
            mine = right.filter(pa.array(levels == level))
            chunk.learn(mine.column("bucket").to_pylist(), mine.column("totals").to_pylist())
        totals, at, first = chunk.totals, chunk.at, chunk.words.first
        n = len(at)
        score, penalty, done = np.zeros(n), np.zeros(n), np.zeros(n, bool)
        for k in range(orders, 1, -1):
            context = np.zeros(n, np.int64)
            context[1:] = totals[k - 2][:-1]
            known = ~done & (totals[k - 1] > 0) & (context > 0)
            score = np.where(known, np.log(np.maximum(totals[k - 1], 1) / np.maximum(context, 1)) + penalty, score)
            done |= known
            penalty += np.where(~done & (at >= k - 1), np.log(backoff), 0.0)
        score = np.where(done, score, np.log(np.maximum(totals[0], 1) / max(1, all_words)) + penalty)
        sums = np.add.reduceat(np.append(score, 0.0), np.minimum(first[:-1], n))
        size = np.diff(first)
        return pa.table({"id": chunk.ids, "n_words": pa.array(size, pa.int64()), "log_score": pa.array(np.where(size > 0, sums, 0.0), pa.float64())})

    return run


def lm_scores(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", orders: int = 3, least: int = 2, backoff: float = 0.4, chunk_bytes: int = 8 << 20, bucket_bytes: int = 8 << 20, even_bytes: int = 64 << 30) -> DataFrame:
    """Score every whole text by the n-grams of all texts: (id_col, n_words, log_score, mean_log_score).

    Words stand between ASCII white space, A-Z lowered. A word w after a context c scores
    count(c w) / count(c) if the longest n-gram (of `orders` words) occurs `least` times or more,
    else `backoff` times the score with the context one word shorter, down to count(w) / number of words.
    n-grams do not cross documents; at a document's start the context is what there is.
    log_score is the sum of natural logarithms. Texts without words, null and empty ones have
    n_words 0, log_score 0 and a null mean. Null ids and repeated rows are kept.

    Documents are dealt by hash into chunks of about `chunk_bytes`. Each chunk sends its distinct
    words and pairs, packed, to count tables partitioned by hash range, and gets back their totals; then
    the same for triples, of which only those with two known pairs can be known. Beyond `even_bytes` of text, chunks and ranges grow with the square root of the size, so that the
    number of pieces, chunks times ranges, grows in proportion to it. Two keys of different n-grams are equal with a probability of about 2**-62.
    """
    if not 1 <= orders <= 3:
        raise ValueError("orders is 1, 2 or 3")
    kind = field_type(df, id_col).simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size, n_words = corpus_size(rows)
    larger = max(1.0, math.sqrt(size / even_bytes))
    chunks, buckets = (max(1, math.ceil(size / (x * larger))) for x in (chunk_bytes, bucket_bytes))
    dealt = bundles(rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int")))
    part = "bucket int, chunk int, keys binary, counts binary"
    back = "chunk int, level int, bucket int, totals binary"
    chunk = dealt.groupBy("chunk")
    totals = chunk.applyInArrow(_count_chunk(orders, buckets), part).groupBy("bucket").applyInArrow(_sum_bucket(least, 0), back)
    if orders > 2:
        triples = chunk.cogroup(totals.groupBy("chunk")).applyInArrow(_count_triples(buckets), part)
        totals = totals.unionAll(triples.groupBy("bucket").applyInArrow(_sum_bucket(least, 1), back))
    scored = chunk.cogroup(totals.groupBy("chunk")).applyInArrow(_score_chunk(orders, buckets, backoff, n_words), f"id {kind}, n_words long, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select(F.col("id").alias(id_col), "n_words", "log_score", mean.alias("mean_log_score"))
