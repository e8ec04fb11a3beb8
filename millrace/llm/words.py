"""Words of a whole Arrow batch at once: positions and 64-bit hashes, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from millrace.llm.common import mix64

SEGMENT = 1 << 17  # bytes handled together, which bounds the arrays of a task
_R = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2**64


def spaced_words() -> np.ndarray:
    """Byte table of words separated by ASCII white space: 0 for a separator, else the byte with A-Z lowered."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[0x20, *range(0x09, 0x0E)]] = 0
    table[0] = 255  # a NUL byte is part of a word; 0xFF never occurs in UTF-8
    return table


def plain_words() -> np.ndarray:
    """Byte table of words made of ASCII letters, digits and all non-ASCII characters, A-Z lowered."""
    table = np.zeros(256, np.uint8)
    keep = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]
    table[keep] = keep
    table[65:91] += 32
    return table


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = SEGMENT + 1
    inverse = pow(_R, -1, 1 << 64)
    up = np.full(n, np.uint64(_R))
    down = np.full(n, np.uint64(inverse))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        up, down = np.cumprod(up), np.cumprod(down)
    letters = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return up, down, letters


@dataclass
class Words:
    """Words of consecutive rows. Word k of the batch is data[start[k]:end[k]]; row r has words first[r] to first[r + 1]."""

    data: np.ndarray  # bytes after the table
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    head: np.ndarray  # hashes of the words' first bytes, if asked for

    def windows(self, offsets: tuple[int, ...]) -> np.ndarray:
        """Hash of the words at `offsets` from each word on; windows that leave their row hold garbage."""
        return window_hashes(self.hash, offsets)


def window_hashes(h: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(len(offsets)), np.uint64)
    with np.errstate(over="ignore"):
        for k in offsets:
            out ^= h[k : k + n]
            out *= np.uint64(0x9E6C63D0676A9A99)
            out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)


def _segment(d: np.ndarray, breaks: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, polynomials of the words of d and of their first `prefix` bytes; a word never crosses a position in `breaks`."""
    up, down, letters = _powers()
    on = d != 0
    begin = on.copy()
    begin[1:] &= ~on[:-1]
    begin[breaks] = on[breaks]
    stop = on.copy()
    stop[:-1] &= ~on[1:]
    last = breaks[breaks > 0] - 1
    stop[last] = on[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(letters[d] * up[: len(d)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        head = np.minimum(end, start + prefix)
        g = (total[head] - total[start]) * down[start] if prefix else h[:0]
        return start, end, h, g


def _cuts(d: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most SEGMENT bytes that end at a row's end or a separator. A longer word is cut, and words_of joins its pieces."""
    at, n = 0, len(d)
    while at < n:
        to = min(n, at + SEGMENT)
        if to < n:
            k = rows[np.searchsorted(rows, to, "right") - 1]
            if k > at:
                to = int(k)
            else:
                gaps = np.flatnonzero(d[at:to] == 0)
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
        yield at, to
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets (one more than rows); null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64)
    if at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct numbers of two arrays, sorted."""
    both = np.sort(np.concatenate([a, b]))
    return both[np.diff(both, prepend=-1) != 0]


def words_of(column: pa.Array, table: np.ndarray, prefix: int = 0, cut=None) -> Words:
    """All words of a string column under a byte table; with `prefix`, also the hashes of that many leading bytes.

    `cut(raw, rows)` may give further positions where a word ends, given the bytes and the offsets of the rows.
    """
    raw, rows = text_bytes(column)
    d = table[raw]
    ends = rows if cut is None else merged(rows, cut(raw, rows))
    parts = []
    for at, to in _cuts(d, ends):
        breaks = ends[np.searchsorted(ends, at) : np.searchsorted(ends, to)] - at
        s, e, h, g = _segment(d[at:to], breaks, prefix)
        s, e = s + at, e + at
        if at and d[at - 1] and d[at] and ends[np.searchsorted(ends, at)] != at:  # the cut is inside a word
            _, tails, sums, heads = parts[-1]
            start = int(parts[-1][0][-1])
            sums[-1] = (int(sums[-1]) + int(h[0]) * pow(_R, at - start, 1 << 64)) & 0xFFFFFFFFFFFFFFFF
            if at - start < prefix:
                heads[-1] = _segment(d[start : min(int(e[0]), start + prefix)], np.zeros(1, np.int64), prefix)[3][0]
            tails[-1] = e[0]
            s, e, h, g = s[1:], e[1:], h[1:], g[1:]
        if len(s):
            parts.append((s, e, h, g))
    empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
    start, end, h, head = (np.concatenate(x) for x in zip(*(parts or [empty]), strict=True))
    h = mix64(h + (end - start).astype(np.uint64))
    head = mix64(head ^ np.uint64(prefix << 56)) if prefix else head
    return Words(d, start, end, h, np.searchsorted(start, rows), head)


def word_hashes(words: list[str], table: np.ndarray) -> np.ndarray:
    """Hash of each given word, as words_of gives it; 0 where the table leaves not just one word."""
    w = words_of(pa.array(words, pa.string()), table)
    out = np.zeros(len(words), np.uint64)
    one = np.diff(w.first) == 1
    out[one] = w.hash[w.first[:-1][one]]
    return out


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about `limit` bytes together, one row at least."""
    n = batch.num_rows
    if not n:
        return
    _, rows = text_bytes(batch.column(text))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(rows, rows[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def map_texts(df, text_col: str, keep: list[str], fields: str, make, rows_limit: int = 256):
    """A DataFrame of the columns `keep` and new ones, made from the texts in Arrow batches.

    `make()` runs once a task and returns a function from a string array (null: empty) to the new
    arrays, in the order of `fields` (DDL). Names may clash: new columns replace kept ones.
    No shuffle; batches are cut to about 1 MB of text and `rows_limit` rows, which bounds a worker's memory.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    new = T._parse_datatype_string(fields)
    keep = [c for c in keep if c not in new.names]
    inner = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    schema = T.StructType([*(T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)), *(T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new))])
    text_at = keep.index(text_col) if text_col in keep and isinstance(df.schema[text_col].dataType, T.StringType) else None
    if text_at is None:
        inner.append(F.col(f"`{text_col}`").cast("string").alias("text"))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            name = "text" if text_at is None else f"k{text_at}"
            for part in slices(batch, name):
                for at in range(0, part.num_rows, rows_limit):
                    piece = part.slice(at, rows_limit)
                    texts = piece.column(name)
                    made = fn(texts.fill_null("") if texts.null_count else texts)
                    yield pa.RecordBatch.from_arrays([*(piece.column(f"k{i}") for i in range(len(keep))), *made], names)

    out = df.select(*inner).mapInArrow(run, schema)
    return out.toDF(*keep, *new.names)
