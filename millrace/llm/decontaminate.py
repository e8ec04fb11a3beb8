"""Operator 9: benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import field_type, mix64, stage_table, without
from millrace.llm.words import plain_words, slices, window_hashes, words_of

#: Fixed masks: positions that count. (unequal words at most, words at least, masks): every choice of so many unequal words in
#: a window of so many words or more leaves one mask whole at some start; a test enumerates them.
MASKS = (
    (1, 6, ((0, 1, 2, 3), (0, 1, 3, 4))),
    (1, 5, ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))),
    (2, 13, ((0, 1, 2, 4, 7, 8), (0, 1, 3, 5, 6, 8), (0, 2, 3, 7, 9, 10), (0, 1, 2, 3, 4, 5))),
    (2, 10, ((0, 2, 5, 6, 7), (0, 1, 2, 3, 5), (0, 1, 4, 5, 7))),
)


@dataclass
class Rules:
    window: int = 13  # words looked at together; a shorter item is looked at whole
    share: float = 0.8  # of these that must be equal


def masks_of(n: int, rules: Rules) -> tuple[tuple[int, ...], ...]:
    """Masks for an item of `n` words: whatever words the rules allow to differ in a window, one mask is whole in it."""
    width = min(rules.window, n)
    unequal = width - max(1, math.ceil(rules.share * width - 1e-9))
    if unequal:
        for most, least, masks in MASKS:
            if most == unequal and width >= least:
                return masks
    run = -(-(width - unequal) // (unequal + 1))  # the longest run of equal words has this many at least
    return (tuple(range(run)),)


def seeds(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the words of a mask at each start in a row of word hashes; masks of other positions give other hashes."""
    salt = np.uint64(hash(mask) & 0xFFFFFFFFFFFFFFFF)  # a tuple of numbers has the same hash in every process
    return mix64(window_hashes(h, mask) ^ salt)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, rules: Rules) -> tuple[int, int, int] | None:
    """Equal words of the alignment doc[i + shift] = item[i], as (words equal in the best window, equal in all, first word in doc), or None below the rules."""
    i0, i1 = max(0, -shift), min(len(item), len(doc) - shift)
    width = min(rules.window, len(item))
    if i1 - i0 < width:
        return None
    same = (doc[i0 + shift : i1 + shift] == item[i0:i1]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(same)])
    runs = total[width:] - total[:-width]
    best = int(runs.max())
    if best < rules.share * width - 1e-9:
        return None
    return best, int(total[-1]), int(i0 + shift + runs.argmax())


class Index:
    """Seeds of a benchmark that fits a broadcast; sorted, with a bit table in front."""

    def __init__(self, items: list[tuple[object, str]], rules: Rules = Rules()):
        self.ids = [i for i, _ in items]
        words = words_of(pa.array([t for _, t in items], pa.string()), plain_words())
        self.words = [words.hash[words.first[k] : words.first[k + 1]] for k in range(len(items))]
        keys, where, at, used = [], [], [], set()
        for k, h in enumerate(self.words):
            for mask in masks_of(len(h), rules) if len(h) else ():
                x = seeds(h, mask)
                used.add(mask)
                keys.append(x)
                where.append(np.full(len(x), k))
                at.append(np.arange(len(x)))
        keys, where, at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, where, at))
        order = np.argsort(keys, kind="stable")
        self.keys, self.where, self.at = keys[order].astype(np.uint64), where[order], at[order]
        bits = 16
        while (1 << bits) < 64 * len(keys) and bits < 24:
            bits += 1
        self.mask = np.uint64((1 << bits) - 1)
        self.low = np.zeros(1 << bits, bool)
        self.low[(self.keys & self.mask).astype(np.int64)] = True
        self.masks = sorted(used)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, positions in the sorted seeds) of all equal seeds."""
        spots, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for mask in self.masks:
            x = seeds(h, mask)
            at = np.flatnonzero(self.low[(x & self.mask).astype(np.int64)])
            lo, hi = np.searchsorted(self.keys, x[at]), np.searchsorted(self.keys, x[at], "right")
            n = hi - lo
            some = n > 0
            spots.append(np.repeat(at[some], n[some]))
            keys.append(np.concatenate([np.arange(a, b) for a, b in zip(lo[some], hi[some], strict=True)]) if some.any() else np.empty(0, np.int64))
        return np.concatenate(spots), np.concatenate(keys)


def _overlaps(index: Index, words, rules: Rules) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item number, best, equal, first word) of all verified overlaps, best alignment of each row and item."""
    spot, key = index.hits(words.hash)
    if not len(spot):
        return
    row = np.searchsorted(words.first, spot, "right") - 1
    item = index.where[key]
    shift = spot - words.first[row] - index.at[key]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r, k, s in sorted(set(zip(row.tolist(), item.tolist(), shift.tolist(), strict=True))):
        found = overlap(words.hash[words.first[r] : words.first[r + 1]], index.words[k], s, rules)
        if found and (found[1], found[0], -found[2]) > (lambda x: (x[1], x[0], -x[2]))(best.get((r, k), (0, 0, 0))):
            best[r, k] = found
    for (r, k), (top, equal, at) in sorted(best.items()):
        yield r, k, top, equal, at


def contaminated(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: float = 0.8, block_items: int = 20_000, block_chars: int = 20_000_000) -> DataFrame:
    """Overlaps of documents with benchmark items: (id_col, item_col, n_equal, n_item_words, first_word, best_window).

    One row for each (document, item) with a verified overlap: an alignment in which some
    window of `window` item words (the whole item, if shorter) has at least `share` equal
    words at equal distances. Seeds of the masks find every such alignment, and nothing is sampled:
    the masks of an item go by its length, so that one is whole under all unequal words that
    the rules allow. Case and punctuation do not
    count. Null or empty texts and items overlap with nothing; rows with a null id are
    compared like others; repeated rows give repeated results; other columns are ignored.

    The benchmark is broadcast in blocks of at most `block_items` items and about `block_chars`
    characters, one pass over the documents for each block; all but the last are staged, and a block's
    seeds are freed before the next ones are sent, so driver and executors hold one block at a time
    whatever the benchmark's size.
    """
    rules = Rules(window, share)
    spark = df.sparkSession
    id_type, item_type = field_type(df, id_col), field_type(benchmark, item_col)
    schema = f"id {id_type.simpleString()}, item {item_type.simpleString()}, n_equal int, n_item_words int, first_word long, best_window int"
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))

    def block_pass(block: list[tuple[object, str]], last: bool) -> DataFrame:
        index = spark.sparkContext.broadcast(Index(block, rules))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    found = list(_overlaps(index.value, words_of(part.column("text"), plain_words()), rules))
                    if not found:
                        continue
                    r, k, top, equal, at = (list(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(r)), pa.array([index.value.ids[x] for x in k], out_type), pa.array(equal, pa.int32()), pa.array([len(index.value.words[x]) for x in k], pa.int32()), pa.array(at, pa.int64()), pa.array(top, pa.int32())],
                        ["id", "item", "n_equal", "n_item_words", "first_word", "best_window"],
                    )

        found = rows.mapInArrow(scan, schema)
        if last:
            return found
        found = stage_table(found, "overlaps")  # so that the executors hold the seeds of one block at a time
        index.destroy()
        return found

    out_type = _arrow_type(item_type)
    out: list[DataFrame] = []
    block, size = [], 0
    for r in items.toLocalIterator():
        if len(block) >= block_items or size >= block_chars:
            out.append(block_pass(block, last=False))
            block, size = [], 0
        block.append((r["item"], r["text"]))
        size += len(r["text"])
    out.append(block_pass(block, last=True))
    out = reduce(DataFrame.unionByName, out)
    return out.withColumnsRenamed({"id": id_col, "item": item_col} if id_col != item_col else {"id": id_col})


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", broadcast_rows: int = 2_000_000, **options) -> DataFrame:
    """`df` without documents that overlap a benchmark item; rows with a null id go if any text with a null id overlaps.

    Ids of hits are broadcast only if they are few; else Spark joins by shuffle.
    """
    hits = contaminated(df, benchmark, id_col=id_col, **options)
    hits = stage_table(hits.select(F.col(hits.columns[0]).alias("hit")).distinct(), "hits")
    return without(df, id_col, hits, "hit", broadcast_rows)
