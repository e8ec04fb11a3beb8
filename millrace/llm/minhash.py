"""Operator 6: near-duplicate documents by bottom-k sketches of one hash function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_tables, mix64, small_enough, stage_table, without
from millrace.llm.components import connected_components, spanning
from millrace.llm.words import map_texts, spaced_words, window_hashes, words_of

SMALL_LIST = 32  # longer inverted lists are compared in blocks
BLOCK = 256  # documents; a task holds the sets of two blocks
COLUMNS = 4096


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (63 bits) of each text; a shorter text is one shingle, a text without words none."""
    words = words_of(texts, spaced_words())
    all_ = words.windows(tuple(range(width))) >> np.uint64(1)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(all_[a : b - width + 1]))
        elif b > a:
            out.append(window_hashes(words.hash[a:b], tuple(range(b - a))) >> np.uint64(1))
        else:
            out.append(all_[:0])
    return out


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def sketches(df: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """(id, n, key1, key2, sketch): set size, a 128-bit key of the whole set, and its k smallest hashes."""

    def make():
        def fn(texts):
            sets = shingle_sets(texts, width)
            key1, key2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            with np.errstate(over="ignore"):
                for r, s in enumerate(sets):
                    m = mix64(s + np.uint64(0x9E3779B97F4A7C15))
                    key1[r], key2[r] = m.sum(dtype=np.uint64), np.bitwise_xor.reduce(m * np.uint64(0xD6E8FEB86659FD93), initial=np.uint64(0))
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), _list_array([s[:k] for s in sets])]

        return fn

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, "text", ["id"], "n long, key1 long, key2 long, sketch array<long>", make)


def least_overlap(k: int):
    """The number of common sketch values that any partner at the threshold of 0.8 has, as a column of n.

    Below 0.8 k shingles both sketches are whole sets, so 0.8 n is exact. Else the overlap of the
    union's k smallest values has mean 0.8 k; half of k lies six or more standard deviations lower at k = 64.
    """
    return F.when(F.col("n") * 5 < 4 * k, F.ceil(F.col("n") * 0.8 - 1e-9)).otherwise(F.floor(F.least("n", F.lit(k)) / 2)).cast("long")


def prefix_entries(classes: DataFrame, k: int) -> DataFrame:
    """(value, id, n, typical, before): the shared sketch values of each class, rarest first, that any partner must meet.

    Sketch values are put in the order of their document frequency. A class whose values are
    mostly its own has no entries: nothing can reach the overlap that it needs. `before` is the
    entry in front in that order, `typical` the sum of the frequencies of all its values.
    """
    spread = classes.select("id", "n", F.explode("sketch").alias("value"))
    shared = stage_table(spread.groupBy("value").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    have = spread.join(shared, "value").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("values"))
    own = F.least(F.col("n"), F.lit(k)) - F.size("values")  # values that no other class has come first
    room = (F.least(F.col("n"), F.lit(k)) - least_overlap(k) + 1 - own).cast("int")
    have = have.withColumn("room", room).where("room > 0")
    typical = F.aggregate("values", F.lit(0).cast("long"), lambda s, x: s + x["c"])
    have = have.select("id", "n", typical.alias("typical"), F.transform(F.slice("values", F.lit(1), F.greatest(F.col("room"), F.lit(0))), lambda x: x["value"]).alias("entries"))
    spread = have.select("id", "n", "typical", "entries", F.posexplode("entries").alias("at", "value"))
    before = F.when(F.col("at") > 0, F.get("entries", F.col("at") - 1)).otherwise(-1 - F.col("id"))  # unlike any other
    return spread.select("value", "id", "n", "typical", before.alias("before"))


def _intersections(a: pa.Array, b: pa.Array) -> np.ndarray:
    return np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in _lists(a, b)], np.int64)


def _lists(*columns: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    flats = [(np.array(c.flatten()), np.concatenate([[0], np.cumsum(np.array(c.value_lengths()))])) for c in columns]
    for r in range(len(columns[0])):
        yield tuple(f[o[r] : o[r + 1]] for f, o in flats)


def estimated(pairs: DataFrame, classes: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs whose union sketch lets their similarity be `least` or more: the k smallest of both sketches, and how many are in both."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in _lists(batch.column("sa"), batch.column("sb")):
                union = np.union1d(x, y)[:k]
                both = np.intersect1d(x, y, assume_unique=True)
                keep.append(bool(len(union)) and np.count_nonzero(both <= union[-1]) >= least * len(union))
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if out.num_rows:
                yield out

    s = classes.select("id", "sketch")
    met = pairs.join(s.withColumnsRenamed({"id": "a", "sketch": "sa"}), "a").join(s.withColumnsRenamed({"id": "b", "sketch": "sb"}), "b")
    return met.select("a", "b", "sa", "sb").mapInArrow(run, pairs.select("a", "b").schema)


def whole_sets(wanted: DataFrame, df: DataFrame, id_col: str, text_col: str, width: int, broadcast_rows: int) -> DataFrame:
    """(_id, shingles) of the documents in `wanted` (_id), from their whole texts."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    wanted = stage_table(wanted.distinct(), "wanted")
    wanted = F.broadcast(wanted) if small_enough(wanted, broadcast_rows) else wanted

    def make():
        return lambda texts: [_list_array(shingle_sets(texts, width))]

    return stage_table(map_texts(rows.join(wanted, "_id", "left_semi"), "text", ["_id"], "shingles array<long>", make), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets have 100 * intersection >= percent * union."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes = [np.array(batch.column(c).value_lengths()).astype(np.int64) for c in ("sa", "sb")]
                both = _intersections(batch.column("sa"), batch.column("sb"))
                keep = 100 * both >= percent * (sizes[0] + sizes[1] - both)
                out = batch.select(["a", "b"]).filter(pa.array(keep & (both > 0)))
                if out.num_rows:
                    yield out

    met = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    return met.select("a", "b", "sa", "sb").mapInArrow(run, pairs.select("a", "b").schema)


def _block_links(percent: int):
    """Links between two blocks of one inverted list, by whole sets: the edges of a spanning forest. Runs in a task."""

    def run(key, table):
        t = table.combine_chunks()
        ids, comp, before = (np.array(t.column(c).to_numpy(zero_copy_only=False)) for c in ("id", "comp", "before"))
        first, second = (np.array(t.column(c).to_numpy(zero_copy_only=False)).astype(bool) for c in ("first", "second"))
        lists = t.column("shingles").chunk(0)
        flat, n = np.array(lists.flatten()), np.array(lists.value_lengths()).astype(np.int64)
        _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        some = times[at] > 1  # what only one document has meets nothing
        row = np.repeat(np.arange(len(ids)), n)[some]
        _, at = np.unique(at[some], return_inverse=True)
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        i, j = np.flatnonzero(first), np.flatnonzero(second)
        both = np.zeros((len(i), len(j)), np.float32)
        for c in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
            a, b = np.searchsorted(at, [c, c + COLUMNS])
            dense = np.zeros((len(ids), COLUMNS), np.float32)
            dense[row[a:b], at[a:b] - c] = 1
            both += dense[i] @ dense[j].T
        ok = 100 * both >= percent * (n[i][:, None] + n[j][None, :] - both)
        ok &= (comp[i][:, None] != comp[j][None, :]) & (before[i][:, None] != before[j][None, :])
        x, y = np.nonzero(ok)
        by_id = np.argsort(ids, kind="stable")  # so that a root is the smallest id
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        root = spanning(place[i[x]], place[j[y]], len(ids))
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": ids[by_id][root[moved]], "b": ids[by_id][moved]})

    return run


def open_lists(entries: DataFrame) -> DataFrame:
    """Entries of the inverted lists that hold more than one component, with m, the length of their list.

    entries: (value, id, n, before, comp).
    """
    sizes = entries.groupBy("value").agg(F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("value", "m")
    return stage_table(entries.join(stage_table(sizes, "lists"), "value"), "open")


def short_pairs(live: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components in short lists whose sizes allow the threshold.

    Two classes with the same entry before met in that entry's list already.
    """
    short = live.where(F.col("m") <= SMALL_LIST).select("value", "id", "n", "comp", "before")
    other = short.select("value", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "comp", "before")))
    near = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    met = short.join(other, "value").where((F.col("id") < F.col("id2")) & (F.col("comp") != F.col("comp2")) & near & (F.col("before") != F.col("before2")))
    return met.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def long_cells(live: DataFrame) -> DataFrame:
    """Pairs of blocks of the long lists: (value, i, j, first, second, id, comp, before).

    Classes with the list's most common entry before need no comparison with each other; the
    others are compared with all.
    """
    rows = live.where(F.col("m") > SMALL_LIST).select("value", "id", "comp", "before")
    groups = rows.groupBy("value", "before").agg(F.count("*").alias("g"))
    common = groups.groupBy("value").agg(F.sum("g").alias("total"), F.max_by("before", F.struct("g", "before")).alias("usual"), F.max("g").alias("g"))
    common = stage_table(common.where("g < total").select("value", "usual", F.ceil((F.col("total") - F.col("g")) / BLOCK).cast("int").alias("odd"), F.ceil(F.col("g") / BLOCK).cast("int").alias("even")), "long")
    rows = rows.join(common, "value").withColumn("is_odd", F.col("before") != F.col("usual"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("is_odd"), F.col("odd")).otherwise(F.col("even"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cell = lambda i, j, first, second: F.struct(i.alias("i"), j.alias("j"), first.alias("first"), second.alias("second"))
    yes, no, block = F.lit(True), F.lit(False), F.col("block")
    odds = F.transform(upto("odd"), lambda x: cell(F.least(x, block), F.greatest(x, block), block <= x, block >= x))
    evens = F.transform(upto("even"), lambda x: cell(block, -1 - x, yes, no))  # an even block is numbered below 0
    mine = F.transform(upto("odd"), lambda x: cell(x, -1 - block, no, yes))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("is_odd"), F.concat(odds, evens)).otherwise(mine)))
    return rows.select("value", "cell.i", "cell.j", "cell.first", "cell.second", "id", "comp", "before")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = 64, broadcast_rows: int = 500_000) -> DataFrame:
    """Groups of near-duplicate documents: (id_col, n_shingles, component_id, kept), one row per input row.

    A document is the set of its distinct `width`-word shingles (words between ASCII white space,
    A-Z lowered); two are linked when 100 * |A and B| >= percent * |A or B|, percent >= 80.
    component_id is the smallest id reachable by links. Documents with equal sets are one class
    from the start. Bottom-k sketches of one hash function give inverted lists of retained
    values; common values propose pairs, the union sketch filters them, and whole sets confirm.
    Each list first proposes its smallest class to all others; what is still apart after
    that is compared in full. No list, group or partner is capped.

    Null, empty and word-free texts have no shingles and link with nothing. A null id has a null
    component and is kept. Rows with one id are one node. Ids are integers.
    """
    if percent < 80:
        raise ValueError("the overlap bounds of the sketches hold from 80 percent on")
    base = stage_table(sketches(df, id_col, text_col, width, k), "sketches")
    known = base.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = stage_table(known.groupBy("key1", "key2", "n").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")), "classes")
    entries = stage_table(prefix_entries(classes, k), "entries")
    sets_of = lambda wanted: whole_sets(wanted, df, id_col, text_col, width, broadcast_rows)

    def links(pairs: DataFrame, name: str) -> DataFrame:
        likely = stage_table(estimated(pairs, classes, k, 0.5), f"{name}-likely")
        sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("_id")))
        out = stage_table(verified(likely, sets, percent), f"{name}-links")
        drop_tables(sets)
        return out

    # the most typical class of each list against all others
    head = F.max_by(F.struct("id", "n"), F.struct("typical", -F.col("id")))
    heads = stage_table(entries.groupBy("value").agg(head.alias("head")).select("value", F.col("head.id").alias("a"), F.col("head.n").alias("n2")), "heads")
    near = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    first = entries.select("value", "id", "n").join(heads, "value").where((F.col("a") != F.col("id")) & near)
    first = stage_table(first.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct(), "first")
    links1 = links(first, "first")
    comps = stage_table(connected_components(links1, "first"), "first-components")
    # what is still apart
    marked = entries.drop("typical").join(comps.select("id", "component"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    live = open_lists(marked)
    found = links1.unionAll(links(stage_table(short_pairs(live, percent).join(first, ["a", "b"], "left_anti"), "second"), "second"))
    cells = stage_table(long_cells(live), "cells")
    if not cells.isEmpty():
        sets = sets_of(cells.select(F.col("id").alias("_id")))
        cells = cells.join(sets, cells["id"] == sets["_id"]).drop("_id")
        far = cells.groupBy("value", "i", "j").applyInArrow(_block_links(percent), links1.schema)
        found = found.unionAll(stage_table(far.distinct(), "far-links"))
    comps = connected_components(found, "all")
    mine = classes.select("key1", "key2", "n", "id").join(comps, "id", "left").select("key1", "key2", "n", F.coalesce("component", "id").alias("component"))
    mine = stage_table(mine, "class-components")
    drop_tables(classes, entries)
    out = base.drop("sketch").join(mine, ["key1", "key2", "n"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, *, id_col: str = "doc_id", broadcast_rows: int = 2_000_000, **options) -> DataFrame:
    """`df` with one document of each group: the one with the smallest id. Rows with a null id stay."""
    groups = near_duplicates(df, id_col=id_col, **options)
    gone = groups.where(~F.col("kept")).select(F.col(id_col).alias("gone")).distinct()
    return without(df, id_col, stage_table(gone, "gone"), "gone", broadcast_rows)
