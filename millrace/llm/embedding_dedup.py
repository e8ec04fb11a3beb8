"""Operator 3: near-duplicate embeddings by randomly rotated binary codes with correction factors."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import field_type, stage_table
from millrace.llm.components import connected_components, spanning


@lru_cache(8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix; the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated unit vectors, packed, and their correction factors: the inner product of a vector with its own code."""
    turned = unit @ rotation(unit.shape[1], seed)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def signs(packed: np.ndarray, dim: int) -> np.ndarray:
    """Unit code vectors (entries +-1 / sqrt(dim)) of packed bits."""
    return ((np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2) - 1) / np.float32(np.sqrt(dim))


def quantised(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors as bytes, with their scales, and how far each lies from the rotated vector."""
    turned = unit @ rotation(unit.shape[1], seed)
    scale = np.abs(turned).max(axis=1) / 127
    q = np.rint(turned / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((turned - q * scale[:, None]) ** 2).sum(axis=1)) + 1e-12


def lowest_estimate(factor: np.ndarray, threshold: float) -> np.ndarray:
    """The least estimate that a pair at the threshold can have.

    The estimate is code x vector / factor, which is unbiased: it is c + sqrt(1 - c * c) * e / f with |e| <= sqrt(1 - f * f) for the cosine c and the
    factor f, so this bound holds always, not just with some confidence; no pair is missed.
    """
    f = np.clip(factor, 1e-6, 1.0)
    return threshold - np.sqrt(1 - threshold * threshold) * np.sqrt(1 - f * f) / f - 1e-5


def prepared(df: DataFrame, id_col: str, vec_col: str, label_col: str, seed: int) -> DataFrame:
    """(id, label, dim, key1, key2, vec) of the vectors that can be compared; key1 and key2 stand for the vector's values."""
    import xxhash

    def run(batches):
        for batch in batches:
            vectors, n = batch.column("vec"), batch.num_rows
            keep, dims, keys, kept = [], [], [], []
            for r in range(n):
                v = vectors[r].values.to_numpy(zero_copy_only=False).astype(np.float64) if vectors[r].is_valid else np.empty(0)
                if len(v) and np.isfinite(v).all() and v.any():
                    keep.append(r)
                    kept.append(v)
                    dims.append(len(v))
                    raw = (v + 0.0).tobytes()
                    keys.append((xxhash.xxh3_64_intdigest(raw, 1), xxhash.xxh3_64_intdigest(raw, 2)))
            if not keep:
                continue
            k1, k2 = (np.array([k[j] for k in keys], np.uint64).view(np.int64) for j in (0, 1))
            rows = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("label").take(rows), pa.array(dims, pa.int32()), pa.array(k1), pa.array(k2), pa.array(kept, pa.list_(pa.float64()))], ["id", "label", "dim", "key1", "key2", "vec"])

    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", F.isnull))
    kinds = [field_type(rows, c).simpleString() for c in ("id", "label")]
    return rows.mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, dim int, key1 long, key2 long, vec array<double>")


def unit_rows(vec: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square over- or underflows."""
    vec = vec / np.abs(vec).max(axis=1, keepdims=True)
    return vec / np.sqrt((vec * vec).sum(axis=1, keepdims=True))


def coded(classes: DataFrame, seed: int) -> DataFrame:
    """(label, dim, cls, code, factor, turned, scale, slip): what a class is compared by before its vector is read."""

    def run(batches):
        for batch in batches:
            dims = np.array(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                unit = unit_rows(np.array(part.column("vec").flatten()).reshape(part.num_rows, dim))
                bits, factor = codes(unit, seed)
                q, scale, slip = quantised(unit, seed)
                raw = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("label", "dim", "cls")), raw(bits), pa.array(factor), raw(q), pa.array(scale), pa.array(slip)], ["label", "dim", "cls", "code", "factor", "turned", "scale", "slip"])

    rows = classes.select("label", "dim", "cls", "vec")
    return rows.mapInArrow(run, f"label {field_type(classes, 'label').simpleString()}, dim int, cls long, code binary, factor double, turned binary, scale double, slip double")


def _column(t: pa.Table, name: str) -> np.ndarray:
    return np.array(t.column(name).to_numpy(zero_copy_only=False))


def _likely(threshold: float):
    """The classes of two blocks of a label (or of one) that may have a link there, by codes alone."""

    def run(key, table):
        t = table.combine_chunks()
        dim = t.column("dim")[0].as_py()
        first, second = (t.filter(pc.is_valid(t.column(c))) for c in ("code", "turned"))
        code = signs(np.frombuffer(b"".join(first.column("code").to_pylist()), np.uint8).reshape(first.num_rows, -1), dim)
        factor = _column(first, "factor")
        other = np.frombuffer(b"".join(second.column("turned").to_pylist()), np.int8).reshape(second.num_rows, dim) * _column(second, "scale").astype(np.float32)[:, None]
        lowest = (lowest_estimate(factor, threshold) * factor).astype(np.float32)
        near = code @ other.T.astype(np.float32) >= lowest[:, None] - (_column(second, "slip") + 1e-5).astype(np.float32)[None, :]
        a, b = _column(first, "cls"), _column(second, "cls")
        near &= a[:, None] != b[None, :]
        cls = np.concatenate([a[near.any(axis=1)], b[near.any(axis=0)]])
        role = np.concatenate([np.zeros(near.any(axis=1).sum(), bool), np.ones(near.any(axis=0).sum(), bool)])
        return pa.table({"i": pa.array(np.full(len(cls), key[2].as_py()), pa.int32()), "j": pa.array(np.full(len(cls), key[3].as_py()), pa.int32()), "cls": cls, "second": role})

    return run


def _links(threshold: float):
    """Links between the likely classes of two blocks (or of one), as counts for each class and the edges of a spanning forest."""

    def run(key, table):
        t = table.combine_chunks()
        ids = _column(t, "id")
        order = np.argsort(ids, kind="stable")
        t, ids = t.take(order).combine_chunks(), ids[order]
        m, cls, second = (_column(t, c) for c in ("m", "cls", "second"))
        second = second.astype(bool)
        unit = unit_rows(np.array(t.column("vec").chunk(0).flatten()).reshape(len(ids), -1))
        i, j = np.flatnonzero(~second), np.flatnonzero(second)
        xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(i), 256):
            x, y = np.nonzero(unit[i[at : at + 256]] @ unit[j].T >= threshold - 1e-9)
            x, y = i[at + x], j[y]
            if key[0].as_py() == key[1].as_py():  # one block: each pair shows twice
                x, y = x[cls[x] < cls[y]], y[cls[x] < cls[y]]
            keep = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold  # exact recomputation in double precision
            xs.append(x[keep])
            ys.append(y[keep])
        x, y = np.concatenate(xs), np.concatenate(ys)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, x, m[y])
        np.add.at(links, y, m[x])
        root = spanning(x, y, len(ids))
        some = np.flatnonzero(links)
        return pa.table({"id": ids[some], "to": ids[root[some]], "cls": cls[some], "links": links[some]})

    return run


def near_duplicate_vectors(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, block: int = 1024, seed: int = 7) -> DataFrame:
    """Groups of near-duplicate vectors: (id_col, n_links, component_id, kept), one row per input row.

    Two vectors are linked when their labels are equal and not null, their lengths are equal
    and their cosine in double precision is at least `threshold`. Vectors that are null, empty or
    zero, or hold null or non-finite components, link with nothing. Equal vectors are one class
    from the start. The classes of a label are dealt into blocks of about `block`; each pair of
    blocks is one task. There, rotated binary codes with correction factors of one block meet the
    other block's rotated vectors, rounded to bytes, and give estimates of all inner products. The bound
    on an estimate is certain, so all links are found; it decides which classes' vectors are sent to
    the pair of blocks for exact recomputation. A task returns counts for each class and a spanning
    forest, never its pairs.

    A null id has no links, a null component and is kept. Rows with one id are one node.
    """
    rows = stage_table(prepared(df, id_col, vec_col, label_col, seed), "vectors")
    keys = ["label", "dim", "key1", "key2"]
    same = rows.groupBy(*keys).agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("vec").alias("vec"))
    same = stage_table(same.withColumn("cls", F.monotonically_increasing_id()), "classes")
    sizes = stage_table(same.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "sizes")
    dealt = coded(same, seed).join(sizes, ["label", "dim"]).withColumn("b", F.pmod(F.xxhash64("cls", F.lit(seed)), "blocks").cast("int"))
    # a class meets the blocks from its own on by its code, and those up to its own by its bytes
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    code, other = (F.when(t, F.col(c)) for t, c in ((F.col("b") <= F.col("x"), "code"), (F.col("b") >= F.col("x"), "turned")))
    cells = dealt.select("label", "dim", F.least("x", "b").alias("i"), F.greatest("x", "b").alias("j"), "cls", code.alias("code"), "factor", other.alias("turned"), "scale", "slip")
    likely = stage_table(cells.groupBy("label", "dim", "i", "j").applyInArrow(_likely(threshold), "i int, j int, cls long, second boolean"), "likely")
    kind = field_type(same, "id").simpleString()
    met = likely.join(same.select("cls", "label", "dim", "id", "m", "vec"), "cls")
    found = met.groupBy("i", "j", "label", "dim").applyInArrow(_links(threshold), f"id {kind}, to {kind}, cls long, links long")
    found = stage_table(found, "found")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("to").alias("b")), "vectors")
    known = same.select(*keys, "id", "m", "cls").join(counts, "cls", "left").join(comps, "id", "left")
    known = stage_table(known.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "known")
    mine = rows.select(*keys, "id").join(known, keys).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = df.select(F.col(id_col).alias("id")).join(mine, "id", "left")
    own = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
