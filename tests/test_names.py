"""Tables whose columns have the names that operators use inside."""

import pytest
from pyspark.sql import functions as F

from millrace import order
from millrace.operators import apply, joins, predicates, rows, sets, windows

INSIDE = ["_idx", "_block", "_own", "_part", "_before", "_key", "_key2", "_right_key", "_k0", "_k1", "_r_v", "_met", "_bucket", "_total", "_here", "_new", "_n", "_run", "_start", "_row", "_rolled", "_IDX2"]
ROWS = [(k, k % 3) for k in range(7)]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(ROWS, "k int, v int")
    return df.select("k", "v", *((F.lit(100 * (i + 1)) + F.col("k")).cast("int").alias(c) for i, c in enumerate(INSIDE)))


ORDER = ["k"]
SAME_ROWS = {
    "skip": (lambda d: rows.skip(d, 2, ORDER), range(2, 7)),
    "drop_last": (lambda d: rows.drop_last(d, 2, ORDER), range(5)),
    "slice": (lambda d: rows.row_slice(d, 1, 3, ORDER), range(1, 4)),
    "slice from the end": (lambda d: rows.row_slice(d, -2, None, ORDER), range(5, 7)),
    "every": (lambda d: rows.every(d, 3, ORDER), range(0, 7, 3)),
    "nth": (lambda d: rows.nth(d, [1, 4], ORDER), [1, 4]),
    "all but": (lambda d: rows.nth(d, [1, 4], ORDER, drop=True), [0, 2, 3, 5, 6]),
    "take while": (lambda d: rows.take_while(d, F.col("k") < 3, ORDER), range(3)),
    "skip until": (lambda d: rows.skip_until(d, F.col("k") == 3, ORDER), range(3, 7)),
    "take": (lambda d: rows.take_rows(d, [3, 0], ORDER).drop("_at"), [0, 3]),
    "roll": (lambda d: rows.roll_rows(d, 1, ORDER).drop("position"), range(7)),
    "shifted": (lambda d: order.shifted(d, "v", 1, ORDER, name="new").drop("new"), range(7)),
    "cumulative": (lambda d: order.cumulative(d, "v", "sum", ORDER, name="new").drop("new"), range(7)),
    "rolling": (lambda d: order.rolling(d, "v", "sum", 2, ORDER, name="new").drop("new"), range(7)),
    "islands": (lambda d: windows.islands(d, F.col("v"), ORDER, "new").drop("new"), range(7)),
    "duplicated": (lambda d: predicates.is_duplicated(d, name="new").drop("new"), range(7)),
    "uniq by": (lambda d: sets.uniq_by(d, "k", order=ORDER), range(7)),
    "join": (lambda d: joins.join(d, d.select("k"), "k"), range(7)),
    "typed join": (lambda d: joins.typed_join(d, d.select("k"), ["k"]), range(7)),
    "zip": (lambda d: joins.zip_rows(d, d.select(F.col("k").alias("z")), ORDER, ["z"]).drop("z"), range(7)),
    "merge": (lambda d: joins.merge_tables(d, d.select("v"), ORDER, ["v"]).drop("v").withColumn("v", F.col("k") % 3), range(7)),
    "range join": (lambda d: joins.range_join(d, d.limit(0).select().sparkSession.range(1).select(F.lit(-1).alias("lo"), F.lit(9).alias("hi")), "k", "lo", "hi", 4).drop("lo", "hi"), range(7)),
}


@pytest.mark.parametrize("name", SAME_ROWS)
def test_columns_keep_their_values(table, name):
    make, wanted = SAME_ROWS[name]
    got = make(table)
    assert sorted(got.columns) == sorted(table.columns)
    want = {r["k"]: r.asDict() for r in table.collect()}
    assert sorted(r["k"] for r in got.collect()) == list(wanted)
    assert all(r.asDict() == want[r["k"]] for r in got.collect())


def test_items_keep_their_values(table):
    want = {r["k"]: r.asDict() for r in table.collect()}
    for made in (windows.chunks(table, 3, ORDER), windows.sliding(table, 2, ORDER), windows.chunk_by(table, F.col("v"), ORDER)):
        for r in made.collect():
            assert all(x.asDict() == want[x["k"]] for x in r["items"])


def test_right_columns_keep_their_values(table):
    got = joins.typed_join(table.select("k", "_r_v", "_met"), table.select("k", "v"), ["k"]).collect()
    assert {(r["k"], r["v"]) for r in got} == set(ROWS)


@pytest.mark.parametrize("block", [2, 3, 100])
@pytest.mark.parametrize("by", [-5, -1, 0, 1, 2, 5, 9])
def test_shift_over_blocks(spark, monkeypatch, block, by):
    monkeypatch.setattr(order, "BLOCK", block)
    df = spark.createDataFrame([(k, None if k == 3 else k * k) for k in range(8)], "k int, v int")
    got = {r["k"]: r["w"] for r in order.shifted(df, "v", by, ORDER, fill=-1, name="w").collect()}
    value = [None if k == 3 else k * k for k in range(8)]
    assert got == {k: value[k - by] if 0 <= k - by < 8 else -1 for k in range(8)}


@pytest.mark.parametrize("size", [1, 3, 7])
def test_frames_longer_than_a_block(spark, monkeypatch, size):
    monkeypatch.setattr(order, "BLOCK", 2)
    df = spark.createDataFrame([(k,) for k in range(9)], "k int")
    got = {r["k"]: r["s"] for r in order.rolling(df, "k", "sum", size, ORDER, name="s").collect()}
    assert got == {k: sum(range(k - size + 1, k + 1)) if k >= size - 1 else None for k in range(9)}


def test_each_keeps_whole_numbers_beside_nulls(spark):
    df = spark.createDataFrame([(2**60 + 1,), (None,)], "n long")
    assert {r["n"] for r in apply.each(df, lambda r: r, "n long").collect()} == {2**60 + 1, None}


def test_deep_links(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(60)], "up int, me int")
    got = apply.recurse(df, "up", "me", F.col("me") == 1)
    assert got.agg(F.max("depth")).first()[0] == 59


def test_a_cluster_needs_a_shared_folder():
    from millrace.staging import shared_folder

    class Session:
        def __init__(self, **conf):
            self.conf = self
            self.values = conf

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077", ""):
        with pytest.raises(ValueError):
            shared_folder(Session(**{"spark.master": master}))
    assert shared_folder(Session(**{"spark.master": "local[2]"})) and shared_folder(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "s3://b/"})) == "s3://b"


def test_staged_tables_are_cleared(spark):
    from pathlib import Path

    from millrace.staging import clear, own_folder, stage

    assert stage(spark.range(3)).count() == 3
    folder = Path(own_folder(spark).removeprefix("file:"))
    assert folder.exists()
    clear(spark)
    assert not folder.exists()
