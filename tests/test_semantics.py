"""Cases that the driver tables do not hold: nulls, empty tables, ties, clashing names, odd texts."""

import base64
import json
import math

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace import Frame
from millrace import queries as core
from millrace.functions import binary, convert, formats, generate, lists, number, text
from millrace.functions import time as time_
from millrace.operators import apply, grouping, joins, predicates, projection, rows, sets, windows
from millrace.order import cumulative, rolling, shifted
from millrace.plans import inspect, selectors, sql
from millrace.sources import files, sqlite
from millrace.streaming import streams

from .oracle import difference


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def values(df):
    return sorted(tuple(r) for r in df.collect())


# -- joins --------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("how", "expected"),
    [
        ("inner", [(1, 2, 3)]),
        ("left", [(1, 2, 3), (5, 6, None)]),
        ("right", [(1, 2, 3), (7, None, 8)]),
        ("outer", [(1, 2, 3), (5, 6, None), (7, None, 8)]),
    ],
)
def test_join_by_text(spark, how, expected):
    a = spark.createDataFrame([(1, 2), (5, 6)], "a int, b int")
    b = spark.createDataFrame([("1", 3), ("7", 8)], "a string, c int")
    out = joins.join(a, b, "a", how=how)
    assert out.columns == ["a", "b", "c"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(expected, key=str)


def test_join_null_key_is_empty_text_and_clashes_get_underscores(spark):
    a = spark.createDataFrame([(None, 1)], "k string, v int")
    b = spark.createDataFrame([("", 2)], "k string, v int")
    assert joins.join(a, b, "k").select("v", "v_").first() == Row(v=1, v_=2)
    assert joins.join(a, b, "k", prefix="r_").columns == ["k", "v", "r_v"]


def test_join_empty_tables(spark):
    a = spark.createDataFrame([], "a int, b int")
    b = spark.createDataFrame([(1, 3)], "a int, c int")
    assert joins.join(a, b, "a").count() == 0
    assert values(joins.join(a, b, "a", how="outer")) == [(1, None, 3)]


def test_typed_full_join_keeps_both_keys_unless_told(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (None, "m")], "k int, v string")
    assert joins.typed_join(a, b, ["k"], how="full").columns == ["k", "v", "k_x", "v_x"]
    assert joins.typed_join(a, b, ["k"], how="full", coalesce=True).columns == ["k", "v", "v_x"]
    assert joins.typed_join(a, b, ["k"]).count() == 0
    assert joins.typed_join(a, b, ["k"], nulls_equal=True).count() == 1


def test_range_join_has_each_pair_once(spark):
    p = spark.createDataFrame([(0.0,), (0.99,), (5.0,), (-3.0,), (None,)], "x double")
    r = spark.createDataFrame([(0.0, 5.0), (-10.0, 100.0), (5.0, 5.0), (None, 2.0)], "lo double, hi double")
    got = values(joins.range_join(p, r, "x", "lo", "hi", 2.0).where("hi < 99").select("x"))
    assert got == [(0.0,), (0.99,)]
    assert joins.range_join(p, r, "x", "lo", "hi", 2.0).count() == 6


def test_range_join_takes_ranges_of_any_length(spark):
    inf, nan = math.inf, math.nan
    xs = [-inf, -1e300, -7.5, -0.0, 0.0, 1e-320, 0.3, 45.07, 45.075, 1e9, 1e300, inf, nan, None]
    bounds = [(-inf, inf), (-inf, 0.0), (0.3, inf), (0.0, nan), (-1e308, 1e308), (0.0, 1e12), (-1e9, 1.0), (0.0, 5e-324), (1e-320, 1e-310), (45.07, 45.08), (45.065, 45.075), (0.3, 0.3), (1.0, 0.0), (nan, inf), (None, 1.0), (0.0, None)]
    p = spark.createDataFrame([(k % 2, x) for k, x in enumerate(xs)], "g int, x double")
    r = spark.createDataFrame([(k % 2, *b) for k, b in enumerate(bounds)], "g int, lo double, hi double")
    text = lambda df: sorted(str(tuple(v)) for v in df.select("x", "lo", "hi").collect())
    for width in (1.0, 0.001, 1e6):
        assert text(joins.range_join(p, r.drop("g"), "x", "lo", "hi", width)) == text(p.crossJoin(r.drop("g")).where("lo <= x and x < hi"))
        assert text(joins.range_join(p, r, "x", "lo", "hi", width, ["g"])) == text(p.join(r, "g").where("lo <= x and x < hi"))
    big = 2**60
    p, r = spark.createDataFrame([(big + k,) for k in range(4)], "x long"), spark.createDataFrame([(big + 1, big + 3)], "lo long, hi long")
    assert values(joins.range_join(p, r, "x", "lo", "hi", 8).select("x")) == [(big + 1,), (big + 2,)]
    p, r = spark.range(100).selectExpr("cast(id / 10 as decimal(9, 1)) as x"), spark.createDataFrame([(0.25, 9.75)], "lo double, hi double")
    met = joins.range_join(p, r, "x", "lo", "hi", 1.0)
    assert met.columns == ["x", "lo", "hi"] and met.select(p["x"], r["lo"]).count() == 95
    assert joins.range_join(p, r.where("lo > 1"), "x", "lo", "hi", 1.0).count() == 0


def test_range_join_meets_few_rows_that_are_no_pairs(spark):
    p = spark.range(2000).select((F.col("id") / 1000).alias("x"))
    r = spark.range(2000).select((F.col("id") / 1000).alias("lo"), ((F.col("id") + 10) / 1000).alias("hi"))
    for width in (1.0, 1e-6):
        pairs = joins.range_join(p, r, "x", "lo", "hi", width).count()
        assert pairs == r.join(p, F.expr("lo <= x and x < hi")).count()
        keyed, spread, keys = joins.by_cells(p, r, "x", "lo", "hi", width)
        assert keyed.count() == 2000 and spread.count() <= 5 * 2000
        assert keyed.join(spread, keys).count() <= 2 * pairs


# -- groups -------------------------------------------------------------------------------


def test_median_leaves_out_nan_and_mode_has_ties(spark):
    df = spark.createDataFrame([(x,) for x in (math.nan, math.nan, 1.0, 2.0, 3.0, 4.0)], "x double")
    assert grouping.math(df, "median", "x").first()["x"] == 2.5
    df = spark.createDataFrame([(x,) for x in (3, 3, 9, 12, 12, 15)], "x int")
    assert grouping.mode(df, "x").first()["mode"] == [3, 12]


def test_strict_aggregates_fail_on_no_rows(spark):
    df = spark.createDataFrame([], "x int")
    assert grouping.math(df, "sum", "x").first()["x"] is None
    with pytest.raises(Exception, match="no values"):
        grouping.math(df, "sum", "x", strict=True).collect()


def test_group_lists_and_implode_keep_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), (None, 2)], "k string, v int")
    got = {r["k"]: len(r["items"]) for r in grouping.group_lists(df, "k").collect()}
    assert got == {"a": 2, None: 1}
    assert grouping.group_lists(df, "k", keep_null=False).count() == 1
    assert sorted(map(str, df.where("k = 'a'").agg(*grouping.implode("v")).first()["v"])) == ["1", "None"]
    with pytest.raises(ValueError):
        grouping.group_lists(df, "items")


def test_n_unique_counts_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "x string")
    assert df.agg(grouping.n_unique("x").alias("n")).first()["n"] == 2


def test_cut_labels(spark):
    assert one(spark, 10.0, lambda c: grouping.cut(c, [10, 20]), "double") == "(-inf, 10]"
    assert one(spark, 10.0, lambda c: grouping.cut(c, [10, 20], left_closed=True), "double") == "[10, 20)"
    assert one(spark, None, lambda c: grouping.cut(c, [10, 20]), "double") is None


def test_quantile_of_a_group(spark):
    df = spark.range(11)
    assert df.agg(grouping.quantile("id", 0.5).alias("q")).first()["q"] == 5


# -- columns ------------------------------------------------------------------------------


def test_insert_update_upsert_rules(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        projection.insert(df, "a", 1)
    with pytest.raises(ValueError):
        projection.update(df, "b", 1)
    assert projection.upsert(df, "b", 2).first() == Row(a=1, b=2)
    assert projection.select(df, "z?").first()["z"] is None


def test_flatten_names_and_empty_lists(spark):
    df = spark.createDataFrame([(1, Row(a=5, b=6)), (2, None)], "a int, s struct<a:int,b:int>")
    assert projection.flatten(df).columns == ["a", "s_a", "b"]
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "a int, l array<int>")
    assert projection.flatten(df, "l").count() == 2
    assert projection.explode(df, "l", empty_as_null=True).count() == 4


def test_merge_deep(spark):
    df = spark.createDataFrame([(Row(x=1, l=[1], s=Row(p=1, q=2)), Row(l=[2], s=Row(q=3, r=4)))], "a struct<x:int,l:array<int>,s:struct<p:int,q:int>>, b struct<l:array<int>,s:struct<q:int,r:int>>")
    m = projection.merge_deep(F.col("a"), F.col("b"), df.schema["a"].dataType, df.schema["b"].dataType, "append")
    assert df.select(m.alias("m")).first()["m"].asDict(True) == {"x": 1, "l": [1, 2], "s": {"p": 1, "q": 3, "r": 4}}


def test_default_fills_missing_columns_and_empty_cells(spark):
    df = spark.createDataFrame([("",), (None,), ("x",)], "a string")
    assert [r["a"] for r in projection.default(df, "d", "a").collect()] == ["", "d", "x"]
    assert [r["a"] for r in projection.default(df, "d", "a", empty=True).collect()] == ["d", "d", "x"]


# -- rows ---------------------------------------------------------------------------------


def test_order_null_last_and_reversed_whole(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "a int")
    assert [r["a"] for r in rows.sort_by(df, "a").collect()] == [1, 2, None]
    assert [r["a"] for r in rows.sort_by(df, "a", reverse=True).collect()] == [None, 2, 1]


def test_natural_order(spark):
    df = spark.createDataFrame([("f10",), ("f9",), ("f1",)], "a string")
    assert [r["a"] for r in rows.sort_by(df, "a", natural=True).collect()] == ["f1", "f9", "f10"]


def test_take_and_skip_without_a_hit(spark):
    df = spark.range(5)
    assert rows.take_while(df, F.col("id") < 99, ["id"]).count() == 5
    assert rows.skip_until(df, F.col("id") > 99, ["id"]).count() == 0
    assert values(rows.take_until(df, F.col("id") == 2, ["id"], include=1)) == [(0,), (1,), (2,)]


def test_empty_table_in_order(spark):
    df = spark.range(0)
    assert rows.skip(df, 1, ["id"]).count() == 0
    assert cumulative(df, "id", "sum", ["id"]).count() == 0


def test_order_across_many_blocks(spark, monkeypatch):
    import millrace.order as order

    monkeypatch.setattr(order, "BLOCK", 7)
    df = spark.range(50).select("id", (F.col("id") * 7 % 13).alias("v")).repartition(5)
    want = [i * 7 % 13 for i in range(50)]
    got = {r["id"]: r["s"] for r in cumulative(df, "v", "sum", ["id"], name="s").collect()}
    assert [got[i] for i in range(50)] == [sum(want[: i + 1]) for i in range(50)]
    got = {r["id"]: r["s"] for r in rolling(df, "v", "sum", 4, ["id"], "s").collect()}
    assert [got[i] for i in range(50)] == [None] * 3 + [sum(want[i - 3 : i + 1]) for i in range(3, 50)]
    got = {r["id"]: r["s"] for r in shifted(df, "v", -3, ["id"], fill=-1, name="s").collect()}
    assert [got[i] for i in range(50)] == want[3:] + [-1] * 3
    runs = {r["id"]: r["chunk"] for r in windows.islands(df, F.floor(F.col("id") / 9), ["id"]).collect()}
    assert [runs[i] for i in range(50)] == [i // 9 for i in range(50)]


def test_windows_with_remainder(spark):
    got = sorted(tuple(x["id"] for x in r["items"]) for r in windows.sliding(spark.range(5), 3, ["id"], 2, remainder=True).collect())
    assert got == [(0, 1, 2), (2, 3, 4), (4,)]


def test_uniq_options(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "i int, s string")
    assert sets.uniq_by(df, "s", order=["i"], ignore_case=True).count() == 2
    assert values(sets.uniq_by(df, "s", order=["i"], ignore_case=True, unique=True)) == [(3, "b")]


def test_headers_and_transpose(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "x", "y")], "i int, p string, q string")
    assert rows.headers(df, ["i"]).columns == ["0", "a", "column2"]
    with pytest.raises(ValueError):
        rows.transpose(spark.range(5), ["id"], limit=3)
    t = rows.transpose(df.select("p", "q", "i"), ["i"])
    assert [tuple(r) for r in t.collect()] == [("p", "a", "x"), ("q", None, "y"), ("i", "0", "1")]


def test_predicates_on_null(spark):
    df = spark.createDataFrame([(None,), ("a",)], "x string")
    assert [r[0] for r in df.select(predicates.is_in(F.col("x"), ["b", None])).collect()] == [True, False]
    assert predicates.any_row(df.limit(0), F.lit(True)).first()[0] is False
    assert predicates.all_rows(df.limit(0), F.lit(False)).first()[0] is True
    assert predicates.find(df, "a", invert=True).count() == 1


# -- functions ----------------------------------------------------------------------------


def test_text_functions(spark):
    assert one(spark, "helloWorld fooBAR", text.snake_case) == "hello_world_foo_bar"
    assert one(spark, "hello_world", text.camel_case) == "helloWorld"
    assert one(spark, "hello_world", text.pascal_case) == "HelloWorld"
    assert one(spark, "some_words", text.title_case) == "Some Words"
    assert one(spark, "añb", lambda c: text.index_of(c, "b")) == 3
    assert one(spark, "abcab", lambda c: text.index_of(c, "ab", end=True)) == 3
    assert one(spark, "a.b.c", lambda c: text.replace(c, ".", "-")) == "a-b.c"
    assert one(spark, "a1b2", lambda c: text.replace(c, r"\d", "#", regex=True)) == "a#b2"
    assert one(spark, "abc", lambda c: text.fill(c, 6, "*", "middle")) == "*abc**"
    assert one(spark, "abc", lambda c: text.fill(c, 2)) == "abc"
    assert one(spark, "a\nb\r\nc\n", lambda c: text.stats(c)["lines"]) == 3
    assert one(spark, "\x1b[31mred\x1b[0m", text.strip_ansi) == "red"
    assert one(spark, "foobar", lambda c: text.common_prefix(c, F.lit("foxes"))) == "fo"
    for s in ("", "f", "fo", "foo", "foob", "fooba", "foobar"):
        assert one(spark, s.encode(), text.encode_base32, "binary") == base64.b32encode(s.encode()).decode()
    assert one(spark, "a b/c_d", text.url_encode) == "a%20b/c%5Fd"
    assert one(spark, "/home/x/a.tar.gz", lambda c: text.path_parse(c)).asDict() == {"parent": "/home/x", "stem": "a.tar", "extension": "gz"}


def test_urls_and_paths(spark):
    u = "http://me:pw@example.com:8080/a/b.html?x=1#top"
    assert one(spark, u, lambda c: text.url_join(text.url_parse(c))) == u
    assert one(spark, u, lambda c: text.url_with(c, host="h.org", port="")) == "http://me:pw@h.org/a/b.html?x=1#top"
    assert one(spark, "a/b.txt", lambda c: text.path_with(c, extension="md")) == "a/b.md"
    assert one(spark, "/x/y/z", lambda c: text.path_relative_to(c, "/x")) == "y/z"
    assert one(spark, "/xy", lambda c: text.path_relative_to(c, "/x")) is None
    assert text.brace_expansions("{A,B}{1..2}c") == ["A1c", "A2c", "B1c", "B2c"]
    for s in (b"", b"f", b"foo", b"foobar"):
        assert bytes(one(spark, base64.b32encode(s).decode(), text.decode_base32)) == s
    assert spark.range(1).select(text.build_query(F.create_map(F.lit("a b"), F.lit("c&d")))).first()[0] == "a+b=c%26d"


def test_python_functions_over_rows(spark):
    df = spark.range(5)
    assert apply.each(df, lambda v: [{"a": v["id"]}] * (v["id"] % 2), "a long").count() == 2
    with pytest.raises(ValueError):
        apply.only(df)
    assert apply.only(df.where("id = 3")).first()["id"] == 3
    assert values(apply.each_while(df, "v", F.when(F.col("id") < 2, F.col("id")), ["id"])) == [(0,), (1,)]
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "up int, me int")
    assert apply.recurse(tree, "up", "me", F.col("me") == 2).count() == 3


def test_parse_texts(spark):
    df = spark.createDataFrame([("hi there",), ("none",), (None,)], "t string")
    assert [tuple(r) for r in text.parse(df, "t", "{a} {b}").collect()] == [("hi", "there")]
    assert text.parse(df, "t", "{_} {b}").columns == ["b"]
    got = text.parse(df, "t", r"(\w)h", regex=True)
    assert got.columns == ["capture0"] and [r[0] for r in got.collect()] == ["t"]
    assert text.split_column(df, "t", " ", n=2).columns == ["column0", "column1"]


def test_number_functions(spark):
    assert one(spark, -7, lambda c: number.floor_div(c, F.lit(2).cast("long")), "long") == -4
    assert one(spark, -7, lambda c: number.modulo(c, F.lit(2).cast("long")), "long") == 1
    assert one(spark, 7, lambda c: number.modulo(c, F.lit(-2).cast("long")), "long") == -1
    assert one(spark, -1.0, number.root, "double") is None
    assert one(spark, 5, lambda c: number.rotate_right(c, 1, 8), "long") == 0b10000010
    assert one(spark, 8, lambda c: number.trailing(c, "0"), "long") == 3
    assert one(spark, 1, lambda c: number.leading(c, "0", 8), "long") == 7
    assert one(spark, 258, number.format_bits, "long") == "00000001 00000010"


def test_conversions(spark):
    assert one(spark, "0xff", convert.into_int) == 255
    assert one(spark, "1_000", convert.into_int) == 1000
    assert one(spark, "zz", convert.into_int) is None
    assert one(spark, "1.5 KiB", convert.into_filesize) == 1536
    assert one(spark, "2kb", convert.into_filesize) == 2000
    assert one(spark, "x", convert.into_filesize) is None
    assert one(spark, "yes", convert.into_bool) is None
    assert one(spark, "yes", lambda c: convert.into_bool(c, relaxed=True)) is True
    assert one(spark, 1, lambda c: convert.into_binary(c, spark.range(1).schema["id"].dataType), "long") == bytearray(b"\x01" + b"\0" * 7)
    assert one(spark, "1.2.3-a+b", convert.into_semver).asDict() == {"major": 1, "minor": 2, "patch": 3, "pre": "a", "build": "b"}
    assert one(spark, "1.2", convert.into_semver) is None
    assert convert.schema({"a": "i64", "s": {"x": "list<str>"}}).simpleString() == "struct<a:bigint,s:struct<x:array<string>>>"
    assert [one(spark, v, convert.detect_type) for v in ("true", "12", "1.5", "3kb", "2024-01-02", "5sec", "abc")] == ["bool", "int", "float", "filesize", "datetime", "duration", "string"]


def test_times(spark):
    assert one(spark, "1hr 20min 3sec", time_.into_duration) == (3600 + 1200 + 3) * 10**9
    assert one(spark, "soon", time_.into_duration) is None
    assert one(spark, 90 * 10**9, time_.duration_parts, "long") == "1min 30sec"
    assert time_.pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"
    assert time_.calendar(spark, 2024, 2).first().asDict()["th"] == 1
    df = spark.sql("select timestamp '2024-05-17 13:45:00' t")
    assert str(df.select(time_.truncate(F.col("t"), "2mo")).first()[0]) == "2024-05-01 00:00:00"
    assert str(df.select(time_.truncate(F.col("t"), "1w")).first()[0]) == "2024-05-13 00:00:00"
    assert str(df.select(time_.ceil(F.col("t"), "1h")).first()[0]) == "2024-05-17 14:00:00"
    assert str(df.select(time_.truncate(F.col("t"), "2w")).first()[0])[:10] in ("2024-05-06", "2024-05-13")


def test_lists_and_matrices(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "x array<double>")
    m = lists.chunks(F.col("x"), 2)
    assert df.select(lists.matrix_multiply(m, m)).first()[0] == [[7.0, 10.0], [15.0, 22.0]]
    assert df.select(lists.matrix_transpose(m)).first()[0] == [[1.0, 3.0], [2.0, 4.0]]
    assert df.select(lists.matrix_sum(m, 0)).first()[0] == [4.0, 6.0]
    assert df.select(lists.scan(F.col("x"), F.lit(0.0), lambda a, b: a + b)).first()[0] == [1.0, 3.0, 6.0, 10.0]
    assert df.select(lists.windows(F.col("x"), 3)).first()[0] == [[1.0, 2.0, 3.0], [2.0, 3.0, 4.0]]
    assert df.select(lists.windows(F.col("x"), 9)).first()[0] == []
    assert df.select(lists.split_list(F.col("x"), 2.0)).first()[0] == [[1.0], [3.0, 4.0]]
    assert df.select(lists.take_while(F.col("x"), lambda v: v < 3)).first()[0] == [1.0, 2.0]
    assert df.select(lists.intersperse(F.col("x"), 0.0)).first()[0] == [1.0, 0.0, 2.0, 0.0, 3.0, 0.0, 4.0]
    assert df.select(lists.identity(2)).first()[0] == [[1.0, 0.0], [0.0, 1.0]]
    long = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "i int, j int, v double")
    assert {(r["i"], r["j"]): r["v"] for r in lists.long_multiply(long, long).collect()} == {(0, 0): 7.0, (0, 1): 10.0, (1, 0): 15.0, (1, 1): 22.0}


def test_bytes(spark):
    x = b"\x01\xab\x01\xab\xff"
    assert one(spark, x, binary.reverse, "binary") == x[::-1]
    assert one(spark, x, lambda c: binary.replace(c, b"\x01\xab", b"\x09"), "binary") == b"\x09\x01\xab\xff"
    assert one(spark, x, lambda c: binary.replace(c, b"\x01\xab", b"", all_=True), "binary") == b"\xff"
    assert one(spark, x, lambda c: binary.index_of(c, b"\x01", end=True), "binary") == 2
    assert one(spark, x, lambda c: binary.split(c, b"\xab"), "binary") == [b"\x01", b"\x01", b"\xff"]
    assert one(spark, x, lambda c: binary.at(c, 1, -2), "binary") == x[1:4]
    assert one(spark, x, lambda c: binary.add(c, b"\x00", 1, end=True), "binary") == x[:4] + b"\x00" + x[4:]
    assert one(spark, b"\x1a\xb0", lambda c: binary.replace(c, b"\xab", b"\x00", all_=True), "binary") == b"\x1a\xb0"


def test_formats(spark):
    assert json.loads(one(spark, "<note><remember>Event</remember></note>", lambda c: formats.from_format(c, "xml"))) == {
        "tag": "note",
        "attrs": {},
        "content": [{"tag": "remember", "attrs": {}, "content": [{"tag": None, "attrs": None, "content": "Event"}]}],
    }
    assert one(spark, "<broken", lambda c: formats.from_format(c, "xml")) is None
    assert json.loads(one(spark, "a = 1\n[b]\nc = 'x'", lambda c: formats.from_format(c, "toml"))) == {"a": 1, "b": {"c": "x"}}
    assert json.loads(one(spark, "[s]\nk = v", lambda c: formats.from_format(c, "ini"))) == {"s": {"k": "v"}}
    back = one(spark, '{"a":1,"b":{"c":"x"}}', lambda c: formats.to_format(c, "toml"))
    assert back == 'a = 1\n[b]\nc = "x"\n'
    page = json.loads(one(spark, "<html><title>T</title><a href='/x'>y</a><h1>H</h1></html>", lambda c: formats.from_format(c, "webpage")))
    assert page["title"] == "T" and page["links"] == ["/x"] and page["headings"] == ["H"]
    assert one(spark, "bread=baguette&cheese=comt%C3%A9", formats.from_url) == {"bread": "baguette", "cheese": "comté"}
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "i int, s string")
    assert formats.to_markdown(df, "i").first()[0] == "| i | s |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |"


def test_page_titles_equal_sql_on_odd_references(spark, tmp_path):
    titles = ["a &amp; b", "cut&amp", "&amp;amp", 'token = &quot;0b9', "&amp;quot;", "&#65;&#x42", "& &nbsp", "", "first</title></head><svg><title>second"]
    pages = [(k, f"<html><head><title>{x}</title></head><h1>A &amp; B</h1></html>") for k, x in enumerate(titles)]
    pages += [(90, None), (91, ""), (92, "<h1>none</h1>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert difference(core.queries()["page_titles"](spark, str(tmp_path)), con, core.oracle_sql()["page_titles"]) == ""
    page = json.loads(one(spark, pages[3][1], lambda c: formats.from_format(c, "webpage")))
    assert page["title"] == 'token = "0b9' and page["headings"] == ["A & B"]


def test_generators(spark):
    assert values(generate.seq(spark, 0, 1, 0.25)) == [(0.0,), (0.25,), (0.5,), (0.75,), (1.0,)]
    r = spark.range(200).select(generate.random_int(3, 5, seed=1).alias("i"), generate.random_float(2, 3, seed=2).alias("f"), F.octet_length(generate.random_binary(4)).alias("b")).agg(F.min("i"), F.max("i"), F.min("f"), F.max("f"), F.max("b")).first()
    assert tuple(r)[:2] == (3, 5) and r[2] >= 2 and r[3] < 3 and r[4] == 4
    assert values(generate.unfold(spark, 1, lambda s: (s, s * 2) if s < 20 else None, 100)) == [(1,), (2,), (4,), (8,), (16,)]


# -- plans, sources, streams --------------------------------------------------------------


def test_selectors_combine(spark):
    df = spark.createDataFrame([], "a int, b1 string, `c d` double, e array<int>")
    assert (selectors.numeric() | selectors.nested()).names(df) == ["a", "c d", "e"]
    assert (~selectors.alpha(ignore_spaces=True)).names(df) == ["b1"]
    assert selectors.by_index(-1).names(df) == ["e"]
    assert selectors.empty().names(df) == []


def test_sql_over_a_frame(spark):
    f = Frame(spark.range(10).toDF("x"))
    assert f.where("x > 3").query("select sum(x) s from df where x < 6").df.first()["s"] == 9
    with pytest.raises(ValueError):
        sql.query(f.df, "drop table df")
    assert "table<x: bigint>" == inspect.describe(f.df)
    assert "Range" in inspect.explain(f.df)


def test_pushdown_reaches_the_scan(spark, sf_dir):
    plan = inspect.explain(Frame.open(spark, f"{sf_dir}/orders.parquet").where("o_totalprice > 100000").select("o_orderkey").df)
    assert "GreaterThan(o_totalprice,100000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


@pytest.mark.parametrize("kind", ["csv", "tsv", "ndjson", "parquet", "orc", "xml"])
def test_save_and_open(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 'a,"b'), (2, "c\td")], "i long, s string")
    path = str(tmp_path / f"t.{kind}")
    files.save(df, path)
    with pytest.raises(Exception, match="(?i)exist"):
        files.save(df, path)
    files.save(df, path, append=True)
    assert values(files.open_(spark, path).select("i", "s").distinct()) == [(1, 'a,"b'), (2, "c\td")]
    assert files.listing(spark, path, "*.*").count() >= 2


def test_sqlite_and_store(spark, tmp_path):
    path = str(tmp_path / "x.db")
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None)], "i long, s string, l array<int>")
    files.save(df, path, table="t")
    with pytest.raises(ValueError):
        files.save(df, path, table="t")
    assert values(files.open_(spark, path, table="t").select("i", "l").where("i = 1")) == [(1, "[1,2]")]
    assert sqlite.query_sqlite(spark, path, "select i from t where i > ?", [1]).first()["i"] == 2
    store = sqlite.Store(spark)
    store.create("p", "i long, s string")
    store.insert("p", [{"i": 1, "s": "x"}, {"i": 2}])
    store.update("p", {"s": "y"}, "i = 2")
    store.delete("p", "i = 1")
    assert values(store.open()["p"]) == [(2, "y")]
    store.export(str(tmp_path / "y.db"))
    store.reset()
    assert store.open() == {}
    store.import_(str(tmp_path / "y.db"))
    assert values(store.open()["p"]) == [(2, "y")]


def test_stream_of_files(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    stream = streams.watch(spark, src, events.schema, files_at_once=1)
    counted = streams.event_windows(stream, "ts", "1 hour", F.count("*").alias("n"), by=["event_type"], late="3650 days")
    got = streams.to_completion(counted, "hours", "complete")
    want = streams.event_windows(events, "ts", "1 hour", F.count("*").alias("n"), by=["event_type"])
    assert values(got) == values(want)
    out = []
    q = streams.tee(streams.watch(spark, src, events.schema), lambda b: out.append(b.count()), lambda b: out.append(-b.count()))
    jobs = streams.Jobs()
    number_ = jobs.spawn(q, "count")
    q.processAllAvailable()
    assert jobs.list()[0][1] == "count" and sum(out) == 0 and max(out) == events.count()
    jobs.kill(number_)
