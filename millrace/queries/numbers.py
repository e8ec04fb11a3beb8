"""Arithmetic, bits, generated numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import generate as g
from millrace.functions import number as n
from millrace.queries.registry import Registry, Tables

QUERIES = Registry()


@QUERIES("""SELECT event_id, round(sin(value), 8) AS s, round(cos(value), 8) AS c, round(exp(value / 100), 8) AS e, round(sqrt(value), 8) AS r, round(ln(value + 1), 8) AS l, round(cbrt(value), 8) AS cb, round(atan(value), 8) AS at FROM events""")
def elementary_functions(t: Tables):
    v = F.col("value")
    f = lambda name, c: F.round(n.elementary(name, c), 8)
    return t.events.select("event_id", f("sin", v).alias("s"), f("cos", v).alias("c"), f("exp", v / 100).alias("e"), f("sqrt", v).alias("r"), f("ln", v + 1).alias("l"), f("cbrt", v).alias("cb"), f("arctan", v).alias("at"))


@QUERIES("SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS c, sign(c_acctbal)::DOUBLE AS s FROM customer")
def rounding(t: Tables):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.abs(b).alias("a"), F.floor(b).alias("f"), F.ceil(b).alias("c"), n.elementary("sign", b).alias("s"))


@QUERIES("SELECT o_orderkey, floor((o_orderkey - 20000) / 7)::BIGINT AS q, ((o_orderkey - 20000) % 7 + 7) % 7 AS m FROM orders")
def floored_division(t: Tables):
    a, b = F.col("o_orderkey") - 20000, F.lit(7).cast("long")
    return t.orders.select("o_orderkey", n.floor_div(a, b).alias("q"), n.modulo(a, b).alias("m"))


@QUERIES("""SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 255 AS o, xor(o_orderkey, 255) AS x, (o_orderkey << 3) AS l, (o_orderkey >> 3) AS r, bit_count(o_orderkey)::INTEGER AS ones FROM orders""")
def bit_operations(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", k.bitwiseAND(F.lit(255)).alias("a"), k.bitwiseOR(F.lit(255)).alias("o"), k.bitwiseXOR(F.lit(255)).alias("x"), n.shift_left(k, 3).alias("l"), n.shift_right(k, 3).alias("r"), n.count_ones(k).alias("ones"))


@QUERIES("SELECT o_orderkey, (((o_orderkey & 255) << 3) | ((o_orderkey & 255) >> 5)) & 255 AS rol, 255 - (o_orderkey & 255) AS inv FROM orders")
def bit_rotation(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", n.rotate_left(k, 3, 8).alias("rol"), n.bits_not(k, 8).alias("inv"))


@QUERIES("SELECT n_nationkey, '0x' || lower(to_hex(n_nationkey)) AS lowerhex, '0b' || bin(n_nationkey) AS binary FROM nation")
def number_formats(t: Tables):
    f = n.format_number(F.col("n_nationkey"))
    return t.nation.select("n_nationkey", f["lowerhex"].alias("lowerhex"), f["binary"].alias("binary"))


@QUERIES("SELECT range AS value FROM range(5, 51, 5)")
def number_sequence(t: Tables):
    return g.seq(t.spark, 5, 50, 5)


@QUERIES("SELECT chr(range::INTEGER) AS value FROM range(97, 103)")
def character_sequence(t: Tables):
    return g.seq_char(t.spark, "a", "f")


@QUERIES("WITH RECURSIVE g(value) AS (SELECT 1::BIGINT UNION ALL SELECT value * 3 FROM g WHERE value < 5000) SELECT value FROM g")
def generated_powers(t: Tables):
    return g.generate(t.spark, "1", "value * 3", "value >= 5000")
