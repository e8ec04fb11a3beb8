"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import grouping as g
from millrace.queries.registry import Registry, Tables

QUERIES = Registry()


@QUERIES("""SELECT o_orderpriority, count(*) AS count, min(o_totalprice) AS o_totalprice_min, round(avg(o_totalprice), 4) AS o_totalprice_avg, max(o_totalprice) AS o_totalprice_max, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders GROUP BY o_orderpriority""")
def aggregate_default_ops(t: Tables):
    out = g.aggregate(t.orders, ["o_orderpriority"], ["o_totalprice"])
    return out.withColumns({"o_totalprice_avg": F.round("o_totalprice_avg", 4), "o_totalprice_sum": F.round("o_totalprice_sum", 2)})


@QUERIES("SELECT c_nationkey::VARCHAR AS c_nationkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS keys, count(*) AS n FROM customer GROUP BY c_nationkey")
def group_into_lists(t: Tables):
    out = g.group_lists(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", order=["c_custkey"])
    keys = F.transform("items", lambda x: x["c_custkey"].cast("string"))
    return out.select("c_nationkey", F.array_join(keys, ",").alias("keys"), F.size("items").cast("long").alias("n"))


@QUERIES("""SELECT event_type, n AS count, n / t AS quantile, printf('%.2f%%', 100 * n / t) AS percentage, repeat('*', floor(100 * n / t)::INTEGER) AS frequency FROM (SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS t FROM events GROUP BY event_type)""")
def histogram_column(t: Tables):
    return g.histogram(t.events, "event_type")


@QUERIES("SELECT lang, count(*) AS count FROM documents GROUP BY lang")
def count_values(t: Tables):
    return g.value_counts(t.documents, "lang")


@QUERIES("SELECT lang, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY lang")
def count_shares(t: Tables):
    return g.value_counts(t.documents, "lang", "share", normalize=True)


@QUERIES("SELECT round(sum(value), 4) AS value FROM events")
def math_sum(t: Tables):
    return g.math(t.events, "sum", "value").select(F.round("value", 4).alias("value"))


@QUERIES("SELECT event_type, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def math_avg(t: Tables):
    return g.math(t.events, "avg", "value", by=["event_type"]).select("event_type", F.round("value", 6).alias("value"))


@QUERIES("SELECT event_type, median(value) AS value FROM events GROUP BY event_type")
def math_median(t: Tables):
    return g.math(t.events, "median", "value", by=["event_type"])


@QUERIES("SELECT round(stddev_pop(value), 6) AS sd, round(var_pop(value), 6) AS var, round(stddev_samp(value), 6) AS sds FROM events")
def math_spread(t: Tables):
    e = t.events.select(F.col("value").alias("sd"), F.col("value").alias("var"), F.col("value").alias("sds"))
    one = lambda op, c, sample=False: g.math(e, op, c, sample=sample).select(F.round(c, 6).alias(c))
    return one("stddev", "sd").crossJoin(one("variance", "var")).crossJoin(one("stddev", "sds", True))


@QUERIES("SELECT min(l_shipdate)::VARCHAR AS low, max(l_shipdate)::VARCHAR AS high FROM lineitem")
def math_min_max(t: Tables):
    return t.lineitem.agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("low"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("high"))


@QUERIES("SELECT n_regionkey, round(product(n_nationkey + 1), 2) AS k FROM nation GROUP BY n_regionkey")
def math_product(t: Tables):
    return g.math(t.nation.select("n_regionkey", (F.col("n_nationkey") + 1).alias("k")), "product", "k", by=["n_regionkey"]).select("n_regionkey", F.round("k", 2).alias("k"))


@QUERIES("""SELECT string_agg(user_id::VARCHAR, ',' ORDER BY user_id) AS mode FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id))""")
def math_mode(t: Tables):
    return g.mode(t.events, "user_id").select(F.array_join(F.col("mode").cast("array<string>"), ",").alias("mode"))


@QUERIES("SELECT source, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def unique_counts(t: Tables):
    return t.documents.groupBy("source").agg(g.n_unique("lang").alias("langs"))


@QUERIES("""SELECT o_totalprice FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i = round_even((n - 1) * 0.9, 0)""")
def quantile_nearest(t: Tables):
    return g.quantile_by_rank(t.orders, "o_totalprice", 0.9)


@QUERIES("SELECT o_orderkey, greatest(o_orderkey, o_custkey) AS high, least(o_orderkey, o_custkey) AS low, o_orderkey + o_custkey AS total FROM orders")
def across_columns(t: Tables):
    pair = ("o_orderkey", "o_custkey")
    return t.orders.select("o_orderkey", g.horizontal("max", *pair).alias("high"), g.horizontal("min", *pair).alias("low"), g.horizontal("sum", *pair).alias("total"))


@QUERIES("""SELECT round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type)""")
def entropy_of_types(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("*").cast("double").alias("n")).agg(F.round(g.entropy("n"), 6).alias("entropy"))


@QUERIES("""SELECT l_shipmode, round("A", 2) AS "A", round("N", 2) AS "N", round("R", 2) AS "R" FROM (SELECT l_linestatus AS l_shipmode, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS "A", sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS "N", sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS "R" FROM lineitem GROUP BY l_linestatus)""")
def pivot_flags(t: Tables):
    rows = t.lineitem.select(F.col("l_linestatus").alias("l_shipmode"), "l_returnflag", "l_quantity")
    out = g.pivot(rows, "l_returnflag", "l_quantity", ["l_shipmode"], "sum", ["A", "N", "R"])
    return out.select("l_shipmode", *(F.round(c, 2).alias(c) for c in "ANR"))


@QUERIES("SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot_columns(t: Tables):
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return g.unpivot(rows, ["p_partkey"], ["p_size", "p_retailprice"])


@QUERIES("""SELECT event_id, CASE WHEN value <= 10 THEN '(-inf, 10]' WHEN value <= 50 THEN '(10, 50]' ELSE '(50, inf]' END AS category FROM events WHERE value IS NOT NULL""")
def cut_bins(t: Tables):
    return t.events.where("value IS NOT NULL").select("event_id", g.cut(F.col("value"), [10, 50]).alias("category"))


@QUERIES("""SELECT c_custkey, CASE WHEN c_acctbal <= (SELECT quantile_cont(c_acctbal, 0.5) FROM customer) THEN 'low' ELSE 'high' END AS category FROM customer""")
def qcut_bins(t: Tables):
    return g.qcut(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", [0.5], ["low", "high"]).select("c_custkey", "category")


@QUERIES("""SELECT bit_and(l_orderkey) AS a, bit_or(l_orderkey) AS o, bit_xor(l_orderkey) AS x, round(sum(l_quantity * l_discount), 2) AS dot FROM lineitem""")
def bit_aggregates(t: Tables):
    return t.lineitem.agg(F.bit_and("l_orderkey").alias("a"), F.bit_or("l_orderkey").alias("o"), F.bit_xor("l_orderkey").alias("x"), F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 2).alias("dot"))


@QUERIES("""SELECT d AS descriptor, v AS s_acctbal FROM (SELECT unnest(['count', 'mean', 'std', 'min', 'max']) AS d, unnest([count(*)::DOUBLE, round(avg(s_acctbal), 4), round(stddev_pop(s_acctbal), 4), min(s_acctbal), max(s_acctbal)]) AS v FROM supplier)""")
def summary_statistics(t: Tables):
    out = g.summary(t.supplier.select("s_acctbal")).where(F.col("descriptor").isin("count", "mean", "std", "min", "max"))
    return out.select("descriptor", F.when(F.col("descriptor").isin("mean", "std"), F.round("s_acctbal", 4)).otherwise(F.col("s_acctbal")).alias("s_acctbal"))


@QUERIES("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(t: Tables):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@QUERIES("SELECT user_id, event_type, round(sum(value) OVER (PARTITION BY user_id), 4) AS total, event_id FROM events")
def sum_over_group(t: Tables):
    from millrace.operators.windows import over

    return t.events.select("user_id", "event_type", F.round(over(F.sum("value"), "user_id"), 4).alias("total"), "event_id")
