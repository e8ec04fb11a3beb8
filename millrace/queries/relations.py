"""Whole-table queries: filters, joins, sets, SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import joins, predicates, sets
from millrace.plans.sql import query as sql_query
from millrace.queries.registry import Registry, Tables

QUERIES = Registry()


@QUERIES("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
 round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(t: Tables):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(price), 2).alias("sum_disc_price"),
            F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
    )


@QUERIES("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def where_rows(t: Tables):
    return predicates.where(t.orders, (F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_totalprice")


@QUERIES("""SELECT c.c_custkey, o.o_orderkey, n.n_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE c.c_mktsegment = 'BUILDING'""")
def join_typed_inner(t: Tables):
    c = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_nationkey")
    out = joins.typed_join(c, t.orders.select("o_orderkey", "o_custkey"), ["c_custkey"], ["o_custkey"])
    return joins.typed_join(out, t.nation.select("n_nationkey", "n_name"), ["c_nationkey"], ["n_nationkey"]).select("c_custkey", "o_orderkey", "n_name")


@QUERIES("""SELECT c.c_custkey, c.c_name, o.o_orderkey FROM customer c LEFT JOIN orders o ON CAST(o.o_custkey AS VARCHAR) = CAST(c.c_custkey AS VARCHAR)""")
def join_text_left(t: Tables):
    o = t.orders.select("o_orderkey", "o_custkey")
    return joins.join(t.customer.select("c_custkey", "c_name"), o, "c_custkey", "o_custkey", "left")


@QUERIES("""SELECT coalesce(a.k, b.k) AS k, a.n AS n, b.n AS n_ FROM (SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey >= 10) b ON a.k = b.k""")
def join_text_outer(t: Tables):
    n = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))
    return joins.join(n.where("k < 15"), n.where("k >= 10"), "k", how="outer")


@QUERIES("""SELECT s.s_suppkey, s.s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 50)""")
def join_semi(t: Tables):
    big = t.lineitem.where("l_quantity >= 50").select("l_suppkey")
    return joins.typed_join(t.supplier.select("s_suppkey", "s_name"), big, ["s_suppkey"], ["l_suppkey"], "semi")


@QUERIES("""SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""")
def join_anti(t: Tables):
    return joins.typed_join(t.customer.select("c_custkey"), t.orders.select("o_custkey"), ["c_custkey"], ["o_custkey"], "anti")


@QUERIES("""SELECT a.event_type AS event_type, a.n AS n, b.n AS n_x FROM (SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS event_type, count(*) AS n FROM events GROUP BY 1) a
 JOIN (SELECT CASE WHEN user_id % 2 = 0 THEN NULL ELSE event_type END AS event_type, count(*) AS n FROM events GROUP BY 1) b ON a.event_type IS NOT DISTINCT FROM b.event_type""")
def join_nulls_equal(t: Tables):
    def side(k):
        return t.events.select(F.when(F.col("user_id") % k != 0, F.col("event_type")).alias("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))

    return joins.typed_join(side(3), side(2), ["event_type"], nulls_equal=True)


@QUERIES("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
def join_cross(t: Tables):
    return joins.typed_join(t.region.select("r_name"), t.nation.select("n_name"), [], how="cross")


@QUERIES("""SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal""")
def join_where_theta(t: Tables):
    a = t.supplier.select(F.col("s_suppkey").alias("low"), F.col("s_nationkey").alias("na"), F.col("s_acctbal").alias("ba"))
    b = t.supplier.select(F.col("s_suppkey").alias("high"), F.col("s_nationkey").alias("nb"), F.col("s_acctbal").alias("bb"))
    return joins.join_where(a, b, F.col("na") == F.col("nb"), F.col("ba") < F.col("bb")).select("low", "high")


@QUERIES("""SELECT e.event_id, p.p_partkey FROM events e JOIN (SELECT p_partkey, p_retailprice / 20 AS lo, p_retailprice / 20 + 0.01 AS hi FROM part) p ON e.value >= p.lo AND e.value < p.hi""")
def join_range_buckets(t: Tables):
    p = t.part.select("p_partkey", (F.col("p_retailprice") / 20).alias("lo"), (F.col("p_retailprice") / 20 + 0.01).alias("hi"))
    return joins.range_join(t.events.select("event_id", "value"), p, "value", "lo", "hi", 1.0).select("event_id", "p_partkey")


@QUERIES("""SELECT a.n_name AS n_name, b.r_name AS r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) b USING (i)""")
def zip_tables(t: Tables):
    return joins.zip_rows(t.nation.select("n_nationkey", "n_name"), t.region.select("r_regionkey", "r_name"), ["n_nationkey"], ["r_regionkey"]).select("n_name", "r_name")


@QUERIES("""SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.i IS NOT NULL THEN b.n ELSE a.n END AS n FROM (SELECT n_nationkey AS k, n_name AS n, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a FULL JOIN (SELECT r_regionkey AS k, r_name AS n, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) b USING (i)""")
def merge_rows(t: Tables):
    a = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))
    b = t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n"))
    return joins.merge_tables(a, b, ["k"], ["k"])


@QUERIES("SELECT lang, source FROM documents WHERE doc_id % 2 = 0 UNION SELECT lang, source FROM documents WHERE doc_id % 3 = 0")
def set_union(t: Tables):
    d = t.documents
    return sets.union(d.where("doc_id % 2 = 0").select("lang", "source"), d.where("doc_id % 3 = 0").select("lang", "source"))


@QUERIES("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_intersect(t: Tables):
    e = t.events
    return sets.intersect(e.where("event_type = 'click'").select("user_id"), e.where("event_type = 'purchase'").select("user_id"))


@QUERIES("SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_difference(t: Tables):
    e = t.events
    return sets.difference(e.where("event_type = 'click'").select("user_id"), e.where("event_type = 'purchase'").select("user_id"))


@QUERIES("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def uniq_rows(t: Tables):
    return sets.uniq(t.orders.select("o_orderstatus", "o_orderpriority"))


@QUERIES("SELECT arg_min(o_orderkey, o_orderkey) AS o_orderkey, o_custkey, count(*) AS count FROM orders GROUP BY o_custkey")
def uniq_by_first(t: Tables):
    return sets.uniq_by(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", order=["o_orderkey"], count=True)


@QUERIES("SELECT max(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def uniq_by_last_repeated(t: Tables):
    return sets.uniq_by(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", order=["o_orderkey"], keep_last=True, repeated=True)


@QUERIES("SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) = 1)")
def unique_mask(t: Tables):
    return predicates.is_unique(t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"), ["c_nationkey"]).where("is_unique").select("c_custkey", "c_mktsegment")


@QUERIES("SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type) > 1 AS is_duplicated FROM events")
def duplicated_mask(t: Tables):
    return predicates.is_duplicated(t.events.select("user_id", "event_type"))


@QUERIES("SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%' OR lower(source) LIKE '%license%'")
def find_text(t: Tables):
    return predicates.find(t.documents, "License", columns=["text", "source"], ignore_case=True).select("doc_id")


@QUERIES("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, 'th[aeiou]n')")
def find_regex_inverted(t: Tables):
    return predicates.find(t.documents, "th[aeiou]n", columns=["text"], regex=True, invert=True).select("doc_id")


@QUERIES("SELECT coalesce(bool_or(o_totalprice > 400000), false) AS \"any\" FROM orders")
def any_true(t: Tables):
    return predicates.any_row(t.orders, F.col("o_totalprice") > 400000)


@QUERIES("SELECT coalesce(bool_and(o_totalprice > 0), true) AS \"all\" FROM orders")
def all_true(t: Tables):
    return predicates.all_rows(t.orders, F.col("o_totalprice") > 0)


@QUERIES("""SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_orderstatus IN ('F', 'P') THEN 'done' WHEN o_totalprice BETWEEN 100000 AND 200000 THEN 'mid' ELSE 'other' END AS kind FROM orders""")
def match_cases(t: Tables):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return t.orders.select("o_orderkey", predicates.match(price, (price < 50000, "low"), (status.isin("F", "P"), "done"), ((100000, 200000), "mid"), otherwise="other").alias("kind"))


@QUERIES("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE c_mktsegment END AS segment FROM customer")
def replace_values(t: Tables):
    return t.customer.select("c_custkey", predicates.replace(F.col("c_mktsegment"), {"BUILDING": "b", "MACHINERY": "m"}).alias("segment"))


@QUERIES("SELECT event_id, coalesce(nullif(value, 0) > 50, false) AS big, value IN (1, 2, 3) AS few FROM events")
def is_in_list(t: Tables):
    return t.events.select("event_id", F.coalesce(F.nullif(F.col("value"), F.lit(0.0)) > 50, F.lit(False)).alias("big"), predicates.is_in(F.col("value"), [1.0, 2.0, 3.0]).alias("few"))


@QUERIES("SELECT l.doc_id, coalesce(l.quality, -1)::INTEGER AS quality FROM labels l WHERE l.toxic IS NOT NULL")
def compact_and_fill(t: Tables):
    return predicates.fill_null(predicates.compact(t.labels, "toxic"), -1, "quality").select("doc_id", "quality")


@QUERIES("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority")
def sql_over_frame(t: Tables):
    return sql_query(t.orders, "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM df WHERE o_totalprice > 1000 GROUP BY o_orderpriority")


@QUERIES("""SELECT r.r_name, count(DISTINCT o.o_custkey) AS customers, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
 FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name""")
def revenue_by_region(t: Tables):
    small = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(small, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name").agg(F.count_distinct("o_custkey").alias("customers"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
