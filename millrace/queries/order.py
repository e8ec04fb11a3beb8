"""Queries on rows in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import rows as r
from millrace.operators import windows as w
from millrace.queries.registry import Registry, Tables

QUERIES = Registry()
BY_TIME = ["ts", "event_id"]


@QUERIES("SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 25")
def first_rows(t: Tables):
    return r.first(t.events, 25, BY_TIME).select("event_id", "value")


@QUERIES("SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def last_rows(t: Tables):
    return r.last(t.events, 25, BY_TIME).select("event_id", "value")


@QUERIES("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 1000000000 OFFSET 100")
def skip_rows(t: Tables):
    return r.skip(t.events, 100, BY_TIME).select("event_id")


@QUERIES("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i > 10")
def drop_last_rows(t: Tables):
    return r.drop_last(t.events, 10, BY_TIME).select("event_id")


@QUERIES("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i >= n - 20 AND i <= n - 5")
def slice_rows(t: Tables):
    return r.row_slice(t.events, -20, -5, BY_TIME).select("event_id")


@QUERIES("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i % 7 = 0")
def every_nth(t: Tables):
    return r.every(t.events, 7, BY_TIME).select("event_id")


@QUERIES("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i NOT IN (0, 2, 4)")
def drop_nth(t: Tables):
    return r.nth(t.events, [0, 2, 4], BY_TIME, drop=True).select("event_id")


@QUERIES("""WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) SELECT event_id FROM e WHERE i < (SELECT min(i) FROM e WHERE value > 90)""")
def take_until_value(t: Tables):
    return r.take_until(t.events, F.col("value") > 90, BY_TIME).select("event_id")


@QUERIES("""WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) SELECT event_id FROM e WHERE i >= (SELECT min(i) FROM e WHERE NOT (value < 95))""")
def skip_while_value(t: Tables):
    return r.skip_while(t.events, F.col("value") < 95, BY_TIME).select("event_id")


@QUERIES("SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS index, event_id FROM events")
def enumerate_events(t: Tables):
    return r.enumerate_rows(t.events, BY_TIME).select("index", "item.event_id")


@QUERIES("SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1 + 3) % count(*) OVER () AS position FROM events")
def roll_rows_down(t: Tables):
    return r.roll_rows(t.events.select("event_id", "ts"), 3, BY_TIME).select("event_id", "position")


@QUERIES("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def top_customers(t: Tables):
    return r.top(t.customer, 20, [-F.col("c_acctbal"), "c_custkey"]).select("c_custkey", "c_acctbal")


@QUERIES("SELECT event_id, lag(value, 2) OVER (ORDER BY ts, event_id) AS before FROM events")
def shift_values(t: Tables):
    return w.shifted(t.events, "value", 2, BY_TIME, name="before").select("event_id", "before")


@QUERIES("SELECT event_id, sum(user_id) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM events")
def cumulative_sum(t: Tables):
    return w.cumulative(t.events, "user_id", "sum", BY_TIME, name="running").select("event_id", "running")


@QUERIES("SELECT event_id, max(value) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS running FROM events")
def cumulative_max_reverse(t: Tables):
    return w.cumulative(t.events, "value", "max", BY_TIME, reverse=True, name="running").select("event_id", "running")


@QUERIES("""SELECT event_id, CASE WHEN count(*) OVER f = 5 THEN sum(user_id) OVER f END::BIGINT AS s FROM events WINDOW f AS (ORDER BY ts, event_id ROWS 4 PRECEDING)""")
def rolling_sum(t: Tables):
    return w.rolling(t.events, "user_id", "sum", 5, BY_TIME, "s").select("event_id", "s")


@QUERIES("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 3599999999 FOLLOWING) AS n FROM events""")
def rolling_hour(t: Tables):
    return w.rolling_time(t.events, "ts", "1 hour", F.count("*"), by=["user_id"]).select("event_id", F.col("_a0").alias("n"))


@QUERIES("""SELECT i // 8 AS chunk, string_agg(event_id::VARCHAR, ',' ORDER BY i) AS ids FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY 1""")
def chunks_of_rows(t: Tables):
    out = w.chunks(t.events.select("event_id", "ts"), 8, BY_TIME)
    return out.select("chunk", F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@QUERIES("""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events), s AS (SELECT i AS start FROM e WHERE i % 10 = 0)
 SELECT s.start, string_agg(e.event_id::VARCHAR, ',' ORDER BY e.i) AS ids FROM s JOIN e ON e.i BETWEEN s.start AND s.start + 3 GROUP BY s.start HAVING count(*) = 4""")
def sliding_windows(t: Tables):
    out = w.sliding(t.events.select("event_id", "ts"), 4, BY_TIME, stride=10)
    return out.select("start", F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@QUERIES("""WITH e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS i FROM events), c AS (SELECT *, CASE WHEN lag(event_type) OVER (ORDER BY i) <> event_type THEN 1 ELSE 0 END AS n FROM e)
 SELECT event_id, (sum(n) OVER (ORDER BY i))::BIGINT AS chunk FROM c""")
def chunk_by_type(t: Tables):
    return w.islands(t.events, F.col("event_type"), BY_TIME).select("event_id", "chunk")


@QUERIES("SELECT (SELECT i FROM (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) ORDER BY value DESC, i LIMIT 1) AS arg_max")
def position_of_max(t: Tables):
    return r.arg_extreme(t.events, "value", BY_TIME)


@QUERIES("SELECT min(i) AS arg_unique FROM (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY event_type")
def position_of_unique(t: Tables):
    return r.arg_unique(t.events, "event_type", BY_TIME)


@QUERIES("SELECT row_number() OVER (ORDER BY s_acctbal, i) - 1 AS rank, i AS arg_sort FROM (SELECT s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier)")
def positions_sorted(t: Tables):
    return r.arg_sort(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", ["s_suppkey"])


@QUERIES("SELECT i AS arg_true FROM (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) WHERE value > 50")
def positions_true(t: Tables):
    return r.arg_true(t.events, F.col("value") > 50, BY_TIME)


@QUERIES("SELECT 'r_regionkey' AS column0, '0' AS column1, '1' AS column2, '2' AS column3, '3' AS column4, '4' AS column5 UNION ALL SELECT 'r_name', max(CASE WHEN r_regionkey = 0 THEN r_name END), max(CASE WHEN r_regionkey = 1 THEN r_name END), max(CASE WHEN r_regionkey = 2 THEN r_name END), max(CASE WHEN r_regionkey = 3 THEN r_name END), max(CASE WHEN r_regionkey = 4 THEN r_name END) FROM region")
def transpose_table(t: Tables):
    return r.transpose(t.region, ["r_regionkey"])


@QUERIES("SELECT a.n_name AS n_name_0, b.n_name AS n_name_1 FROM nation a JOIN nation b ON a.n_name < b.n_name")
def combine_pairs(t: Tables):
    return r.combinations(t.nation.select("n_name"), 2, "n_name")


@QUERIES("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, NULL FROM region")
def append_tables(t: Tables):
    return r.append(t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), t.region.select(F.col("r_regionkey").alias("k")))
