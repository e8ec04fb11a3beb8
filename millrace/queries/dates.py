"""Date and time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import time as d
from millrace.queries.registry import Registry, Tables
from millrace.streaming.streams import event_windows, sessions

QUERIES = Registry()


@QUERIES("""SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, dayofyear(o_orderdate)::INTEGER AS doy, weekofyear(o_orderdate)::INTEGER AS w, isodow(o_orderdate)::INTEGER AS wd, quarter(o_orderdate)::INTEGER AS q FROM orders""")
def date_parts(t: Tables):
    c = F.col("o_orderdate")
    names = {"y": "year", "m": "month", "d": "day", "doy": "ordinal", "w": "week", "wd": "weekday", "q": "quarter"}
    return t.orders.select("o_orderkey", *(d.part(c, v).alias(k) for k, v in names.items()))


@QUERIES("SELECT event_id, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS mi, second(ts)::INTEGER AS s, (epoch_us(ts) % 1000000 * 1000)::INTEGER AS ns FROM events")
def time_parts(t: Tables):
    c = F.col("ts")
    return t.events.select("event_id", d.part(c, "hour").alias("h"), d.part(c, "minute").alias("mi"), d.part(c, "second").alias("s"), d.part(c, "nanosecond").alias("ns"))


@QUERIES("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t FROM orders")
def format_dates(t: Tables):
    return t.orders.select("o_orderkey", d.strftime(F.col("o_orderdate"), "%Y/%m/%d").alias("d"), d.strftime(F.col("o_orderdate"), "%H:%M:%S").alias("t"))


@QUERIES("SELECT o_orderkey, year(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y'))::INTEGER AS y FROM orders")
def parse_dates(t: Tables):
    text = d.strftime(F.col("o_orderdate"), "%d/%m/%Y")
    return t.orders.select("o_orderkey", F.year(d.into_datetime(text, "%d/%m/%Y")).alias("y"))


@QUERIES("""SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS h, strftime(date_trunc('month', ts), '%Y-%m-%d') AS mo, strftime(time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS q FROM events""")
def truncate_times(t: Tables):
    c = F.col("ts")
    return t.events.select("event_id", d.strftime(d.truncate(c, "1h"), "%Y-%m-%d %H:%M").alias("h"), d.strftime(d.truncate(c, "1mo"), "%Y-%m-%d").alias("mo"), d.strftime(d.truncate(c, "15m"), "%Y-%m-%d %H:%M").alias("q"))


@QUERIES("SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) * 1000 AS span FROM events GROUP BY user_id")
def time_differences(t: Tables):
    return t.events.groupBy("user_id").agg(F.max("ts").alias("b"), F.min("ts").alias("a")).select("user_id", d.difference(F.col("b").cast("timestamp"), F.col("a").cast("timestamp")).alias("span"))


@QUERIES("SELECT event_id, epoch_us(ts) * 1000 AS ns FROM events")
def epoch_nanoseconds(t: Tables):
    return t.events.select("event_id", d.epoch_nanos(F.col("ts")).alias("ns"))


@QUERIES("SELECT strftime(x, '%Y-%m-%d') AS date FROM (SELECT unnest(generate_series(DATE '2024-02-20', DATE '2024-03-10', INTERVAL 3 DAY)) AS x)")
def date_sequence(t: Tables):
    return d.seq_date(t.spark, "2024-02-20", "2024-03-10", 3)


@QUERIES("""SELECT n_nationkey, (n_nationkey * 3600 + 90)::BIGINT * 1000000000 AS ns FROM nation""")
def parse_durations(t: Tables):
    text = F.concat(F.col("n_nationkey").cast("string"), F.lit("hr 1min 30sec"))
    return t.nation.select("n_nationkey", d.into_duration(text).alias("ns"))


@QUERIES("""SELECT strftime(time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def event_time_windows(t: Tables):
    out = event_windows(t.events, "ts", "1 hour", F.count("*").alias("n"), by=["event_type"])
    return out.select(d.strftime(F.col("window_start"), "%Y-%m-%d %H:%M").alias("start"), "event_type", "n")


@QUERIES("""WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(t: Tables):
    out = sessions(t.events, "ts", "30 minutes", F.count("*").alias("n"), by=["user_id"])
    return out.select("user_id", d.strftime(F.col("session_start"), "%Y-%m-%d %H:%M:%S").alias("start"), "n")
