"""Conversions, formats, lists, bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import binary as b
from millrace.functions import convert as c
from millrace.functions import formats as f
from millrace.functions import lists as li
from millrace.queries.registry import Registry, Tables

QUERIES = Registry()


@QUERIES("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_field(t: Tables):
    return t.events.select("event_id", f.query_json(F.col("props"), "k").cast("long").alias("k"))


@QUERIES("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_parsed(t: Tables):
    return t.events.select("event_id", f.from_json(F.col("props"), "k long")["k"].alias("k"))


@QUERIES("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey::VARCHAR || '}' AS js FROM nation")
def json_written(t: Tables):
    return t.nation.select("n_nationkey", f.to_json(None, "n_name", "n_regionkey").alias("js"))


@QUERIES("SELECT n_nationkey, n_name || ',' || n_regionkey::VARCHAR AS line FROM nation")
def csv_written(t: Tables):
    return t.nation.select("n_nationkey", f.to_csv("n_name", "n_regionkey").alias("line"))


@QUERIES("SELECT c_custkey, c_custkey::VARCHAR AS s, c_acctbal::BIGINT AS i, (c_custkey % 2 = 0) AS even FROM (SELECT c_custkey, trunc(c_acctbal) AS c_acctbal FROM customer)")
def casts(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", c.into_string(k).alias("s"), c.into_int(F.col("c_acctbal").cast("string")).alias("i"), c.into_bool(F.when(k % 2 == 0, "TRUE").otherwise("false")).alias("even"))


@QUERIES("SELECT p_partkey, (p_size * 1024)::BIGINT AS n FROM part")
def file_sizes(t: Tables):
    return t.part.select("p_partkey", c.into_filesize(F.concat(F.col("p_size").cast("string"), F.lit(" KiB"))).alias("n"))


@QUERIES("SELECT n_nationkey, n_nationkey::BIGINT AS major, 2::BIGINT AS minor, (n_nationkey + 1)::VARCHAR || '.0.0' AS next FROM nation")
def semantic_versions(t: Tables):
    v = c.into_semver(F.concat(F.col("n_nationkey").cast("string"), F.lit(".2.3-rc.1")))
    return t.nation.select("n_nationkey", v["major"].alias("major"), v["minor"].alias("minor"), c.semver_bump(v, "major").alias("next"))


@QUERIES("SELECT vec_id, round(list_sum(e), 4) AS s, round(list_max(e), 6) AS hi, round(list_min(e), 6) AS lo FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def list_folds(t: Tables):
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.round(li.reduce(e, 0.0, lambda a, x: a + x), 4).alias("s"), F.round(F.array_max(e), 6).alias("hi"), F.round(F.array_min(e), 6).alias("lo"))


@QUERIES("SELECT doc_id, list_contains(string_split(text, ' '), 'the') AS has FROM documents")
def list_membership(t: Tables):
    return t.documents.select("doc_id", li.list_contains(F.split("text", " "), "the").alias("has"))


@QUERIES("""SELECT vec_id, round(list_sum(list_transform(range(1, 9), lambda k: e[k] * e[8 * (k - 1) + 1])), 5) AS corner, round(list_sum(e), 4) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)""")
def matrix_products(t: Tables):
    m = li.chunks(F.col("embedding").cast("array<double>"), 8)
    rows = t.embeddings.select("vec_id", m.alias("m"))
    return rows.select("vec_id", F.round(li.matrix_multiply(F.col("m"), F.col("m"))[0][0], 5).alias("corner"), F.round(li.matrix_sum(F.col("m")), 4).alias("total"))


@QUERIES("""SELECT n_nationkey, reverse(n_name) AS rev, strlen(n_name)::INTEGER AS n, upper(hex(encode(replace(n_name, 'A', 'bb')))) AS rep, instr(n_name, 'A')::INTEGER - 1 AS at FROM nation""")
def byte_functions(t: Tables):
    x = F.col("n_name").cast("binary")
    return t.nation.select("n_nationkey", b.reverse(x).cast("string").alias("rev"), b.length(x).alias("n"), F.hex(b.replace(x, b"A", b"bb", all_=True)).alias("rep"), b.index_of(x, b"A").cast("int").alias("at"))
