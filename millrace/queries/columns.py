"""Column queries: choose, add, rename, nest, unnest."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import projection as p
from millrace.plans import selectors as s
from millrace.queries.registry import Registry, Tables

QUERIES = Registry()


@QUERIES("SELECT c_name, c_custkey FROM customer")
def select_columns(t: Tables):
    return p.select(t.customer, "c_name", "c_custkey")


@QUERIES("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def reject_columns(t: Tables):
    return p.reject(t.customer, "c_acctbal")


@QUERIES("SELECT *, p_size * 2 AS double_size FROM part")
def insert_column(t: Tables):
    return p.insert(t.part, "double_size", F.col("p_size") * 2)


@QUERIES("SELECT p_partkey, upper(p_name) AS p_name FROM part")
def update_column(t: Tables):
    return p.update(t.part.select("p_partkey", "p_name"), "p_name", F.upper("p_name"))


@QUERIES("SELECT n_nationkey, n_name, n_regionkey + 1 AS n_regionkey, 'x' AS tag FROM nation")
def upsert_columns(t: Tables):
    return p.upsert(p.upsert(t.nation, "n_regionkey", F.col("n_regionkey") + 1), "tag", "x")


@QUERIES("SELECT lower(r_name) AS r_name, r_regionkey FROM region")
def update_all_cells(t: Tables):
    return p.update_cells(t.region, F.lower, ["r_name"])


@QUERIES("SELECT r_regionkey AS id, r_name AS name FROM region")
def rename_columns(t: Tables):
    return p.rename(t.region, "id", "name")


@QUERIES("SELECT r_regionkey AS \"R_REGIONKEY\", r_name AS \"R_NAME\" FROM region")
def rename_by_function(t: Tables):
    return p.rename(t.region, by=str.upper)


@QUERIES("SELECT n_name, n_nationkey, n_regionkey FROM nation")
def move_column(t: Tables):
    return p.move(t.nation, "n_name", before="n_nationkey")


@QUERIES("SELECT s_suppkey, s_name FROM supplier")
def drop_right_columns(t: Tables):
    return p.drop_columns(t.supplier, 2)


@QUERIES("SELECT n_name AS n_nationkey, n_regionkey::VARCHAR AS n_name, n_nationkey::VARCHAR AS n_regionkey FROM nation")
def roll_columns_left(t: Tables):
    n = t.nation.select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    return p.roll_columns(n, 1, cells_only=True)


@QUERIES("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'none' ELSE s_name END AS s_name, 0 AS extra FROM supplier")
def default_values(t: Tables):
    gaps = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("s_name"))
    return p.default(p.default(gaps, "none", "s_name"), 0, "extra")


@QUERIES("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def flatten_record(t: Tables):
    nested = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.struct("n_name", "r_name").alias("names"))
    return p.flatten(nested)


@QUERIES("SELECT doc_id, w AS word FROM (SELECT doc_id, unnest(string_split(source || '-' || lang, '-')) AS w FROM documents)")
def flatten_list(t: Tables):
    lists = t.documents.select("doc_id", F.split(F.concat_ws("-", "source", "lang"), "-").alias("word"))
    return p.flatten(lists, "word")


@QUERIES("SELECT r_regionkey, r_name AS \"r:name\", r_regionkey AS \"r:key\" FROM region")
def unnest_record(t: Tables):
    nested = t.region.select("r_regionkey", F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")).alias("r"))
    return p.unnest(nested, "r", separator=":")


@QUERIES("SELECT vec_id, count(*) AS n, round(sum(x), 3) AS total FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id")
def explode_lists(t: Tables):
    rows = p.explode(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x")
    return rows.groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("total"))


@QUERIES("SELECT count(*) AS \"rows\", 5::BIGINT AS \"columns\" FROM customer")
def table_shape(t: Tables):
    return p.shape(t.customer)


@QUERIES("SELECT r_regionkey, 'r_name' AS name, r_name AS value FROM region")
def record_items(t: Tables):
    return p.items(t.region, "r_name")


@QUERIES("SELECT r_regionkey, r_name, 'v1' AS version, 7 AS n FROM region")
def merge_constants(t: Tables):
    return p.merge_record(t.region, {"version": "v1", "n": 7})


@QUERIES("SELECT c_custkey, (c_mktsegment = 'BUILDING')::INTEGER AS \"c_mktsegment_BUILDING\", (c_mktsegment = 'MACHINERY')::INTEGER AS \"c_mktsegment_MACHINERY\" FROM customer")
def dummy_columns(t: Tables):
    return p.dummies(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", values={"c_mktsegment": ["BUILDING", "MACHINERY"]})


@QUERIES("SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def selector_float(t: Tables):
    return s.float_().select(t.lineitem)


@QUERIES("SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def selector_combined(t: Tables):
    return ((s.integer() & s.ends_with("key")) | s.temporal()).select(t.orders)


@QUERIES("SELECT c_custkey, c_mktsegment FROM customer")
def selector_position(t: Tables):
    return (s.first() | s.last()).select(t.customer)


@QUERIES("SELECT p_name, p_brand, p_type FROM part")
def selector_string(t: Tables):
    return (s.string() - s.matches("zzz")).select(t.part)
