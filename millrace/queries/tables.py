"""Further queries over tables: files, stores, streams, selectors, SQL forms, row and column operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import formats as f
from millrace.functions import generate as g
from millrace.operators import apply as a
from millrace.operators import grouping as gr
from millrace.operators import predicates as pr
from millrace.operators import projection as p
from millrace.operators import rows as r
from millrace.operators import windows as w
from millrace.order import numbered
from millrace.plans import inspect as i
from millrace.plans import selectors as s
from millrace.plans.sql import query
from millrace.queries.registry import Registry, Tables
from millrace.sources import files, sqlite
from millrace.staging import shared_folder
from millrace.streaming import streams as st

QUERIES = Registry()
BY_TIME = ["ts", "event_id"]


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/queries-{uuid.uuid4().hex}"


def _database(t: Tables) -> str:
    """A SQLite file; one process writes it, so the folder must be one that the driver can open."""
    from pathlib import Path

    folder = Path(_folder(t).removeprefix("file://").removeprefix("file:"))
    folder.mkdir(parents=True)
    return str(folder / "tables.db")


# -- files ----------------------------------------------------------------------------------

_EVENTS = "SELECT event_id, user_id, event_type, value FROM events"


def _events(t: Tables):
    return t.events.select("event_id", "user_id", "event_type", "value")


def _saved(t: Tables, kind: str, **options):
    path = f"{_folder(t)}/events.{kind}"
    files.save(_events(t), path)
    return files.open_(t.spark, path, schema=_events(t).schema, **options)


@QUERIES(_EVENTS)
def saved_csv(t: Tables):
    return _saved(t, "csv")


@QUERIES(_EVENTS)
def saved_tsv(t: Tables):
    return _saved(t, "tsv")


@QUERIES(_EVENTS)
def saved_ndjson(t: Tables):
    return _saved(t, "ndjson")


@QUERIES(_EVENTS)
def saved_orc(t: Tables):
    return _saved(t, "orc")


@QUERIES(_EVENTS)
def saved_parquet(t: Tables):
    return _saved(t, "parquet")


@QUERIES(_EVENTS)
def saved_xml(t: Tables):
    return _saved(t, "xml")


@QUERIES("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS value FROM nation")
def saved_text(t: Tables):
    path = f"{_folder(t)}/nation.txt"
    files.save(t.nation, path)
    return files.open_(t.spark, path)


@QUERIES("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def saved_in_parts(t: Tables):
    """Appended to twice, by folders of a key; only the second half of the copies is read again."""
    path = f"{_folder(t)}/events.parquet"
    for half in (0, 1):
        files.save(t.events.select("event_id", "event_type", F.lit(half).alias("half")), path, append=True, partition_by=["half"])
    return files.open_(t.spark, path).where("half = 1").groupBy("event_type").agg(F.count("*").alias("n"))


@QUERIES("SELECT 3 AS files, true AS sized, 3 AS counted FROM range(1)")
def files_listed(t: Tables):
    path = _folder(t)
    t.nation.repartition(3).write.parquet(f"{path}/nation.parquet")
    found = files.listing(t.spark, path, "*.parquet", recursive=True).agg(F.count("*").cast("int").alias("files"), F.bool_and(F.col("size") > 0).alias("sized"))
    used = files.disk_usage(t.spark, f"{path}/nation.parquet").agg(F.sum(F.least("files", F.lit(3))).cast("int").alias("counted"))
    return found.crossJoin(used)


# -- SQLite and the store -------------------------------------------------------------------


@QUERIES("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def sqlite_round_trip(t: Tables):
    path = _database(t)
    sqlite.write_sqlite(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path, "supplier")
    return sqlite.read_sqlite(t.spark, path, "supplier")


@QUERIES("SELECT s_nationkey::BIGINT AS k, count(*) AS n FROM supplier WHERE s_acctbal > 1000 GROUP BY s_nationkey")
def sqlite_query(t: Tables):
    path = _database(t)
    sqlite.write_sqlite(t.supplier.select("s_nationkey", "s_acctbal"), path, "supplier")
    return sqlite.query_sqlite(t.spark, path, "SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > ? GROUP BY s_nationkey", [1000])


@QUERIES("SELECT unnest(['nation', 'region']) AS name")
def sqlite_schema(t: Tables):
    path = _database(t)
    for name in ("region", "nation"):
        sqlite.write_sqlite(getattr(t, name), path, name)
    return t.spark.createDataFrame([(n,) for n in sqlite.tables_of(path)], "name string")


@QUERIES("SELECT n_nationkey AS k, CASE WHEN n_nationkey > 9 THEN 'late' ELSE n_name END AS name FROM nation WHERE n_regionkey <> 0")
def store_changes(t: Tables):
    store = sqlite.Store(t.spark, f"s{uuid.uuid4().hex}_")
    store.create("n", "k int, name string, region int")
    store.insert("n", t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    store.update("n", {"name": "late"}, "k > 9")
    store.delete("n", "region = 0")
    return store.open()["n"].select("k", "name")


@QUERIES("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def store_exported(t: Tables):
    path = _database(t)
    store = sqlite.Store(t.spark, f"s{uuid.uuid4().hex}_")
    store.create("region", "r_regionkey int, r_name string")
    store.insert("region", t.region)
    store.export(path)
    store.reset()
    assert store.open() == {}
    store.import_(path)
    return store.open()["region"]


# -- streams --------------------------------------------------------------------------------


def _stream(t: Tables):
    return st.watch(t.spark, f"{t.sf_dir}/", t.events.schema, pattern="events.parquet*")


@QUERIES("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_totals(t: Tables):
    totals = _stream(t).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return st.to_completion(totals, "totals", "complete")


@QUERIES("SELECT event_id, user_id FROM events WHERE value > 50")
def stream_filtered(t: Tables):
    return st.to_completion(_stream(t).where("value > 50").select("event_id", "user_id"), "filtered")


@QUERIES("SELECT event_id FROM events UNION ALL SELECT user_id FROM events")
def stream_interleaved(t: Tables):
    both = st.interleave(_stream(t).select("event_id"), _stream(t).select(F.col("user_id").alias("event_id")))
    return st.to_completion(both, "interleaved")


@QUERIES("SELECT 'low' AS kind, count(*) AS n FROM events WHERE value < 50 UNION ALL SELECT 'high', count(*) FROM events WHERE value >= 50")
def stream_teed(t: Tables):
    """A stream that writes two folders at once, run as a job to its end."""
    path, jobs = _folder(t), st.Jobs()

    def part(name: str, test: str):
        return lambda batch: batch.where(test).select("event_id").write.mode("append").parquet(f"{path}/{name}")

    number = jobs.spawn(st.tee(_stream(t), part("low", "value < 50"), part("high", "value >= 50")), "tee")
    running = jobs.running[number][0]
    running.processAllAvailable()
    assert [(n, d) for n, d, _ in jobs.list()] == [(number, "tee")]
    jobs.kill(number)
    read = lambda name: t.spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return read("low").unionByName(read("high"))


@QUERIES("SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id")
def first_of_each_key(t: Tables):
    return st.deduplicated(t.events, "user_id", time="ts").select("user_id", "ts")


# -- inspection -----------------------------------------------------------------------------


@QUERIES("SELECT 'table<r_regionkey: int, r_name: string>' AS kind, true AS planned, true AS timed, 5 AS seen, 2 AS head FROM range(1)")
def described_frame(t: Tables):
    frame, seen = i.observe(t.region, f"rows{uuid.uuid4().hex}")
    i.ignore(frame)
    _, head = i.peek(t.region, 2)
    row = (i.describe(t.region), "Scan parquet" in i.explain(t.region), i.timeit(t.region) > 0, seen.get["n"], len(head))
    return t.spark.createDataFrame([row], "kind string, planned boolean, timed boolean, seen int, head int")


@QUERIES("SELECT count(*) AS n, count(*) AS again FROM nation")
def cached_frame(t: Tables):
    kept = t.nation.cache()
    try:
        return t.spark.createDataFrame([(len(kept.collect()), kept.count())], "n long, again long")
    finally:
        kept.unpersist()


# -- selectors ------------------------------------------------------------------------------

_KINDS = "o_orderkey a1, o_custkey b, o_orderstatus _c, o_totalprice d4, o_orderdate e, true f"


def _kinds(t: Tables):
    c = F.col
    return t.orders.select(c("o_orderkey").alias("a1"), c("o_custkey").cast("int").alias("b"), c("o_orderstatus").alias("_c"), c("o_totalprice").alias("d4"), c("o_orderdate").cast("date").alias("e"), F.lit(True).alias("f"), F.encode("o_orderstatus", "utf-8").alias("g"), F.array("o_orderkey").alias("h"), F.struct("o_orderkey").alias("i"), c("o_totalprice").cast("decimal(12,2)").alias("j"), F.expr("INTERVAL '1' DAY").alias("77"), F.parse_json(F.lit("1")).alias("k"))


_SELECTED = {
    "all": (s.all_(), "a1 b _c d4 e f g h i j 77 k"), "alpha": (s.alpha(), "b e f g h i j k"), "alphanumeric": (s.alphanumeric(), "a1 b d4 e f g h i j 77 k"), "array": (s.array(), "h"), "binary": (s.binary(), "g"), "boolean": (s.boolean(), "f"),
    "by_dtype": (s.by_dtype("i64", "f64"), "a1 d4"), "by_index": (s.by_index(0, -1), "a1 k"), "by_name": (s.by_name("b", "f"), "b f"), "date": (s.date(), "e"), "datetime": (s.datetime(), ""), "decimal": (s.decimal(), "j"), "digit": (s.digit(), "77"),
    "duration": (s.duration(), "77"), "empty": (s.empty(), ""), "exclude": (s.exclude("a1", "b", "k"), "_c d4 e f g h i j 77"), "list": (s.list_(), "h"), "nested": (s.nested(), "h i"), "numeric": (s.numeric(), "a1 b d4 j"), "object": (s.object_(), "k"),
    "signed_integer": (s.signed_integer(), "a1 b"), "starts_with": (s.starts_with("a", "_"), "a1 _c"), "struct": (s.struct(), "i"), "temporal": (s.temporal(), "e 77"), "both": (s.integer() | s.float_(), "a1 b d4"), "neither": (s.numeric() - s.integer(), "d4 j"), "not": (~s.numeric() & s.alpha(), "e f g h i k"),
}


@QUERIES(" UNION ALL ".join(f"SELECT '{k}' AS selector, '{v}' AS columns" for k, (_, v) in _SELECTED.items()))
def selectors_of_each_kind(t: Tables):
    table = _kinds(t)
    return t.spark.createDataFrame([(k, " ".join(choose.names(table))) for k, (choose, _) in _SELECTED.items()], "selector string, columns string")


@QUERIES("SELECT o_orderkey AS a1, o_custkey::INTEGER AS b, o_totalprice AS d4 FROM orders")
def selected_columns(t: Tables):
    return (s.integer() | s.float_()).select(_kinds(t))


# -- SQL over frames ------------------------------------------------------------------------

_SQL = {
    "sql_joined_and_ordered": ("SELECT n_name, r_name FROM {n} JOIN {r} ON n_regionkey = r_regionkey ORDER BY n_name", "nation", "region"),
    "sql_having_distinct": ("SELECT DISTINCT n_regionkey, count(*) AS n FROM {n} GROUP BY n_regionkey HAVING count(*) > 2", "nation", "region"),
    "sql_windowed": ("SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS k FROM {n}", "nation", "region"),
    "sql_cases": ("SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 3 AND 9 THEN 'mid' WHEN n_name LIKE 'A%' THEN 'a' ELSE 'z' END AS kind FROM {n} WHERE n_regionkey IN (0, 1, 2, 3)", "nation", "region"),
    "sql_united": ("SELECT n_name AS name FROM {n} UNION SELECT r_name FROM {r}", "nation", "region"),
    "sql_nested": ("WITH big AS (SELECT n_regionkey AS k FROM {n} GROUP BY n_regionkey) SELECT r_name FROM {r} WHERE r_regionkey IN (SELECT k FROM big)", "nation", "region"),
}


def _sql_query(name: str, text: str):
    def run(t: Tables):
        return query(t.nation, text.format(n="df", r="other"), other=t.region)

    run.__name__ = name
    return QUERIES(text.format(n="nation", r="region"))(run)


for _name, (_text, *_) in _SQL.items():
    _sql_query(_name, _text)


# -- rows -----------------------------------------------------------------------------------


@QUERIES("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal DESC, c_custkey DESC) - 1 AS place FROM customer")
def sorted_backwards(t: Tables):
    return numbered(r.sort_by(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal", "c_custkey", reverse=True), "place").select("c_custkey", "place")


@QUERIES("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier")
def sorted_naturally(t: Tables):
    """Texts with numbers in them, in the order of the numbers, without case."""
    rows = t.supplier.select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Item").otherwise("item"), F.col("s_suppkey")).alias("name"))
    return numbered(r.sort_by(rows, "name", natural=True, ignore_case=True), "place").select("s_suppkey", "place")


@QUERIES("SELECT event_id FROM (SELECT event_id, min(CASE WHEN value > 30 THEN i END) OVER () AS stop, i FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i FROM events)) WHERE stop IS NULL OR i < stop")
def taken_while_small(t: Tables):
    return r.take_while(t.events, F.col("value") <= 30, BY_TIME).select("event_id")


@QUERIES("SELECT event_id FROM (SELECT event_id, min(CASE WHEN value > 60 THEN i END) OVER () AS start, i FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i FROM events)) WHERE i >= start")
def skipped_until_large(t: Tables):
    return r.skip_until(t.events, F.col("value") > 60, BY_TIME).select("event_id")


@QUERIES("SELECT r_name AS name, 0 AS part FROM region UNION ALL SELECT n_name, 1 FROM nation")
def prepended_tables(t: Tables):
    return r.prepend(t.nation.select(F.col("n_name").alias("name")), t.region.select(F.col("r_name").alias("name")), order_column="part")


@QUERIES("SELECT o_orderkey, true AS moved FROM orders")
def shuffled_rows(t: Tables):
    """All rows once, and most of them in another place."""
    rows = numbered(r.shuffle(t.orders.select("o_orderkey"), 5), "place")
    rows = rows.join(r.indexed(t.orders.select("o_orderkey"), ["o_orderkey"], "home"), "o_orderkey")
    moved = rows.agg((F.count_if(F.col("place") != F.col("home")) > 0.9 * F.count("*")).alias("moved"))
    return rows.select("o_orderkey").crossJoin(F.broadcast(moved))


@QUERIES("SELECT k::INTEGER AS k, [a, b, c] AS items FROM (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS k, a, b, c FROM (SELECT r_regionkey AS a FROM region WHERE r_regionkey < 3) JOIN (SELECT r_regionkey AS b FROM region WHERE r_regionkey < 3) ON a <> b JOIN (SELECT r_regionkey AS c FROM region WHERE r_regionkey < 3) ON c <> a AND c <> b)")
def permuted_rows(t: Tables):
    return r.permuted(t.region.where("r_regionkey < 3"), "r_regionkey")


@QUERIES("SELECT 7 AS n, 7 AS ids FROM range(1)")
def chosen_rows(t: Tables):
    return g.choice(t.orders, 7, 3).agg(F.count("*").cast("int").alias("n"), F.count_distinct("o_orderkey").cast("int").alias("ids"))


@QUERIES("SELECT unnest([1, 2, 4, 8, 16]) AS value")
def unfolded_values(t: Tables):
    return g.unfold(t.spark, 1, lambda v: (v, 2 * v) if v < 20 else None, 100).select(F.col("value").cast("int").alias("value"))


@QUERIES("SELECT n_name FROM nation WHERE n_nationkey = 7")
def only_row(t: Tables):
    return a.only(t.nation.where("n_nationkey = 7").select("n_name"))


# -- columns --------------------------------------------------------------------------------


@QUERIES("SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS name, unnest(['int', 'string', 'int']) AS kind")
def column_names_and_types(t: Tables):
    names = p.columns_frame(t.nation).withColumnRenamed("column", "name")
    return p.schema_frame(t.nation).withColumnRenamed("type", "kind").join(names, "name")


@QUERIES("SELECT 'r_regionkey' AS \"column\", list(r_regionkey::VARCHAR ORDER BY r_regionkey) AS \"values\" FROM region UNION ALL SELECT 'r_name', list(r_name ORDER BY r_regionkey) FROM region")
def column_values(t: Tables):
    return p.values(t.region, ["r_regionkey"])


@QUERIES("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) IN (1, 4, 9) THEN -1 ELSE o_totalprice END AS o_totalprice FROM orders")
def set_by_position(t: Tables):
    return pr.set_with_index(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", -1.0, [0, 3, 8], ["o_orderkey"])


@QUERIES("SELECT r_name AS AFRICA, r_regionkey AS \"0\" FROM region WHERE r_regionkey > 0")
def headers_from_first_row(t: Tables):
    named = r.headers(t.region.select("r_regionkey", "r_name"), ["r_regionkey"])
    return named.select(F.col(named.columns[1]).alias("AFRICA"), F.col(named.columns[0]).alias("0"))


@QUERIES("SELECT list_value(r0, r1, r2, r3, r4) AS clockwise, name FROM (SELECT 'r_regionkey' AS name, '4' AS r0, '3' AS r1, '2' AS r2, '1' AS r3, '0' AS r4 UNION ALL SELECT 'r_name', max(r_name) FILTER (r_regionkey = 4), max(r_name) FILTER (r_regionkey = 3), max(r_name) FILTER (r_regionkey = 2), max(r_name) FILTER (r_regionkey = 1), max(r_name) FILTER (r_regionkey = 0) FROM region)")
def rotated_table(t: Tables):
    turned = r.rotate(t.region, ["r_regionkey"])
    return turned.select(F.array(*turned.columns[:-1]).alias("clockwise"), F.col(turned.columns[-1]).alias("name"))


# -- groups and functions -------------------------------------------------------------------


@QUERIES("SELECT l_returnflag, round(sum(l_quantity * l_discount), 4) AS dot FROM lineitem GROUP BY l_returnflag")
def dot_products(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(gr.dot("l_quantity", "l_discount"), 4).alias("dot"))


@QUERIES("SELECT count(*) FILTER (e IS NULL) AS e, 0::BIGINT AS event_type FROM (SELECT CASE WHEN event_id % 3 = 0 THEN value END AS e, event_type FROM events)")
def null_counts(t: Tables):
    rows = t.events.select(F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("e"), "event_type")
    return rows.agg(*gr.count_null("e", "event_type"))


@QUERIES("SELECT n_regionkey, list(i ORDER BY i) AS groups FROM (SELECT n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) GROUP BY n_regionkey")
def positions_of_groups(t: Tables):
    return gr.group_positions(t.nation, ["n_regionkey"], ["n_nationkey"])


@QUERIES("SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 6) AS range FROM orders GROUP BY o_orderpriority")
def python_aggregate(t: Tables):
    spread = a.aggregate_function(lambda v: float(v.max() - v.min()), "double")
    return t.orders.groupBy("o_orderpriority").agg(F.round(spread("o_totalprice"), 6).alias("range"))


@QUERIES("SELECT r_regionkey, k::INTEGER AS k FROM region, LATERAL (SELECT unnest(range(0, r_regionkey)) AS k)")
def python_table_function(t: Tables):
    upto = a.table_function(lambda n: ((k,) for k in range(n)), "k int")
    name = f"upto_{uuid.uuid4().hex}"
    t.spark.udtf.register(name, upto)
    t.region.createOrReplaceTempView(name + "_t")
    return t.spark.sql(f"SELECT r_regionkey, k FROM {name}_t, LATERAL {name}(r_regionkey)")


@QUERIES("SELECT n_nationkey, n_name AS name, 'k: ' || n_nationkey || chr(10) AS text FROM nation")
def yaml_cells(t: Tables):
    back = f.from_format(F.concat(F.lit("a:\n  - name: '"), F.col("n_name"), F.lit("'\n")), "yaml")
    return t.nation.select("n_nationkey", f.query_json(back, "a.0.name").alias("name"), f.to_format(F.to_json(F.struct(F.col("n_nationkey").alias("k"))), "yaml").alias("text"))


@QUERIES("SELECT n_name AS name FROM nation")
def wrapped_column(t: Tables):
    return p.wrap(t.nation.select("n_name"), "name")


@QUERIES("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def columns_sliced(t: Tables):
    return p.column_slice(t.orders, (0, 1), (2, 4))


@QUERIES("SELECT n_nationkey, n_name AS a, 2 AS x, n_regionkey AS y, 3 AS z, [1, n_regionkey] AS l FROM nation")
def records_merged_deeply(t: Tables):
    left = t.nation.select("n_nationkey", F.struct(F.col("n_name").alias("a"), F.struct(F.lit(1).alias("x"), F.col("n_regionkey").alias("y")).alias("b"), F.array(F.lit(1)).alias("l")).alias("left"))
    rows = left.withColumn("right", F.struct(F.struct(F.lit(2).alias("x"), F.lit(3).alias("z")).alias("b"), F.array("left.b.y").alias("l")))
    kinds = rows.schema
    merged = p.merge_deep(F.col("left"), F.col("right"), kinds["left"].dataType, kinds["right"].dataType, "append")
    return rows.select("n_nationkey", merged.alias("m")).select("n_nationkey", "m.a", "m.b.*", "m.l")


@QUERIES("SELECT event_type, min(i) AS first, list(event_id ORDER BY i) AS ids FROM (SELECT *, i - row_number() OVER (PARTITION BY event_type ORDER BY i) AS run FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events)) GROUP BY event_type, run")
def runs_as_lists(t: Tables):
    rows = r.indexed(t.events.select("event_id", "event_type", "ts"), BY_TIME, "i")
    runs = w.chunk_by(rows, F.col("event_type"), ["i"])
    return runs.select(F.get("items", F.lit(0))["event_type"].alias("event_type"), F.get("items", F.lit(0))["i"].alias("first"), F.transform("items", lambda x: x["event_id"]).alias("ids"))


@QUERIES("SELECT o_orderpriority, v[round_even((len(v) - 1) * 0.3, 0)::INTEGER + 1] AS low FROM (SELECT o_orderpriority, list(o_totalprice ORDER BY o_totalprice) AS v FROM orders GROUP BY o_orderpriority)")
def quantiles_of_groups(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(gr.quantile("o_totalprice", 0.3).alias("low"))


@QUERIES("SELECT o_orderpriority, v[round_even((len(v) - 1) * 0.3, 0)::INTEGER + 1] AS o_totalprice FROM (SELECT o_orderpriority, list(o_totalprice ORDER BY o_totalprice) AS v FROM orders GROUP BY o_orderpriority)")
def quantiles_of_large_groups(t: Tables):
    return gr.quantile_by_rank(t.orders, "o_totalprice", 0.3, ["o_orderpriority"])


@QUERIES("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_of_any_shape(t: Tables):
    return t.events.select("event_id", F.variant_get(f.from_json_variant(F.col("props")), "$.k", "bigint").alias("k"))


@QUERIES("SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def sheet_read(t: Tables):
    """A workbook made here of the rows of region, read as a table of text."""
    import zipfile

    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [t.region.columns, *t.region.collect()]
    body = "".join("<row>" + "".join(map(cell, x)) + "</row>" for x in rows)
    path = _database(t).replace("tables.db", "region.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><R Id="r1" Target="worksheets/sheet1.xml"/></R>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return files.open_(t.spark, path)


@QUERIES("SELECT count(*) FILTER (value < 0) = 0 AS none, false AS few FROM events")
def all_values_false(t: Tables):
    none = pr.all_false(t.events, F.col("value") < 0, "none")
    return none.crossJoin(pr.all_false(t.events, F.col("value") > 50, "few"))


@QUERIES("SELECT unnest(['n', 'r']) AS name, unnest([25, 5])::BIGINT AS rows")
def store_listed(t: Tables):
    store = sqlite.Store(t.spark, f"s{uuid.uuid4().hex}_")
    store.put("n", t.nation)
    store.put("r", t.region)
    store.put("x", t.region)
    store.delete("x")
    return store.ls().select("name", F.when(F.col("name") == "n", store.get("n").count()).otherwise(store.get("r").count()).alias("rows"))


@QUERIES("SELECT count(*)::BIGINT AS rows FROM orders")
def profiled_plan(t: Tables):
    """The rows that the scan of orders gave, as the profile of a grouping has them."""
    seen = i.profile(t.orders.groupBy("o_orderpriority").agg(F.sum("o_totalprice")))
    return seen.where(F.col("operator").startswith("Scan") & (F.col("metric") == "number of output rows")).agg(F.max("value").alias("rows"))
