"""Further queries over cells: names and paths, encodings, numbers, matrices, formats, bytes, times."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import binary as b
from millrace.functions import convert as c
from millrace.functions import formats as f
from millrace.functions import generate as g
from millrace.functions import lists as li
from millrace.functions import number as n
from millrace.functions import text as x
from millrace.functions import time as d
from millrace.queries.registry import Registry, Tables

QUERIES = Registry()

# -- text -----------------------------------------------------------------------------------

_WORDS = "list_filter(string_split_regex(p_type, '[^A-Za-z0-9]+'), lambda w: w <> '')"


@QUERIES(f"SELECT p_partkey, list_aggregate(list_transform({_WORDS}, lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') AS pascal, lower(p_type[1]) || list_aggregate(list_transform({_WORDS}, lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '')[2:] AS camel FROM part")
def joined_cases(t: Tables):
    return t.part.select("p_partkey", x.pascal_case(F.col("p_type")).alias("pascal"), x.camel_case(F.col("p_type")).alias("camel"))


@QUERIES("SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '[^A-Za-z0-9/:.]', '') <> '' AS host, url AS back, url AS built FROM pages")
def url_round_trip(t: Tables):
    parts = x.url_parse(F.col("url"))
    return t.pages.select("page_id", (parts["host"] != "").alias("host"), F.url_decode(x.url_encode(F.col("url"), all_=True)).alias("back"), x.url_join(parts).alias("built"))


@QUERIES("SELECT n_nationkey, 'k=' || n_nationkey || '&r=' || n_regionkey AS query, n_nationkey::VARCHAR AS first, 'r' AS second FROM nation")
def url_queries(t: Tables):
    built = x.build_query(F.create_map(F.lit("k"), F.col("n_nationkey"), F.lit("r"), F.col("n_regionkey")))
    split = x.url_query(built)
    return t.nation.select("n_nationkey", built.alias("query"), split[0]["value"].alias("first"), split[1]["key"].alias("second"))


@QUERIES("SELECT page_id, regexp_replace(url, '^https?://', 'ftp://') AS moved FROM pages WHERE regexp_matches(url, '^https?://')")
def url_changed(t: Tables):
    rows = t.pages.where(F.col("url").rlike("^https?://"))
    return rows.select("page_id", x.url_with(F.col("url"), scheme="ftp").alias("moved"))


@QUERIES("SELECT n_nationkey, '/data/' || n_regionkey AS parent, 'n' || n_nationkey AS stem, 'csv' AS extension, n_regionkey || '/n' || n_nationkey || '.csv' AS below, 4 AS parts, '/data/' || n_regionkey || '/n' || n_nationkey || '.txt' AS renamed FROM nation")
def path_families(t: Tables):
    path = F.concat(F.lit("/data/"), F.col("n_regionkey"), F.lit("/n"), F.col("n_nationkey"), F.lit(".csv"))
    p = x.path_parse(path)
    pieces = (F.size(x.path_split(path)) + 1).cast("int")
    return t.nation.select("n_nationkey", p["parent"].alias("parent"), p["stem"].alias("stem"), p["extension"].alias("extension"), x.path_relative_to(path, "/data").alias("below"), pieces.alias("parts"), x.path_with(path, extension="txt").alias("renamed"))


@QUERIES("SELECT n_nationkey, n_name AS plain, length(n_name)::INTEGER AS chars, n_name AS again FROM nation")
def escapes_and_characters(t: Tables):
    coloured = F.concat(F.lit("\u001b[31m"), F.col("n_name"), F.lit("\u001b[0m"))
    return t.nation.select("n_nationkey", x.strip_ansi(coloured).alias("plain"), F.size(x.split_chars(F.col("n_name"))).alias("chars"), F.array_join(x.split_chars(F.col("n_name")), "").alias("again"))


@QUERIES("SELECT n_nationkey, n_name AS back, n_name AS back_hex, (ceil(length(n_name) / 5.0) * 8)::INTEGER AS size FROM nation")
def base32_round_trip(t: Tables):
    v = F.encode("n_name", "utf-8")
    return t.nation.select("n_nationkey", x.decode_base32(x.encode_base32(v)).cast("string").alias("back"), x.decode_base32(x.encode_base32(v, True), True).cast("string").alias("back_hex"), F.char_length(x.encode_base32(v)).alias("size"))


@QUERIES("SELECT n_nationkey, n_name AS back, 2 * length(n_name)::INTEGER AS wide FROM nation")
def character_sets(t: Tables):
    return t.nation.select("n_nationkey", F.decode(F.encode("n_name", "utf-16be"), "utf-16be").alias("back"), F.octet_length(F.encode("n_name", "utf-16be")).alias("wide"))


@QUERIES("SELECT doc_id, length(text)::BIGINT AS chars, octet_length(encode(text))::BIGINT AS bytes, len(regexp_extract_all(text, '[\\p{L}\\p{N}_''’]+'))::BIGINT AS words FROM documents")
def text_statistics(t: Tables):
    s = x.stats(F.col("text"))
    return t.documents.select("doc_id", s["chars"].alias("chars"), s["bytes"].alias("bytes"), s["words"].alias("words"))


@QUERIES("SELECT n_nationkey, n_name || '.*' AS text, regexp_matches(n_name || '.*', 'x') AS found FROM nation")
def escaped_patterns(t: Tables):
    text = F.concat("n_name", F.lit(".*"))
    return t.nation.select("n_nationkey", F.regexp_replace(text, x.escape_regex(text), text.cast("string")).alias("text"), F.regexp_like(text, F.concat(x.escape_regex(text), F.lit("x"))).alias("found"))


@QUERIES("SELECT unnest(['n1_a', 'n1_b', 'n2_a', 'n2_b']) AS name")
def brace_expansion(t: Tables):
    return t.spark.createDataFrame([(v,) for v in x.brace_expansions("n{1..2}_{a,b}")], "name string")


@QUERIES("SELECT n_nationkey, '  ' || n_name || chr(10) || n_name AS text, substr(n_name, 1, 0) || 'N' AS common FROM nation")
def indents_and_prefixes(t: Tables):
    text = F.concat(F.lit("    "), F.col("n_name"), F.lit("\n  "), F.col("n_name"))
    return t.nation.select("n_nationkey", x.dedent(text, 2).alias("text"), x.common_prefix(F.lit("NATION"), F.lit("NOTION")).alias("common"))


# -- numbers --------------------------------------------------------------------------------


@QUERIES("SELECT event_id, " + ", ".join(f"round({sql}, 8) AS {name}" for name, sql in {
    "arccos": "acos(v)", "arcsin": "asin(v)", "arctan": "atan(v)", "arccosh": "acosh(1 + v)", "arcsinh": "asinh(v)", "arctanh": "atanh(v / 2)",
    "cosh": "cosh(v)", "sinh": "sinh(v)", "tan": "tan(v)", "tanh": "tanh(v)", "log1p": "ln(1 + v)", "log2": "log2(1 + v)", "degrees": "degrees(asin(v))",
}.items()) + " FROM (SELECT event_id, (abs(value) - floor(abs(value))) AS v FROM events)")
def further_elementary_functions(t: Tables):
    v = F.abs("value") - F.floor(F.abs("value"))
    r = lambda name, arg=v, **o: F.round(n.elementary(name, arg, **o), 8)
    names = [r(k).alias(k) for k in ("arccos", "arcsin", "arctan", "arcsinh", "cosh", "sinh", "tan", "tanh", "log1p")]
    return t.events.select("event_id", *names, r("arccosh", v + 1).alias("arccosh"), r("arctanh", v / 2).alias("arctanh"), F.round(n.log(v + 1, 2), 8).alias("log2"), r("arcsin", degrees=True).alias("degrees"))


@QUERIES("SELECT c_custkey, round(c_acctbal::DECIMAL(18, 2), 1)::DOUBLE AS one, round(c_acctbal::DECIMAL(18, 2), -2)::DOUBLE AS hundreds FROM customer")
def rounded_to_places(t: Tables):
    v = F.col("c_acctbal").cast("decimal(18,2)")
    return t.customer.select("c_custkey", n.round_to(v, 1).cast("double").alias("one"), n.round_to(v, -2).cast("double").alias("hundreds"))


@QUERIES("SELECT o_orderkey, (((o_orderkey & 255) >> 3) | ((o_orderkey & 255) << 5)) & 255 AS ror, (64 - bit_count(o_orderkey))::INTEGER AS zeros FROM orders")
def bits_to_the_right(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", n.rotate_right(k, 3, 8).alias("ror"), n.count_zeros(k).alias("zeros"))


@QUERIES("SELECT n_nationkey, substr(bin(n_nationkey + 256), 2) AS bits, bin(n_nationkey) AS binary, printf('%x', n_nationkey) AS hexadecimal FROM nation")
def number_bases(t: Tables):
    shown = n.format_number(F.col("n_nationkey"), prefix=False)
    return t.nation.select("n_nationkey", n.format_bits(F.col("n_nationkey")).alias("bits"), shown["binary"].alias("binary"), shown["lowerhex"].alias("hexadecimal"))


@QUERIES("SELECT s_suppkey, s_acctbal > 0 AND s_nationkey > 5 AS a, s_acctbal > 0 OR s_nationkey > 5 AS o, (s_acctbal > 0) <> (s_nationkey > 5) AS x, NOT s_acctbal > 0 AS n, s_nationkey::DOUBLE ** 2 AS square, s_nationkey IN (1, 3, 5) AS has FROM supplier")
def logic_and_powers(t: Tables):
    p, q = F.col("s_acctbal") > 0, F.col("s_nationkey") > 5
    return t.supplier.select("s_suppkey", (p & q).alias("a"), (p | q).alias("o"), (p != q).alias("x"), (~p).alias("n"), F.pow("s_nationkey", F.lit(2)).alias("square"), F.array_contains(F.array(F.lit(1), F.lit(3), F.lit(5)), F.col("s_nationkey")).alias("has"))


@QUERIES("SELECT event_id, abs(value * 3 - (value + value + value)) <= 2.220446049250313e-16 * greatest(1, abs(value * 3), abs(value + value + value)) AS near FROM events")
def near_equality(t: Tables):
    v = F.col("value")
    return t.events.select("event_id", n.close(v * 3, v + v + v).alias("near"))


# -- lists and matrices ---------------------------------------------------------------------

_M = "[[1.0, k], [k, 2.0]]"


def _matrix():
    k = F.col("n_nationkey").cast("double")
    return F.array(F.array(F.lit(1.0), k), F.array(k, F.lit(2.0)))


@QUERIES("SELECT n_nationkey, [[2.0, 2 * k], [2 * k, 4.0]] AS sum, [[0.0, 0.0], [0.0, 0.0]] AS difference, [[3.0, 3 * k], [3 * k, 6.0]] AS scaled, [[2.0, k + 1], [k + 1, 3.0]] AS mapped FROM (SELECT n_nationkey, n_nationkey::DOUBLE AS k FROM nation)")
def matrix_arithmetic(t: Tables):
    m = _matrix()
    return t.nation.select("n_nationkey", li.matrix_add(m, m).alias("sum"), li.matrix_add(m, m, -1).alias("difference"), li.matrix_scale(m, 3.0).alias("scaled"), li.matrix_map(m, lambda v: v + 1).alias("mapped"))


@QUERIES("SELECT n_nationkey, [1.0, k] AS row0, [k, 2.0] AS col1, [[9.0, 9.0], [k, 2.0]] AS set_row, [[1.0, 9.0], [k, 9.0]] AS set_col, [[1.0], [k], [k], [2.0]] AS reshaped, [[1.0, k], [k, 2.0]] AS turned FROM (SELECT n_nationkey, n_nationkey::DOUBLE AS k FROM nation)")
def matrix_parts(t: Tables):
    m, nines = _matrix(), F.array(F.lit(9.0), F.lit(9.0))
    return t.nation.select("n_nationkey", li.matrix_row(m, 0).alias("row0"), li.matrix_column(m, 1).alias("col1"), li.matrix_set_row(m, 0, nines).alias("set_row"), li.matrix_set_column(m, 1, nines).alias("set_col"), li.matrix_reshape(m, 1).alias("reshaped"), li.matrix_transpose(m).alias("turned"))


@QUERIES("SELECT n_nationkey, greatest(k, 2.0) AS most, least(1.0, k) AS least, (3 + 2 * k) / 4 AS mean, [1 + k, k + 2] AS sums, [greatest(1.0, k), greatest(2.0, k)] AS tops FROM (SELECT n_nationkey, n_nationkey::DOUBLE AS k FROM nation)")
def matrix_statistics(t: Tables):
    m = _matrix()
    return t.nation.select("n_nationkey", li.matrix_extreme(m).alias("most"), li.matrix_extreme(m, False).alias("least"), li.matrix_mean(m).alias("mean"), li.matrix_sum(m, 0).alias("sums"), li.matrix_extreme(m, True, 1).alias("tops"))


@QUERIES("SELECT [[1.0, 0.0], [0.0, 1.0]] AS one, [[0.0, 0.0, 0.0]] AS none")
def matrix_constants(t: Tables):
    return t.spark.range(1).select(li.identity(2).alias("one"), li.zeros(1, 3).alias("none"))


@QUERIES("SELECT i, j, sum(v * w)::DOUBLE AS v FROM (SELECT n_nationkey % 5 AS i, n_regionkey AS k, n_nationkey AS v FROM nation) a JOIN (SELECT n_regionkey AS k, n_nationkey % 3 AS j, n_nationkey AS w FROM nation) b USING (k) GROUP BY i, j")
def matrix_long_product(t: Tables):
    left = t.nation.select((F.col("n_nationkey") % 5).alias("i"), F.col("n_regionkey").alias("j"), F.col("n_nationkey").cast("double").alias("v"))
    right = t.nation.select(F.col("n_regionkey").alias("i"), (F.col("n_nationkey") % 3).alias("j"), F.col("n_nationkey").cast("double").alias("v"))
    return li.long_multiply(left, right)


@QUERIES("SELECT p_partkey, replace(p_type, ' ', '-') AS between, [1, 3, 6] AS sums, 0::BIGINT AS at, [[1], [4]] AS parts FROM part")
def list_iteration(t: Tables):
    w = F.split("p_type", " ")
    numbers = F.array(*(F.lit(k) for k in (1, 2, 3)))
    cut = F.array(*(F.lit(k) for k in (1, 0, 4)))
    first = li.find_index(w, lambda v: v == F.get(w, F.lit(0)))
    return t.part.select("p_partkey", F.array_join(li.intersperse(w, "-"), "").alias("between"), li.scan(numbers, F.lit(0), lambda s, v: s + v).alias("sums"), first.alias("at"), li.split_list(cut, 0).alias("parts"))


@QUERIES("SELECT n_nationkey, [1, 2] AS low, [[1, 2], [2, 3], [3, 4]] AS pairs, [[1, 2, 3], [4]] AS threes FROM nation")
def list_windows(t: Tables):
    four = F.array(*(F.lit(k) for k in (1, 2, 3, 4)))
    return t.nation.select("n_nationkey", li.take_while(four, lambda v: v < 3).alias("low"), li.windows(four, 2).alias("pairs"), li.chunks(four, 3).alias("threes"))


# -- conversions ----------------------------------------------------------------------------


@QUERIES("SELECT n_nationkey, n_nationkey::DOUBLE AS f, lpad(printf('%x', n_nationkey), 2, '0') || '00000000000000' AS little, lpad(printf('%x', n_nationkey), 16, '0') AS big, n_name AS name FROM nation")
def floats_and_bytes(t: Tables):
    k, kind = F.col("n_nationkey"), t.nation.schema["n_nationkey"].dataType
    record = c.into_record(F.array(F.struct(F.lit("name"), F.col("n_name"))))
    return t.nation.select("n_nationkey", c.into_float(F.concat(F.lit(" "), k.cast("string"))).alias("f"), F.lower(F.hex(c.into_binary(k, kind))).alias("little"), F.lower(F.hex(c.into_binary(k, kind, big=True))).alias("big"), record["name"].alias("name"))


@QUERIES("SELECT 'a' AS name, 'smallint' AS kind UNION ALL SELECT 'b', 'decimal(10,2)' UNION ALL SELECT 'c', 'struct<d:timestamp,e:array<string>>'")
def schema_from_names(t: Tables):
    made = c.schema({"a": "u8", "b": "decimal<10,2>", "c": {"d": "datetime<us, UTC>", "e": "list<str>"}})
    return t.spark.createDataFrame([(x.name, x.dataType.simpleString()) for x in made], "name string, kind string")


# -- formats --------------------------------------------------------------------------------


@QUERIES("SELECT n_nationkey, n_name AS csv, n_name AS url, n_name AS second, n_name AS toml, n_name AS ini FROM nation")
def formats_parsed(t: Tables):
    name, quoted = F.col("n_name"), F.concat(F.lit('"'), F.col("n_name"), F.lit('"'))
    rows = t.nation.select("n_nationkey", name, F.concat_ws("    ", F.lit("x"), name).alias("ssv"))
    cells = f.from_ssv(rows.select("ssv"), "ssv", ["one", "two"])
    assert cells.columns == ["one", "two"]
    get = lambda kind, text, path: f.query_json(f.from_format(text, kind), path)
    return rows.select(
        "n_nationkey",
        f.from_csv(F.concat(F.lit("7,"), quoted), "a int, b string")["b"].alias("csv"),
        f.from_url(F.concat(F.lit("q="), F.url_encode(name)))["q"].alias("url"),
        F.get(F.split("ssv", " {2,}"), F.lit(1)).alias("second"),
        get("toml", F.concat(F.lit("[t]\nname = "), quoted), "t.name").alias("toml"),
        get("ini", F.concat(F.lit("[s]\nname = "), name), "s.name").alias("ini"),
    )


@QUERIES("SELECT n_nationkey, n_name AS xml, n_name AS eml, n_name AS ics, n_name AS vcf, n_name AS plist FROM nation")
def documents_parsed(t: Tables):
    name = F.col("n_name")
    get = lambda kind, text, path: f.query_json(f.from_format(text, kind), path)
    plist = f.to_format(F.to_json(F.struct("n_name")), "plist")
    return t.nation.select(
        "n_nationkey",
        get("xml", F.concat(F.lit("<a><b>"), name, F.lit("</b></a>")), "content.0.content.0.content").alias("xml"),
        get("eml", F.concat(F.lit("Subject: "), name, F.lit("\nFrom: a@b\n\nbody")), "Subject").alias("eml"),
        get("ics", F.concat(F.lit("BEGIN:VEVENT\nSUMMARY:"), name, F.lit("\nEND:VEVENT")), "0.SUMMARY").alias("ics"),
        get("vcf", F.concat(F.lit("BEGIN:VCARD\nFN:"), name, F.lit("\nEND:VCARD")), "0.FN").alias("vcf"),
        get("plist", plist, "n_name").alias("plist"),
    )


@QUERIES("SELECT n_nationkey, 'k = ' || n_nationkey || chr(10) || 'name = \"' || n_name || '\"' || chr(10) AS toml, n_nationkey || chr(9) || CASE WHEN n_name LIKE '% %' THEN n_name ELSE n_name END AS tsv FROM nation")
def formats_written(t: Tables):
    data = F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
    return t.nation.select("n_nationkey", f.to_format(data, "toml").alias("toml"), f.to_csv("n_nationkey", "n_name", separator="\t").alias("tsv"))


@QUERIES("SELECT '<table><thead><tr><th>r_regionkey</th><th>r_name</th></tr></thead><tbody>' || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>', '' ORDER BY r_regionkey) || '</tbody></table>' AS text FROM region")
def html_written(t: Tables):
    return f.to_html(t.region, "r_regionkey")


# -- bytes ----------------------------------------------------------------------------------


@QUERIES("SELECT n_nationkey, '<' || n_name AS added, n_name[:-2] || '>' || n_name[-1:] AS inside, n_name[1:1] = 'A' AS starts, n_name[-1:] = 'A' AS ends, replace(n_name, 'A', '') AS removed, string_split(n_name, 'A') AS pieces FROM nation")
def byte_edits(t: Tables):
    v = F.encode("n_name", "utf-8")
    pieces = F.transform(b.split(v, b"A"), lambda p: p.cast("string"))
    return t.nation.select("n_nationkey", b.add(v, b"<").cast("string").alias("added"), b.add(v, b">", 1, end=True).cast("string").alias("inside"), b.starts_with(v, b"A").alias("starts"), b.ends_with(v, b"A").alias("ends"), b.remove(v, b"A", all_=True).cast("string").alias("removed"), pieces.alias("pieces"))


# -- times and random values ----------------------------------------------------------------


@QUERIES("SELECT event_id, date_trunc('hour', ts) AS low, CASE WHEN date_trunc('day', ts) = ts THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS high, 1000 * epoch_us(ts) AS nanos, ts AS again FROM events")
def times_rounded(t: Tables):
    ts, kind = F.col("ts"), t.events.schema["ts"].dataType
    return t.events.select("event_id", d.truncate(ts, "1h").cast(kind).alias("low"), d.ceil(ts, "1d").cast(kind).alias("high"), d.epoch_nanos(ts).alias("nanos"), d.from_epoch_nanos(d.epoch_nanos(ts)).cast(kind).alias("again"))


@QUERIES("SELECT event_id, ts - INTERVAL 9 HOUR AS moved, 60000000000 AS minute, '1.5 hr' AS shown FROM events")
def zones_and_spans(t: Tables):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", d.replace_timezone(ts, "Asia/Tokyo").cast(t.events.schema["ts"].dataType).alias("moved"), d.difference(ts + F.expr("INTERVAL 1 MINUTE"), ts).alias("minute"), d.format_duration(F.lit(5_400_000_000_000), "hr").alias("shown"))


@QUERIES("SELECT true AS known, true AS today FROM range(1)")
def zones_and_now(t: Tables):
    zones = d.timezones(t.spark).where("timezone IN ('UTC', 'Europe/Paris', 'Asia/Tokyo')").agg((F.count("*") == 3).alias("known"))
    return zones.withColumn("today", F.current_timestamp() >= F.current_date())


@QUERIES("SELECT w::INTEGER + 1 AS week, 1 + 7 * w::INTEGER AS monday FROM range(4) r(w)")
def calendar_month(t: Tables):
    weeks = d.calendar(t.spark, 2021, 2)  # begins on a Monday and has four weeks
    return weeks.select(((F.col("mo") - 1) / 7 + 1).cast("int").alias("week"), F.col("mo").cast("int").alias("monday"))


@QUERIES("SELECT true AS bools, true AS floats, true AS bytes, true AS chars, true AS uuids, true AS words, true AS sides FROM range(1)")
def random_values(t: Tables):
    rows = t.spark.range(200).select(g.random_bool(0.5, 1).alias("a"), g.random_float(2.0, 3.0, 2).alias("f"), g.random_binary(5, 3).alias("b"), g.random_chars(6, 4).alias("c"), g.random_uuid().alias("u"), g.random_password(9, 5).alias("p"))
    out = rows.agg(
        (F.count_distinct("a") == 2).alias("bools"),
        F.bool_and((F.col("f") >= 2) & (F.col("f") < 3)).alias("floats"),
        F.bool_and(F.octet_length("b") == 5).alias("bytes"),
        F.bool_and(F.char_length("c") == 6).alias("chars"),
        (F.count_distinct("u") == 200).alias("uuids"),
        F.bool_and(F.char_length("p") == 9).alias("words"),
    )
    return out.crossJoin(g.dice(t.spark, 300, 6, 7).agg((F.count_distinct("value") == 6).alias("sides")))


# -- less common functions ------------------------------------------------------------------


@QUERIES("SELECT n_nationkey, n_name || chr(10) || '|' || '€' AS text, 'a' || chr(10) || '  ' || n_name AS unindented, ['x  = 1', 'yyy= 2'] AS aligned FROM nation")
def characters_and_alignment(t: Tables):
    text = F.concat("n_name", x.char("newline"), x.char("pipe"), x.char("20ac"))
    inner = F.concat(F.lit("  a\n    "), F.col("n_name"))
    return t.nation.select("n_nationkey", text.alias("text"), x.unindent(inner).alias("unindented"), x.align(F.array(F.lit("x= 1"), F.lit("yyy= 2")), "=").alias("aligned"))


@QUERIES("SELECT n_nationkey, 2::INTEGER AS n, n_nationkey::VARCHAR AS first, 'y' AS second FROM nation")
def columns_detected(t: Tables):
    text = F.concat(F.lit("key   name\n"), F.col("n_nationkey"), F.lit("     x\n7  y\n"))
    rows = x.detect_columns(text)
    return t.nation.select("n_nationkey", F.size(rows).alias("n"), rows[0]["key"].alias("first"), rows[1]["name"].alias("second"))


@QUERIES("SELECT n_nationkey, n_nationkey BETWEEN 2 AND 9 AS caret, n_nationkey = 3 AS tilde, n_nationkey >= 5 AS least, n_nationkey < 2 AS pre FROM nation")
def version_ranges(t: Tables):
    v = c.into_semver(F.concat(F.lit("1."), F.col("n_nationkey"), F.lit(".4")))
    pre = c.into_semver(F.concat(F.lit("2.0.0-"), F.lit("a")))
    inside = lambda text: c.semver_matches(v, text)
    return t.nation.select("n_nationkey", (inside("^1.2.3") & inside("<1.10")).alias("caret"), inside("~1.3").alias("tilde"), inside(">=1.5.0, <2").alias("least"), (inside("<1.2.0") & c.semver_matches(pre, "<2.0.0")).alias("pre"))


@QUERIES("""SELECT n_nationkey, TIMESTAMP '2024-05-17 00:00:00' + INTERVAL (n_nationkey % 24) HOUR AS today, TIMESTAMP '2024-05-10 19:45:00' AS friday, TIMESTAMP '2024-05-20 00:00:00' AS monday, TIMESTAMP '2024-05-17 12:05:30' AS soon, TIMESTAMP '2024-05-17 12:00:00' - INTERVAL (n_nationkey) DAY AS ago, true AS other FROM nation""")
def dates_in_words(t: Tables):
    now = F.lit("2024-05-17 12:00:00").cast("timestamp")  # a Friday
    said = lambda text: d.from_human(text if not isinstance(text, str) else F.lit(text), now).cast("timestamp_ntz")
    hour = F.concat(F.lit("Today at "), F.lpad((F.col("n_nationkey") % 24).cast("string"), 2, "0"), F.lit(":00"))
    ago = F.concat(F.col("n_nationkey"), F.lit(" days ago"))
    return t.nation.select("n_nationkey", said(hour).alias("today"), said("Last Friday at 19:45").alias("friday"), said("next monday").alias("monday"), said("In 5 minutes and 30 seconds").alias("soon"), said(ago).alias("ago"), said("some day").isNull().alias("other"))


@QUERIES("SELECT n_nationkey, [n_name] AS found, '[\"' || n_name || '\"]' AS picked FROM nation")
def pages_queried(t: Tables):
    page = F.concat(F.lit('<a><b k="1">'), F.col("n_name"), F.lit('</b><b class="x">other</b></a>'))
    marked = F.concat(F.lit('<div><p class="q r">'), F.col("n_name"), F.lit("</p><p>z</p></div>"))
    return t.nation.select("n_nationkey", f.query_xml(page, "a/b[@k='1']/text()").alias("found"), f.query_web(marked, "p.q").alias("picked"))


@QUERIES("SELECT event_id, props::JSON->>'k' AS k, '2' AS last, 'true' AS flag FROM events")
def message_packs(t: Tables):
    data = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.array(F.lit(-1.5), F.lit(2.0)).alias("v"), F.lit(True).alias("b"), F.lit("é" * 40).alias("s")))
    back = f.from_msgpack(f.to_msgpack(data))
    return t.events.select("event_id", f.query_json(back, "k").alias("k"), F.replace(f.query_json(back, "v.1"), F.lit(".0"), F.lit("")).alias("last"), f.query_json(back, "b").alias("flag"))


@QUERIES("SELECT n_nationkey, list_filter(range(0, length(n_name)), lambda i: n_name[i + 1] = 'A') AS places, CASE WHEN n_nationkey > 4 THEN sqrt(n_nationkey - 4) END AS root FROM nation")
def places_and_roots(t: Tables):
    v = F.encode("n_name", "utf-8")
    return t.nation.select("n_nationkey", b.index_of_all(v, b"A").cast("array<bigint>").alias("places"), F.when(F.col("n_nationkey") > 4, n.root(F.col("n_nationkey") - 4)).alias("root"))
