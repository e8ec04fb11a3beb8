"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as x
from millrace.queries.registry import Registry, Tables

QUERIES = Registry()


@QUERIES("SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || substr(c_mktsegment, 2) AS cap, lower(c_mktsegment) AS low, upper(c_name) AS up FROM customer")
def case_changes(t: Tables):
    return t.customer.select("c_custkey", x.capitalize(F.col("c_mktsegment")).alias("cap"), F.lower("c_mktsegment").alias("low"), F.upper("c_name").alias("up"))


@QUERIES("SELECT p_partkey, replace(lower(p_name), ' ', '_') AS snake, replace(lower(p_name), ' ', '-') AS kebab, replace(upper(p_name), ' ', '_') AS screaming FROM (SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z]+', ' ', 'g') AS p_name FROM part)")
def word_cases(t: Tables):
    name = F.regexp_replace("p_type", "[^A-Za-z]+", " ")
    return t.part.select("p_partkey", x.snake_case(F.lower(name)).alias("snake"), x.kebab_case(F.lower(name)).alias("kebab"), x.screaming_snake_case(F.lower(name)).alias("screaming"))


@QUERIES("SELECT doc_id, contains(text, 'the') AS has, starts_with(text, 'T') AS starts, ends_with(text, '.') AS ends FROM documents")
def text_tests(t: Tables):
    c = F.col("text")
    return t.documents.select("doc_id", x.contains(c, "the").alias("has"), x.starts_with(c, "T").alias("starts"), x.ends_with(c, ".").alias("ends"))


@QUERIES("SELECT doc_id, CASE WHEN instr(text, 'er') = 0 THEN -1 ELSE strlen(substr(text, 1, instr(text, 'er') - 1)) END::INTEGER AS at, instr(text, 'er')::INTEGER - 1 AS char_at FROM documents")
def text_index_of(t: Tables):
    return t.documents.select("doc_id", x.index_of(F.col("text"), "er").alias("at"), x.index_of(F.col("text"), "er", chars=True).alias("char_at"))


@QUERIES("SELECT doc_id, strlen(text)::INTEGER AS n_bytes, length(text)::INTEGER AS n_chars FROM documents")
def text_lengths(t: Tables):
    return t.documents.select("doc_id", x.length(F.col("text")).alias("n_bytes"), x.length(F.col("text"), True).alias("n_chars"))


@QUERIES("""SELECT doc_id, md5(replace(text, 'th', 'TH')) AS all_, md5(CASE WHEN instr(text, 'th') > 0 THEN substr(text, 1, instr(text, 'th') - 1) || 'TH' || substr(text, instr(text, 'th') + 2) ELSE text END) AS one, md5(regexp_replace(text, '[aeiou]+', '_', 'g')) AS rx FROM documents""")
def text_replace(t: Tables):
    c = F.col("text")
    return t.documents.select("doc_id", F.md5(x.replace(c, "th", "TH", all_=True)).alias("all_"), F.md5(x.replace(c, "th", "TH")).alias("one"), F.md5(x.replace(c, "[aeiou]+", "_", all_=True, regex=True)).alias("rx"))


@QUERIES("SELECT p_partkey, regexp_replace(p_name, '[0-9]+', '#') AS name FROM part")
def text_replace_regex_once(t: Tables):
    return t.part.select("p_partkey", x.replace(F.col("p_name"), "[0-9]+", "#", regex=True).alias("name"))


@QUERIES("SELECT c_custkey, substr(c_name, 3, 5) AS mid, substr(c_name, length(c_name) - 3, 4) AS tail, substr(c_name, 2) AS rest FROM customer")
def text_substring(t: Tables):
    c = F.col("c_name")
    return t.customer.select("c_custkey", x.substring(c, 2, 6).alias("mid"), x.substring(c, -4).alias("tail"), x.slice_(c, 1).alias("rest"))


@QUERIES("SELECT n_nationkey, rpad(n_name, 15, '.') AS l, lpad(n_name, 15, '.') AS r, reverse(n_name) AS rev FROM nation")
def text_fill(t: Tables):
    c = F.col("n_name")
    return t.nation.select("n_nationkey", x.fill(c, 15, ".").alias("l"), x.fill(c, 15, ".", "right").alias("r"), F.reverse(c).alias("rev"))


@QUERIES("SELECT n_nationkey, trim(v) AS both_, ltrim(v) AS l, rtrim(v, '-') AS r FROM (SELECT n_nationkey, '  ' || n_name || '--' AS v FROM nation)")
def text_trim(t: Tables):
    v = F.concat(F.lit("  "), F.col("n_name"), F.lit("--"))
    return t.nation.select("n_nationkey", x.trim(v).alias("both_"), x.trim(v, right=False).alias("l"), x.trim(v, "-", left=False).alias("r"))


@QUERIES("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::INTEGER AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def text_distance(t: Tables):
    a = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    b = t.nation.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("b"))
    return a.join(b, F.col("k") < F.col("k2")).select("a", "b", F.levenshtein("a", "b").alias("d"))


@QUERIES("SELECT doc_id, unnest(string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10))) AS line FROM documents")
def text_lines(t: Tables):
    return x.lines(t.documents.select("doc_id", "text"), "text").select("doc_id", "line")


@QUERIES("SELECT p_partkey, string_split(p_type, ' ')[1] AS a, string_split(p_type, ' ')[2] AS b FROM part")
def text_split_column(t: Tables):
    return x.split_column(t.part.select("p_partkey", "p_type"), "p_type", " ", "a", "b")


@QUERIES("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS item FROM part")
def text_split_row(t: Tables):
    return x.split_row(t.part.select("p_partkey", "p_type"), "p_type", " ").select("p_partkey", "item")


@QUERIES("SELECT doc_id, len(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+([''’][\\p{L}\\p{N}_]+)*'), lambda w: length(w) >= 4))::INTEGER AS n FROM documents")
def text_words(t: Tables):
    return t.documents.select("doc_id", F.size(x.split_words(F.col("text"), 4)).alias("n"))


@QUERIES("SELECT s_suppkey, regexp_extract(s_name, '^([^#]*)#(.*)$', 1) AS kind, regexp_extract(s_name, '^([^#]*)#(.*)$', 2) AS number FROM supplier WHERE regexp_matches(s_name, '^[^#]*#.*$')")
def parse_pattern(t: Tables):
    return x.parse(t.supplier.select("s_suppkey", "s_name"), "s_name", "{kind}#{number}")


@QUERIES("SELECT event_id, regexp_extract(props, '\"k\": ([0-9]+)', 1) AS k FROM events WHERE regexp_matches(props, '\"k\": ([0-9]+)')")
def parse_regex(t: Tables):
    return x.parse(t.events.select("event_id", "props"), "props", r'"k": (?P<k>[0-9]+)', regex=True)


@QUERIES("SELECT n_name || ' (' || n_nationkey::VARCHAR || ')' AS label, n_name || '-' || n_regionkey::VARCHAR AS joined FROM nation")
def format_template(t: Tables):
    return t.nation.select(x.format_pattern("{n_name} ({n_nationkey})").alias("label"), x.concat_str("-", "n_name", "n_regionkey").alias("joined"))


@QUERIES("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, base64(encode(source)) AS b64, hex(encode(source)) AS hex FROM documents")
def hashes_and_encodings(t: Tables):
    return t.documents.select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.base64(F.col("source").cast("binary")).alias("b64"), F.hex("source").alias("hex"))


@QUERIES("SELECT page_id, split_part(url, '://', 1) AS scheme, regexp_extract(url, '://([^/:?#]+)', 1) AS host, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path FROM pages")
def url_parts(t: Tables):
    u = x.url_parse(F.col("url"))
    return t.pages.select("page_id", u["scheme"].alias("scheme"), u["host"].alias("host"), u["path"].alias("path"))


@QUERIES("SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS base, regexp_replace(url, '/*[^/]*/*$', '') AS dir FROM pages")
def path_parts(t: Tables):
    return t.pages.select("page_id", x.path_basename(F.col("url")).alias("base"), x.path_dirname(F.col("url")).alias("dir"))


@QUERIES("SELECT lang, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def join_texts(t: Tables):
    return t.documents.select("lang", "source").distinct().groupBy("lang").agg(x.str_join(F.sort_array(F.collect_list("source")), ",").alias("sources"))
