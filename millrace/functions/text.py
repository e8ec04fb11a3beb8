"""Text functions on columns, as built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """A pattern that matches a text literally."""
    return re.escape(text) if text else ""


def capitalize(c: Column) -> Column:
    """Upper-case the first character only."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.char_length(c)))


def words(c: Column) -> Column:
    """Words of an identifier or phrase: runs of letters and digits, cut where lower case turns to upper."""
    cut = F.regexp_replace(c, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    cut = F.regexp_replace(cut, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.regexp_extract_all(cut, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def snake_case(c: Column) -> Column:
    return F.array_join(F.transform(words(c), F.lower), "_")


def kebab_case(c: Column) -> Column:
    return F.array_join(F.transform(words(c), F.lower), "-")


def screaming_snake_case(c: Column) -> Column:
    return F.array_join(F.transform(words(c), F.upper), "_")


def title_case(c: Column) -> Column:
    return F.array_join(F.transform(words(c), lambda w: capitalize(F.lower(w))), " ")


def pascal_case(c: Column) -> Column:
    return F.array_join(F.transform(words(c), lambda w: capitalize(F.lower(w))), "")


def camel_case(c: Column) -> Column:
    p = pascal_case(c)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.char_length(p)))


def contains(c: Column, text: str, ignore_case: bool = False) -> Column:
    return F.contains(F.lower(c), F.lit(text.lower())) if ignore_case else F.contains(c, F.lit(text))


def starts_with(c: Column, text: str, ignore_case: bool = False) -> Column:
    return F.startswith(F.lower(c), F.lit(text.lower())) if ignore_case else F.startswith(c, F.lit(text))


def ends_with(c: Column, text: str, ignore_case: bool = False) -> Column:
    return F.endswith(F.lower(c), F.lit(text.lower())) if ignore_case else F.endswith(c, F.lit(text))


def index_of(c: Column, text: str, chars: bool = False, end: bool = False) -> Column:
    """First (or last) place of a text, in UTF-8 bytes unless `chars`; -1 if absent."""
    if end:
        back = F.instr(F.reverse(c), text[::-1])
        at = F.when(back == 0, -1).otherwise(F.char_length(c) - back - len(text) + 1)
    else:
        at = F.instr(c, text) - 1
    if chars:
        return at
    return F.when(at < 0, -1).otherwise(F.octet_length(F.substring(c, F.lit(1), at)))


def length(c: Column, chars: bool = False) -> Column:
    """Length in UTF-8 bytes, or in characters."""
    return F.char_length(c) if chars else F.octet_length(c)


def replace(c: Column, find: str, by: str, all_: bool = False, regex: bool = False) -> Column:
    """Replace the first match, or all; literal text unless `regex`."""
    if all_:
        return F.regexp_replace(c, find, by) if regex else F.replace(c, F.lit(find), F.lit(by))
    if regex:  # match the text up to the first hit lazily, once
        return F.regexp_replace(c, f"(?s)\\A(.*?)(?:{find})", "$1" + by) if "$" not in by else F.regexp_replace(c, f"(?s)\\A((?:(?!{find}).)*+){find}", by)
    at = F.instr(c, find)
    return F.when(at > 0, F.overlay(c, F.lit(by), at, F.lit(len(find)))).otherwise(c)


def substring(c: Column, start: int, stop: int | None = None) -> Column:
    """Characters start to stop (inclusive); negative positions count from the end."""
    n = F.char_length(c)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = n - 1 if stop is None else F.lit(stop) if stop >= 0 else n + stop
    return F.substring(c, a + 1, F.greatest(b - a + 1, F.lit(0)))


def slice_(c: Column, start: int, size: int | None = None) -> Column:
    """`size` characters from `start` on, which counts from the end if negative."""
    n = F.char_length(c)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    return F.substring(c, a + 1, n if size is None else F.lit(size))


def trim(c: Column, chars: str | None = None, left: bool = True, right: bool = True) -> Column:
    """Strip white space, or given characters, from the ends."""
    kind = r"[\s\p{Z}]" if chars is None else "[" + re.sub(r"([\\\]\[^-])", r"\\\1", chars) + "]"
    out = F.regexp_replace(c, f"^{kind}+", "") if left else c
    return F.regexp_replace(out, f"{kind}+$", "") if right else out


def fill(c: Column, width: int, character: str = " ", alignment: str = "left") -> Column:
    """Pad to a width: the text stands left, right, middle (more on the right) or middle-right; longer texts stay whole."""
    text = c.cast("string")
    missing = F.greatest(F.lit(width) - F.char_length(text), F.lit(0))
    less, more = F.floor(missing / 2).cast("int"), F.ceil(missing / 2).cast("int")
    before, after = {"left": (F.lit(0), missing), "right": (missing, F.lit(0)), "middle": (less, more), "middle-right": (more, less)}[alignment]
    return F.concat(F.repeat(F.lit(character), before.cast("int")), text, F.repeat(F.lit(character), after.cast("int")))


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\$1")


def stats(c: Column) -> Column:
    """Lines, words, bytes and characters."""
    return F.struct(
        F.when(c == "", 0).otherwise(F.size(F.split(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n"))).cast("long").alias("lines"),
        F.size(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_'’]+)"), F.lit(1))).cast("long").alias("words"),
        F.octet_length(c).cast("long").alias("bytes"),
        F.char_length(c).cast("long").alias("chars"),
    )


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\u001b\\[[0-9;?]*[ -/]*[@-~]", "")


def lines(df: DataFrame, column: str, skip_empty: bool = False, name: str = "line") -> DataFrame:
    """One row a line; a final line end opens no line."""
    text = F.regexp_replace(F.col(column), r"\r?\n\z", "")
    rows = df.withColumn(name, F.explode(F.split(text, r"\r?\n")))
    return rows.where(F.trim(F.col(name)) != "") if skip_empty else rows


def split_row(df: DataFrame, column: str, separator: str, regex: bool = False, number: int = -1, name: str = "item") -> DataFrame:
    """One row a part."""
    return df.withColumn(name, F.explode(F.split(F.col(column), separator if regex else quoted(separator), number)))


def split_column(df: DataFrame, column: str, separator: str, *names: str, n: int | None = None, regex: bool = False, collapse_empty: bool = False) -> DataFrame:
    """Parts as columns: given names, or column0 to column{n-1}; what is missing is null."""
    parts = F.split(F.col(column), separator if regex else quoted(separator))
    if collapse_empty:
        parts = F.filter(parts, lambda p: p != "")
    names = names or tuple(f"column{k}" for k in range(n or 0))
    if not names:
        raise ValueError("give the names of the columns, or n, their number")
    return df.select(*(c for c in df.columns if c != column), *(F.get(parts, F.lit(k)).alias(name) for k, name in enumerate(names)))


def split_words(c: Column, least: int = 1) -> Column:
    """Words of letters, digits and apostrophes, as a list."""
    found = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*)"), F.lit(1))
    return F.filter(found, lambda w: F.char_length(w) >= least)


def split_chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def parse(df: DataFrame, column: str, pattern: str, regex: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """Columns from a pattern such as `{a}-{b}` (`{_}` is dropped), or from a regex's groups (unnamed: captureN).

    A pattern must match the whole text. Texts that do not match give no row; a regex gives one row a match.
    """
    rest = [c for c in df.columns if c != column] if keep is None else list(keep)
    text = F.col(column)
    if not regex:
        parts = re.split(r"\{([^{}]*)\}", pattern)
        names = parts[1::2]
        body = "".join(quoted(p) if k % 2 == 0 else "(.*?)" for k, p in enumerate(parts))
        body = f"(?s)\\A{body}\\z"
        rows = df.where(text.rlike(body))
        return rows.select(*rest, *(F.regexp_extract(text, body, k + 1).alias(n) for k, n in enumerate(names) if n != "_"))
    compiled = re.compile(pattern)
    named = {v: k for k, v in compiled.groupindex.items()}
    java = re.sub(r"\(\?P<", "(?<", pattern)
    groups = [F.regexp_extract_all(text, F.lit(java), F.lit(k + 1)).alias(named.get(k + 1, f"capture{k}")) for k in range(compiled.groups)]
    rows = df.select(*rest, F.inline(F.arrays_zip(*groups)))
    return rows.toDF(*rest, *(named.get(k + 1, f"capture{k}") for k in range(compiled.groups)))


def format_pattern(pattern: str) -> Column:
    """Fill `{column}` places of a template with the row's values; null is empty."""
    parts = re.split(r"\{([^{}]*)\}", pattern)
    return F.concat(*(F.lit(p) if k % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) for k, p in enumerate(parts)))


def concat_str(separator: str, *columns: str) -> Column:
    """Join cells; null if any is null."""
    out: list[Column] = []
    for k, c in enumerate(columns):
        out += [F.lit(separator)] * (k > 0) + [F.col(c).cast("string")]
    return F.concat(*out)


def str_join(c: Column, separator: str = "") -> Column:
    """Items of a list as one text."""
    return F.array_join(c, separator)


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common beginning of two texts."""
    n = F.least(F.char_length(a), F.char_length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.substring(a, F.lit(1), F.array_max(same))


def dedent(c: Column, width: int) -> Column:
    """Remove `width` blanks from the start of each line."""
    return F.regexp_replace(c, f"(?m)^ {{{width}}}", "")


def encode_base32(c: Column, hex_alphabet: bool = False) -> Column:
    """Base-32 text of bytes, by 5-bit groups."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUV" if hex_alphabet else "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = F.filter(F.split(F.hex(c), ""), lambda x: x != "")
    bits = F.array_join(F.transform(digits, lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")
    whole = F.rpad(bits, (F.ceil(F.char_length(bits) / 5) * 5).cast("int"), F.lit("0"))
    text = F.array_join(F.transform(F.regexp_extract_all(whole, F.lit("(.{5})"), F.lit(1)), lambda x: F.substring(F.lit(alphabet), F.conv(x, 2, 10).cast("int") + 1, F.lit(1))), "")
    return F.when(F.octet_length(c) == 0, "").otherwise(F.rpad(text, (F.ceil(F.char_length(text) / 8) * 8).cast("int"), F.lit("=")))


def url_encode(c: Column, all_: bool = False) -> Column:
    """Percent-encoding of all but letters and digits; `/ : .` too only with `all_`."""
    out = F.url_encode(c)
    for old, new in (("+", "%20"), ("*", "%2A"), ("-", "%2D"), ("_", "%5F"), (".", "%2E")):
        out = F.replace(out, F.lit(old), F.lit(new))
    if not all_:
        for old, new in (("%2F", "/"), ("%3A", ":"), ("%2E", ".")):
            out = F.replace(out, F.lit(old), F.lit(new))
    return out


def url_parse(c: Column) -> Column:
    """Parts of a URL."""
    part = lambda p: F.coalesce(F.try_parse_url(c, F.lit(p)), F.lit(""))
    port = F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1)
    user = part("USERINFO")
    return F.struct(
        part("PROTOCOL").alias("scheme"),
        F.split_part(user, F.lit(":"), F.lit(1)).alias("username"),
        F.split_part(user, F.lit(":"), F.lit(2)).alias("password"),
        part("HOST").alias("host"),
        port.alias("port"),
        part("PATH").alias("path"),
        part("QUERY").alias("query"),
        part("REF").alias("fragment"),
    )


def url_query(c: Column) -> Column:
    """Keys and values of a query string, in order."""
    pairs = F.filter(F.split(c, "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(F.url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("key"), F.url_decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("value")))


def path_parse(c: Column) -> Column:
    """Parent, stem and extension of a path."""
    base = F.regexp_extract(c, r"([^/]*)/*$", 1)
    ext = F.regexp_extract(base, r"(?<=.)\.([^.]*)$", 1)
    return F.struct(
        F.regexp_replace(F.regexp_replace(c, r"/*[^/]*/*$", ""), r"^$", "").alias("parent"),
        F.when(base.rlike(r"(?<=.)\.[^.]*$"), F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")).otherwise(base).alias("stem"),
        ext.alias("extension"),
    )


def path_basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)/*$", 1)


def path_dirname(c: Column, levels: int = 1) -> Column:
    out = c
    for _ in range(levels):
        out = F.regexp_replace(out, r"/*[^/]*/*$", "")
    return out


def path_join(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("/", *parts), r"(?<!:)/{2,}", "/")


def path_split(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda p: p != "")


def decode_base32(c: Column, hex_alphabet: bool = False) -> Column:
    """Bytes of a base-32 text, padding left out."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUV" if hex_alphabet else "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    chars = split_chars(F.rtrim(F.upper(c), F.lit("=")))
    bits = F.array_join(F.transform(chars, lambda x: F.lpad(F.conv(F.instr(F.lit(alphabet), x) - 1, 10, 2), 5, "0")), "")
    octets = F.regexp_extract_all(bits, F.lit("(.{8})"), F.lit(1))
    return F.unhex(F.array_join(F.transform(octets, lambda x: F.lpad(F.conv(x, 2, 16), 2, "0")), ""))


def build_query(record: Column) -> Column:
    """A map as a query string."""
    return F.array_join(F.transform(F.map_entries(record), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"].cast("string")))), "&")


def url_join(parts: Column) -> Column:
    """A URL from the parts that url_parse gives; empty parts are left out."""
    some = lambda name, before, after="": F.when(parts[name] != "", F.concat(F.lit(before), parts[name], F.lit(after))).otherwise("")
    user = F.when(parts["username"] != "", F.concat(parts["username"], some("password", ":"), F.lit("@"))).otherwise("")
    return F.concat(some("scheme", "", "://"), user, parts["host"], some("port", ":"), parts["path"], some("query", "?"), some("fragment", "#"))


def url_with(c: Column, **changes: Column | str) -> Column:
    """The URL with some parts replaced: scheme, host, port, path, query, fragment."""
    parts = url_parse(c)
    for name, value in changes.items():
        parts = parts.withField(name, value if isinstance(value, Column) else F.lit(value))
    return url_join(parts)


def path_with(c: Column, extension: str | None = None, stem: str | None = None, parent: str | None = None) -> Column:
    """The path with some parts replaced."""
    p = path_parse(c)
    ext = F.lit(extension) if extension is not None else p["extension"]
    up = F.lit(parent) if parent is not None else p["parent"]
    name = F.concat(F.lit(stem) if stem is not None else p["stem"], F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))
    return F.when(up == "", name).otherwise(F.concat(up, F.lit("/"), name))


def path_relative_to(c: Column, base: str) -> Column:
    """The rest of a path below a folder; null if it is not below."""
    root = base.rstrip("/")
    return F.when(c == root, "").when(F.startswith(c, F.lit(root + "/")), F.substring(c, F.lit(len(root) + 2), F.char_length(c)))


def brace_expansions(pattern: str) -> list[str]:
    """All texts that a pattern with `{a,b}` lists and `{1..3}` ranges stands for."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    span = re.fullmatch(r"(\d+)\.\.(\d+)", m[1])
    if span:
        a, b = int(span[1]), int(span[2])
        width = len(span[1]) if span[1].startswith("0") and len(span[1]) > 1 else 0
        items = [str(k).zfill(width) for k in range(a, b + 1)]
    else:
        items = m[1].split(",")
    out: list[str] = []
    for i in items:
        out += [x for x in brace_expansions(pattern[: m.start()] + i + pattern[m.end() :]) if x not in out]
    return out


#: Names of characters.
CHARACTERS = {
    "nul": "\0", "tab": "\t", "newline": "\n", "enter": "\n", "nl": "\n", "line_feed": "\n", "lf": "\n", "cr": "\r", "crlf": "\r\n",
    "sp": " ", "space": " ", "pipe": "|", "lparen": "(", "rparen": ")", "lbracket": "[", "rbracket": "]", "lbrace": "{", "rbrace": "}",
    "single_quote": "'", "squote": "'", "sq": "'", "double_quote": '"', "dquote": '"', "dq": '"', "tilde": "~", "hash": "#", "path_sep": "/", "bel": "\a", "backspace": "\b", "esc": "\u001b",
}


def char(name: str) -> Column:
    """A character by its name, or by its number in hexadecimal."""
    return F.lit(CHARACTERS[name] if name in CHARACTERS else chr(int(name, 16)))


def unindent(c: Column) -> Column:
    """Remove the blanks that all lines with text begin with."""
    lines = F.split(c, "\n")
    indents = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.char_length(x) - F.char_length(F.ltrim(x)))
    width = F.coalesce(F.array_min(indents), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.when(F.trim(x) == "", "").otherwise(F.substring(x, width + 1, F.char_length(x)))), "\n")


def align(lines: Column, mark: str) -> Column:
    """A list of lines with blanks before the first `mark` of each, so that the marks stand in one column."""
    at = lambda x: F.instr(x, mark)
    widest = F.array_max(F.transform(lines, at))
    return F.transform(lines, lambda x: F.when(at(x) == 0, x).otherwise(F.concat(F.substring(x, F.lit(1), at(x) - 1), F.repeat(F.lit(" "), widest - at(x)), F.substring(x, at(x), F.char_length(x)))))


def detect_columns(c: Column, headers: bool = True) -> Column:
    """Rows of a text of blank-separated columns, as a list of maps; names come from the first line, or are column0 on."""
    lines = F.filter(F.split(c, "\r?\n"), lambda x: (F.trim(x) != "") & ~F.rlike(x, F.lit(r"^[\s+|=-]*$")))
    cells = F.transform(lines, lambda x: F.split(F.trim(F.regexp_replace(x, r"\s+|(?<=\s)\|(?=\s)", " ")), " +"))
    width = F.array_max(F.transform(cells, F.size))
    plain = F.transform(F.sequence(F.lit(0), F.coalesce(width, F.lit(1)) - 1), lambda k: F.concat(F.lit("column"), k))
    names = F.get(cells, F.lit(0)) if headers else plain
    rows = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))) if headers else cells
    return F.transform(rows, lambda r: F.map_from_arrays(names, F.transform(names, lambda _, k: F.get(r, k))))
