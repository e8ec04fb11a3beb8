"""Text formats in cells: JSON and CSV by built-in expressions, others by small Arrow-batched parsers."""

from __future__ import annotations

import configparser
import html.parser
import json
import plistlib
import re
import struct
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from email import message_from_string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_json(c: Column | None = None, *columns: str) -> Column:
    """A struct, or the named columns, as JSON with null fields."""
    return F.to_json(c if c is not None else F.struct(*columns), {"ignoreNullFields": "false"})


def from_json(c: Column, schema: str | T.DataType) -> Column:
    """JSON to a typed value; what does not fit is null."""
    return F.from_json(c, schema)


def from_json_variant(c: Column) -> Column:
    """JSON of any shape; null where it is not JSON."""
    return F.try_parse_json(c)


def query_json(c: Column, path: str) -> Column:
    """The part of a JSON text at a path such as `a.b.0`, as text."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(c, "$" + steps)


def to_csv(*columns: str, separator: str = ",") -> Column:
    return F.to_csv(F.struct(*columns), {"sep": separator})


def from_csv(c: Column, schema: str, separator: str = ",") -> Column:
    return F.from_csv(c, schema, {"sep": separator})


def table_text(df: DataFrame, make: Column, separator: str = "\n", order: str | None = None) -> DataFrame:
    """All rows as one text; for results that are small."""
    line = F.struct(F.col(order), make.alias("t")) if order else F.struct(make.alias("t"))
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), separator).alias("text"))


def to_markdown(df: DataFrame, order: str | None = None) -> DataFrame:
    """A small table as Markdown text."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |"))
    head = "| " + " | ".join(df.columns) + " |\n|" + "|".join(" --- " for _ in df.columns) + "|\n"
    return table_text(df, row, "\n", order).select(F.concat(F.lit(head), "text").alias("text"))


def to_html(df: DataFrame, order: str | None = None) -> DataFrame:
    """A small table as an HTML table."""

    def esc(c: str) -> Column:
        out = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            out = F.replace(out, F.lit(old), F.lit(new))
        return out

    row = F.concat(F.lit("<tr>"), *(x for c in df.columns for x in (F.lit("<td>"), esc(c), F.lit("</td>"))), F.lit("</tr>"))
    head = "<table><thead><tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr></thead><tbody>"
    return table_text(df, row, "", order).select(F.concat(F.lit(head), "text", F.lit("</tbody></table>")).alias("text"))


def _batched(parse: Callable[[str], object], dump: Callable[[object], str] | None = None):
    """An Arrow-batched function of a text; what cannot be parsed is null. The result is text (JSON unless told otherwise)."""
    render = dump or (lambda x: json.dumps(x, ensure_ascii=False, default=str))

    def one(text):
        if text is None:
            return None
        try:
            return render(parse(text))
        except Exception:  # any parser's failure on one cell is that cell's null
            return None

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one, na_action="ignore").astype(object)

    return run


def _xml_tree(node: ET.Element) -> dict:
    content = [{"tag": None, "attrs": None, "content": node.text}] if node.text and node.text.strip() else []
    for child in node:
        content.append(_xml_tree(child))
        if child.tail and child.tail.strip():
            content.append({"tag": None, "attrs": None, "content": child.tail})
    return {"tag": node.tag, "attrs": dict(node.attrib), "content": content}


def _xml_node(tree: dict) -> str:
    from xml.sax.saxutils import escape, quoteattr

    if tree.get("tag") is None:
        return escape(tree["content"])
    attrs = "".join(f" {k}={quoteattr(v)}" for k, v in (tree.get("attrs") or {}).items())
    body = "".join(map(_xml_node, tree.get("content") or []))
    return f"<{tree['tag']}{attrs}>{body}</{tree['tag']}>" if body else f"<{tree['tag']}{attrs}/>"


def _ini(text: str) -> dict:
    p = configparser.ConfigParser(interpolation=None, allow_no_value=True)
    p.optionxform = str
    p.read_string(text if text.lstrip().startswith("[") else "[]\n" + text)
    return {s: dict(p.items(s)) for s in p.sections()}


def _eml(text: str) -> dict:
    m = message_from_string(text)
    body = m.get_payload() if not m.is_multipart() else ""
    return {"Subject": m["Subject"], "From": m["From"], "To": m["To"], "Date": m["Date"], "Body": body}


def _blocks(text: str, begin: str, end: str) -> list[dict]:
    """Property lines between BEGIN and END lines, folded lines joined."""
    joined = text.replace("\r\n", "\n").replace("\n ", "").replace("\n\t", "")
    out, now = [], None
    for line in joined.split("\n"):
        if line == begin:
            now = {}
        elif line == end and now is not None:
            out.append(now)
            now = None
        elif now is not None and ":" in line:
            key, value = line.split(":", 1)
            now[key.split(";")[0]] = value
    return out


def _toml_value(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, list):
        return "[" + ", ".join(map(_toml_value, v)) + "]"
    return json.dumps(v, ensure_ascii=False) if isinstance(v, str) else str(v)


def _toml(data: dict, path: tuple[str, ...] = ()) -> str:
    plain = [f"{k} = {_toml_value(v)}\n" for k, v in data.items() if not isinstance(v, dict) and v is not None]
    inner = [_toml(v, (*path, k)) for k, v in data.items() if isinstance(v, dict)]
    head = f"[{'.'.join(path)}]\n" if path and (plain or not inner) else ""
    return head + "".join(plain) + "".join(inner)


class _Page(html.parser.HTMLParser):
    """Title (of several the first), description, headings and links of a page."""

    def __init__(self):
        super().__init__()
        self.out = {"title": "", "description": "", "links": [], "headings": []}
        self.inside: str | None = None
        self.titled = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "title":
            self.inside = None if self.titled else tag
            self.titled = True
        elif tag in ("h1", "h2", "h3"):
            self.inside = tag
            self.out["headings"].append("")
        elif tag == "a" and a.get("href"):
            self.out["links"].append(a["href"])
        elif tag == "meta" and a.get("name") == "description":
            self.out["description"] = a.get("content") or ""

    def handle_endtag(self, tag):
        if tag == self.inside:
            self.inside = None

    def handle_data(self, data):
        if self.inside == "title":
            self.out["title"] += data
        elif self.inside:
            self.out["headings"][-1] += data


def _page(text: str) -> dict:
    p = _Page()
    p.feed(text)
    return p.out


def _yaml():
    import yaml  # an optional package

    return yaml


#: Name -> parser of a text to plain data, given back as JSON text.
PARSERS = {
    "xml": lambda t: _xml_tree(ET.fromstring(t)),
    "toml": tomllib.loads,
    "ini": _ini,
    "plist": lambda t: plistlib.loads(t.encode()),
    "eml": _eml,
    "ics": lambda t: _blocks(t, "BEGIN:VEVENT", "END:VEVENT"),
    "vcf": lambda t: _blocks(t, "BEGIN:VCARD", "END:VCARD"),
    "webpage": _page,
    "webpage_source": lambda t: _page(t.replace("&", "&amp;")),  # character references stay as written
    "yaml": lambda t: _yaml().safe_load(t),
}

#: Name -> writer of JSON text to another format.
WRITERS = {
    "xml": lambda t: _xml_node(json.loads(t)),
    "toml": lambda t: _toml(json.loads(t)),
    "plist": lambda t: plistlib.dumps(json.loads(t)).decode(),
    "yaml": lambda t: _yaml().safe_dump(json.loads(t), sort_keys=False, allow_unicode=True),
}


def from_format(c: Column, kind: str) -> Column:
    """Text of a format (see PARSERS) to JSON text; null where it does not parse. YAML needs the package yaml."""
    if kind == "yaml":
        _yaml()
    return _batched(PARSERS[kind])(c)


def to_format(c: Column, kind: str) -> Column:
    """JSON text to a format (see WRITERS). YAML needs the package yaml."""
    if kind == "yaml":
        _yaml()
    return _batched(WRITERS[kind], str)(c)


def from_ssv(df: DataFrame, column: str, names: list[str], spaces: int = 2) -> DataFrame:
    """Columns of texts whose cells are divided by `spaces` blanks or more."""
    parts = F.split(F.trim(F.col(column)), f" {{{spaces},}}")
    return df.select(*(F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)))


def from_url(c: Column) -> Column:
    """A query string as a map."""
    return F.map_from_entries(F.transform(F.split(c, "&"), lambda p: F.struct(F.url_decode(F.split_part(p, F.lit("="), F.lit(1))), F.url_decode(F.split_part(p, F.lit("="), F.lit(2))))))


def query_xml(c: Column, path: str) -> Column:
    """Texts at an XPath of an XML text, as a list."""
    return F.xpath(c, F.lit(path))


class _Found(html.parser.HTMLParser):
    """Texts of the elements that a selector names: a tag, `.class`, `#id`, or a tag with one of these."""

    def __init__(self, selector: str):
        super().__init__()
        tag, mark, name = re.fullmatch(r"([\w-]*)([.#]?)([\w-]*)", selector).groups()
        self.fits = lambda t, a: (not tag or t == tag) and (not mark or name in (a.get("class") or "").split() if mark == "." else not mark or a.get("id") == name)
        self.open: list[tuple[str, int | None]] = []
        self.out: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.fits(tag, dict(attrs)):
            self.out.append("")
            self.open.append((tag, len(self.out) - 1))
        elif self.open:
            self.open.append((tag, None))

    def handle_endtag(self, tag):
        while any(t == tag for t, _ in self.open) and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        for _, k in self.open:
            if k is not None:
                self.out[k] += data


def query_web(c: Column, selector: str) -> Column:
    """Texts of the elements of a page that a selector names (see _Found), as a JSON list."""

    def parse(text: str) -> list[str]:
        p = _Found(selector)
        p.feed(text)
        return p.out

    return _batched(parse)(c)


def _pack(v, out: bytearray) -> bytearray:
    """MessagePack bytes of plain data."""
    if v is None or isinstance(v, bool):
        out.append({None: 0xC0, False: 0xC2, True: 0xC3}[v])
    elif isinstance(v, int):
        if 0 <= v < 128 or -32 <= v < 0:
            out.append(v & 0xFF)
        else:
            out += b"\xd3" + v.to_bytes(8, "big", signed=True)
    elif isinstance(v, float):
        out += b"\xcb" + struct.pack(">d", v)
    elif isinstance(v, str):
        raw = v.encode()
        out += (bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xdb" + len(raw).to_bytes(4, "big")) + raw
    elif isinstance(v, list | dict):
        short, long = (0x90, b"\xdd") if isinstance(v, list) else (0x80, b"\xdf")
        out += bytes([short | len(v)]) if len(v) < 16 else long + len(v).to_bytes(4, "big")
        for x in v if isinstance(v, list) else (y for pair in v.items() for y in pair):
            _pack(x, out)
    return out


#: First byte of a MessagePack value -> struct format of the number that follows it.
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}


def _unpack(raw: bytes, at: int = 0) -> tuple[object, int]:
    """(value, next position) of MessagePack bytes."""
    b = raw[at]
    at += 1
    sized = lambda n: (int.from_bytes(raw[at : at + n], "big"), at + n)
    if b < 0x80 or b >= 0xE0:
        return (b if b < 0x80 else b - 256), at
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b], at
    if b in _NUMBERS:
        n = struct.calcsize(_NUMBERS[b])
        return struct.unpack(_NUMBERS[b], raw[at : at + n])[0], at + n
    if 0xA0 <= b < 0xC0 or 0xD9 <= b <= 0xDB or 0xC4 <= b <= 0xC6:
        n, at = (b & 31, at) if b < 0xC0 else sized(1 << (b - (0xD9 if b > 0xD0 else 0xC4)))
        body = raw[at : at + n]
        return (body.hex() if 0xC4 <= b <= 0xC6 else body.decode()), at + n
    n, at = (b & 15, at) if b < 0xA0 else sized(2 if b in (0xDC, 0xDE) else 4)
    items = []
    for _ in range(n * (2 if b < 0x90 or b >= 0xDE else 1)):
        x, at = _unpack(raw, at)
        items.append(x)
    return (dict(zip(items[::2], items[1::2], strict=True)) if b < 0x90 or b >= 0xDE else items), at


def to_msgpack(c: Column) -> Column:
    """JSON text to MessagePack bytes."""
    return F.unhex(_batched(lambda t: bytes(_pack(json.loads(t), bytearray())).hex(), str)(c))


def from_msgpack(c: Column) -> Column:
    """MessagePack bytes to JSON text; null where they do not parse."""
    return _batched(lambda t: _unpack(bytes.fromhex(t))[0])(F.hex(c))
