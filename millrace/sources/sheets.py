"""Spreadsheet files (xlsx and ods): one row of cells a row, read by the tasks, one file at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: XML namespaces of the two formats.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"

Rows = Iterator[tuple[str, int, list[str | None]]]  # sheet, row from 0, cells


def _column(place: str) -> int:
    """Column number of a place such as `AB12`, from 0."""
    n = 0
    for ch in re.match("[A-Z]*", place)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _xlsx(archive: zipfile.ZipFile) -> Rows:
    names = set(archive.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ET.fromstring(archive.read("xl/sharedStrings.xml"))]
    target = {r.get("Id"): r.get("Target") for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ET.fromstring(archive.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        path = target[sheet.get(_LINK)].lstrip("/")
        with archive.open(path if path.startswith("xl/") else f"xl/{path}") as f:
            at = -1
            for _, row in ET.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                at = int(row.get("r", at + 2)) - 1
                cells: list[str | None] = []
                for c in row.iter(f"{_MAIN}c"):
                    k = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (k - len(cells))
                    v = c.findtext(f"{_MAIN}v")
                    if c.get("t") == "inlineStr":
                        v = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif c.get("t") == "s" and v is not None:
                        v = shared[int(v)]
                    elif c.get("t") == "b" and v is not None:
                        v = "true" if v == "1" else "false"
                    cells.append(v)
                yield sheet.get("name"), at, cells
                row.clear()


def _ods(archive: zipfile.ZipFile) -> Rows:
    for table in ET.fromstring(archive.read("content.xml")).iter(f"{_TABLE}table"):
        at = 0
        for row in table.iter(f"{_TABLE}table-row"):
            cells: list[str | None] = []
            for c in row:
                if c.tag not in (f"{_TABLE}table-cell", f"{_TABLE}covered-table-cell"):
                    continue
                paragraphs = ["".join(p.itertext()) for p in c.iter(f"{_TEXT}p")]
                v = c.get(f"{_OFFICE}value") or c.get(f"{_OFFICE}boolean-value") or c.get(f"{_OFFICE}date-value") or ("\n".join(paragraphs) if paragraphs else None)
                times = int(c.get(f"{_TABLE}number-columns-repeated", 1))
                cells += [v] * (times if v is not None else min(times, 1024))  # trailing blanks are repeated to the sheet's edge
            while cells and cells[-1] is None:
                cells.pop()
            times = int(row.get(f"{_TABLE}number-rows-repeated", 1))
            if cells:
                for k in range(times):
                    yield table.get(f"{_TABLE}name"), at + k, cells
            at += times


def sheets(spark: SparkSession, *paths: str, batch: int = 10_000) -> DataFrame:
    """All rows of spreadsheet files: (file, sheet, row from 0, cells as text); blank cells are null.

    A file is read by one task (its archive must fit in memory); many files are read side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    found = _ods(archive) if "content.xml" in archive.namelist() else _xlsx(archive)
                    out: list[tuple] = []
                    for sheet, row, cells in found:
                        out.append((path, sheet, row, cells))
                        if len(out) >= batch:
                            yield _batch(out)
                            out = []
                    if out:
                        yield _batch(out)

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInArrow(run, "file string, sheet string, row int, cells array<string>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "sheet", "row", "cells"])


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, header: bool = True) -> DataFrame:
    """One sheet as a table of text columns, the first unless named; names come from its first row, or are column0 on."""
    rows = sheets(spark, path)
    if sheet is None:
        sheet = rows.limit(1).first()["sheet"]
    rows = rows.where(F.col("sheet") == sheet)
    first = rows.agg(F.min_by("cells", "row").alias("cells"), F.min("row").alias("row"), F.max(F.size("cells")).alias("n")).first()
    names = [(first["cells"][k] if header and k < len(first["cells"]) else None) or f"column{k}" for k in range(first["n"])]
    body = rows.where(F.col("row") > first["row"]) if header else rows
    return body.select(*(F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)))
