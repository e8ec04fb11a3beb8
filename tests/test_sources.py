"""Files that are made here: spreadsheets, SQLite in batches."""

import sqlite3
import zipfile

from millrace.sources import sheets, sqlite
from millrace.sources.files import open_

XLSX = {
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" r:id="r1"/><sheet name="two" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<R xmlns="x"><r Id="r1" Target="worksheets/sheet1.xml"/><r Id="r2" Target="/xl/worksheets/sheet2.xml"/></R>',
    "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>',
    "xl/worksheets/sheet1.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" t="b"><v>1</v></c><c r="C3"><v>2.5</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>',
}
ODS = {
    "content.xml": '<o:document xmlns:o="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:t="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:x="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><t:table t:name="s"><t:table-row><t:table-cell><x:p>k</x:p></t:table-cell><t:table-cell><x:p>v</x:p></t:table-cell><t:table-cell t:number-columns-repeated="16000"/></t:table-row><t:table-row t:number-rows-repeated="2"><t:table-cell o:value="1.5"><x:p>1,5</x:p></t:table-cell><t:table-cell t:number-columns-repeated="2"><x:p>z</x:p></t:table-cell></t:table-row></t:table></o:document>',
}


def archive(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return str(path)


def test_xlsx(spark, tmp_path):
    path = archive(tmp_path / "a.xlsx", XLSX)
    assert sorted((r["sheet"], r["row"], tuple(r["cells"])) for r in sheets.sheets(spark, path).collect()) == [("one", 0, ("name", None, "n")), ("one", 2, ("ab", "true", "2.5")), ("two", 0, ("7",))]
    table = open_(spark, path)
    assert table.columns == ["name", "column1", "n"] and [tuple(r) for r in table.collect()] == [("ab", "true", "2.5")]
    assert [tuple(r) for r in open_(spark, path, table="two", header=False).collect()] == [("7",)]


def test_ods(spark, tmp_path):
    table = open_(spark, archive(tmp_path / "a.ods", ODS))
    assert table.columns == ["k", "v", "column2"] and [tuple(r) for r in table.collect()] == [("1.5", "z", "z")] * 2


def test_sqlite_in_batches(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (k INTEGER, v REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(k, k / 2 if k % 3 else None) for k in range(25)])
        db.execute("CREATE TABLE none (k INTEGER)")
        for size in (10, 25, 100):
            got = sqlite._rows(spark, db.execute("SELECT k, v FROM t"), ["k", "v"], batch=size)
            assert sorted((r["k"], r["v"]) for r in got.collect()) == [(k, k / 2 if k % 3 else None) for k in range(25)]
    assert sqlite.read_sqlite(spark, path, "none").count() == 0
    assert sqlite.query_sqlite(spark, path, "SELECT k FROM t WHERE k > ?", [99]).columns == ["k"]
    assert sqlite.read_sqlite(spark, path, "t").where("v IS NULL").count() == 9
