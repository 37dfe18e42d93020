from __future__ import annotations

import gzip
import zipfile

import pytest

from sparkloom.sources import files


def test_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n3;4\n")
    (tmp_path / "b").write_text('{"x": 1, "s": {"t": 5}}\n{"x": 2}\nnot json\n')
    (tmp_path / "c.json").write_text('{"x": [1, 2], "y": ["a", "b"]}')
    (tmp_path / "d.tsv.gz").write_bytes(gzip.compress(b"x\ty\n1\t2\n"))
    spark.range(3).write.parquet(str(tmp_path / "e.parquet"))
    a, b, c, d, e = (files.load(spark, str(tmp_path / n)) for n in ("a.csv", "b", "c.json", "d.tsv.gz", "e.parquet"))
    assert (a.delimiter, [tuple(r) for r in a.df.collect()]) == (";", [(1, 2), (3, 4)])
    assert b.format == "jsonl" and sorted(b.df.columns) == ["s.t", "x"] and b.df.count() == 2 and b.notes
    assert {tuple(r) for r in c.df.collect()} == {(1, "a"), (2, "b")}
    assert d.format == "tsv" and [tuple(r) for r in d.df.collect()] == [(1, 2)]
    assert e.df.count() == 3


def test_names():
    assert files.canonical_names(["Total Price", "total-price", "  ", "é 1"]) == ["total_price", "total_price__1", "col", "é_1"]


def test_archives_encodings_and_single_records(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.csv.zip", "w") as z:
        z.writestr("t.csv", "x,y\n1,2\n3,4\n")
        z.writestr("other.csv", "z\n1\n")
    (tmp_path / "b.csv").write_bytes("name,x\ncafé,1\n".encode("latin-1"))
    (tmp_path / "c.json").write_text('{"x": 1, "y": "a"}')
    a, b, c = (files.load(spark, str(tmp_path / n)) for n in ("a.csv.zip", "b.csv", "c.json"))
    assert [tuple(r) for r in a.df.collect()] == [(1, 2), (3, 4)] and a.notes == ["another file: other.csv"]
    assert b.encoding == "ISO-8859-1" and b.df.first()["name"] == "café"
    assert [tuple(r) for r in c.df.collect()] == [(1, "a")]
    with pytest.raises(files.LoadError):
        files.load(spark, str(tmp_path / "missing.csv"))


def test_workbooks(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>city, name</t></si><si><t>n</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet.format(""))
        z.writestr("xl/worksheets/sheet2.xml", sheet.format('<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>Bonn</t></is></c><c r="C2"><v>7</v></c></row>'))
    got = files.load(spark, str(tmp_path / "w.xlsx"))
    assert got.format == "excel" and [(r[0], r[2]) for r in got.df.collect()] == [("Bonn", 7)] and got.df.columns[0] == "city, name"
    (tmp_path / "old").write_bytes(b"\xd0\xcf\x11\xe0 rest")
    with pytest.raises(files.LoadError, match="old binary"):
        files.load(spark, str(tmp_path / "old"))
