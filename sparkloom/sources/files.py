"""Loading a file of unknown format: by extension, then by its first bytes.

The head of a file is read through Spark's own binary reader, so paths may lie in any
store that Spark reaches. Archives and workbooks, which can't be split, are unpacked by
one task each into a folder of text in the shared folder, and read from there.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from dataclasses import dataclass, field
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.lineage import kept

#: Formats by extension.
FORMATS = {"xlsx": "excel", "xlsm": "excel", "csv": "csv", "tsv": "tsv", "tab": "tsv", "txt": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "pq": "parquet"}
COMPRESSED = ("gz", "bz2", "zip")


class LoadError(ValueError):
    """A file that can't be read, with what was found out about it."""

    def __init__(self, path: str, reason: str, tried: list[str]):
        super().__init__(f"{path}: {reason} (tried: {', '.join(tried) or 'nothing'})")
        self.path, self.reason, self.tried = path, reason, tried



@dataclass
class Loaded:
    """A table and where it came from."""

    df: DataFrame
    path: str
    format: str
    delimiter: str | None = None
    encoding: str = "utf-8"
    notes: list[str] = field(default_factory=list)


def format_of(spark: SparkSession, path: str) -> str:
    parts = path.rsplit("/", 1)[-1].lower().split(".")
    while len(parts) > 1 and parts[-1] in COMPRESSED:
        parts.pop()
    return FORMATS.get(parts[-1]) if len(parts) > 1 and parts[-1] in FORMATS else sniffed(head(spark, path))


def head(spark: SparkSession, path: str, size: int = 4096) -> bytes:
    found = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size).alias("head")).first()
    return bytes(found["head"]) if found else b""


def sniffed(start: bytes) -> str:
    """The format that the first bytes of a file look like."""
    if start.startswith(b"PAR1"):
        return "parquet"
    if start.startswith(b"PK"):
        return "excel" if b"xl/" in start or b"[Content_Types]" in start else "zip"
    if start.startswith(b"\xd0\xcf"):
        return "old_excel"
    text = start.decode("utf-8", "replace").lstrip("﻿ \t\r\n")
    lines = text.splitlines()
    if len(lines) > 1 and lines[0].startswith("{") and lines[0].rstrip().endswith("}"):
        return "jsonl"
    if text[:1] in ("{", "["):
        return "json"
    return "tsv" if lines and lines[0].count("\t") > lines[0].count(",") else "csv"


def delimiter_of(line: str) -> str:
    return max(",;\t|", key=lambda d: (line.count(d), d == ","))


def flattened(df: DataFrame) -> DataFrame:
    """Structs spread into dotted columns, one level deep."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.StructType):
            out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}.{g.name}") for g in f.dataType]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def encoding_of(start: bytes) -> str:
    """utf-8, or latin-1 for what isn't; a byte order mark is taken off by Spark's reader."""
    for cut in range(4):  # the head may end inside a character
        try:
            start[: len(start) - cut].decode("utf-8")
        except UnicodeDecodeError:
            continue
        return "utf-8"
    return "ISO-8859-1"


def _members(frames):
    """Lines of the text files of zip archives."""
    for f in frames:
        for data in f["content"]:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for name in sorted(n for n in z.namelist() if not n.endswith("/") and not n.startswith("__MACOSX")):
                    body = z.read(name)
                    for a in range(0, len(lines := body.decode(encoding_of(body[:4096])).splitlines()), 10_000):
                        yield pd.DataFrame({"member": name, "n": range(a, min(a + 10_000, len(lines))), "value": lines[a : a + 10_000]})


_XL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheets(frames):
    """Rows of the sheets of workbooks, as CSV lines; a cell stands where its reference says."""
    for f in frames:
        for data in f["content"]:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = set(z.namelist())
                shared = ["".join(t.text or "" for t in si.iter(f"{_XL}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_XL}si")] if "xl/sharedStrings.xml" in names else []
                for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n))):
                    out, rows = io.StringIO(), 0
                    for row in ElementTree.fromstring(z.read(name)).iter(f"{_XL}row"):
                        cells: dict[int, str] = {}
                        for c in row.iter(f"{_XL}c"):
                            letters = re.sub(r"\d", "", c.get("r", "")) or "A"
                            at = reduce(lambda n, ch: n * 26 + ord(ch) - 64, letters, 0) - 1
                            v = c.find(f"{_XL}v")
                            text = "".join(t.text or "" for t in c.iter(f"{_XL}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                            cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
                        if cells:
                            csv.writer(out, lineterminator="\n").writerow([cells.get(i, "").replace("\n", " ") for i in range(max(cells) + 1)])
                            rows += 1
                    if rows:
                        lines = out.getvalue().splitlines()
                        yield pd.DataFrame({"member": name, "n": range(len(lines)), "value": lines})


def _unpacked(spark: SparkSession, path: str, reader) -> tuple[str, list[str]]:
    """A folder with the first member that holds anything, as text, and the names of the others."""
    lines = kept(spark.read.format("binaryFile").load(path).select("content").mapInPandas(reader, "member string, n long, value string"))
    members = [r[0] for r in lines.select("member").distinct().collect()]
    if not members:
        raise LoadError(path, "nothing in it", ["zip"])
    first = min(members, key=lambda m: (len(m), m))
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    lines.where(F.col("member") == first).orderBy("n").select("value").coalesce(1).write.text(folder)
    return folder, sorted(set(members) - {first})


def _csv(spark: SparkSession, path: str, delimiter: str, encoding: str, notes: list[str]) -> DataFrame:
    options = {"header": True, "inferSchema": True, "sep": delimiter, "encoding": encoding, "mode": "PERMISSIVE"}
    df = spark.read.csv(path, **options)
    names = [c.strip() for c in df.columns]
    lines, rows = spark.read.text(path).where(F.trim("value") != "").count() - 1, df.count()
    if rows < 0.5 * lines:  # an open quotation mark has swallowed lines
        df = spark.read.csv(path, **options, quote="")
        names = [c.strip().strip('"') for c in df.columns]
        notes.append("quotation marks were taken as they are")
    return df.toDF(*names)


def load(spark: SparkSession, path: str) -> Loaded:
    """The table of a file or folder. Lines that can't be read are left out and counted in the notes; a file that gives no table raises LoadError."""
    tried: list[str] = []
    try:
        kind = format_of(spark, path)
        tried.append(kind)
        return _loaded(spark, path, kind)
    except LoadError:
        raise
    except Exception as wrong:
        raise LoadError(path, str(wrong).splitlines()[0][:300], tried) from wrong


def _loaded(spark: SparkSession, path: str, kind: str) -> Loaded:
    notes: list[str] = []
    if kind == "old_excel":
        raise LoadError(path, "a workbook of the old binary format", [kind])
    if kind == "excel":
        folder, others = _unpacked(spark, path, _sheets)
        notes += [f"another sheet: {o}" for o in others]
        return Loaded(_csv(spark, folder, ",", "utf-8", notes), path, kind, ",", notes=notes)
    if kind == "zip" or path.lower().endswith(".zip"):
        folder, others = _unpacked(spark, path, _members)
        inner = _loaded(spark, folder, kind if kind != "zip" else sniffed("\n".join(r[0] for r in spark.read.text(folder).limit(5).collect()).encode()))
        inner.path, inner.notes = path, inner.notes + [f"another file: {o}" for o in others]
        return inner
    if kind == "parquet":
        return Loaded(spark.read.parquet(path), path, kind)
    if kind in ("csv", "tsv"):
        packed = path.lower().endswith((".gz", ".bz2"))
        encoding = "utf-8" if packed or "." not in path.rsplit("/", 1)[-1] else encoding_of(head(spark, path, 200_000))
        first = spark.read.text(path).first()
        delimiter = "\t" if kind == "tsv" else delimiter_of(first[0] if first else "")
        return Loaded(_csv(spark, path, delimiter, encoding, notes), path, kind, delimiter, encoding, notes)
    df = spark.read.json(path, multiLine=kind == "json", mode="DROPMALFORMED")
    if kind == "jsonl":
        lines = spark.read.text(path).where(F.trim("value") != "")
        if bad := lines.where(F.try_parse_json("value").isNull()).count():
            notes.append(f"{bad} lines could not be read")
    if kind == "json" and len(df.columns) and all(isinstance(f.dataType, T.ArrayType) for f in df.schema):
        df = df.select(F.explode(F.arrays_zip(*[F.col(f"`{c}`") for c in df.columns])).alias("r")).select("r.*")
        notes.append("columns of lists were made rows")
    return Loaded(flattened(df), path, kind, notes=notes)


def canonical_names(columns: list[str]) -> list[str]:
    """Names in small letters with other signs as one underscore, 120 characters at most; repeats get __1, __2, ..."""
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        name = re.sub(r"_+", "_", re.sub(r"\W+", "_", c.strip().lower())).strip("_")[:120] or "col"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}__{n}" if n else name)
    return out
