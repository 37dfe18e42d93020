"""Streaming sources with kept offsets: tables polled by a watermark, folders watched by snapshots, Kafka topics.

Both sources are Python data sources (`register(spark)` makes them known). Offsets are kept in
the stream's checkpoint, so a restarted stream reads neither twice nor less.

`watermark_poll` reads the rows of a table whose watermark column is above the last offset,
cut into ranges of about `limit` rows for as many tasks. Options: `connector` (`parquet`, or
`module:function` of a DB-API driver), `path` (of the Parquet files, or what the function is
called with), `table`, `column` (one of the schema's, of numbers or text), `limit` (10,000),
`start` (a watermark to begin after). Rows with a null watermark are never read; rows that are
added later at or below the last offset aren't either, as in any poll by a watermark.

`folder_changes` tells which files of a folder were ADDED, MODIFIED or REMOVED since the last
batch, by size and time of change: rows of path, change, size and modified (seconds), by path.
Options: `path`, `pattern` (`*`), `manifests` (a shared folder for the snapshots, which
the offsets name; by default `<path>/.manifests`).
"""

from __future__ import annotations

import fnmatch
import hashlib
import importlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import feeds

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")


class _Range(InputPartition):
    def __init__(self, after, upto):
        self.after, self.upto = after, upto


class _Parquet:
    """Watermarks and rows of Parquet files; row groups without rows in the range are skipped by their statistics."""

    def __init__(self, options: dict, columns: list[str], column: str):
        self.path, self.columns, self.column = options["path"], columns, column

    def _where(self, after, upto):
        field = pc.field(self.column)
        found = field.is_valid()
        found = found if after is None else found & (field > after)
        return found if upto is None else found & (field <= upto)

    def _open(self) -> ds.Dataset:
        fs, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (None, self.path)
        return ds.dataset(path, filesystem=fs, format="parquet")

    def marks(self, after, upto, limit: int) -> list:
        """The last watermark of each range of about `limit` rows."""
        sizes: dict = {}
        for batch in self._open().to_batches(columns=[self.column], filter=self._where(after, upto)):
            for pair in batch.column(0).value_counts():
                value = pair["values"].as_py()
                sizes[value] = sizes.get(value, 0) + pair["counts"].as_py()
        out, n, last = [], 0, None
        for last in sorted(sizes):
            n += sizes[last]
            if n >= limit:
                out.append(last)
                n = 0
        return out + ([last] if n else [])

    def newest(self, after):
        best = None
        for batch in self._open().to_batches(columns=[self.column], filter=self._where(after, None)):
            most = pc.max(batch.column(0)).as_py()
            best = most if best is None or most is not None and most > best else best
        return best

    def rows(self, after, upto) -> Iterator[pa.RecordBatch]:
        yield from self._open().to_batches(columns=self.columns, filter=self._where(after, upto))


class _Driver:
    """Watermarks and rows of a table by a DB-API driver."""

    def __init__(self, options: dict, columns: list[str], column: str):
        module, _, function = options["connector"].partition(":")
        self.connect, self.path, self.table, self.columns, self.column = getattr(importlib.import_module(module), function or "connect"), options["path"], options["table"], columns, column
        for name in (self.table, column, *columns):
            if not _NAME.fullmatch(name):
                raise ValueError(f"{name!r} is no name of a table or column")

    def _asked(self, what: str, after, upto, rest: str = "") -> Iterator[tuple]:
        tests = [f"{self.column} IS NOT NULL"] + [f"{self.column} {sign} ?" for sign, v in ((">", after), ("<=", upto)) if v is not None]
        link = self.connect(self.path)
        try:
            found = link.cursor()
            found.execute(f"SELECT {what} FROM {self.table} WHERE {' AND '.join(tests)} {rest}", [v for v in (after, upto) if v is not None])
            while rows := found.fetchmany(5000):
                yield from rows
        finally:
            link.close()

    def marks(self, after, upto, limit: int) -> list:
        out, n, last = [], 0, None
        for last, count in self._asked(f"{self.column}, count(*)", after, upto, f"GROUP BY {self.column} ORDER BY {self.column}"):
            n += count
            if n >= limit:
                out.append(last)
                n = 0
        return out + ([last] if n else [])

    def newest(self, after):
        return next(iter(self._asked(f"max({self.column})", after, None)))[0]

    def rows(self, after, upto) -> Iterator[tuple]:
        yield from self._asked(", ".join(self.columns), after, upto)


class _Poll(DataSourceStreamReader):
    def __init__(self, options: dict, columns: list[str]):
        column = options["column"]
        if column not in columns:
            raise ValueError(f"{column} is no column that may be read by")
        self.table = (_Parquet if options["connector"] == "parquet" else _Driver)(options, columns, column)
        self.limit, start = int(options.get("limit", 10_000)), options.get("start")
        self.begin = json.loads(start) if start is not None else None
        self.last = None

    def initialOffset(self) -> dict:
        return {"after": json.dumps(self.begin)}

    def latestOffset(self) -> dict:
        found = self.table.newest(self.last if self.last is not None else self.begin)
        self.last = self.last if found is None else found
        return {"after": json.dumps(self.last if self.last is not None else self.begin)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = json.loads(start["after"]), json.loads(end["after"])
        if after == upto or upto is None:
            return []
        marks = self.table.marks(after, upto, self.limit)
        return [_Range(a, b) for a, b in zip([after, *marks[:-1]], marks, strict=True)] if marks else []

    def read(self, partition: _Range) -> Iterator:
        yield from self.table.rows(partition.after, partition.upto)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class WatermarkPoll(DataSource):
    @classmethod
    def name(cls) -> str:
        return "watermark_poll"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Poll(dict(self.options), schema.fieldNames())


class _Files(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class _Watch(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.manifests = options.get("manifests", f"{self.path.rstrip('/')}/.manifests")

    def _at(self, path: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)

    def _read(self, name: str) -> dict[str, list]:
        if not name:
            return {}
        fs, folder = self._at(self.manifests)
        with fs.open_input_stream(f"{folder}/{name}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"manifest": ""}

    def latestOffset(self) -> dict:
        fs, folder = self._at(self.path)
        found = fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
        files = {f.path: [f.size, f.mtime_ns / 1e9] for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern) and not re.search(r"/[._]", f.path[len(folder) :])}
        body = json.dumps(files, sort_keys=True).encode()
        name = hashlib.sha256(body).hexdigest()[:32]
        fs, folder = self._at(self.manifests)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{name}.json") as f:
            f.write(body)
        return {"manifest": name}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = self._read(start["manifest"]), self._read(end["manifest"])
        rows = [(p, "ADDED" if p not in a else "REMOVED" if p not in b else "MODIFIED", *b.get(p, a.get(p))) for p in sorted(a.keys() | b.keys()) if a.get(p) != b.get(p)]
        size = max(1, math.ceil(len(rows) / 64))
        return [_Files(rows[i : i + size]) for i in range(0, len(rows), size)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "path string, change string, size long, modified double"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Watch(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(WatermarkPoll)
    spark.dataSource.register(FolderChanges)
    return spark


def polled(spark: SparkSession, schema: str, path: str, column: str, connector: str = "parquet", table: str = "", limit: int = 10_000, start=None) -> DataFrame:
    """A stream of the rows of a table as its watermark column grows."""
    reader = register(spark).readStream.format("watermark_poll").schema(schema).options(path=path, column=column, connector=connector, table=table, limit=limit)
    return (reader if start is None else reader.option("start", json.dumps(start))).load()


def watched(spark: SparkSession, path: str, pattern: str = "*", manifests: str | None = None) -> DataFrame:
    """A stream of the changes of a folder's files."""
    reader = register(spark).readStream.format("folder_changes").options(path=path, pattern=pattern)
    return (reader.option("manifests", manifests) if manifests else reader).load()


def topic(spark: SparkSession, servers: str, name: str, schema: str | None = None, start: str = "latest", **options: str) -> DataFrame:
    """A stream of a Kafka topic's messages with their places (see feeds.messages); Spark keeps the offsets. Needs Spark's Kafka package on the class path."""
    try:
        records = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": name, "startingOffsets": start, **options}).load()
    except Exception as missing:
        if "kafka" in str(missing).lower() and "DATA_SOURCE" in str(missing).upper().replace(" ", "_"):
            raise ImportError("Spark's Kafka source is not on the class path: start the session with --packages org.apache.spark:spark-sql-kafka-0-10_2.13") from missing
        raise
    return feeds.messages(records, schema)


def ingest_changes(stream: DataFrame, read, folder: str) -> None:
    """read(paths) of each batch's added and modified files, written under `folder`/rows with the files' paths; each file's latest batch counts (see `latest`)."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        told = batch.collect()  # a row a file
        spark.createDataFrame([(r["path"], r["change"], number) for r in told], "path string, change string, batch long").write.mode("overwrite").parquet(f"{folder}/files/batch_={number}")
        paths = [r["path"] for r in told if r["change"] != "REMOVED"]
        if paths:
            read(paths).write.mode("overwrite").parquet(f"{folder}/rows/batch_={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows, with `path`, of the files that are there now, each as it was read last. `schema` is that of the rows with their `path`."""
    files = spark.read.parquet(f"{folder}/files").groupBy("path").agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch_")
    gone = spark.read.parquet(f"{folder}/files").where("change = 'REMOVED'").selectExpr("path", "batch AS batch_")
    rows = spark.read.schema(f"{schema}, batch_ long").parquet(f"{folder}/rows")
    return rows.join(files.join(gone, ["path", "batch_"], "left_anti"), ["path", "batch_"], "left_semi").drop("batch_")
