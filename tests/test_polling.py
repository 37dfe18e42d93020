"""Streaming sources that are restarted: no row twice, none lost, changed files seen."""

from __future__ import annotations

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import polling


def pull(stream, folder):
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def rows_of(spark, folder, schema):
    return sorted(map(tuple, spark.read.schema(schema).parquet(f"{folder}/out").collect()))


SCHEMA = "id long, name string"


def test_database_is_polled_from_where_it_ended(spark, tmp_path):
    path = f"{tmp_path}/t.db"
    link = sqlite3.connect(path)
    link.execute("CREATE TABLE things (id INTEGER, name TEXT, more TEXT)")
    put = lambda rows: (link.executemany("INSERT INTO things VALUES (?, ?, 'x')", rows), link.commit())
    put([(i, f"n{i}") for i in range(95)] + [(94, "again"), (None, "never")])
    stream = lambda: polling.polled(spark, SCHEMA, path, "id", "sqlite3:connect", "things", 30)
    pull(stream(), f"{tmp_path}/s")
    first = rows_of(spark, f"{tmp_path}/s", SCHEMA)
    assert first == sorted([(i, f"n{i}") for i in range(95)] + [(94, "again")])
    pull(stream(), f"{tmp_path}/s")
    assert rows_of(spark, f"{tmp_path}/s", SCHEMA) == first
    put([(i, f"n{i}") for i in range(200, 300)])
    pull(stream(), f"{tmp_path}/s")
    assert rows_of(spark, f"{tmp_path}/s", SCHEMA) == sorted(first + [(i, f"n{i}") for i in range(200, 300)])
    later = polling.polled(spark, SCHEMA, path, "id", "sqlite3:connect", "things", 30, start=250)
    pull(later, f"{tmp_path}/later")
    assert [r[0] for r in rows_of(spark, f"{tmp_path}/later", SCHEMA)] == list(range(251, 300))


def test_ranges_cover_every_row_once():
    class Table:
        def marks(self, after, upto, limit):
            values = [v for v in (1, 1, 2, 5, 5, 5, 9) if (after is None or v > after) and v <= upto]
            out, n = [], 0
            for i, v in enumerate(values):
                n += 1
                if n >= limit and (i + 1 == len(values) or values[i + 1] != v):
                    out.append(v)
                    n = 0
            return out + ([values[-1]] if n else [])

    reader = polling._Poll.__new__(polling._Poll)
    reader.table, reader.limit = Table(), 2
    got = [(p.after, p.upto) for p in reader.partitions({"after": "null"}, {"after": "9"})]
    assert got == [(None, 1), (1, 5), (5, 9)] and reader.partitions({"after": "9"}, {"after": "9"}) == []


def test_parquet_is_polled(spark, tmp_path):
    schema = "id long, at string"
    put = lambda a, b: spark.range(a, b).selectExpr("id", "concat('2024-', lpad(id, 5, '0')) AS at").write.mode("append").parquet(f"{tmp_path}/table")
    put(0, 100)
    for column, name in (("id", "n"), ("at", "t")):
        pull(polling.polled(spark, schema, f"{tmp_path}/table", column, limit=7), f"{tmp_path}/{name}")
    put(100, 150)
    for column, name in (("id", "n"), ("at", "t")):
        pull(polling.polled(spark, schema, f"{tmp_path}/table", column, limit=7), f"{tmp_path}/{name}")
        assert [r[0] for r in rows_of(spark, f"{tmp_path}/{name}", schema)] == list(range(150))
    with pytest.raises(Exception, match="no column"):
        polling.polled(spark, schema, f"{tmp_path}/table", "secret").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()


def test_names_are_checked():
    with pytest.raises(ValueError, match="no name"):
        polling._Driver({"connector": "sqlite3:connect", "path": "x", "table": "t; DROP TABLE t"}, ["a"], "a")


def test_changed_files_are_seen_and_read_anew(spark, tmp_path):
    watched, folder = f"{tmp_path}/in", f"{tmp_path}/told"
    os.makedirs(watched)
    put = lambda name, text: open(f"{watched}/{name}", "w").write(text)
    read = lambda paths: spark.read.text(paths).select("value", F.regexp_replace(F.input_file_name(), "^file:/*", "/").alias("path"))
    stream = lambda: polling.watched(spark, watched, "*.txt")

    def told(n):
        return sorted((os.path.basename(r.path), r.change) for r in spark.read.parquet(f"{folder}/files").where(F.col("batch") == n).collect())

    def now():
        return sorted(r.value for r in polling.latest(spark, folder, "value string, path string").collect())

    put("a.txt", "a1\na2")
    put("b.txt", "b1")
    put("c.csv", "no")
    polling.ingest_changes(stream(), read, folder)
    assert told(0) == [("a.txt", "ADDED"), ("b.txt", "ADDED")] and now() == ["a1", "a2", "b1"]
    polling.ingest_changes(stream(), read, folder)
    put("b.txt", "b1 changed")
    put("d.txt", "d1")
    os.unlink(f"{watched}/a.txt")
    polling.ingest_changes(stream(), read, folder)
    last = spark.read.parquet(f"{folder}/files").agg(F.max("batch")).first()[0]
    assert told(last) == [("a.txt", "REMOVED"), ("b.txt", "MODIFIED"), ("d.txt", "ADDED")] and now() == ["b1 changed", "d1"]


def test_kafka_is_named_where_it_is_missing(spark):
    with pytest.raises(ImportError, match="kafka"):
        polling.topic(spark, "localhost:9092", "t")
