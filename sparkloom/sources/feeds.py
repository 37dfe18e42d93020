"""Feeds: message envelopes, tables read by a watermark, folders watched by snapshots, public JSON services, packet captures, texts cut into chunks."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import time
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def messages(records: DataFrame, schema: str | None = None) -> DataFrame:
    """Values of message records (value, partition, offset, timestamp), as Spark's Kafka source gives them: fields of JSON by a schema, else the raw text; with _kafka_partition, _kafka_offset and _kafka_ts."""
    text = F.col("value").cast("string")
    body = F.from_json(text, schema).alias("b") if schema else F.struct(text.alias("value")).alias("b")
    return records.select(body, F.col("partition").alias("_kafka_partition"), F.col("offset").alias("_kafka_offset"), F.col("timestamp").alias("_kafka_ts")).select("b.*", "_kafka_partition", "_kafka_offset", "_kafka_ts")


def since(df: DataFrame, column: str, watermark, limit: int, allowed: tuple[str, ...] | None = None) -> tuple[DataFrame, object]:
    """The next rows after a watermark, in its order, `limit` at most, and the watermark to go on from; rows that share the last value come together."""
    if column not in (allowed or df.columns):
        raise ValueError(f"{column} is no column that may be read by")
    newer = df if watermark is None else df.where(F.col(column) > F.lit(watermark))
    last = newer.orderBy(column).limit(limit).agg(F.max(column)).first()[0]
    return (newer.limit(0), watermark) if last is None else (newer.where(F.col(column) <= F.lit(last)), last)


def snapshot(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size and modified of the files of a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change (ADDED, MODIFIED, REMOVED) between two snapshots, by path."""
    a, b = (s.select("path", F.struct("size", "modified").alias(n)) for s, n in ((before, "a"), (after, "b")))
    change = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(F.col("a") != F.col("b"), "MODIFIED")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL").orderBy("path")


#: Of each service: the type of its answer, the array of rows in it, and the columns taken from a row.
SERVICES: dict[str, tuple[str, str, dict[str, str]]] = {
    "fred": ("observations array<struct<date: string, value: string>>", "observations", {"date": "to_date(r.date)", "value": "try_cast(r.value AS DOUBLE)"}),
    "bls": ("Results struct<series: array<struct<seriesID: string, data: array<struct<year: string, period: string, value: string>>>>>", "flatten(transform(Results.series, s -> transform(s.data, d -> named_struct('id', s.seriesID, 'd', d))))", {"series": "r.id", "month": "concat(r.d.year, '-', substring(r.d.period, 2, 2))", "value": "try_cast(r.d.value AS DOUBLE)"}),
    "noaa": ("results array<struct<date: string, datatype: string, station: string, value: double>>", "results", {"at": "try_to_timestamp(r.date)", "kind": "r.datatype", "station": "r.station", "value": "r.value"}),
    "openml": ("data array<struct<name: string, rows: array<array<string>>>>", "flatten(transform(data, t -> transform(t.rows, x -> named_struct('t', t.name, 'x', x))))", {"table": "r.t", "cells": "r.x"}),
    "pubmed": ("result struct<articles: array<struct<uid: string, title: string, pubdate: string>>>", "result.articles", {"uid": "r.uid", "title": "r.title", "published": "r.pubdate"}),
    "quakes": ("features array<struct<id: string, properties: struct<mag: double, place: string, time: bigint>, geometry: struct<coordinates: array<double>>>>", "features", {"id": "r.id", "at": "timestamp_millis(r.properties.time)", "magnitude": "r.properties.mag", "place": "r.properties.place", "longitude": "r.geometry.coordinates[0]", "latitude": "r.geometry.coordinates[1]", "depth": "r.geometry.coordinates[2]"}),
    "indicators": ("data array<struct<countryiso3code: string, date: string, value: double, indicator: struct<id: string>>>", "data", {"country": "r.countryiso3code", "year": "try_cast(r.date AS INT)", "indicator": "r.indicator.id", "value": "r.value"}),
    "games": ("resultSets array<struct<headers: array<string>, rowSet: array<array<string>>>>", "flatten(transform(resultSets, s -> transform(s.rowSet, x -> map_from_arrays(s.headers, x))))", {"player": "r['PLAYER_NAME']", "day": "r['GAME_DATE']", "points": "try_cast(r['PTS'] AS DOUBLE)"}),
}


def answers(raw: DataFrame, service: str, text: str = "body") -> DataFrame:
    """Rows of a service's JSON answers, with the columns that `raw` carries beside them; answers that don't read give none."""
    schema, rows, columns = SERVICES[service]
    carried = [c for c in raw.columns if c != text]
    return raw.select(*carried, F.from_json(text, schema).alias("a")).select(*carried, "a.*").select(*carried, F.explode(F.expr(rows)).alias("r")).select(*carried, *[F.expr(x).alias(n) for n, x in columns.items()])


def fetched(spark: SparkSession, urls: list[str], folder: str, opener: Callable[[str], bytes] | None = None, pause: float = 0.2) -> DataFrame:
    """url, body, sha256 and fetched_at of pages, kept under a folder as Parquet; a page that is there already isn't asked for again. Few pages a task, a pause between them."""
    get = opener or (lambda u: urllib.request.urlopen(u, timeout=30).read())
    schema = T.StructType([T.StructField(n, t) for n, t in (("url", T.StringType()), ("body", T.StringType()), ("sha256", T.StringType()), ("fetched_at", T.DoubleType()))])
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    asked = spark.createDataFrame([(u,) for u in dict.fromkeys(urls)], "url string")
    known = spark.read.schema(schema).parquet(folder)

    def run(frames):
        for f in frames:
            rows = []
            for u in f["url"]:
                body = get(u)
                rows.append((u, body.decode("utf-8", "replace"), hashlib.sha256(body).hexdigest(), time.time()))
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=[x.name for x in schema])

    asked.join(known, "url", "left_anti").repartition(4).mapInPandas(run, schema).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder).join(asked, "url", "left_semi")


def packets(spark: SparkSession, path: str) -> DataFrame:
    """file, number, seconds, length, protocol, source and destination of the packets of capture files; a file is read by one task, and a cut-off end is left out."""

    def run(frames):
        for f in frames:
            rows = []
            for name, data in zip(f["path"], f["content"], strict=True):
                order = "<" if data[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
                fine = 1e-9 if data[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1e-6
                at, n = 24, 0
                while at + 16 <= len(data):
                    sec, part, kept, size = struct.unpack(order + "IIII", data[at : at + 16])
                    body, at, n = data[at + 16 : at + 16 + kept], at + 16 + kept, n + 1
                    ip = len(body) >= 34 and body[12:14] == b"\x08\x00"
                    who = {1: "icmp", 6: "tcp", 17: "udp"}.get(body[23], str(body[23])) if ip else None
                    ends = [".".join(map(str, body[i : i + 4])) if ip else None for i in (26, 30)]
                    rows.append((name, n, sec + part * fine, size, who, *ends))
            yield pd.DataFrame(rows, columns=["file", "number", "seconds", "length", "protocol", "source", "destination"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, number long, seconds double, length long, protocol string, source string, destination string")


def chunks(docs: DataFrame, key: str, text: str, most: int = 4000) -> DataFrame:
    """key, n, chunk_id and chunk: texts cut at ends of paragraphs into pieces of `most` characters at most; a longer paragraph is cut within. Ids depend on key and content, so a second run gives the same."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n+")
    parts = F.flatten(F.transform(lines, lambda p: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, p: Column) -> Column:
        fits = F.length(s["open"]) + F.length(p) + 1 <= most
        joined = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n"), p))
        return F.when(fits | (s["open"] == ""), F.struct(s["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), p.alias("open")))

    packed = F.aggregate(F.filter(parts, lambda p: p != ""), start, step, lambda s: F.filter(F.concat(s["done"], F.array(s["open"])), lambda c: c != ""))
    cut = docs.select(F.col(key), F.posexplode(packed).alias("n", "chunk"))
    return cut.select(key, "n", F.substring(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col("n").cast("string"), "chunk"), 256), 1, 16).alias("chunk_id"), "chunk")


def ingested(entries: DataFrame, known: DataFrame, key: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """The store after taking in valid entries (a later one replaces the known one of its key), and the quarantined rest."""
    good, bad = entries.where(valid), entries.where(~F.coalesce(valid, F.lit(False)))
    return known.join(good.select(key), key, "left_anti").unionByName(good), bad


def written_bundle(findings: DataFrame, folder: str, meta: dict) -> str:
    """A bundle of findings as JSON lines with a manifest that holds their digest; when it was written is no part of the digest."""
    ordered = findings.select(F.to_json(F.struct(*[F.col(c) for c in sorted(findings.columns)])).alias("value"))
    digest = ordered.select(F.sha2("value", 256).alias("h")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.substring("h", 1, 16))), ""), 256)).first()[0] if findings.head(1) else hashlib.sha256(b"").hexdigest()
    ordered.write.mode("overwrite").text(f"{folder}/findings")
    stamp = json.dumps({**meta, "integrity": digest, "generated_at": time.time()}, sort_keys=True)
    findings.sparkSession.createDataFrame([(stamp,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return digest


def resolved(spark: SparkSession, name: str, known: dict[str, str]) -> str:
    """A path as it is, a known dataset's path, or the newest CSV of a folder's raw/ (of the folder itself, if it has none)."""
    if name in known:
        return known[name]
    if re.search(r"\.[A-Za-z0-9]{1,8}$", name):
        return name
    for folder in (f"{name}/raw", name):
        try:
            newest = snapshot(spark, folder, "*.csv").orderBy(F.desc("modified"), F.desc("path")).first()
        except Exception as gone:  # a folder that isn't there is the one case that is looked past
            if "PATH_NOT_FOUND" not in str(gone):
                raise
            continue
        if newest:
            return newest["path"]
    raise FileNotFoundError(name)
