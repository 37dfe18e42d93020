"""Queries on feeds: messages, watermarks, chunks, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources import feeds, table


def message_fields(spark: SparkSession, d: str) -> DataFrame:
    """Events sent as JSON messages and read back, with their places in the log."""
    e = table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).cast("binary").alias("value"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"))
    found = feeds.messages(e, "event_id bigint, event_type string, value double")
    return found.groupBy("_kafka_partition", "event_type").agg(F.count("*").alias("n"), F.max("_kafka_offset").alias("last"), F.round(F.sum("value"), 3).alias("total"))


def watermark_pulls(spark: SparkSession, d: str) -> DataFrame:
    """Three pulls of 500 rows each, every one from where the last ended."""
    e, mark, found = table(spark, d, "events"), None, None
    for pull in (1, 2, 3):
        rows, mark = feeds.since(e, "event_id", mark, 500, ("event_id", "ts"))
        one = rows.agg(F.lit(pull).alias("pull"), F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
        found = one if found is None else found.unionByName(one)
    return found


WATERMARK_SQL = "WITH r AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 500 + 1 AS pull FROM events) SELECT p.pull::INT AS pull, count(event_id) AS n, min(event_id) AS first, max(event_id) AS last FROM (VALUES (1), (2), (3)) p(pull) LEFT JOIN r USING (pull) GROUP BY 1"


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return feeds.chunks(table(spark, d, "documents"), "doc_id", "text", 4000).select("doc_id", "n", "chunk_id", F.length("chunk").alias("size"))


def store_after_ingest(spark: SparkSession, d: str) -> DataFrame:
    """A store of parts after new versions of some and new parts came in; what isn't valid is quarantined."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    new = p.where("p_partkey % 3 = 0").select((F.col("p_partkey") + F.expr("IF(p_partkey % 2 = 0, 0, 1000000)")).alias("p_partkey"), F.expr("IF(p_partkey % 5 = 0, NULL, upper(p_name))").alias("p_name"), "p_size")
    store, bad = feeds.ingested(new, p, "p_partkey", F.col("p_name").isNotNull())
    told = store.agg(F.lit("store").alias("kind"), F.count("*").alias("n"), F.count_if(F.col("p_name") == F.upper("p_name")).alias("fresh"), F.sum("p_partkey").alias("keys"))
    return told.unionByName(bad.agg(F.lit("quarantine").alias("kind"), F.count("*").alias("n"), F.lit(0).cast("long").alias("fresh"), F.sum("p_partkey").alias("keys")))


INGEST_SQL = """WITH n AS (SELECT p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1000000 END AS k, CASE WHEN p_partkey % 5 <> 0 THEN upper(p_name) END AS name FROM part WHERE p_partkey % 3 = 0), g AS (SELECT * FROM n WHERE name IS NOT NULL), s AS (SELECT p_partkey AS k, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT k FROM g) UNION ALL SELECT * FROM g)
SELECT 'store' AS kind, count(*) AS n, count(*) FILTER (WHERE name = upper(name)) AS fresh, sum(k)::BIGINT AS keys FROM s UNION ALL SELECT 'quarantine', count(*), 0, sum(k)::BIGINT FROM n WHERE name IS NULL"""


def row_changes(spark: SparkSession, d: str) -> DataFrame:
    """Of rows that differ between two versions: each changed column with its value before and after."""
    old = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"), F.col("p_brand").alias("brand"))
    new = old.select("p_partkey", F.expr("IF(p_partkey % 10 = 5, concat(size, '0'), size)").alias("size"), F.expr("IF(p_partkey % 15 = 5, NULL, brand)").alias("brand"))
    both = old.alias("a").join(new.alias("b"), "p_partkey")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").alias("before"), F.col(f"b.{c}").alias("after")) for c in ("size", "brand")])
    return both.select("p_partkey", F.inline(cells)).where(~F.col("before").eqNullSafe(F.col("after")))


CHANGES_SQL = """SELECT p_partkey, 'size' AS "column", p_size::VARCHAR AS before, p_size::VARCHAR || '0' AS after FROM part WHERE p_partkey % 10 = 5 UNION ALL SELECT p_partkey, 'brand', p_brand, NULL FROM part WHERE p_partkey % 15 = 5"""


def bundle_identities(spark: SparkSession, d: str) -> DataFrame:
    """Identities of findings: the digest of their fields in the order of names, whatever order they are written in."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("title"), F.lit("trade").alias("method"), F.col("n_nationkey").alias("label"))
    keys = sorted(n.columns)
    return n.select("label", F.substring(F.sha2(F.to_json(F.struct(*keys)), 256), 1, 16).alias("identity"))


QUERIES = {
    "message_fields": (message_fields, "SELECT (user_id % 4)::INT AS _kafka_partition, event_type, count(*) AS n, max(event_id) AS last, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"),
    "watermark_pulls": (watermark_pulls, WATERMARK_SQL),
    "text_chunks": (text_chunks, None),
    "store_after_ingest": (store_after_ingest, INGEST_SQL),
    "row_changes": (row_changes, CHANGES_SQL),
    "bundle_identities": (bundle_identities, "SELECT n_nationkey AS label, substr(sha256('{\"label\":' || n_nationkey || ',\"method\":\"trade\",\"title\":\"' || n_name || '\"}'), 1, 16) AS identity FROM nation"),
}
