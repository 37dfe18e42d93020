"""Queries of the join family: equi, semi, anti, outer, range, as-of, kNN and aligned series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import joining
from sparkloom.sources import table


def left_outer(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    spent = o.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    return c.join(spent, c.c_custkey == spent.o_custkey, "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.round("spent", 2).alias("spent"))


def semi(spark: SparkSession, d: str) -> DataFrame:
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_quantity >= 49")
    return o.join(l, o.o_orderkey == l.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def anti(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def range_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Events inside named periods; periods are cut into days, so that the join has a key."""
    e = table(spark, d, "events").select("event_id", "ts")
    periods = spark.sql("SELECT * FROM VALUES ('launch', TIMESTAMP '2024-01-03 06:00:00', TIMESTAMP '2024-01-05 18:00:00'), ('outage', TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-05 12:00:00'), ('sale', TIMESTAMP '2024-01-20 00:00:00', TIMESTAMP '2024-01-22 00:00:00') t(name, starts, ends)")
    found = joining.within(e, periods, "ts", "starts", "ends")
    return found.groupBy("name").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


RANGE_SQL = """
SELECT name, count(*) AS n, min(event_id) AS first_id FROM events JOIN (VALUES
 ('launch', TIMESTAMP '2024-01-03 06:00:00', TIMESTAMP '2024-01-05 18:00:00'), ('outage', TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-05 12:00:00'),
 ('sale', TIMESTAMP '2024-01-20 00:00:00', TIMESTAMP '2024-01-22 00:00:00')) t(name, starts, ends) ON ts BETWEEN starts AND ends GROUP BY name
"""


def as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's latest earlier view."""
    e = table(spark, d, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    left = e.where(F.col("event_type") == kinds[1]).select("user_id", "ts", "event_id")
    right = e.where(F.col("event_type") == kinds[0]).select("user_id", "ts", F.col("value").alias("before"))
    return joining.as_of(left, right, ["user_id"], "ts", ["before"]).select("event_id", "user_id", "before")


AS_OF_SQL = """
WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS n FROM (SELECT DISTINCT event_type FROM events)),
a AS (SELECT e.* FROM events e JOIN k USING (event_type) WHERE n = 2), b AS (SELECT user_id, ts, value FROM events JOIN k USING (event_type) WHERE n = 1)
SELECT a.event_id, a.user_id, b.value AS before FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts
"""


def shared_keys(spark: SparkSession, d: str) -> DataFrame:
    """Columns that two tables share by name, without their prefixes, with the missing shares that a join must reckon with."""
    profiles = [joining.metadata(table(spark, d, name), prefix) for name, prefix in (("orders", "o_"), ("lineitem", "l_"))]
    return joining.shared_keys(*profiles).select("key", F.round("quality", 6).alias("quality"))


def hash_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rows added, removed and changed between two versions of a table."""
    old = table(spark, d, "part").where("p_partkey % 10 <> 3")
    new = table(spark, d, "part").where("p_partkey % 10 <> 4").withColumn("p_size", F.when(F.col("p_partkey") % 10 == 5, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return joining.diff(old, new, ["p_partkey"]).groupBy("status").agg(F.count("*").alias("n"))


def aligned_series(spark: SparkSession, d: str) -> DataFrame:
    """One column for each kind of event by day, holes filled with the column's mean."""
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.sum("value").alias("v"))
    kinds = [r[0] for r in days.select("event_type").distinct().orderBy("event_type").collect()]
    wide = days.groupBy("day").pivot("event_type", kinds).agg(F.first("v"))
    means = wide.agg(*[F.avg(k).alias(k) for k in kinds]).first()
    filled = wide.select(F.col("day").cast("string").alias("day"), *[F.coalesce(F.col(k), F.lit(means[k])).alias(k) for k in kinds])
    return filled.unpivot("day", kinds, "event_type", "v").select("day", "event_type", F.round("v", 2).alias("v"))


ALIGN_SQL = """
WITH s AS (SELECT ts::DATE AS day, event_type, sum(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT event_type, avg(v) AS m FROM s GROUP BY 1),
g AS (SELECT * FROM (SELECT DISTINCT day FROM s), (SELECT DISTINCT event_type FROM s))
SELECT strftime(g.day, '%Y-%m-%d') AS day, g.event_type, round(coalesce(s.v, m.m), 2) AS v FROM g LEFT JOIN s USING (day, event_type) JOIN m ON m.event_type = g.event_type
"""


def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Upsert: the last event of each user stays."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_id", "event_type")


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Customers of two periods: new, gone and shared."""
    o = table(spark, d, "orders")
    cut = F.lit("1995-01-01").cast("timestamp")
    a, b = o.where(F.col("o_orderdate") < cut).select("o_custkey"), o.where(F.col("o_orderdate") >= cut).select("o_custkey")
    parts = (("new", b.distinct().join(a, "o_custkey", "left_anti")), ("gone", a.distinct().join(b, "o_custkey", "left_anti")), ("shared", a.intersect(b)))
    named = [p.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, p in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


SET_SQL = """
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01')
SELECT 'new' AS kind, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'gone', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'shared', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
"""

QUERIES = {
    "join_left_outer": (left_outer, "SELECT c_custkey, count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "join_semi": (semi, "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) GROUP BY 1"),
    "join_anti": (anti, "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY 1"),
    "join_range_overlap": (range_overlap, RANGE_SQL),
    "join_as_of": (as_of, AS_OF_SQL),
    "join_shared_keys": (shared_keys, "SELECT 'orderkey' AS key, round(0.5 + 0.5 * (1 - greatest((SELECT avg((o_orderkey IS NULL)::INT) FROM orders), (SELECT avg((l_orderkey IS NULL)::INT) FROM lineitem))), 6) AS quality UNION ALL SELECT 'orderdate ↔ shipdate', 0.7"),
    "join_hash_diff": (hash_diff, "SELECT status, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 10 = 3 THEN 'added' WHEN p_partkey % 10 = 4 THEN 'removed' WHEN p_partkey % 10 = 5 THEN 'changed' ELSE 'same' END AS status FROM part) GROUP BY 1"),
    "join_aligned_series": (aligned_series, ALIGN_SQL),
    "upsert_latest_wins": (latest_wins, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "set_operations": (set_operations, SET_SQL),
}
