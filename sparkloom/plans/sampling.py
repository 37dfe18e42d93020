"""Queries on sampling, ranking and sets of best rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import tiers
from sparkloom.sources import table


def stratified_temporal(spark: SparkSession, d: str) -> DataFrame:
    """Five events of each of 20 equal spans of time, by the hash of their id."""
    e = table(spark, d, "events").select("event_id", F.unix_micros("ts").alias("t"))
    lo, hi = e.agg(F.min("t"), F.max("t")).first()
    binned = e.withColumn("stratum", F.least(F.lit(19), F.floor((F.col("t") - lo) * 20 / (hi - lo))).cast("int"))
    n = F.row_number().over(Window.partitionBy("stratum").orderBy(F.md5(F.col("event_id").cast("string").cast("binary"))))
    return binned.withColumn("n", n).where("n <= 5").select("stratum", "event_id")


STRATA_SQL = "WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), e AS (SELECT event_id, least(19, floor((epoch_us(ts) - lo)::DOUBLE * 20 / (hi - lo)))::INT AS stratum FROM events, b) SELECT stratum, event_id FROM e QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(event_id::VARCHAR)) <= 5"


def stratified_panel(spark: SparkSession, d: str) -> DataFrame:
    """Two events of each user and kind."""
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("n", n).where("n <= 2").select("user_id", "event_type", "event_id")


def sample_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Line items in tiers of 2,000 and 8,000 rows and all: how many rows and months each has, by the method that their shape asks for."""
    parts, told = tiers.tiers(table(spark, d, "lineitem"), {1: (2000, 8), 2: (8000, 10), 3: (None, None)}, ["l_orderkey"], small=1000)
    found = None
    for tier, part in parts.items():
        one = part.agg(F.lit(tier).alias("tier"), F.count("*").alias("n"), F.count_distinct(F.date_format("l_shipdate", "yyyy-MM")).alias("months"))
        found = one if found is None else found.unionByName(one)
    return found.join(told.select("tier", "shape", "method", "n_columns"), "tier")


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """The 100 orders of the least hash: the same for any order of the rows."""
    h = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    return table(spark, d, "orders").orderBy(h, "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


def top_findings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no other part beats in both price (low) and size (high): one sorted pass by price within each brand."""
    p = table(spark, d, "part")
    cheaper = p.groupBy("p_brand", "p_retailprice").agg(F.max("p_size").alias("m"))
    best = cheaper.withColumn("before", F.max("m").over(Window.partitionBy("p_brand").orderBy("p_retailprice").rowsBetween(Window.unboundedPreceding, -1)))
    front = best.where("before IS NULL OR m > before").select("p_brand", "p_retailprice", F.col("m").alias("p_size"))
    return p.join(front, ["p_brand", "p_retailprice", "p_size"]).select("p_partkey", "p_brand", "p_retailprice", "p_size")


PARETO_SQL = "SELECT p_partkey, p_brand, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))"


def bandit_ucb1(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of events by mean value plus their exploration bonus."""
    arms = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg(F.col("value") / 500).alias("mean"))
    total = F.sum("n").over(Window.partitionBy())
    return arms.select("event_type", F.round(F.col("mean") + F.sqrt(2 * F.log(total) / F.col("n")), 6).alias("score"))


def rollup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def cosine_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The three vectors most like vector 0 by cosine; that one vector is read first."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q = F.array(*map(F.lit, e.where("vec_id = 0").first()["v"]))
    scored = e.where("vec_id <> 0").select("vec_id", F.round(dot("v", q) / F.sqrt(dot("v", "v") * dot(q, q)), 6).alias("cosine"))
    return scored.orderBy(F.desc("cosine"), "vec_id").limit(3)


COSINE_SQL = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)), 6) AS cosine FROM e, q WHERE vec_id <> 0 ORDER BY 2 DESC, 1 LIMIT 3"


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy((k % 10).alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def identities(spark: SparkSession, d: str) -> DataFrame:
    """A short hash over the canonical text of each row, and how often it comes."""
    c = table(spark, d, "customer")
    text = F.concat_ws("|", F.col("c_mktsegment"), F.col("c_nationkey").cast("string"))
    return c.groupBy(F.substring(F.sha2(text.cast("binary"), 256), 1, 16).alias("identity")).agg(F.count("*").alias("n"))


QUERIES = {
    "sample_tiers": (sample_tiers, None),
    "sample_stratified_temporal": (stratified_temporal, STRATA_SQL),
    "sample_stratified_panel": (stratified_panel, "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 2"),
    "sample_by_hash": (hash_sample, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 100"),
    "top_orders": (top_findings, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "pareto_front": (pareto_front, PARETO_SQL),
    "bandit_ucb1": (bandit_ucb1, "WITH a AS (SELECT event_type, count(*) AS n, avg(value / 500) AS mean FROM events GROUP BY 1) SELECT event_type, round(mean + sqrt(2 * ln(sum(n) OVER ()) / n), 6) AS score FROM a"),
    "rollup_orders": (rollup, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "cosine_top_k": (cosine_top_k, COSINE_SQL),
    "json_fields": (json_fields, "SELECT (json_extract_string(props, '$.k')::INT % 10) AS k, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1"),
    "row_identities": (identities, "SELECT substr(sha256(c_mktsegment || '|' || c_nationkey), 1, 16) AS identity, count(*) AS n FROM customer GROUP BY 1"),
}
