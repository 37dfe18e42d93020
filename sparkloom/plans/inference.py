"""Queries on estimates, consensus and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import stats
from sparkloom.sources import table


def difference_in_differences(spark: SparkSession, d: str) -> DataFrame:
    """The change of mean order value of one priority after a date, less that of the others: four means from one pass."""
    o = table(spark, d, "orders")
    treated, after = F.col("o_orderpriority").startswith("1"), F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")
    means = o.agg(*[F.avg(F.when(t & a, F.col("o_totalprice"))).alias(n) for n, t, a in (("ta", treated, after), ("tb", treated, ~after), ("ca", ~treated, after), ("cb", ~treated, ~after))])
    return means.select(F.round((F.col("ta") - F.col("tb")) - (F.col("ca") - F.col("cb")), 4).alias("effect"))


DID_SQL = "SELECT round((avg(o_totalprice) FILTER (WHERE t AND a) - avg(o_totalprice) FILTER (WHERE t AND NOT a)) - (avg(o_totalprice) FILTER (WHERE NOT t AND a) - avg(o_totalprice) FILTER (WHERE NOT t AND NOT a)), 4) AS effect FROM (SELECT o_totalprice, o_orderpriority LIKE '1%' AS t, o_orderdate >= TIMESTAMP '1995-01-01' AS a FROM orders)"


def posteriors(spark: SparkSession, d: str) -> DataFrame:
    """Of each segment's mean balance: a normal prior (0, variance 1,000,000) updated by the data's mean and variance."""
    s = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("m"), F.var_samp("c_acctbal").alias("v"))
    weight = 1 / F.lit(1e6) + F.col("n") / F.col("v")
    return s.select("c_mktsegment", F.round(F.col("n") / F.col("v") * F.col("m") / weight, 4).alias("mean"), F.round(F.sqrt(1 / weight), 4).alias("sd"))


POSTERIOR_SQL = "WITH s AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1) SELECT c_mktsegment, round(n / v * m / (1 / 1e6::DOUBLE + n / v), 4) AS mean, round(sqrt(1 / (1 / 1e6::DOUBLE + n / v)), 4) AS sd FROM s"


def outlier_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Events that two of three detectors flag within their kind: robust z, quartile fences, plain z."""
    e = stats.robust_z(table(spark, d, "events"), "value", ["event_type"])
    g = Window.partitionBy("event_type")
    fences = table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"))
    e = e.withColumn("plain", (F.col("value") - F.avg("value").over(g)) / F.stddev_pop("value").over(g)).join(fences, "event_type")
    iqr = F.col("q3") - F.col("q1")
    votes = (F.abs("z") >= 2.5).cast("int") + (F.abs("plain") >= 2).cast("int") + (~F.col("value").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)).cast("int")
    return e.select("event_id", F.coalesce(votes, F.lit(0)).alias("votes")).where("votes >= 2")


CONSENSUS_SQL = """
WITH m AS (SELECT event_type, median(value) AS m, avg(value) AS a, stddev_pop(value) AS s, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
d AS (SELECT event_type, median(abs(value - m)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1),
v AS (SELECT event_id, (abs(0.6745 * (value - m) / mad) >= 2.5)::INT + (abs((value - a) / s) >= 2)::INT + (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::INT AS votes FROM events JOIN m USING (event_type) JOIN d USING (event_type))
SELECT event_id, votes FROM v WHERE votes >= 2
"""


def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name begins with a term, of brands that some large part has."""
    p = table(spark, d, "part")
    term = p.agg(F.substring(F.min("p_name"), 1, 6)).first()[0]
    large = p.where("p_size >= 45").select("p_brand")
    return p.where(F.lower("p_name").startswith(term.lower())).join(large, "p_brand", "left_semi").select("p_partkey").distinct()


def keyword_rank(spark: SparkSession, d: str) -> DataFrame:
    """The ten documents that share most words with benchmark item 1, by the Jaccard index of their word sets."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != ""))
    b = table(spark, d, "benchmark")
    asked = F.array(*map(F.lit, b.where("item_id = 1").select(words(F.col("text")).alias("w")).first()["w"]))
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", words(F.col("text")).alias("w"))
    score = F.size(F.array_intersect("w", asked)) / F.greatest(F.lit(1), F.size(F.array_union("w", asked)))
    return docs.select("doc_id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> ''))"
KEYWORD_SQL = f"WITH q AS (SELECT {_WORDS} AS q FROM benchmark WHERE item_id = 1), d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(len(list_intersect(w, q))::DOUBLE / greatest(1, len(w) + len(q) - len(list_intersect(w, q))), 9) AS score FROM d, q ORDER BY 2 DESC, 1 LIMIT 10"

QUERIES = {
    "difference_in_differences": (difference_in_differences, DID_SQL),
    "normal_posteriors": (posteriors, POSTERIOR_SQL),
    "outlier_consensus": (outlier_consensus, CONSENSUS_SQL),
    "prefix_lookup": (prefix_lookup, "SELECT DISTINCT p_partkey FROM part WHERE starts_with(lower(p_name), lower((SELECT substr(min(p_name), 1, 6) FROM part))) AND p_brand IN (SELECT p_brand FROM part WHERE p_size >= 45)"),
    "keyword_rank": (keyword_rank, KEYWORD_SQL),
}
