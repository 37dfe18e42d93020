"""Queries on contracts, entries, bands and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import functions as fn
from sparkloom.operators import contracts
from sparkloom.sources import table


def _bundles(spark: SparkSession, d: str) -> DataFrame:
    """One bundle of results for each user: counts of findings by severity, kinds seen, a forecast's peak."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("rows"), F.count_if(F.col("value") > 250).alias("crit"), F.count_if(F.col("value").between(150, 250)).alias("warn"), F.array_sort(F.collect_set("event_type")).alias("methods"), F.round(F.max("value"), 4).alias("peak"), F.min("event_type").alias("first_type"), F.when(F.count_if(F.col("value") > 400) > 0, F.lit(1.0)).alias("confidence"))


_B = """b AS (SELECT user_id, count(*) AS "rows", count(*) FILTER (WHERE value > 250) AS crit, count(*) FILTER (WHERE value BETWEEN 150 AND 250) AS warn, list_sort(list_distinct(list(event_type))) AS methods, round(max(value), 4) AS peak, min(event_type) AS first_type,
 CASE WHEN count(*) FILTER (WHERE value > 400) > 0 THEN 1.0 END AS confidence FROM events GROUP BY 1)"""
_RULES = [
    ("any_crit", "crit", "number", ">", 0, "crit > 0"),
    ("few_rows", "rows", "number", "<=", 60, '"rows" <= 60'),
    ("no_warn", "warn", "number", "==", 0, "warn = 0"),
    ("some_warn", "warn", "number", "!=", 0, "warn <> 0"),
    ("two_or_three", "crit", "number", "in", [2, 3], "crit IN (2, 3)"),
    ("not_two", "crit", "number", "not_in", [2], "crit <> 2"),
    ("has_error", "methods", "list", "contains", "error", "list_contains(methods, 'error')"),
    ("ends_in_k", "first_type", "text", "regex", "k$", "regexp_matches(first_type, 'k$')"),
    ("has_l", "first_type", "text", "contains", "l", "contains(first_type, 'l')"),
    ("text_above", "first_type", "text", ">=", 1.0, "false"),
    ("sure", "confidence", "number", ">=", 0.5, "coalesce(confidence >= 0.5, false)"),
    ("low_peak", "peak", "number", "<", 200.0, "peak < 200"),
]


def contract_operators(spark: SparkSession, d: str) -> DataFrame:
    return contracts.evaluated(_bundles(spark, d), [(n, F.col(f), kind, op, x) for n, f, kind, op, x, _ in _RULES], ["user_id"]).select("user_id", "contract", "satisfied")


OPERATORS_SQL = f"WITH {_B} " + " UNION ALL ".join(f"SELECT user_id, '{n}' AS contract, ({sql}) AS satisfied FROM b" for n, *_, sql in _RULES)


def contract_firings(spark: SparkSession, d: str) -> DataFrame:
    """Events as bundles of one finding: a contract fires at most twice an hour and kind."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts", (F.col("value") > 100).alias("satisfied"))
    found = contracts.fired(e, "ts", 3600, 2, ["event_type"], ["event_id"])
    return found.groupBy("event_type", "outcome").agg(F.count("*").alias("n"))


FIRINGS_SQL = """WITH r AS (SELECT event_type, value > 100 AS ok, count(*) FILTER (WHERE value > 100) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events)
SELECT event_type, CASE WHEN NOT ok THEN 'not_satisfied' WHEN recent > 2 THEN 'rate_limited' ELSE 'fired' END AS outcome, count(*) AS n FROM r GROUP BY 1, 2"""


def rate_windows(spark: SparkSession, d: str) -> DataFrame:
    """The most events of a user within a minute, an hour and a day."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts"))
    e = table(spark, d, "events")
    counts = e.select("user_id", *[F.count("*").over(w.rangeBetween(-s * 1_000_000 + 1, 0)).alias(n) for n, s in (("minute", 60), ("hour", 3600), ("day", 86400))])
    return counts.groupBy("user_id").agg(*[F.max(n).alias(n) for n in ("minute", "hour", "day")])


RATES_SQL = "SELECT user_id, max(m) AS minute, max(h) AS hour, max(x) AS day FROM (SELECT user_id, " + ", ".join(f"count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {s * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS {n}" for n, s in (("m", 60), ("h", 3600), ("x", 86400))) + " FROM events) GROUP BY 1"

_ENTRY = {
    "id": "CASE WHEN p_partkey % 90 <> 0 THEN concat('p', p_partkey) END", "name": "CASE WHEN p_partkey % 37 = 0 THEN ' ' ELSE p_name END", "source": "'catalog'", "license": "CASE WHEN p_partkey % 50 = 1 THEN NULL ELSE 'cc0' END",
    "definition": "CASE WHEN p_partkey % 13 = 0 THEN 'short' ELSE concat(p_name, ' ', p_type) END", "status": "CASE WHEN p_partkey % 7 = 0 THEN 'odd' ELSE 'draft' END", "score": "p_size / 45.0",
}


def entry_validation(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "part").select("p_partkey", *[F.expr(x).alias(n) for n, x in _ENTRY.items()], F.expr("IF(p_partkey % 3 = 0, array(), array(p_brand))").alias("aliases"))
    found = contracts.entry_errors(entries)
    return found.select("p_partkey", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "quarantined")


ENTRY_SQL = f"""WITH e AS (SELECT p_partkey, {", ".join(f"{x} AS {n}" for n, x in _ENTRY.items())} FROM part), k AS (SELECT p_partkey,
 concat_ws(',', CASE WHEN coalesce(trim(id), '') = '' THEN 'missing_id' END, CASE WHEN coalesce(trim(name), '') = '' THEN 'missing_name' END, CASE WHEN license IS NULL THEN 'missing_license' END, CASE WHEN length(definition) < 8 THEN 'short_definition' END, CASE WHEN NOT score BETWEEN 0 AND 1 THEN 'score_out_of_range' END) AS errors,
 concat_ws(',', CASE WHEN status = 'odd' THEN 'unknown_status' END, CASE WHEN p_partkey % 3 = 0 THEN 'no_aliases' END) AS warnings FROM e) SELECT *, errors <> '' AS quarantined FROM k"""


def forecast_bands(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("value"), F.stddev_samp("l_discount").alias("sd"))
    b = b.select("l_suppkey", (F.col("value") - 1.7 * F.col("sd")).alias("low"), "value", (F.col("value") + 1.7 * F.col("sd")).alias("high"))
    return contracts.projected_bands(b, 0.0, 0.1).select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("low", "value", "high")], "clipped")


BANDS_SQL = """WITH b AS (SELECT l_suppkey, avg(l_discount) AS v, stddev_samp(l_discount) AS s FROM lineitem GROUP BY 1), c AS (SELECT l_suppkey, v - 1.7 * s AS lo, v, v + 1.7 * s AS hi FROM b)
SELECT l_suppkey, round(greatest(0, least(0.1, lo)), 6) AS low, round(greatest(0, least(0.1, v)), 6) AS value, round(greatest(0, least(0.1, hi)), 6) AS high, (lo < 0 OR lo > 0.1 OR v < 0 OR v > 0.1 OR hi < 0 OR hi > 0.1) AS clipped FROM c"""

_TEMPLATES = "VALUES ('retail', 'price', 'daily', 0D, 1e6D), ('retail', 'quantity', 'daily', 0D, 100D), ('retail', 'discount', 'daily', 0D, 1D), ('climate', 'temp', 'hourly', -50D, 60D), ('climate', 'tax', 'hourly', 0D, 0.02D), ('logistics', 'ship', 'daily', 0D, 1D), ('logistics', 'key', 'daily', 0D, 10D)"


def template_scores(spark: SparkSession, d: str) -> DataFrame:
    names = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    l = table(spark, d, "lineitem")
    columns = l.agg(F.array(*[F.struct(F.lit(c).alias("name"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")) for c in names]).alias("p")).select(F.inline("p"))
    templates = spark.sql(f"SELECT * FROM {_TEMPLATES} AS t(template, keyword, cadence, lo, hi)")
    return contracts.template_scores(columns, templates, "daily").select("template", F.round("score", 6).alias("score"))


TEMPLATE_SQL = f"""WITH t AS (SELECT * FROM ({_TEMPLATES.replace("D,", "::DOUBLE,").replace("D)", "::DOUBLE)")}) t(template, keyword, cadence, lo, hi)),
c AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, min({c})::DOUBLE AS clo, max({c})::DOUBLE AS chi FROM lineitem" for c in ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))}),
m AS (SELECT template, keyword, cadence, count(name) AS n, max(least(1, greatest(0, least(hi, chi) - greatest(lo, clo)) / greatest(chi - clo, 1e-9))) FILTER (WHERE name IS NOT NULL) AS o FROM t LEFT JOIN c ON contains(name, keyword) GROUP BY 1, 2, 3)
SELECT template, round(avg((n > 0)::INT) * CASE WHEN cadence = 'daily' THEN 1.0 ELSE 0.5 END * (0.5 + 0.5 * coalesce(avg(o), 0)), 6) AS score FROM m GROUP BY template, cadence"""


def banded_findings(spark: SparkSession, d: str) -> DataFrame:
    """Effect of each part's brand on price as Cohen's d against the rest, its band, and what a report does with it."""
    p = table(spark, d, "part")
    whole = p.agg(F.count("*").alias("n0"), F.sum("p_retailprice").alias("s0"), F.sum(F.col("p_retailprice") ** 2).alias("q0"))
    b = p.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_retailprice").alias("s"), F.sum(F.col("p_retailprice") ** 2).alias("q")).join(F.broadcast(whole))
    rest = F.col("n0") - F.col("n")
    va, vb = F.col("q") - F.col("s") ** 2 / F.col("n"), (F.col("q0") - F.col("q")) - (F.col("s0") - F.col("s")) ** 2 / rest
    dd = (F.col("s") / F.col("n") - (F.col("s0") - F.col("s")) / rest) / F.sqrt((va + vb) / (F.col("n0") - 2))
    c = F.least(F.lit(1.0), F.abs(dd) * 5)
    sure = fn.confidence_band(c)
    report = F.when(sure == "low", "suppress").when(sure == "medium", "hedge").otherwise("render")
    return b.select("p_brand", F.round(dd, 6).alias("d"), fn.cohens_d_band(dd).alias("band"), sure.alias("confidence"), report.alias("report"))


BANDED_SQL = """WITH w AS (SELECT count(*) AS n0, sum(p_retailprice) AS s0, sum(p_retailprice ** 2) AS q0 FROM part), b AS (SELECT p_brand, count(*) AS n, sum(p_retailprice) AS s, sum(p_retailprice ** 2) AS q FROM part GROUP BY 1),
d AS (SELECT p_brand, (s / n - (s0 - s) / (n0 - n)) / sqrt(((q - s ** 2 / n) + ((q0 - q) - (s0 - s) ** 2 / (n0 - n))) / (n0 - 2)) AS d FROM b, w), c AS (SELECT *, least(1, abs(d) * 5) AS c FROM d)
SELECT p_brand, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' WHEN abs(d) < 1.2 THEN 'large' ELSE 'very_large' END AS band,
 CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN c >= 0.7 THEN 'render' WHEN c >= 0.4 THEN 'hedge' ELSE 'suppress' END AS report FROM c"""

QUERIES = {
    "contract_operators": (contract_operators, OPERATORS_SQL),
    "contract_firings": (contract_firings, FIRINGS_SQL),
    "rate_windows": (rate_windows, RATES_SQL),
    "entry_validation": (entry_validation, ENTRY_SQL),
    "forecast_bands": (forecast_bands, BANDS_SQL),
    "template_scores": (template_scores, TEMPLATE_SQL),
    "banded_findings": (banded_findings, BANDED_SQL),
}
