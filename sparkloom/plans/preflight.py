"""Queries on missing values, value types, sampling and the structure of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import gates, preflight, structure
from sparkloom.packaging import shipped
from sparkloom.sources import table

_HOLES = {
    "whole": "value",
    "few": "CASE WHEN event_id % 500 <> 7 THEN value END",
    "scattered": "CASE WHEN event_id % 11 <> 3 THEN value END",
    "early": "CASE WHEN event_id > (SELECT max(event_id) FROM events) * 0.15 THEN value END",
    "late": "CASE WHEN event_id < (SELECT max(event_id) FROM events) * 0.85 THEN value END",
    "nightly": "CASE WHEN hour(ts) >= 3 THEN value END",
    "blocks": "CASE WHEN floor(event_id / 25) % 4 <> 1 THEN value END",
    "sparse": "CASE WHEN event_id % 10 = 0 THEN value END",
}


def _holes(spark: SparkSession, d: str) -> DataFrame:
    """Events with values taken away in known patterns, as the tables themselves have no nulls."""
    e = table(spark, d, "events")
    last = e.agg(F.max("event_id")).first()[0]
    return e.select("event_id", "ts", *[F.expr(x.replace("(SELECT max(event_id) FROM events)", str(last))).alias(n) for n, x in _HOLES.items()])


_HOLES_SQL = "h AS (SELECT event_id, ts, " + ", ".join(f"{x} AS {n}" for n, x in _HOLES.items()) + " FROM events)"


def missingness_classes(spark: SparkSession, d: str) -> DataFrame:
    found = preflight.missingness(_holes(spark, d), list(_HOLES), ["event_id"], "ts")
    return found.withColumn("rate", F.round("rate", 9))


_CLASSES = f"""
{_HOLES_SQL}, u AS (SELECT event_id, ts, "column", v FROM (SELECT event_id, ts, {", ".join(f"coalesce({n}::VARCHAR, 'x') AS {n}" for n in _HOLES)} FROM h) UNPIVOT (v FOR "column" IN ({", ".join(_HOLES)}))),
p AS (SELECT *, (v = 'x')::INT AS gone, row_number() OVER (PARTITION BY "column" ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY "column") AS total FROM u),
z AS (SELECT *, greatest(floor(total * 0.2), 1) AS head FROM p),
w AS (SELECT "column", sum(gone) AS n_missing, avg(gone) AS rate, avg(gone) FILTER (WHERE pos < head) AS head, avg(gone) FILTER (WHERE pos >= total - head) AS tail,
             avg(gone) FILTER (WHERE pos >= head AND pos < total - head) AS middle FROM z GROUP BY 1),
hr AS (SELECT "column", max(r) - min(r) AS hs, max(r) AS ht FROM (SELECT "column", hour(ts), avg(gone) AS r FROM p GROUP BY 1, 2) GROUP BY 1),
dr AS (SELECT "column", max(r) - min(r) AS ds, max(r) AS dt FROM (SELECT "column", dayofweek(ts), avg(gone) AS r FROM p GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT "column", sum(n) AS inside FROM (SELECT "column", g, count(*) AS n FROM (SELECT "column", pos - row_number() OVER (PARTITION BY "column" ORDER BY pos) AS g FROM p WHERE gone = 1) GROUP BY 1, 2) WHERE n >= 5 GROUP BY 1),
j AS (SELECT *, (head > 0.5 AND ((middle > 0 AND head / middle >= 3) OR middle < 0.05)) AS lead, (tail > 0.5 AND ((middle > 0 AND tail / middle >= 3) OR middle < 0.05)) AS trail,
             greatest(CASE WHEN hs > 0.2 AND ht > 2 * rate AND ht > 0.2 THEN hs ELSE 0 END, CASE WHEN ds > 0.2 AND dt > 2 * rate AND dt > 0.2 THEN ds ELSE 0 END) AS swing
      FROM w JOIN hr USING ("column") JOIN dr USING ("column") LEFT JOIN b USING ("column")),
k AS (SELECT "column", n_missing::BIGINT AS n_missing, rate, CASE WHEN n_missing = 0 THEN 'none' WHEN rate < 0.01 THEN 'negligible' WHEN rate > 0.8 THEN 'near_total' WHEN lead AND NOT trail THEN 'bulk_leading'
       WHEN trail AND NOT lead THEN 'bulk_trailing' WHEN swing >= 0.5 THEN 'time_correlated' WHEN coalesce(inside, 0) / n_missing >= 0.5 THEN 'structured' ELSE 'random' END AS pattern FROM j),
m AS (SELECT "column", n_missing, round(rate, 9) AS rate, pattern, CASE WHEN pattern = 'none' THEN NULL WHEN pattern = 'near_total' THEN 'crit' WHEN rate >= 0.2 THEN 'warn' ELSE 'info' END AS severity FROM k)
"""

_DIRTY = {
    "amount": "CASE WHEN event_id % 50 = 7 THEN 'ERR' WHEN event_id % 3 = 0 THEN CAST(event_id AS {s}) ELSE '2.5' END",
    "flag": "CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END",
    "mess": "CASE WHEN event_id % 2 = 0 THEN '17' WHEN event_id % 5 = 1 THEN 'n/a' ELSE 'word' END",
    "when_": "CASE WHEN event_id % 8 = 0 THEN 'soon' ELSE '2024-01-05 10:00:00' END",
}


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", *[F.expr(x.format(s="STRING")).alias(n) for n, x in _DIRTY.items()])


def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    found = preflight.type_violations(_dirty(spark, d), list(_DIRTY), "event_id")
    return found.select("column", "dominant", "n_other", F.round("rate", 9).alias("rate"), F.array_join("samples", ",").alias("samples"), "severity")


_TYPE = """CASE WHEN trim(v) = 'n/a' THEN 'empty' WHEN v IN ('yes', 'no') THEN 'boolean' WHEN regexp_full_match(v, '-?[0-9]+([.][0-9]+)?') THEN 'number'
 WHEN try_cast(v AS TIMESTAMP) IS NOT NULL THEN 'datetime' ELSE 'string' END"""
_VIOLATIONS = f"""
t AS (SELECT event_id, {", ".join(f"{x.format(s='VARCHAR')} AS {n}" for n, x in _DIRTY.items())} FROM events),
c AS (SELECT *, {_TYPE} AS type FROM t UNPIVOT (v FOR "column" IN ({", ".join(_DIRTY)}))), f AS (SELECT * FROM c WHERE type <> 'empty'),
n AS (SELECT "column", type, count(*) AS n FROM f GROUP BY 1, 2), q AS (SELECT "column", sum(n) AS filled, max(n) AS top, arg_max(type, n) AS kind FROM n GROUP BY 1),
dm AS (SELECT "column", filled, CASE WHEN top >= 0.7 * filled THEN kind ELSE 'mixed' END AS dominant FROM q),
o AS (SELECT f."column", dominant, filled, v, event_id FROM f JOIN dm USING ("column") WHERE type <> dominant),
s AS (SELECT "column", string_agg(v, ',' ORDER BY event_id) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY event_id) AS r FROM o) WHERE r <= 5 GROUP BY 1),
v AS (SELECT "column", dominant, count(*) AS n_other, count(*) / max(filled) AS rate FROM o GROUP BY 1, 2 HAVING count(*) / max(filled) >= 0.001),
vs AS (SELECT "column", dominant, n_other, round(rate, 9) AS rate, samples, CASE WHEN rate >= 0.2 THEN 'crit' WHEN rate >= 0.05 THEN 'warn' ELSE 'info' END AS severity FROM v JOIN s USING ("column"))
"""


def sampling_steps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    found = preflight.sampling(e, "ts", ["ts", "event_id"], ["event_type"])
    return found.select("event_type", *[F.round(c, 4).alias(c) for c in ("median", "mean", "largest", "cv")], "n_wide", "verdict", "step")


_SAMPLING = """
g AS (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) / 1e6 AS gap FROM events),
gm AS (SELECT event_type, median(gap) AS median, avg(gap) AS mean, max(gap) AS largest, stddev_pop(gap) AS sd FROM g WHERE gap IS NOT NULL GROUP BY 1),
gw AS (SELECT event_type, count(*) FILTER (WHERE gap > 10 * median) AS n_wide FROM g JOIN gm USING (event_type) WHERE gap IS NOT NULL GROUP BY 1),
sa AS (SELECT event_type, round(median, 4) AS median, round(mean, 4) AS mean, round(largest, 4) AS largest, round(sd / mean, 4) AS cv, n_wide,
 CASE WHEN n_wide > 0 THEN 'gaps' WHEN sd / mean < 0.05 THEN 'regular' WHEN sd / mean < 0.5 THEN 'mild' ELSE 'irregular' END AS verdict,
 CASE WHEN median <= 0 THEN NULL WHEN median <= 1 THEN '1s' WHEN median <= 60 THEN '1min' WHEN median <= 300 THEN '5min' WHEN median <= 900 THEN '15min' WHEN median <= 3600 THEN '1h' WHEN median <= 21600 THEN '6h'
  WHEN median <= 86400 THEN '1D' WHEN median <= 604800 THEN '7D' ELSE floor(median / 86400)::BIGINT || 'D' END AS step FROM gm JOIN gw USING (event_type))
"""


def preflight_findings(spark: SparkSession, d: str) -> DataFrame:
    sampled = preflight.sampling(table(spark, d, "events"), "ts", ["ts", "event_id"], ["event_type"]).withColumnRenamed("event_type", "subject")
    return preflight.findings(preflight.missingness(_holes(spark, d), list(_HOLES), ["event_id"], "ts"), preflight.type_violations(_dirty(spark, d), list(_DIRTY), "event_id"), sampled)


PREFLIGHT_SQL = f"""WITH {_CLASSES}, {_VIOLATIONS}, {_SAMPLING}
SELECT 'missingness' AS "check", "column" AS subject, pattern AS label, severity FROM m WHERE pattern <> 'none' UNION ALL SELECT 'schema', "column", dominant, severity FROM vs
UNION ALL SELECT 'sampling', event_type, verdict, 'warn' FROM sa WHERE verdict IN ('gaps', 'irregular')"""


# structure of a table -----------------------------------------------------------------------------

_MIXED = {
    "event_id": "event_id", "ts_text": "CAST(ts AS {s})", "amount_text": "CASE WHEN event_id % 20 = 0 THEN 'ERR' ELSE CAST(event_id * 3 AS {s}) END", "latitude": "value / 10", "longitude": "value / 5", "event_type": "event_type",
    "user_nbr": "user_id", "total_value": "floor(value)", "comment": "concat('a long remark about the event with the number ', CAST(event_id AS {s}), ' and ', event_type)",
}


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select(*[F.expr(x.format(s="STRING")).alias(n) for n, x in _MIXED.items()])


def structure_roles(spark: SparkSession, d: str) -> DataFrame:
    return structure.roles(_mixed(spark, d), order="event_id").select("column", "role", F.round("missing_rate", 6).alias("missing_rate"), F.round("unique_ratio", 6).alias("unique_ratio"), F.round("datetime_rate", 6).alias("datetime_rate"), F.round("numeric_rate", 6).alias("numeric_rate"), "monotonic")


def _role_sql() -> str:
    cast = {n: x.format(s="VARCHAR").replace("CAST(ts AS VARCHAR)", "strftime(ts, '%Y-%m-%d %H:%M:%S')") for n, x in _MIXED.items()}
    numeric = {"event_id", "latitude", "longitude", "user_nbr", "total_value"}
    rows = " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", {str(n in numeric).lower()} AS is_number, count(*) AS n, count({x}) AS filled, count(DISTINCT {x}) AS u, avg((try_cast({x} AS TIMESTAMP) IS NOT NULL)::INT) AS dr0, avg((try_cast({x} AS DOUBLE) IS NOT NULL)::INT) AS nr, avg(length({x}::VARCHAR)) AS len,
        (SELECT coalesce(bool_and(x >= b), true) FROM (SELECT try_cast({x} AS DOUBLE) AS x, lag(try_cast({x} AS DOUBLE)) OVER (ORDER BY event_id) AS b FROM events) WHERE b IS NOT NULL AND x IS NOT NULL) AS mono FROM events"""
        for n, x in ((n, f"({x})") for n, x in cast.items() if n not in numeric)
    ) + " UNION ALL " + " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", true AS is_number, count(*) AS n, count({x}) AS filled, count(DISTINCT {x}) AS u, 0.0 AS dr0, 1.0 AS nr, 0.0 AS len, (SELECT bool_and(x >= b) FROM (SELECT {x} AS x, lag({x}) OVER (ORDER BY event_id) AS b FROM events) WHERE b IS NOT NULL) AS mono FROM events"""
        for n, x in ((n, f"({x})") for n, x in cast.items() if n in numeric)
    )
    return f"""r AS ({rows}), a AS (SELECT *, 1 - filled / n AS miss, u / n AS ratio, CASE WHEN regexp_matches("column", 'time|date|ts|dt') THEN dr0 ELSE 0 END AS dr FROM r),
k AS (SELECT *, CASE WHEN regexp_matches("column", '^lat$|latitude') THEN 'geo_lat' WHEN regexp_matches("column", '^(lon|lng)$|longitude') THEN 'geo_lon' WHEN dr >= 0.8 THEN 'datetime' WHEN is_number OR nr >= 0.9 THEN 'numeric' END AS role0 FROM a),
st AS (SELECT "column", CASE WHEN coalesce(role0, '') <> 'datetime' AND (regexp_matches("column", '^id$|_id$|uuid|guid|(nbr|number)$') OR ratio > 0.98 OR (role0 = 'numeric' AND mono AND ratio > 0.98)) THEN 'id_like'
 WHEN role0 IS NOT NULL THEN role0 WHEN u <= 200 AND ratio < 0.2 THEN 'categorical' WHEN len >= 40 AND ratio > 0.5 THEN 'free_text' ELSE 'categorical' END AS role, miss, ratio, dr, nr, mono, u FROM k)"""


STRUCTURE_SQL = f'WITH {_role_sql()} SELECT "column", role, round(miss, 6) AS missing_rate, round(ratio, 6) AS unique_ratio, round(dr, 6) AS datetime_rate, round(nr, 6) AS numeric_rate, mono AS monotonic FROM st'


def structure_targets(spark: SparkSession, d: str) -> DataFrame:
    return structure.targets(structure.roles(_mixed(spark, d), order="event_id")).select("column", F.round("score", 6).alias("score"))


TARGET_SQL = f"""WITH {_role_sql()} SELECT "column", round(0.5 * (1 - miss) + greatest(0, 0.5 - abs(ratio - 0.2)) + CASE WHEN regexp_matches("column", 'count|num|number|total|injur|fatal|killed|amount|value') THEN 0.5 ELSE 0 END
 + CASE WHEN regexp_matches("column", 'per_day|rate|rolling|avg|mean') THEN 0.2 ELSE 0 END, 6) AS score FROM st WHERE role = 'numeric' ORDER BY score DESC LIMIT 15"""


def structure_contract(spark: SparkSession, d: str) -> DataFrame:
    """One row on the whole table: its columns by role, time and place, which analyses it is fit for, and the views to look at."""
    df = _mixed(spark, d)
    return structure.contract(structure.roles(df, order="event_id"), df.count())


CONTRACT_SQL = f"""WITH {_role_sql()}, c AS (SELECT (SELECT count(*) FROM events) AS n_rows, count(*) AS n_columns, count(*) FILTER (WHERE role = 'numeric') AS n_numeric, min("column") FILTER (WHERE role = 'datetime') AS time_column,
 min("column") FILTER (WHERE role = 'geo_lat') AS lat, min("column") FILTER (WHERE role = 'geo_lon') AS lon, min("column") FILTER (WHERE role = 'categorical') AS grp FROM st)
SELECT n_rows, n_columns, n_numeric, time_column, (lat IS NOT NULL AND lon IS NOT NULL) AS has_geo, (n_rows >= 5 AND n_columns >= 2) AS eligible_basic, (n_rows >= 20 AND n_numeric >= 1) AS eligible_deep,
 concat_ws(',', 'raw_table', CASE WHEN n_numeric > 0 THEN 'numeric_matrix' END, CASE WHEN time_column IS NOT NULL THEN 'time_series_counts' END, CASE WHEN time_column IS NOT NULL AND n_numeric > 0 THEN 'time_series_numeric_sums' END,
 CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 'geo_view' END, CASE WHEN time_column IS NOT NULL AND grp IS NOT NULL THEN 'grouped_time_series_topk' END) AS views FROM c"""


def grouped_daily_top(spark: SparkSession, d: str) -> DataFrame:
    """The recommended view of counts by day and group, for the ten groups with most rows."""
    return structure.grouped_top(table(spark, d, "events"), "ts", "user_id", 10)


TOPK_SQL = "WITH t AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 10) SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM t) GROUP BY 1, 2"


def dataset_shape(spark: SparkSession, d: str) -> DataFrame:
    """The shape of four tables: size first, then width, holes, networks, panels and series."""
    o = table(spark, d, "orders")
    wide = o.select(*[F.expr(f"IF(o_orderkey % 10 = 0, o_totalprice * {i}, NULL)").alias(f"c{i}") for i in range(6)], "o_orderkey")
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("origin"), F.col("l_suppkey").alias("destination"), "l_quantity")
    panel = table(spark, d, "events").select(F.col("user_id").alias("station_id"), "ts", "value")
    found = [structure.shape(df, small=10).select(F.lit(n).alias("name"), "shape", "time_column", "panel_column") for n, df in (("orders", o), ("sparse", wide), ("edges", edges), ("panel", panel), ("small", o.limit(5)))]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).unionByName(found[4])


def columns_by_variance(spark: SparkSession, d: str) -> DataFrame:
    return structure.by_variance(table(spark, d, "lineitem"), 3, ["l_orderkey"])


VARIANCE_SQL = """WITH p AS (SELECT 'l_partkey' AS c, 2 AS i, stddev_pop(l_partkey) AS s FROM lineitem UNION ALL SELECT 'l_suppkey', 3, stddev_pop(l_suppkey) FROM lineitem UNION ALL SELECT 'l_linenumber', 4, stddev_pop(l_linenumber) FROM lineitem
 UNION ALL SELECT 'l_quantity', 5, stddev_pop(l_quantity) FROM lineitem UNION ALL SELECT 'l_extendedprice', 6, stddev_pop(l_extendedprice) FROM lineitem UNION ALL SELECT 'l_discount', 7, stddev_pop(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', 8, stddev_pop(l_tax) FROM lineitem),
r AS (SELECT c, i FROM p ORDER BY s DESC, i LIMIT 2) SELECT 'l_orderkey' AS "column", 1 AS place UNION ALL SELECT c, row_number() OVER (ORDER BY i)::INT + 1 FROM r"""


def inferred_constraints(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_quantity", "l_discount", (F.col("l_discount") * 100).alias("discount_percent"), (F.col("l_tax") - 0.04).alias("shift"))
    return structure.constraints(l)


CONSTRAINT_SQL = """SELECT * FROM (VALUES ('l_quantity', 'nonnegative', 0.0::DOUBLE, NULL::DOUBLE), ('l_discount', 'fraction', 0.0, 1.0), ('discount_percent', 'percent', 0.0, 100.0)) t("column", kind, low, high)
WHERE (SELECT min(l_quantity) >= 0 AND min(l_discount) >= 0 AND max(l_discount) <= 1 FROM lineitem)"""


def daily_model_frame(spark: SparkSession, d: str) -> DataFrame:
    """Daily buckets with empty days: amounts that count are summed, others averaged."""
    e = table(spark, d, "events").where("user_id % 7 = 3").select("ts", F.col("value").alias("total_value"), (F.col("value") / 2).alias("level"))
    found = structure.daily(e, "ts", ["total_value", "level"])
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("total_value", 4).alias("total_value"), F.round("level", 4).alias("level"), "event_count")


DAILY_SQL = """WITH e AS (SELECT ts::DATE AS day, value FROM events WHERE user_id % 7 = 3), g AS (SELECT unnest(generate_series((SELECT min(day) FROM e), (SELECT max(day) FROM e), INTERVAL 1 DAY))::DATE AS day),
a AS (SELECT day, sum(value) AS t, avg(value / 2) AS l, count(*) AS n FROM e GROUP BY 1)
SELECT strftime(g.day, '%Y-%m-%d') AS day, round(coalesce(t, 0), 4) AS total_value, round(l, 4) AS level, coalesce(n, 0) AS event_count FROM g LEFT JOIN a USING (day)"""


def target_choice(spark: SparkSession, d: str) -> DataFrame:
    return structure.target_choice(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.col("l_extendedprice").alias("total_price"), "l_tax")).select("column", F.round("score", 6).alias("score"))


_CHOICE = " UNION ALL ".join(f"""SELECT '{n}' AS "column", round({s} + (quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1)) / stddev_pop({c}) + 0.5, 6) AS score FROM lineitem""" for n, c, s in (("l_quantity", "l_quantity", 0), ("total_price", "l_extendedprice", 2), ("l_tax", "l_tax", 0), ("l_orderkey", "l_orderkey", -6)))


def canonical_time(spark: SparkSession, d: str) -> DataFrame:
    """Text times read into one order, with the median step and whether the rows came in order."""
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))
    return structure.canonical_time(e, "stamp", "event_id").select("n", "n_bad", F.round("cadence", 3).alias("cadence"), "monotonic")


TIME_SQL = """WITH e AS (SELECT event_id, date_trunc('second', ts) AS t FROM events), l AS (SELECT t, epoch(t) - epoch(lag(t) OVER (ORDER BY t, event_id)) AS gap, t >= lag(t) OVER (ORDER BY event_id) AS ok FROM e)
SELECT count(*) AS n, 0::BIGINT AS n_bad, round(median(gap), 3) AS cadence, bool_and(coalesce(ok, true)) AS monotonic FROM l"""


def sanitized_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Infinite numbers made null, columns that look like ids or false times left out."""
    l = table(spark, d, "lineitem").select("l_orderkey", F.expr("l_extendedprice / NULLIF(l_linenumber - 1, 0)").alias("ratio"), F.expr("IF(l_linenumber = 2, DOUBLE('Infinity'), l_tax)").alias("rate"))
    kept = structure.sanitized(l, ["l_orderkey"])
    return kept.agg(F.count("*").alias("n"), F.count("ratio").alias("n_ratio"), F.count("rate").alias("n_rate"), F.round(F.sum("rate"), 4).alias("rate"))


def compositional_check(spark: SparkSession, d: str) -> DataFrame:
    """Shares of quantity by flag and supplier: whether they form a composition, and their centred log ratios' means."""
    w = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")).alias(f) for f in "ANR"])
    return structure.compositional(w, list("ANR")).select("n", "is_compositional", *[F.round(c, 6).alias(c) for c in ("clr_A", "clr_N", "clr_R", "ilr_1", "ilr_2")])


COMPOSITION_SQL = """WITH w AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS r FROM lineitem GROUP BY 1),
s AS (SELECT count(*) AS c, min(least(a, n, r)) >= 0 AND stddev_pop(a + n + r) / avg(a + n + r) < 0.05 AND abs(avg(a + n + r) - 1) <= 0.1 AS ok FROM w),
l AS (SELECT ln(greatest(a, 1e-12)) AS a, ln(greatest(n, 1e-12)) AS n, ln(greatest(r, 1e-12)) AS r FROM w), m AS (SELECT *, (a + n + r) / 3 AS g FROM l)
SELECT (SELECT c FROM s) AS n, (SELECT ok FROM s) AS is_compositional, round(avg(a - g), 6) AS "clr_A", round(avg(n - g), 6) AS "clr_N", round(avg(r - g), 6) AS "clr_R", round(avg((a - n) / sqrt(2)), 6) AS ilr_1, round(avg((a + n - 2 * r) / sqrt(6)), 6) AS ilr_2 FROM m"""

def advanced_gates(spark: SparkSession, d: str) -> DataFrame:
    """Which of the seventeen advanced steps a table of events is fit for, and why not."""
    return gates.gated(table(spark, d, "events").drop("props"))



GATES_SQL = """
WITH u AS (SELECT DISTINCT epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL),
d AS (SELECT t - lag(t) OVER (ORDER BY t) AS d FROM u),
f AS (SELECT (SELECT count(*) FROM events) AS n, (SELECT stddev_pop(d) / avg(d) FROM d) AS cv),
s AS (
  SELECT place, step, numbers, least_rows, need, holds FROM (VALUES
    (1, 'composition', 2, 1, 'rows form no composition', false),
    (2, 'mutual_information', 2, 20, '', true),
    (3, 'granger', 2, 30, 'no time axis', true),
    (4, 'hidden_regimes', 1, 50, '', true),
    (5, 'wavelets', 1, 32, '', true),
    (6, 'uneven_periods', 1, 16, 'times are even', NULL),
    (7, 'interpolation', 1, 8, '', true),
    (8, 'sparse_dynamics', 2, 50, 'no time axis', true),
    (9, 'components', 2, 4, '', true),
    (10, 'power', 2, 4, 'no groups to compare', false),
    (11, 'clusters', 2, 30, '', true),
    (12, 'posteriors', 1, 5, '', true),
    (13, 'panel', 1, 4, 'no time axis and entities', true),
    (14, 'survival', 1, 10, 'no duration and event', false),
    (15, 'spatial', 3, 5, 'no latitude and longitude', false),
    (16, 'network', 0, 1, 'no source and target', false),
    (17, 'treatment', 2, 4, 'no panel with a binary treatment', false)) v(place, step, numbers, least_rows, need, holds)),
r AS (
  SELECT place, step,
    CASE WHEN numbers > 1 THEN 'fewer than ' || numbers || ' numbers'
      WHEN n < least_rows THEN 'fewer than ' || least_rows || ' rows'
      WHEN NOT coalesce(holds, cv >= 0.05) THEN need END AS reason
  FROM s, f)
SELECT place, step, reason IS NULL AS applied, reason FROM r
"""


def advanced_steps(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each advanced step that applies tells of the events."""
    found = gates.run(table(shipped(spark), d, "events").drop("props"))
    out = None
    for name, result in found.items():
        one = result.agg(F.lit(name).alias("step"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "advanced_gates": (advanced_gates, GATES_SQL),
    "advanced_steps": (advanced_steps, None),
    "missingness_classes": (missingness_classes, f"WITH {_CLASSES} SELECT * FROM m"),
    "schema_violations": (schema_violations, f"WITH {_VIOLATIONS} SELECT * FROM vs"),
    "sampling_steps": (sampling_steps, f"WITH {_SAMPLING} SELECT * FROM sa"),
    "preflight_findings": (preflight_findings, PREFLIGHT_SQL),
    "structure_roles": (structure_roles, STRUCTURE_SQL),
    "structure_targets": (structure_targets, TARGET_SQL),
    "structure_contract": (structure_contract, CONTRACT_SQL),
    "grouped_daily_top": (grouped_daily_top, TOPK_SQL),
    "dataset_shape": (dataset_shape, None),
    "columns_by_variance": (columns_by_variance, VARIANCE_SQL),
    "inferred_constraints": (inferred_constraints, CONSTRAINT_SQL),
    "daily_model_frame": (daily_model_frame, DAILY_SQL),
    "target_choice": (target_choice, f"SELECT * FROM ({_CHOICE}) ORDER BY score DESC LIMIT 1"),
    "canonical_time": (canonical_time, TIME_SQL),
    "sanitized_numbers": (sanitized_numbers, "SELECT count(*) AS n, count(l_extendedprice / nullif(l_linenumber - 1, 0)) AS n_ratio, count(*) FILTER (WHERE l_linenumber <> 2) AS n_rate, round(sum(l_tax) FILTER (WHERE l_linenumber <> 2), 4) AS rate FROM lineitem"),
    "compositional_check": (compositional_check, COMPOSITION_SQL),
}
