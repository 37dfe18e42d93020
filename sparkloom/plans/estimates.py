"""Queries on estimates: effects, survival, corrections, regression, causal contrasts, bootstraps, spatial dependence."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom import functions as fn
from sparkloom.operators import estimates
from sparkloom.sources import table

Z = fn.normal_quantile(0.975)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the days until their last shipment, and whether that fell within the first sixty days."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    o = table(spark, d, "orders").join(l, "o_orderkey")
    return o.withColumn("days", F.abs(F.datediff("shipped", "o_orderdate")).cast("double") % 121).withColumn("event", (F.col("o_orderkey") % 3 != 0).cast("int"))


_O = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate, quantity, discount, (abs(date_diff('day', o_orderdate::DATE, shipped::DATE)) % 121)::DOUBLE AS days, (o_orderkey % 3 <> 0)::INT AS event
 FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped, sum(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def effect_measures(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    found = estimates.effects(o, "o_totalprice", F.col("o_orderstatus") == "F", "o_orderpriority", F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000)
    return found.select("measure", *[F.round(c, 6).alias(c) for c in ("value", "low", "high")])


EFFECTS_SQL = f"""WITH g AS (SELECT avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (WHERE o_orderstatus <> 'F') AS b, stddev_samp(o_totalprice) FILTER (WHERE o_orderstatus <> 'F') AS s FROM orders),
p AS (SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY o_orderpriority), t AS (SELECT count(*) AS n, sum(o_totalprice) AS s, sum(o_totalprice ** 2) AS q FROM orders),
w AS (SELECT t.n, k, b - t.s ** 2 / t.n AS between_, q - t.s ** 2 / t.n AS total FROM t, (SELECT count(*) AS k, sum(s ** 2 / n) AS b FROM p)),
c AS (SELECT count(*) FILTER (WHERE f AND x) + 0.5::DOUBLE AS a, count(*) FILTER (WHERE f AND NOT x) + 0.5::DOUBLE AS b, count(*) FILTER (WHERE NOT f AND x) + 0.5::DOUBLE AS c, count(*) FILTER (WHERE NOT f AND NOT x) + 0.5::DOUBLE AS d FROM (SELECT o_orderstatus = 'F' AS f, o_totalprice > 150000 AS x FROM orders))
SELECT 'glass' AS measure, round((a - b) / s, 6) AS value, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM g
UNION ALL SELECT 'omega_squared', round((between_ - (k - 1) * (total - between_) / (n - k)) / (total + (total - between_) / (n - k)), 6), NULL, NULL FROM w
UNION ALL SELECT 'odds_ratio', round(a * d / (b * c), 6), round(exp(ln(a * d / (b * c)) - {Z} * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6), round(exp(ln(a * d / (b * c)) + {Z} * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) FROM c"""


def survival_curve(spark: SparkSession, d: str) -> DataFrame:
    found = estimates.kaplan_meier(_orders(spark, d), "days", F.col("event") == 1)
    return found.select("time", "at_risk", "deaths", *[F.round(c, 6).alias(c) for c in ("survival", "low", "high")])


_KM = f"""{_O}, t AS (SELECT days AS time, count(*) AS n, sum(event) AS deaths FROM o GROUP BY 1), r AS (SELECT time, deaths, sum(n) OVER (ORDER BY time DESC) AS at_risk FROM t), s AS (SELECT * FROM r WHERE deaths > 0),
l AS (SELECT *, sum(CASE WHEN deaths < at_risk THEN ln(1 - deaths / at_risk) ELSE 0 END) OVER w AS lg, sum((deaths = at_risk)::INT) OVER w AS z, sum(CASE WHEN deaths < at_risk THEN deaths / (at_risk * (at_risk - deaths)) ELSE 0 END) OVER w AS v FROM s WINDOW w AS (ORDER BY time)),
km AS (SELECT time, at_risk::BIGINT AS at_risk, deaths::BIGINT AS deaths, CASE WHEN z > 0 THEN 0 ELSE exp(lg) END AS survival, CASE WHEN z = 0 THEN exp(lg) ** exp({Z} * sqrt(v) / abs(lg)) ELSE 0 END AS low, CASE WHEN z = 0 THEN exp(lg) ** exp(-{Z} * sqrt(v) / abs(lg)) ELSE 0 END AS high FROM l)"""


def survival_median(spark: SparkSession, d: str) -> DataFrame:
    """Median survival: the first time at which the curve is at a half or below."""
    return estimates.kaplan_meier(_orders(spark, d), "days", F.col("event") == 1).where("survival <= 0.5").agg(F.min("time").alias("median"))


def survival_arms(spark: SparkSession, d: str) -> DataFrame:
    found = estimates.log_rank(_orders(spark, d), "days", F.col("event") == 1, F.col("o_orderpriority").startswith("1"))
    return found.select(F.round("chi2", 5).alias("chi2"), F.round("p", 5).alias("p"))


ARMS_SQL = f"""WITH {_O}, t AS (SELECT days AS time, count(*) AS n, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS na, sum(event) AS d, coalesce(sum(event) FILTER (WHERE o_orderpriority LIKE '1%'), 0) AS da FROM o GROUP BY 1),
r AS (SELECT d, da, sum(n) OVER w AS r, sum(na) OVER w AS ra FROM t WINDOW w AS (ORDER BY time DESC)), e AS (SELECT da - d * ra / r AS o, CASE WHEN r > 1 THEN d * ra / r * (1 - ra / r) * (r - d) / (r - 1) ELSE 0 END AS v FROM r WHERE d > 0),
c AS (SELECT sum(o) ** 2 / sum(v) AS chi2 FROM e) SELECT round(chi2, 5) AS chi2, round({fn.erfc_sql("sqrt(chi2 / 2)")}, 5) AS p FROM c"""


def cox_hazards(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).withColumns({"urgent": F.col("o_orderpriority").startswith("1").cast("int"), "open_": (F.col("o_orderstatus") == "O").cast("int")})
    return estimates.cox(o, "days", F.col("event") == 1, ["urgent", "open_"]).select("covariate", *[F.round(c, 5).alias(c) for c in ("coefficient", "se", "hazard_ratio", "low", "high", "p")])


def hazards_proportional(spark: SparkSession, d: str) -> DataFrame:
    """The hazard of urgent orders and whether it stays the same over time."""
    o = _orders(spark, d).withColumn("urgent", F.col("o_orderpriority").startswith("1").cast("int"))
    beta = estimates.cox(o, "days", F.col("event") == 1, ["urgent"]).first()["coefficient"]
    found = estimates.proportional(o, "days", F.col("event") == 1, ["urgent"], [beta])
    return found.select("covariate", "n", F.round(F.lit(beta), 5).alias("coefficient"), F.round("chi2", 4).alias("chi2"), F.round("p", 4).alias("p"), "violated")


def _newton_sql(rounds: int = 8) -> str:
    """Newton's rounds for one covariate, each a table of one number, and the residuals at the last."""
    parts = ["b0 AS (SELECT 0.0::DOUBLE AS b)"]
    for k in range(rounds):
        parts.append(f"""b{k + 1} AS (
  SELECT any_value(b) + sum(dx - d * m) / sum(d * (m - m * m)) AS b
  FROM (SELECT b, d, dx, sum(n1 * exp(b)) OVER v / sum(n0 + n1 * exp(b)) OVER v AS m FROM t, b{k} WINDOW v AS (ORDER BY days DESC)) WHERE d > 0)""")
    return ",\n".join(parts)


_ROUNDS = 8
PROPORTIONAL_SQL = f"""
WITH {_O},
t AS (
  SELECT days, count(*) FILTER (NOT starts_with(o_orderpriority, '1')) AS n0, count(*) FILTER (starts_with(o_orderpriority, '1')) AS n1,
    sum(event) AS d, sum(event * starts_with(o_orderpriority, '1')::INT) AS dx FROM o GROUP BY 1),
{_newton_sql(_ROUNDS)},
r AS (
  SELECT b, d, dx, sum(n1 * exp(b)) OVER v / sum(n0 + n1 * exp(b)) OVER v AS m, sum(d) OVER (ORDER BY days) - (d + 1) / 2 AS k
  FROM t, b{_ROUNDS} WINDOW v AS (ORDER BY days DESC)),
s AS (
  SELECT any_value(b) AS b, sum(d) AS n, sum(dx - d * m) AS r, sum(dx - 2 * m * dx + d * m * m) AS rr, sum(k * (dx - d * m)) AS kr, sum(d * k) AS k, sum(d * k * k) AS kk
  FROM r WHERE d > 0),
c AS (SELECT b, n, (kr - k * r / n) ** 2 / ((kk - k * k / n) * ((rr - r * r / n) / (n - 1))) AS chi2 FROM s),
p AS (SELECT *, {fn.erfc_sql("sqrt(chi2 / 2)")} AS p FROM c)
SELECT 'urgent' AS covariate, n::BIGINT AS n, round(b, 5) AS coefficient, round(chi2, 4) AS chi2, round(p, 4) AS p, p < 0.05 AS violated FROM p"""


def _daily_z(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    g = Window.partitionBy("event_type")
    return days.withColumn("z", F.round((F.col("n") - F.avg("n").over(g)) / F.stddev_pop("n").over(g), 9)).withColumn("p", fn.normal_tail(F.col("z")))


_DZ = f"""dz AS (SELECT event_type, day, n, z, {fn.erfc_sql("(abs(z) / sqrt(2))")} AS p FROM (SELECT event_type, strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS n, round((count(*) - avg(count(*)) OVER (PARTITION BY event_type)) / stddev_pop(count(*)) OVER (PARTITION BY event_type), 9) AS z FROM events GROUP BY 1, 2)),
cr AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r FROM dz), cq AS (SELECT *, least(1, min(p * m / r) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q, least(1, p * m) AS bonferroni FROM cr)"""


def corrected_p_values(spark: SparkSession, d: str) -> DataFrame:
    """p-values of daily departures, corrected by Benjamini-Hochberg and Bonferroni."""
    return estimates.corrected(_daily_z(spark, d), "p").select("event_type", "day", *[F.round(c, 6).alias(c) for c in ("p", "q", "bonferroni")])


def credibility(spark: SparkSession, d: str) -> DataFrame:
    """Of each kind of event: its largest departure with corrected p-values, how many days a sweep of limits flags, and whether that holds over the sweep."""
    limits = (1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5)
    c = estimates.corrected(_daily_z(spark, d), "p")
    g = c.groupBy("event_type").agg(F.round(F.max(F.abs("z")), 6).alias("z"), F.round(F.min("q"), 6).alias("q"), F.round(F.min("bonferroni"), 6).alias("bonferroni"), *[F.count_if(F.abs("z") > t).alias(f"n{i}") for i, t in enumerate(limits)])
    present = sum((F.col(f"n{i}") > 0).cast("int") for i in range(len(limits)))
    return g.select("event_type", "z", "q", "bonferroni", F.col("n4").alias("n_flagged"), (present / len(limits)).alias("present"), (present / len(limits) >= 0.7).alias("robust"))


CREDIBILITY_SQL = f"""WITH {_DZ}, g AS (SELECT event_type, round(max(abs(z)), 6) AS z, round(min(q), 6) AS q, round(min(bonferroni), 6) AS bonferroni, count(*) FILTER (WHERE abs(z) > 2) AS n_flagged, max(abs(z)) AS top FROM cq GROUP BY 1),
s AS (SELECT event_type, (SELECT count(*) FROM (VALUES (1.0), (1.25), (1.5), (1.75), (2.0), (2.25), (2.5)) t(l) WHERE top > l) / 7 AS present FROM g) SELECT event_type, z, q, bonferroni, n_flagged, present, present >= 0.7 AS robust FROM g JOIN s USING (event_type)"""


def regression_terms(spark: SparkSession, d: str) -> DataFrame:
    """Backdoor estimate of quantity's effect on price, with discount held: estimates, standard errors, R squared."""
    return estimates.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).select("term", F.round("estimate", 3).alias("estimate"), F.round("se", 3).alias("se"), "n", F.round("r2", 6).alias("r2"))


OLS_SQL = """WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, var_pop(l_quantity) * count(*) AS s11, var_pop(l_discount) * count(*) AS s22, covar_pop(l_quantity, l_discount) * count(*) AS s12, covar_pop(l_quantity, l_extendedprice) * count(*) AS s1, covar_pop(l_discount, l_extendedprice) * count(*) AS s2, var_pop(l_extendedprice) * count(*) AS sy FROM lineitem),
b AS (SELECT *, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 ** 2) AS b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 ** 2) AS b2 FROM s), r AS (SELECT *, sy - b1 * s1 - b2 * s2 AS rss FROM b)
SELECT 'intercept' AS term, round(my - b1 * m1 - b2 * m2, 3) AS estimate, NULL::DOUBLE AS se, n, round(1 - rss / sy, 6) AS r2 FROM r UNION ALL SELECT 'l_quantity', round(b1, 3), round(sqrt(rss / (n - 3) * s22 / (s11 * s22 - s12 ** 2)), 3), n, round(1 - rss / sy, 6) FROM r
UNION ALL SELECT 'l_discount', round(b2, 3), round(sqrt(rss / (n - 3) * s11 / (s11 * s22 - s12 ** 2)), 3), n, round(1 - rss / sy, 6) FROM r"""


def granger_f(spark: SparkSession, d: str) -> DataFrame:
    """Whether yesterday's count of events tells more of the day's value than yesterday's value does: both residual sums, F and its p-value."""
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"), F.count("*").cast("double").alias("n"))
    w = Window.partitionBy("event_type").orderBy("day")
    lags = days.withColumns({"v1": F.lag("v").over(w), "n1": F.lag("n").over(w)})
    return estimates.f_test(lags, "v", ["v1"], ["n1"]).select("n", F.round("rss_own", 1).alias("rss_own"), F.round("rss_both", 1).alias("rss_both"), F.round("f", 5).alias("f"), F.round("p", 5).alias("p"))


GRANGER_SQL = f"""WITH days AS (SELECT event_type, ts::DATE AS day, round(sum(value), 4) AS v, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), l AS (SELECT v, lag(v) OVER w AS v1, lag(n) OVER w AS n1 FROM days WINDOW w AS (PARTITION BY event_type ORDER BY day)), k AS (SELECT * FROM l WHERE v1 IS NOT NULL),
s AS (SELECT count(*) AS n, var_pop(v) * count(*) AS sy, var_pop(v1) * count(*) AS s11, var_pop(n1) * count(*) AS s22, covar_pop(v1, n1) * count(*) AS s12, covar_pop(v1, v) * count(*) AS s1, covar_pop(n1, v) * count(*) AS s2 FROM k),
r AS (SELECT n, sy - s1 ** 2 / s11 AS own, sy - ((s22 * s1 - s12 * s2) * s1 + (s11 * s2 - s12 * s1) * s2) / (s11 * s22 - s12 ** 2) AS both_ FROM s), f AS (SELECT *, (own - both_) / (both_ / (n - 3)) AS f FROM r)
SELECT n, round(own, 1) AS rss_own, round(both_, 1) AS rss_both, round(f, 5) AS f, round({fn.erfc_sql("sqrt(greatest(0, f) / 2)")}, 5) AS p FROM f"""


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """Value by user and week, a row for each pair; odd users are treated from the third week on."""
    e = table(spark, d, "events").select("user_id", F.floor(F.dayofmonth("ts") / 7).cast("int").alias("week"), "value")
    cells = e.groupBy("user_id", "week").agg(F.sum("value").alias("y"))
    grid = e.select("user_id").distinct().withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return grid.join(cells, ["user_id", "week"], "left").select("user_id", "week", ((F.col("user_id") % 2 == 1) & (F.col("week") >= 2)).cast("int").alias("treated"), F.coalesce("y", F.lit(0.0)).alias("y"))


_P = "p AS (SELECT u.user_id, w.week, (u.user_id % 2 = 1 AND w.week >= 2)::INT AS x, coalesce(c.y, 0) AS y FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(5)) AS week) w LEFT JOIN (SELECT user_id, floor(day(ts) / 7)::INT AS week, sum(value) AS y FROM events GROUP BY 1, 2) c ON c.user_id = u.user_id AND c.week = w.week)"


def panel_treatment(spark: SparkSession, d: str) -> DataFrame:
    """Two-way fixed effects of a treatment on a balanced panel, with errors clustered by user and the slope of the gap before it."""
    return estimates.difference_in_differences(_panel(spark, d), "user_id", "week", "treated", "y").select(F.round("effect", 4).alias("effect"), F.round("se", 4).alias("se"), F.round("p", 5).alias("p"), "n", F.round("pretrend", 4).alias("pretrend"))


PANEL_SQL = f"""WITH {_P}, f AS (SELECT *, x - avg(x) OVER (PARTITION BY user_id) - avg(x) OVER (PARTITION BY week) + avg(x) OVER () AS dx, y - avg(y) OVER (PARTITION BY user_id) - avg(y) OVER (PARTITION BY week) + avg(y) OVER () AS dy FROM p),
b AS (SELECT sum(dx * dy) / sum(dx ** 2) AS b FROM f), u AS (SELECT user_id, sum(dx * (dy - b * dx)) AS u, sum(dx ** 2) AS xx, count(*) AS n FROM f, b GROUP BY 1), s AS (SELECT sqrt(sum(u ** 2)) / sum(xx) AS se, sum(n)::BIGINT AS n FROM u),
g AS (SELECT week, avg(y) FILTER (WHERE user_id % 2 = 1) - avg(y) FILTER (WHERE user_id % 2 = 0) AS gap FROM p WHERE week < 2 GROUP BY 1)
SELECT round(b, 4) AS effect, round(se, 4) AS se, round({fn.erfc_sql("(abs(b / se) / sqrt(2))")}, 5) AS p, n, (SELECT round(regr_slope(gap, week), 4) FROM g) AS pretrend FROM b, s"""


def panel_variance(spark: SparkSession, d: str) -> DataFrame:
    return estimates.panel_shares(_panel(spark, d), "user_id", "week", "y").select(*[F.round(c, 6).alias(c) for c in ("entity_share", "time_share", "residual_share")], "dominant")


VARIANCE_SQL = f"""WITH {_P}, w AS (SELECT count(*) AS n, sum(y) AS s, sum(y ** 2) AS q FROM p), e AS (SELECT sum(s ** 2 / n) AS b FROM (SELECT count(*) AS n, sum(y) AS s FROM p GROUP BY user_id)), t AS (SELECT sum(s ** 2 / n) AS b FROM (SELECT count(*) AS n, sum(y) AS s FROM p GROUP BY week)),
k AS (SELECT (e.b - s ** 2 / n) / (q - s ** 2 / n) AS a, (t.b - s ** 2 / n) / (q - s ** 2 / n) AS c FROM w, e, t), m AS (SELECT a, c, greatest(0, 1 - a - c) AS r FROM k)
SELECT round(a, 6) AS entity_share, round(c, 6) AS time_share, round(r, 6) AS residual_share, CASE WHEN a >= c AND a >= r THEN 'entity' WHEN c >= r THEN 'time' ELSE 'residual' END AS dominant FROM m"""


def bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    found = estimates.bootstrap(e, F.col("event_id"), {"n": F.lit(1), "s": F.col("value")}, lambda c: c("s") / c("n"))
    return found.select("n_replicates", *[F.round(c, 6).alias(c) for c in ("low", "high", "sd")])


def _hex(*parts: str) -> str:
    return "(('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _boot_sql(source: str, key: str, sums: dict[str, str], statistic: str) -> str:
    steps, total, term = [], 0.0, 2.718281828459045**-1
    for i in range(1, 8):
        total += term
        steps.append(total)
        term /= i
    weight = " + ".join(f"(u >= {round(t, 12)})::INT" for t in steps)
    return f"""WITH {source} g AS (SELECT floor({_hex(key)} * 256)::INT AS g, {", ".join(f"sum({x}) AS {n}" for n, x in sums.items())} FROM src GROUP BY 1),
w AS (SELECT b, g.*, {_hex("'42'", "b", "g.g")} AS u FROM g, (SELECT unnest(range(1, 201)) AS b)), d AS (SELECT b, {", ".join(f"sum(({weight}) * {n}) AS {n}" for n in sums)} FROM w GROUP BY 1), v AS (SELECT {statistic} AS v FROM d)
SELECT count(v) AS n_replicates, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(stddev_samp(v), 6) AS sd FROM v"""


BOOT_SQL = _boot_sql("src AS (SELECT event_id AS k, value FROM events),", "k", {"n": "1", "s": "value"}, "s / n")
_R = "(n * sxy - sx * sy) / sqrt((n * sxx - sx ** 2) * (n * syy - sy ** 2))"
BOOT_CORR_SQL = _boot_sql("src AS (SELECT p_partkey AS k, p_size::DOUBLE AS x, p_retailprice AS y FROM part),", "k", {"n": "1", "sx": "x", "sy": "y", "sxx": "x * x", "syy": "y * y", "sxy": "x * y"}, _R)


def bootstrap_correlation(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    x, y = F.col("x"), F.col("y")
    r = lambda c: (c("n") * c("sxy") - c("sx") * c("sy")) / F.sqrt((c("n") * c("sxx") - c("sx") ** 2) * (c("n") * c("syy") - c("sy") ** 2))
    found = estimates.bootstrap(p, F.col("p_partkey"), {"n": F.lit(1), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}, r)
    return found.select("n_replicates", *[F.round(c, 6).alias(c) for c in ("low", "high", "sd")])


def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The mean of daily values with whole weeks drawn together, so that neighbours' dependence stays."""
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))
    block = F.concat_ws("-", "event_type", F.floor(F.dayofmonth("day") / 5).cast("string"))
    found = estimates.bootstrap(days, block, {"n": F.lit(1), "s": F.col("v")}, lambda c: c("s") / c("n"))
    return found.select("n_replicates", *[F.round(c, 4).alias(c) for c in ("low", "high", "sd")])


BLOCK_SQL = _boot_sql("src AS (SELECT event_type || '-' || (day(day) // 5) AS k, v FROM (SELECT event_type, ts::DATE AS day, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)),", "k", {"n": "1", "s": "v"}, "s / n").replace(", 6)", ", 4)")


def causal_effects(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).select((F.col("o_orderstatus") == "F").cast("int").alias("t"), F.col("o_totalprice").alias("y"), "quantity", "discount")
    return estimates.treatment_effect(o, "t", "y", ["quantity", "discount"]).select("method", F.round("effect", 2).alias("effect"))


def spatial_dependence(spark: SparkSession, d: str) -> DataFrame:
    s = _points(spark, d)
    return estimates.spatial(s, "k", "x", "y", "v").select("n", *[F.round(c, 6).alias(c) for c in ("moran", "expected", "geary", "z")], F.round("p", 5).alias("p"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 7919 % 1009).cast("double").alias("x"), (F.col("p_partkey") * 104729 % 997).cast("double").alias("y"), (F.col("p_retailprice") + F.col("p_partkey") * 7919 % 1009).alias("v"))


SPATIAL_SQL = f"""WITH s AS (SELECT p_partkey AS k, (p_partkey * 7919 % 1009)::DOUBLE AS x, (p_partkey * 104729 % 997)::DOUBLE AS y, p_retailprice + p_partkey * 7919 % 1009 AS v FROM part), m AS (SELECT count(*) AS n, avg(v) AS m FROM s), z AS (SELECT k, x, y, v - m AS z FROM s, m),
w AS (SELECT a.k, b.k AS o, a.z AS z, b.z AS oz, 1 / greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 1e-9) AS w FROM z a JOIN z b ON a.k <> b.k QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.k) <= 8),
q AS (SELECT avg(z ** 2) AS m2, avg(z ** 4) AS m4 FROM z), c AS (SELECT sum(w) AS s0, sum(w * z * oz) AS cross_, sum(w * (z - oz) ** 2) AS apart FROM w), p1 AS (SELECT sum(w ** 2) AS s1 FROM (SELECT least(k, o), greatest(k, o), sum(w) AS w FROM w GROUP BY 1, 2)),
p2 AS (SELECT sum(w ** 2) AS s2 FROM (SELECT k, sum(w) AS w FROM (SELECT k, w FROM w UNION ALL SELECT o, w FROM w) GROUP BY 1)),
r AS (SELECT n, cross_ / s0 / m2 AS i, -1 / (n - 1) AS e, (n - 1) * apart / (2 * s0 * n * m2) AS g, (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 ** 2) - m4 / m2 ** 2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 ** 2)) / ((n - 1)::DOUBLE * (n - 2) * (n - 3) * s0 ** 2) AS second FROM m, q, c, p1, p2),
f AS (SELECT *, (i - e) / sqrt(second - e ** 2) AS z FROM r) SELECT n, round(i, 6) AS moran, round(e, 6) AS expected, round(g, 6) AS geary, round(z, 6) AS z, round({fn.erfc_sql("(abs(z) / sqrt(2))")}, 5) AS p FROM f"""


def matched_uplift(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("t"), F.col("o_totalprice").alias("y"), "quantity", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return estimates.matched_uplift(o, "o_orderkey", "t", "y", ["quantity"], ["o_orderpriority", "month"]).select(F.col("key").alias("o_orderkey"), "match", F.round("uplift", 2).alias("uplift"), "chosen")


UPLIFT_SQL = f"""WITH {_O}, sd AS (SELECT stddev_pop(quantity) AS s FROM o), f AS (SELECT o_orderkey AS k, o_orderpriority AS p, strftime(o_orderdate, '%Y-%m') AS m, o_orderstatus = 'F' AS t, o_totalprice AS y, quantity / s AS q FROM o, sd),
j AS (SELECT a.k, b.k AS match, a.y - b.y AS uplift FROM f a JOIN f b ON a.p = b.p AND a.m = b.m AND a.t AND NOT b.t QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY round((a.q - b.q) ** 2, 9), b.k) = 1)
SELECT k AS o_orderkey, match, round(uplift, 2) AS uplift, uplift >= (SELECT quantile_cont(uplift, 0.8) FROM j) AS chosen FROM j"""

_INV = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount", "l_tax": "l_tax"}


def invariants(spark: SparkSession, d: str) -> DataFrame:
    """Direct columns, sums of up to four, differences, products, ratios and squares by their coefficient of variation, the 25 steadiest first."""
    l = table(spark, d, "lineitem")
    parts = [F.struct(F.lit(n).alias("form"), (F.stddev_pop(F.expr(x)) / F.abs(F.avg(F.expr(x)))).alias("cv")) for n, x in _forms().items()]
    return l.agg(F.array(*parts).alias("p")).select(F.inline("p")).where("cv IS NOT NULL").orderBy("cv", "form").limit(25).select("form", F.round("cv", 6).alias("cv"))


def _forms() -> dict[str, str]:
    c = list(_INV)
    out = {x: x for x in c} | {f"{x}^2": f"{x} * {x}" for x in c}
    for k in (2, 3, 4):
        out |= {" + ".join(s): " + ".join(s) for s in combinations(c, k)}
    for a, b in combinations(c, 2):
        out |= {f"{a} - {b}": f"{a} - {b}", f"{a} * {b}": f"{a} * {b}", f"{a} / {b}": f"{a} / nullif({b}, 0)"}
    return out


INVARIANTS_SQL = "WITH f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS form, stddev_pop({x}) / abs(avg({x})) AS cv FROM lineitem" for n, x in _forms().items()) + ") SELECT form, round(cv, 6) AS cv FROM f WHERE cv IS NOT NULL ORDER BY f.cv, form LIMIT 25"


def default_twin(spark: SparkSession, d: str) -> DataFrame:
    """What a twin of the table starts from: figures of its best target."""
    l = table(spark, d, "lineitem")
    q = estimates.quantiles(l, "l_extendedprice", [0.05, 0.5, 0.95])
    told = l.agg(F.count("l_extendedprice").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("sd"), F.round(F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber")), 4).alias("last"))
    return told.select("n", "mean", "sd", *[F.lit(round(v, 4)).alias(n) for n, v in zip(("p05", "p50", "p95"), q, strict=True)], "last")


def risk_index(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("freq"), F.avg("value").alias("a"), F.max("value").alias("m"))
    return e.select("event_type", "freq", F.round(F.col("freq") * (0.5 * F.col("a") + 0.5 * F.col("m")), 3).alias("risk"))


def power_table(spark: SparkSession, d: str) -> DataFrame:
    """Rows needed in each group to see each brand's price effect, and the smallest effect that its own rows could show."""
    p = table(spark, d, "part")
    mean, sd = p.agg(F.avg("p_retailprice"), F.stddev_pop("p_retailprice")).first()
    z = fn.normal_quantile(0.975) + fn.normal_quantile(0.8)
    g = p.groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("m"), F.corr("p_size", "p_retailprice").alias("r"))
    effect = F.abs(F.col("m") - float(mean)) / float(sd)
    return g.select("p_brand", F.ceil(2 * (z / F.round(effect, 6)) ** 2).alias("n_needed"), F.round(z * F.sqrt(2 / F.col("n")), 6).alias("detectable"), F.ceil((z / F.atanh(F.round("r", 6))) ** 2 + 3).alias("n_correlation"))


_ZP = fn.normal_quantile(0.975) + fn.normal_quantile(0.8)
POWER_SQL = f"""WITH w AS (SELECT avg(p_retailprice) AS m0, stddev_pop(p_retailprice) AS s0 FROM part), g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m, corr(p_size, p_retailprice) AS r FROM part GROUP BY 1)
SELECT p_brand, ceil(2 * ({_ZP} / round(abs(m - m0) / s0, 6)) ** 2)::BIGINT AS n_needed, round({_ZP} * sqrt(2 / n), 6) AS detectable, ceil(({_ZP} / (0.5 * ln((1 + round(r, 6)) / (1 - round(r, 6))))) ** 2 + 3)::BIGINT AS n_correlation FROM g, w"""


def posterior_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Of each segment's balances: a normal posterior's interval, and mean and scale of a normal-inverse-gamma one."""
    s = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").cast("double").alias("n"), F.avg("c_acctbal").alias("m"), F.var_samp("c_acctbal").alias("v"), (F.var_pop("c_acctbal") * F.count("*")).alias("ss"))
    weight = 1 / F.lit(1e6) + F.col("n") / F.col("v")
    mean, sd = F.col("n") / F.col("v") * F.col("m") / weight, F.sqrt(1 / weight)
    kappa, alpha = 0.001 + F.col("n"), 0.001 + F.col("n") / 2
    beta = 0.001 + F.col("ss") / 2 + 0.001 * F.col("n") * F.col("m") ** 2 / (2 * kappa)
    return s.select("c_mktsegment", F.round(mean - Z * sd, 4).alias("low"), F.round(mean + Z * sd, 4).alias("high"), F.round(F.col("n") * F.col("m") / kappa, 4).alias("nig_mean"), F.round(F.sqrt(beta / (alpha * kappa)), 4).alias("nig_scale"))


POSTERIOR_SQL = f"""WITH s AS (SELECT c_mktsegment, count(*)::DOUBLE AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v, var_pop(c_acctbal) * count(*) AS ss FROM customer GROUP BY 1), p AS (SELECT *, 1 / 1e6::DOUBLE + n / v AS w FROM s)
SELECT c_mktsegment, round(n / v * m / w - {Z} * sqrt(1 / w), 4) AS low, round(n / v * m / w + {Z} * sqrt(1 / w), 4) AS high, round(n * m / (0.001 + n), 4) AS nig_mean, round(sqrt((0.001 + ss / 2 + 0.001 * n * m ** 2 / (2 * (0.001 + n))) / ((0.001 + n / 2) * (0.001 + n))), 4) AS nig_scale FROM p"""


def prior_validation(spark: SparkSession, d: str) -> DataFrame:
    """Votes on priors (events: a prior for each user, kinds as verdicts): smoothed confidence, trend of the last five, status."""
    e = table(spark, d, "events").withColumn("verdict", F.expr("CASE event_type WHEN 'click' THEN 'up' WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'contradiction' WHEN 'login' THEN 'down' ELSE 'seen' END")).withColumn("human", F.col("value") > 120)
    up, down, contra = F.col("verdict") == "up", F.col("verdict") == "down", F.col("verdict") == "contradiction"
    late = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) <= 5
    g = e.withColumn("late", late).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(up).alias("n_up"), F.count_if(down).alias("n_down"), F.count_if(contra).alias("n_contra"), F.count_if(up & F.col("human")).alias("hu"), F.count_if(down & F.col("human")).alias("hd"), F.count_if(F.col("late") & up).alias("lu"), F.count_if(F.col("late") & (down | contra)).alias("ld"))
    pos, neg = F.col("n_up") + F.col("hu") + 1, F.col("n_down") + F.col("hd") + F.col("n_contra") + 1
    g = g.withColumn("confidence", pos / (pos + neg)).withColumn("trend", F.when(F.col("n") < 3, "no-data").when(F.col("lu") > F.col("ld") + 1, "strengthening").when(F.col("ld") > F.col("lu"), "weakening").otherwise("stable"))
    status = F.when(F.col("n") < 3, "candidate").when((F.col("trend") == "weakening") | (F.col("confidence") <= 0.4), "questioned").when((F.col("confidence") >= 0.9) & (F.col("n") >= 8), "canonical").otherwise("validated")
    return g.select("user_id", "n_up", "n_down", "n_contra", F.round("confidence", 6).alias("confidence"), "trend", status.alias("status"))


VALIDATION_SQL = """WITH e AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'up' WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'contradiction' WHEN 'login' THEN 'down' ELSE 'seen' END AS v, value > 120 AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5 AS late FROM events),
g AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE v = 'up') AS n_up, count(*) FILTER (WHERE v = 'down') AS n_down, count(*) FILTER (WHERE v = 'contradiction') AS n_contra, count(*) FILTER (WHERE v = 'up' AND h) AS hu, count(*) FILTER (WHERE v = 'down' AND h) AS hd, count(*) FILTER (WHERE v = 'up' AND late) AS lu, count(*) FILTER (WHERE v IN ('down', 'contradiction') AND late) AS ld FROM e GROUP BY 1),
c AS (SELECT *, (n_up + hu + 1) / (n_up + hu + n_down + hd + n_contra + 2) AS c, CASE WHEN n < 3 THEN 'no-data' WHEN lu > ld + 1 THEN 'strengthening' WHEN ld > lu THEN 'weakening' ELSE 'stable' END AS trend FROM g)
SELECT user_id, n_up, n_down, n_contra, round(c, 6) AS confidence, trend, CASE WHEN n < 3 THEN 'candidate' WHEN trend = 'weakening' OR c <= 0.4 THEN 'questioned' WHEN c >= 0.9 AND n >= 8 THEN 'canonical' ELSE 'validated' END AS status FROM c"""


def feedback_summary(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counts by kind of row and verdict."""
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(*[F.count_if((F.col("o_orderstatus") == s) & c).alias(f"{s}_{n}") for s in "FOP" for n, c in (("large", F.col("o_totalprice") > 200000), ("small", F.col("o_totalprice") <= 200000))])


def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Requests by user and kind since a time, with the first and the last."""
    e = table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


def domain_summary(spark: SparkSession, d: str) -> DataFrame:
    """Entries by source with conditional sums, and distinct parts over the join with their orders."""
    p, l = table(spark, d, "part"), table(spark, d, "lineitem")
    return p.join(l, p.p_partkey == l.l_partkey).groupBy("p_brand").agg(F.count_distinct("p_partkey").alias("n_parts"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"), F.round(F.sum(F.when(F.col("p_size") > 25, F.col("l_quantity")).otherwise(0.0)), 2).alias("large_quantity"))


def relationships_by_domain(spark: SparkSession, d: str) -> DataFrame:
    """Edges between customers' and suppliers' nations, counted by the regions at both ends."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    names = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.concat_ws(".", "r_name", "n_name").alias("node"))
    edges = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey")).join(F.broadcast(table(spark, d, "supplier")), F.expr("l_suppkey = s_suppkey")).groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    both = edges.join(F.broadcast(names.withColumnRenamed("node", "src")), F.expr("c_nationkey = n_nationkey")).drop("n_nationkey").join(F.broadcast(names.withColumnRenamed("node", "tgt")), F.expr("s_nationkey = n_nationkey"))
    return both.groupBy(F.split_part("src", F.lit("."), F.lit(1)).alias("source"), F.split_part("tgt", F.lit("."), F.lit(1)).alias("target")).agg(F.sum("n").alias("n"))


DOMAINS_SQL = """SELECT a.r_name AS source, b.r_name AS target, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation x ON x.n_nationkey = c_nationkey JOIN region a ON a.r_regionkey = x.n_regionkey JOIN nation y ON y.n_nationkey = s_nationkey JOIN region b ON b.r_regionkey = y.n_regionkey GROUP BY 1, 2"""


def composite_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals between 0 and 1 for each supplier, and the least of those that are there."""
    l = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("a"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_tax"))).alias("b"), F.avg(F.when(F.col("l_quantity") > 49.5, F.col("l_discount"))).alias("c"))
    s = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in (1 - F.col("a") * 10, F.when(F.col("l_suppkey") % 3 != 0, 1 - F.col("b") * 5), 1 - F.col("c") * 4)]
    s = [s[0], F.when(F.col("l_suppkey") % 3 != 0, s[1]), F.when(F.col("c").isNotNull(), s[2])]
    return l.select("l_suppkey", F.round(F.least(*s), 6).alias("composite"), sum(x.isNotNull().cast("int") for x in s).alias("active"))


SIGNALS_SQL = """WITH l AS (SELECT l_suppkey, avg(l_discount) AS a, avg(l_tax) FILTER (WHERE l_returnflag = 'R') AS b, avg(l_discount) FILTER (WHERE l_quantity > 49.5) AS c FROM lineitem GROUP BY 1),
s AS (SELECT l_suppkey, greatest(0, least(1, 1 - a * 10)) AS x, CASE WHEN l_suppkey % 3 <> 0 THEN greatest(0, least(1, 1 - b * 5)) END AS y, CASE WHEN c IS NOT NULL THEN greatest(0, least(1, 1 - c * 4)) END AS z FROM l)
SELECT l_suppkey, round(least(x, y, z), 6) AS composite, (x IS NOT NULL)::INT + (y IS NOT NULL)::INT + (z IS NOT NULL)::INT AS active FROM s"""


def evolution_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Deviations that three ledger rows or more speak of."""
    o = table(spark, d, "orders").select(F.array(F.concat(F.lit("dev"), (F.col("o_custkey") % 97).cast("string")), F.concat(F.lit("rel"), (F.col("o_orderkey") % 53).cast("string"))).alias("ids"), "o_orderkey").where("o_totalprice > 250000")
    return o.select("o_orderkey", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("support"), F.min("o_orderkey").alias("first")).where("support >= 3")


PROPOSALS_SQL = "SELECT id, count(*) AS support, min(o_orderkey) AS first FROM (SELECT o_orderkey, unnest(['dev' || (o_custkey % 97), 'rel' || (o_orderkey % 53)]) AS id FROM orders WHERE o_totalprice > 250000) GROUP BY 1 HAVING count(*) >= 3"

QUERIES = {
    "effect_measures": (effect_measures, EFFECTS_SQL),
    "survival_curve": (survival_curve, f"WITH {_KM} SELECT time, at_risk, deaths, round(survival, 6) AS survival, round(low, 6) AS low, round(high, 6) AS high FROM km"),
    "survival_median": (survival_median, f"WITH {_KM} SELECT min(time) AS median FROM km WHERE survival <= 0.5"),
    "survival_arms": (survival_arms, ARMS_SQL),
    "cox_hazards": (cox_hazards, None),
    "hazards_proportional": (hazards_proportional, PROPORTIONAL_SQL),
    "corrected_p_values": (corrected_p_values, f"WITH {_DZ} SELECT event_type, day, round(p, 6) AS p, round(q, 6) AS q, round(bonferroni, 6) AS bonferroni FROM cq"),
    "credibility": (credibility, CREDIBILITY_SQL),
    "regression_terms": (regression_terms, OLS_SQL),
    "granger_lags": (granger_f, GRANGER_SQL),
    "panel_treatment": (panel_treatment, PANEL_SQL),
    "panel_variance": (panel_variance, VARIANCE_SQL),
    "bootstrap_mean": (bootstrap_mean, BOOT_SQL),
    "bootstrap_correlation": (bootstrap_correlation, BOOT_CORR_SQL),
    "block_bootstrap": (block_bootstrap, BLOCK_SQL),
    "causal_effects": (causal_effects, None),
    "spatial_dependence": (spatial_dependence, SPATIAL_SQL),
    "matched_uplift": (matched_uplift, UPLIFT_SQL),
    "invariants": (invariants, INVARIANTS_SQL),
    "default_twin": (default_twin, "SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS sd, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, (SELECT round(l_extendedprice, 4) FROM lineitem ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC LIMIT 1) AS last FROM lineitem"),
    "risk_index": (risk_index, "SELECT event_type, count(*) AS freq, round(count(*) * (0.5 * avg(value) + 0.5 * max(value)), 3) AS risk FROM events GROUP BY 1"),
    "power_table": (power_table, POWER_SQL),
    "posterior_intervals": (posterior_intervals, POSTERIOR_SQL),
    "prior_validation": (prior_validation, VALIDATION_SQL),
    "feedback_summary": (feedback_summary, "SELECT o_orderpriority, " + ", ".join(f"""count(*) FILTER (WHERE o_orderstatus = '{s}' AND {c}) AS "{s}_{n}" """ for s in "FOP" for n, c in (("large", "o_totalprice > 200000"), ("small", "o_totalprice <= 200000"))) + " FROM orders GROUP BY 1"),
    "usage_summary": (usage_summary, "SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2"),
    "domain_summary": (domain_summary, "SELECT p_brand, count(DISTINCT p_partkey) AS n_parts, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned, round(sum(CASE WHEN p_size > 25 THEN l_quantity ELSE 0 END), 2) AS large_quantity FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1"),
    "relationships_by_domain": (relationships_by_domain, DOMAINS_SQL),
    "composite_signals": (composite_signals, SIGNALS_SQL),
    "evolution_proposals": (evolution_proposals, PROPOSALS_SQL),
}
