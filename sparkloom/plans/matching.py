"""Queries of the matching family: join reports, fallbacks by level, fuzzy and similarity joins, priors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import joining
from sparkloom.operators.nearest import nearest
from sparkloom.sources import table


def join_report(spark: SparkSession, d: str) -> DataFrame:
    """Keys that two tables could be joined on, columns of the same name first, then a lone pair of times."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("OrderKey"), F.expr("IF(o_orderkey % 4 = 0, NULL, o_totalprice)").alias("price"), F.col("o_orderdate").alias("ordered"))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_extendedprice").cast("string").alias("price"), F.col("l_shipdate").alias("shipped"))
    return joining.shared_keys(joining.metadata(a), joining.metadata(b)).select("key", F.round("quality", 6).alias("quality"))


REPORT_SQL = """SELECT 'orderkey' AS key, round(0.5 + 0.5 * (1 - greatest((SELECT avg((o_orderkey IS NULL)::INT) FROM orders), (SELECT avg((l_orderkey IS NULL)::INT) FROM lineitem))), 6) AS quality
UNION ALL SELECT 'price', round(0.25 + 0.5 * (1 - greatest((SELECT avg((o_orderkey % 4 = 0)::INT) FROM orders), (SELECT avg((l_extendedprice IS NULL)::INT) FROM lineitem))), 6) UNION ALL SELECT 'ordered ↔ shipped', 0.7"""


def join_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """Whether two series step alike and how far their numbers of rows are apart."""
    hours = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("t")).agg(F.count("*").alias("n"))
    days = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("t")).agg(F.count("*").alias("n"))
    return joining.compatibility(hours, "t", days, "t")


COMPAT_SQL = """WITH h AS (SELECT DISTINCT date_trunc('hour', ts) AS t FROM events), d AS (SELECT DISTINCT date_trunc('day', ts) AS t FROM events),
a AS (SELECT count(*) AS n, (SELECT median(g) FROM (SELECT epoch(t) - epoch(lag(t) OVER (ORDER BY t)) AS g FROM h)) AS c FROM h), b AS (SELECT count(*) AS n, (SELECT median(g) FROM (SELECT epoch(t) - epoch(lag(t) OVER (ORDER BY t)) AS g FROM d)) AS c FROM d)
SELECT a.n AS rows_a, b.n AS rows_b, a.c::DOUBLE AS cadence_a, b.c::DOUBLE AS cadence_b, CASE WHEN greatest(a.c, b.c) / least(a.c, b.c) < 1.05 THEN 'exact' WHEN greatest(a.c, b.c) / least(a.c, b.c) < 4 THEN 'approx' ELSE 'mismatch' END AS cadence, greatest(a.n, b.n) / least(a.n, b.n) > 10 AS warn_rows FROM a, b"""


def keys_in_list(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a list of keys, one that has no row included."""
    wanted = spark.range(1, 1001).select((F.col("id") * 7).alias("o_orderkey"))
    return wanted.join(table(spark, d, "orders"), "o_orderkey", "left").select("o_orderkey", "o_totalprice")


def left_join_three_keys(spark: SparkSession, d: str) -> DataFrame:
    """Features with their outcomes where there are any, the newest 500 first."""
    l = table(spark, d, "lineitem")
    late = l.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("returned"))
    return l.join(late, ["l_orderkey", "l_partkey", "l_suppkey"], "left").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(500).select("l_orderkey", "l_linenumber", "returned")


THREE_SQL = """WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, sum(l_quantity) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3)
SELECT l_orderkey, l_linenumber, returned FROM lineitem LEFT JOIN r USING (l_orderkey, l_partkey, l_suppkey) ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 500"""

_NAMED = "VALUES ('launch', 11), ('outage', 23), ('sale', 37)"


def referent_levels(spark: SparkSession, d: str) -> DataFrame:
    """What each event refers to, by the surest of six levels that it gives: named event, time, entity, group, position, row."""
    e = table(spark, d, "events").select("event_id", F.expr("event_id % 41").alias("code"), F.expr("IF(event_id % 3 = 0, ts, NULL)").alias("at"), F.expr("IF(event_id % 5 < 2, user_id, NULL)").alias("entity"), F.expr("IF(event_id % 7 < 3, event_type, NULL)").alias("grp"), F.expr("IF(event_id % 2 = 0, event_id DIV 2, NULL)").alias("position"))
    named = spark.sql(f"SELECT * FROM {_NAMED} AS t(name, code)")
    return joining.by_level(e, named, "code").groupBy("level").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 2).alias("confidence"), F.min("referent").alias("least"))


LEVEL_SQL = f"""WITH e AS (SELECT event_id, event_id % 41 AS code, CASE WHEN event_id % 3 = 0 THEN ts END AS at_, CASE WHEN event_id % 5 < 2 THEN user_id END AS entity, CASE WHEN event_id % 7 < 3 THEN event_type END AS grp, CASE WHEN event_id % 2 = 0 THEN event_id // 2 END AS position FROM events),
l AS (SELECT CASE WHEN name IS NOT NULL THEN 'named_event' WHEN at_ IS NOT NULL THEN 'timestamp' WHEN entity IS NOT NULL THEN 'entity' WHEN grp IS NOT NULL THEN 'group' WHEN position IS NOT NULL THEN 'position' ELSE 'row_index' END AS level,
 coalesce(name, strftime(at_, '%Y-%m-%d %H:%M:%S'), entity::VARCHAR, grp, position::VARCHAR, event_id::VARCHAR) AS referent FROM e LEFT JOIN ({_NAMED}) t(name, c) ON t.c = e.code)
SELECT level, count(*) AS n, max(CASE level WHEN 'named_event' THEN 0.95 WHEN 'timestamp' THEN 0.9 WHEN 'entity' THEN 0.85 WHEN 'group' THEN 0.7 WHEN 'position' THEN 0.55 ELSE 0.3 END)::DOUBLE AS confidence, min(referent) AS least FROM l GROUP BY 1"""


def runs_compared(spark: SparkSession, d: str) -> DataFrame:
    """Two runs' metrics by kind of event: only in one, shared, and how far each metric moved."""
    e = table(spark, d, "events")
    half = F.lit("2024-01-16").cast("timestamp")
    runs = [e.where(c).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")) for c in ((F.col("ts") < half) & (F.col("event_type") != "view"), (F.col("ts") >= half) & (F.col("event_type") != "login"))]
    return joining.metric_deltas(runs[0], runs[1], "event_type", ["n", "mean"]).select("event_type", "status", F.round("n_delta", 6).alias("n_delta"), F.round("mean_delta", 6).alias("mean_delta"))


RUNS_SQL = """WITH a AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events WHERE ts < TIMESTAMP '2024-01-16' AND event_type <> 'view' GROUP BY 1), b AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type <> 'login' GROUP BY 1)
SELECT event_type, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'gone' ELSE 'shared' END AS status, round((b.n - a.n)::DOUBLE, 6) AS n_delta, round(b.m - a.m, 6) AS mean_delta FROM a FULL JOIN b USING (event_type)"""


def prior_tags(spark: SparkSession, d: str) -> DataFrame:
    """Findings by supplier tagged with what an earlier run knows: the law, the number of regimes or the range, whichever speaks first."""
    f = table(spark, d, "supplier").select(
        "s_suppkey", F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'logistic' WHEN 1 THEN 'power_law' END").alias("law"), F.expr("1.0 + (s_suppkey % 10) / 5").alias("rmse"), F.expr("IF(s_suppkey % 4 = 2, s_suppkey % 6, NULL)").alias("k"), F.col("s_acctbal").alias("value"))
    return joining.prior_tags(f, {"law": "logistic", "rmse": 1.5, "k": 3, "low": 0.0, "high": 5000.0}).groupBy("kind", "alignment").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))


TAG_SQL = """WITH f AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'logistic' WHEN 1 THEN 'power_law' END AS law, 1.0::DOUBLE + (s_suppkey % 10) / 5 AS rmse, CASE WHEN s_suppkey % 4 = 2 THEN s_suppkey % 6 END AS k, s_acctbal AS v FROM supplier),
g AS (SELECT *, CASE WHEN v < 0 THEN -v WHEN v > 5000 THEN v - 5000 ELSE 0 END AS away FROM f),
t AS (SELECT s_suppkey, CASE WHEN law IS NOT NULL THEN 'physics' WHEN k IS NOT NULL THEN 'regimes' ELSE 'baseline' END AS kind,
 CASE WHEN law IS NOT NULL THEN CASE WHEN law <> 'logistic' THEN 'novel' WHEN rmse / 1.5 <= 1.25 THEN 'matches' ELSE 'drifts' END WHEN k IS NOT NULL THEN CASE WHEN abs(k - 3) = 0 THEN 'matches' WHEN abs(k - 3) <= 1 THEN 'drifts' ELSE 'novel' END
 ELSE CASE WHEN away = 0 THEN 'matches' WHEN away / 5000 <= 0.3 THEN 'drifts' ELSE 'novel' END END AS alignment FROM g) SELECT kind, alignment, count(*) AS n, min(s_suppkey) AS first FROM t GROUP BY 1, 2"""

_PRIORS = "VALUES ('cooling', 'linear', 'physics', 'dy dt a y b', 'a', -1D, -2D, -0.01D), ('cooling', 'linear', 'physics', 'dy dt a y b', 'b', 0D, 0D, 500D), ('interest', 'linear', 'finance', 'dy dt r y', 'a', 1D, 0.001D, 0.5D), ('growth', 'logistic', 'biology', 'dy dt r y one y K', 'r', 1D, 0.01D, 3D), ('growth', 'logistic', 'biology', 'dy dt r y one y K', 'K', 0D, 10D, 10000D), ('growth2', 'logistic', 'biology', 'dy dt r y one y K', 'r', -1D, 0.01D, 2D), ('growth2', 'logistic', 'biology', 'dy dt r y one y K', 'K', 0D, 10D, 9000D)"
_COLS = "(prior, form, domain, structure, param, sign, low, high)"


def _user_fits(spark: SparkSession, d: str) -> DataFrame:
    """Each user's line of values over the days of the month, and its rate and ceiling."""
    day = F.dayofmonth("ts").cast("double")
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.regr_slope("value", day), 6).alias("a"), F.round(F.regr_intercept("value", day), 6).alias("b"), F.round(F.avg("value") / 100, 6).alias("r"), (F.max("value") * 10).alias("K"))


_USERS_SQL = """u AS (
  SELECT user_id, round(regr_slope(value, day(ts)::DOUBLE), 6) AS a, round(regr_intercept(value, day(ts)::DOUBLE), 6) AS b,
    round(avg(value) / 100, 6) AS r, max(value) * 10 AS k
  FROM events GROUP BY 1)"""
_FITS_SQL = """f AS (
  SELECT user_id * 2 AS fit, 'linear' AS form, 'a' AS param, a AS value FROM u
  UNION ALL SELECT user_id * 2, 'linear', 'b', b FROM u
  UNION ALL SELECT user_id * 2 + 1, 'logistic', 'r', r FROM u
  UNION ALL SELECT user_id * 2 + 1, 'logistic', 'K', k FROM u)"""
_OWN_PRIORS_SQL = """p AS (
  SELECT 'u' || user_id AS prior, 'linear' AS form, 'd' || (user_id // 10) AS domain, 'dy dt a y b' AS structure, 'a' AS param, sign(a)::DOUBLE AS sign FROM u WHERE user_id % 3 > 0 AND a IS NOT NULL
  UNION ALL SELECT 'u' || user_id, 'linear', 'd' || (user_id // 10), 'dy dt a y b', 'b', sign(b)::DOUBLE FROM u WHERE user_id % 3 > 0 AND a IS NOT NULL
  UNION ALL SELECT 'u' || user_id, 'logistic', 'd' || (user_id // 10), 'dy dt r y one y K', 'r', 1.0::DOUBLE FROM u WHERE user_id % 3 = 0
  UNION ALL SELECT 'u' || user_id, 'logistic', 'd' || (user_id // 10), 'dy dt r y one y K', 'K', 0.0::DOUBLE FROM u WHERE user_id % 3 = 0)"""


def _double(text: str) -> str:
    import re

    return re.sub(r"(\d)D\b", r"\1::DOUBLE", text)


def prior_matches(spark: SparkSession, d: str) -> DataFrame:
    """The three best priors of each user's fits, by the ranges that their parameters fall into; a wrong sign rules a prior out."""
    priors = spark.sql(f"SELECT * FROM {_PRIORS} AS t{_COLS}")
    of = lambda fit, form, *names: [F.struct(fit.alias("fit"), F.lit(form).alias("form"), F.lit(n).alias("param"), F.col(n).alias("value")) for n in names]
    user = F.col("user_id") * 2
    fits = _user_fits(spark, d).select(F.inline(F.array(*of(user, "linear", "a", "b"), *of(user + 1, "logistic", "r", "K"))))
    return joining.prior_matches(fits, priors).select("fit", "prior", F.round("confidence", 6).alias("confidence"))


MATCH_SQL = f"""
WITH {_USERS_SQL}, {_FITS_SQL},
p AS (SELECT * FROM ({_double(_PRIORS)}) t{_COLS}),
x AS (SELECT DISTINCT fit, form FROM f),
j AS (
  SELECT x.fit, p.prior, p.param, value, sign,
    CASE WHEN value IS NULL THEN 0.7 WHEN value BETWEEN low AND high THEN 1 ELSE greatest(0, 1 - greatest(low - value, value - high) / (high - low)) END AS s
  FROM x JOIN p USING (form) LEFT JOIN f ON f.fit = x.fit AND f.param = p.param),
c AS (SELECT fit, prior, CASE WHEN bool_or(value * sign < 0) THEN 0 ELSE avg(s) END AS confidence FROM j GROUP BY 1, 2)
SELECT fit, prior, round(confidence, 6) AS confidence FROM c WHERE confidence > 0.4
QUALIFY row_number() OVER (PARTITION BY fit ORDER BY confidence DESC, prior) <= 3"""


def prior_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of users' laws that say nearly the same, and pairs of one domain (ten users) that contradict each other in a sign."""
    u = _user_fits(spark, d)
    of = lambda form, structure, **signs: [F.struct(F.lit(form).alias("form"), F.lit(structure).alias("structure"), F.lit(n).alias("param"), x.cast("double").alias("sign")) for n, x in signs.items()]
    line, curve = of("linear", "dy dt a y b", a=F.signum("a"), b=F.signum("b")), of("logistic", "dy dt r y one y K", r=F.lit(1), K=F.lit(0))
    rows = u.select("user_id", F.inline(F.when(F.col("user_id") % 3 == 0, F.array(*curve)).when(F.col("a").isNotNull(), F.array(*line))))
    priors = rows.select(F.concat(F.lit("u"), "user_id").alias("prior"), F.concat(F.lit("d"), F.floor(F.col("user_id") / 10)).alias("domain"), "form", "structure", "param", "sign")
    return joining.prior_pairs(priors).select("a", "b", F.round("score", 6).alias("score"), "duplicate", "contradiction")


DUPLICATE_SQL = f"""
WITH {_USERS_SQL}, {_OWN_PRIORS_SQL},
g AS (SELECT prior, any_value(form) AS form, any_value(domain) AS domain, list_distinct(string_split(lower(any_value(structure)), ' ')) AS w, list(param) AS k FROM p GROUP BY 1),
j AS (SELECT a.prior AS a, b.prior AS b, (a.form = b.form) AS f, (a.domain = b.domain) AS dm, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS jw, len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) AS jk FROM g a JOIN g b ON a.prior < b.prior AND (a.form = b.form OR a.domain = b.domain)),
s AS (SELECT a, b, 0.5 * f::INT + 0.2 * dm::INT + 0.2 * (jw >= 0.6)::INT + 0.1 * (jk >= 0.6)::INT AS score FROM j),
c AS (SELECT DISTINCT x.prior AS a, y.prior AS b FROM p x JOIN p y ON x.domain = y.domain AND x.param = y.param AND x.prior < y.prior AND x.sign * y.sign < 0)
SELECT a, b, round(score, 6)::DOUBLE AS score, score >= 0.85 AS duplicate, (c.a IS NOT NULL) AS contradiction FROM s LEFT JOIN c USING (a, b) WHERE score >= 0.85 OR c.a IS NOT NULL"""


def fused_series(spark: SparkSession, d: str) -> DataFrame:
    """Series cut to the shortest one's length and set side by side by place: their correlations and two principal components."""
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return joining.fused(days, "event_type", "day", "v").select("a", "b", F.round("r", 6).alias("r"), F.round("explained", 6).alias("explained"))


def fuzzy_titles(spark: SparkSession, d: str) -> DataFrame:
    """The best title for each altered part name, by edit distance among those that share a word with it, 0.55 at least."""
    p = table(spark, d, "part")
    asked = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("id"), F.concat(F.translate("p_name", "aeo", "eoa"), F.lit(" x"), F.col("p_brand")).alias("title"))
    titles = p.select(F.col("p_partkey").alias("match_id"), F.concat_ws(" ", "p_name", "p_brand").alias("other"))
    return joining.fuzzy_best(asked, titles, 0.55).select("id", "match_id", F.round("ratio", 6).alias("ratio"))


FUZZY_SQL = """WITH a AS (SELECT p_partkey AS id, translate(p_name, 'aeo', 'eoa') || ' x' || p_brand AS title FROM part WHERE p_partkey % 100 = 0), t AS (SELECT p_partkey AS match_id, p_name || ' ' || p_brand AS other FROM part),
aw AS (SELECT DISTINCT id, title, unnest(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9_]+'), lambda x: x <> '')) AS w FROM a), tw AS (SELECT DISTINCT match_id, other, unnest(list_filter(regexp_split_to_array(lower(other), '[^a-z0-9_]+'), lambda x: x <> '')) AS w FROM t),
j AS (SELECT DISTINCT id, match_id, title, other FROM aw JOIN tw USING (w)), s AS (SELECT id, match_id, 1 - levenshtein(lower(title), lower(other)) / greatest(length(title), length(other)) AS r FROM j)
SELECT id, match_id, round(r, 6) AS ratio FROM s WHERE r >= 0.55 QUALIFY row_number() OVER (PARTITION BY id ORDER BY r DESC, match_id) = 1"""


def fuzzy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages without those that an earlier one resembles (words of whole texts sorted, 80 % alike at least)."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"))
    again = b.select((F.col("id") + 1000).alias("id"), F.concat(F.lit("The "), "title").alias("title"))
    return joining.fuzzy_dedupe(b.unionByName(again), 0.8).select("id")


FUZZY_DEDUPE_SQL = """
WITH b AS (SELECT item_id AS id, text AS title FROM benchmark UNION ALL SELECT item_id + 1000, 'The ' || text FROM benchmark),
w AS (SELECT id, list_sort(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x <> '')) AS l FROM b),
s AS (SELECT id, array_to_string(l, ' ') AS t, list_distinct(l) AS l FROM w),
u AS (SELECT id, t, unnest(l) AS x FROM s),
p AS (SELECT DISTINCT a.id AS a, b.id AS b, a.t AS ta, b.t AS tb FROM u a JOIN u b ON a.x = b.x AND a.id < b.id)
SELECT id FROM b WHERE id NOT IN (SELECT b FROM p WHERE 1 - levenshtein(ta, tb) / greatest(length(ta), length(tb)) >= 0.8)"""


def cosine_join(spark: SparkSession, d: str) -> DataFrame:
    """For every hundredth vector, the three of all others with the largest cosine."""
    v = table(spark, d, "embeddings")
    return nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 3).select("query_id", "vec_id", F.round("score", 6).alias("score"))


_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
COSINE_SQL = f"""
WITH {_V}, s AS (
  SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.e, c.e), 9) AS s
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(s, 6) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 3"""


def euclidean_join(spark: SparkSession, d: str) -> DataFrame:
    """For every hundredth vector, the three nearest of all others."""
    v = table(spark, d, "embeddings")
    return nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 3, "euclidean").select("query_id", "vec_id", F.round(-F.col("score"), 6).alias("distance"))


EUCLID_SQL = f"""
WITH {_V}, s AS (
  SELECT q.vec_id AS query_id, c.vec_id, round(list_distance(q.e, c.e), 9) AS s
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(s, 6) AS distance FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) <= 3"""


def numeric_key_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Experiments most like every hundredth order, by the cosine of their figures, among all orders."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    v = F.array(F.sum("l_quantity").cast("double"), F.sum("l_extendedprice").cast("double") / 1000, F.avg("l_discount").cast("double") * 100)
    o = table(spark, d, "orders").select("o_orderkey").join(l.agg(v.alias("v")), "o_orderkey")
    found = nearest(o.where("o_orderkey % 100 = 0"), o, "o_orderkey", "v", 5)
    return found.where("score > 0").select("query_id", F.col("o_orderkey").alias("match_id"), F.round("score", 6).alias("score"))


NUMERIC_SQL = """
WITH l AS (SELECT l_orderkey, [sum(l_quantity), sum(l_extendedprice) / 1000, avg(l_discount) * 100]::DOUBLE[] AS v FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, v FROM orders JOIN l ON l_orderkey = o_orderkey),
s AS (
  SELECT a.o_orderkey AS query_id, b.o_orderkey AS match_id, round(list_cosine_similarity(a.v, b.v), 9) AS s
  FROM o a JOIN o b ON a.o_orderkey <> b.o_orderkey WHERE a.o_orderkey % 100 = 0)
SELECT query_id, match_id, round(s, 6) AS score FROM s WHERE s > 0
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, match_id) <= 5"""

_SIGNATURES = "CASE WHEN p_size < 15 THEN 'exponential decay' WHEN p_size < 30 THEN 'exponential growth' ELSE 'linear' END AS shape, p_size % 2 = 0 AS monotonic, p_type AS domain, (p_size - 25.0) AS slope, p_size % 14 AS bends, CASE WHEN p_size % 3 = 0 THEN 1.0 END AS frequency"


def signature_priors(spark: SparkSession, d: str) -> DataFrame:
    """Priors suggested for the signature of part 1's kind: similar signatures vote with their similarity."""
    s = table(spark, d, "part").selectExpr("p_partkey", "p_brand AS prior", "p_retailprice / 2000 AS confidence", *_SIGNATURES.replace(" AS monotonic", " AS monotonic").split(", "))
    asked = s.orderBy("p_partkey").limit(1)
    return joining.signature_votes(asked, s).select("prior", F.round("total", 6).alias("total"), "n", F.round("confidence", 6).alias("confidence"))


_FEW = "CASE WHEN {x} = 0 THEN 'none' WHEN {x} <= 3 THEN 'few' WHEN {x} <= 12 THEN 'moderate' ELSE 'many' END"
SIGNATURE_SQL = f"""WITH s AS (SELECT p_partkey, p_brand AS prior, p_retailprice / 2000 AS confidence, {_SIGNATURES} FROM part), q AS (SELECT * FROM s ORDER BY p_partkey LIMIT 1),
z AS (SELECT s.prior, s.confidence, CASE WHEN s.shape = q.shape THEN 0.45 WHEN split_part(s.shape, ' ', 1) = split_part(q.shape, ' ', 1) THEN 0.225 ELSE 0 END + 0.1 * (s.monotonic = q.monotonic)::INT + 0.2 * (s.domain = q.domain)::INT + 0.1 * (s.slope * q.slope > 0 OR s.slope = 0 OR q.slope = 0)::INT
 + 0.1 * ({_FEW.format(x="s.bends")} = {_FEW.format(x="q.bends")})::INT + 0.05 * ((s.frequency IS NULL) = (q.frequency IS NULL))::INT AS sim FROM s, q WHERE s.p_partkey <> q.p_partkey)
SELECT prior, round(sum(sim), 6)::DOUBLE AS total, count(*) AS n, round(avg(confidence), 6) AS confidence FROM z WHERE sim >= 0.5 GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, n DESC, prior LIMIT 3"""

QUERIES = {
    "join_report": (join_report, REPORT_SQL),
    "join_compatibility": (join_compatibility, COMPAT_SQL),
    "keys_in_list": (keys_in_list, "SELECT w.k AS o_orderkey, o_totalprice FROM (SELECT unnest(range(7, 7001, 7)) AS k) w LEFT JOIN orders ON o_orderkey = w.k"),
    "left_join_three_keys": (left_join_three_keys, THREE_SQL),
    "referent_levels": (referent_levels, LEVEL_SQL),
    "runs_compared": (runs_compared, RUNS_SQL),
    "prior_tags": (prior_tags, TAG_SQL),
    "prior_matches": (prior_matches, MATCH_SQL),
    "prior_duplicates": (prior_duplicates, DUPLICATE_SQL),
    "fused_series": (fused_series, None),
    "fuzzy_titles": (fuzzy_titles, FUZZY_SQL),
    "fuzzy_dedupe": (fuzzy_dedupe, FUZZY_DEDUPE_SQL),
    "cosine_join": (cosine_join, COSINE_SQL),
    "euclidean_join": (euclidean_join, EUCLID_SQL),
    "numeric_key_similarity": (numeric_key_similarity, NUMERIC_SQL),
    "signature_priors": (signature_priors, SIGNATURE_SQL),
}
