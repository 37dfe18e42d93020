"""Joins that Spark has no word of its own for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def within(events: DataFrame, periods: DataFrame, at: str, starts: str, ends: str, bucket: str = "DAY") -> DataFrame:
    """Rows of events with each period that holds their time, both ends included.

    A period is written once for each bucket of time that it touches, so the join is
    an equi-join on the bucket with the exact bounds as its rest, not a nested loop.
    """
    spread = periods.withColumn("_b", F.explode(F.sequence(F.date_trunc(bucket, F.col(starts)), F.date_trunc(bucket, F.col(ends)), F.expr(f"INTERVAL 1 {bucket}"))))
    dealt = events.withColumn("_b", F.date_trunc(bucket, F.col(at)))
    return dealt.join(spread, "_b").where(F.col(at).between(F.col(starts), F.col(ends))).drop("_b")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Rows of left with the values of the latest row of right at or before their time, by key.

    Both sides are put together and sorted once by key and time; the last values are
    carried forward, so no pair of rows is made that is not an answer.
    """
    one = left.select(F.lit(1).alias("_side"), *keys, at, F.struct(*[c for c in left.columns]).alias("_row"), F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("_v"))
    two = right.select(F.lit(0).alias("_side"), *keys, at, F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = one.unionByName(two).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select("_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def metadata(df: DataFrame, prefix: str = "") -> DataFrame:
    """key (the column's name in small letters, without the prefix), kind and missing share of each column."""
    kinds = {c: ("number" if t.startswith(("int", "big", "double", "float", "decimal", "small")) else "time" if t.startswith(("date", "timestamp")) else "text") for c, t in df.dtypes}
    parts = [F.struct(F.lit(c.lower().removeprefix(prefix)).alias("key"), F.lit(kinds[c]).alias("kind"), F.avg(F.col(c).isNull().cast("double")).alias("missing")) for c in df.columns]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def shared_keys(a: DataFrame, b: DataFrame, limit: int = 8) -> DataFrame:
    """Columns of the same name in both, with a quality: half for the same kind (a quarter else), half for what is filled."""
    b = b.select("key", F.col("kind").alias("kind_b"), F.col("missing").alias("missing_b"))
    quality = F.when(F.col("kind") == F.col("kind_b"), 0.5).otherwise(0.25) + 0.5 * (1 - F.greatest("missing", "missing_b"))
    named = a.join(b, "key").select("key", quality.alias("quality"))
    lone = lambda m, k: m.where(F.col(k) == "time").agg(F.min("key").alias("name"), F.count("*").alias("n")).where("n = 1").select("name")
    times = lone(a, "kind").alias("x").join(lone(b, "kind_b").alias("y"), F.expr("x.name <> y.name")).select(F.concat_ws(" ↔ ", "x.name", "y.name").alias("key"), F.lit(0.7).alias("quality"))
    return named.unionByName(times).orderBy(F.desc("quality"), "key").limit(limit)


def compatibility(a: DataFrame, at_a: str, b: DataFrame, at_b: str) -> DataFrame:
    """Rows and median steps of two series, whether they step alike (exact, approx, mismatch) and whether rows differ tenfold."""
    def told(df: DataFrame, at: str, s: str) -> DataFrame:
        day = F.to_date(at)
        inside = df.select(F.unix_seconds(at).alias("t"), day.alias("p")).withColumn("g", F.col("t") - F.lag("t").over(Window.partitionBy("p").orderBy("t")))
        between = inside.groupBy("p").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select((F.col("lo") - F.lag("hi").over(Window.orderBy("p"))).alias("g"))
        gaps = inside.select("g").unionByName(between).where("g IS NOT NULL")
        return gaps.agg(F.median("g").alias(f"cadence_{s}")).join(df.agg(F.count("*").alias(f"rows_{s}")))

    both = told(a, at_a, "a").join(told(b, at_b, "b"))
    ratio = F.greatest("cadence_a", "cadence_b") / F.least("cadence_a", "cadence_b")
    return both.select("rows_a", "rows_b", "cadence_a", "cadence_b", F.when(ratio < 1.05, "exact").when(ratio < 4, "approx").otherwise("mismatch").alias("cadence"), (F.greatest("rows_a", "rows_b") / F.least("rows_a", "rows_b") > 10).alias("warn_rows"))


#: How sure each level of reference is.
LEVELS = (("named_event", 0.95), ("timestamp", 0.90), ("entity", 0.85), ("group", 0.70), ("position", 0.55), ("row_index", 0.30))


def by_level(rows: DataFrame, named: DataFrame, code: str) -> DataFrame:
    """level, referent and confidence of each row (event_id, code, at, entity, grp, position), by the surest level it gives; named events (name, code) are joined."""
    found = rows.join(named, code, "left")
    given = [F.col("name"), F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.col("entity").cast("string"), F.col("grp"), F.col("position").cast("string"), F.col("event_id").cast("string")]
    told = F.coalesce(*[F.when(g.isNotNull(), F.struct(F.lit(n).alias("level"), g.alias("referent"), F.lit(c).alias("confidence"))) for (n, c), g in zip(LEVELS, given, strict=True)])
    return found.select("event_id", told.alias("r")).select("event_id", "r.*")


def metric_deltas(a: DataFrame, b: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """status (new, gone, shared) of each key of two runs, and the change of each metric."""
    left = a.select(key, *[F.col(m).alias(f"a_{m}") for m in metrics], F.lit(True).alias("in_a"))
    right = b.select(key, *[F.col(m).alias(f"b_{m}") for m in metrics], F.lit(True).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNull(), "gone").otherwise("shared")
    return left.join(right, key, "full_outer").select(key, status.alias("status"), *[(F.col(f"b_{m}") - F.col(f"a_{m}")).cast("double").alias(f"{m}_delta") for m in metrics])


def prior_tags(findings: DataFrame, prior: dict) -> DataFrame:
    """kind and alignment (matches, drifts, novel) of each finding (law, rmse, k, value): the first of law, number of regimes and range that both sides give."""
    same = F.lower("law") == prior["law"]
    law = F.when(~same, "novel").when(F.col("rmse") / prior["rmse"] <= 1.25, "matches").otherwise("drifts")
    step = F.abs(F.col("k") - prior["k"])
    away = F.greatest(F.lit(prior["low"]) - F.col("value"), F.col("value") - prior["high"], F.lit(0.0))
    base = F.when(away == 0, "matches").when(away / (prior["high"] - prior["low"]) <= 0.3, "drifts").otherwise("novel")
    regimes = F.when(step == 0, "matches").when(step <= 1, "drifts").otherwise("novel")
    tag = F.when(F.col("law").isNotNull(), F.struct(F.lit("physics").alias("kind"), law.alias("alignment"))).when(F.col("k").isNotNull(), F.struct(F.lit("regimes").alias("kind"), regimes.alias("alignment"))).when(F.col("value").isNotNull(), F.struct(F.lit("baseline").alias("kind"), base.alias("alignment")))
    return findings.withColumn("tag", tag).where("tag IS NOT NULL").select(*findings.columns, "tag.*")


def prior_matches(fits: DataFrame, priors: DataFrame, floor: float = 0.4, most: int = 3) -> DataFrame:
    """The best priors of each fit (fit, form, param, value): mean score of the parameters' ranges, 0.7 for a missing one, 0 for a wrong sign."""
    asked = fits.select("fit", "form").distinct().join(priors, "form")
    value = asked.join(fits.select("fit", "param", "value"), ["fit", "param"], "left")
    away = F.greatest(F.col("low") - F.col("value"), F.col("value") - F.col("high"), F.lit(0.0))
    score = F.when(F.col("value").isNull(), 0.7).otherwise(F.greatest(F.lit(0.0), 1 - away / (F.col("high") - F.col("low"))))
    wrong = F.coalesce(F.bool_or(F.col("value") * F.col("sign") < 0), F.lit(False))
    judged = value.groupBy("fit", "prior").agg(F.when(wrong, 0.0).otherwise(F.avg(score)).alias("confidence")).where(F.col("confidence") > floor)
    return judged.withColumn("_r", F.row_number().over(Window.partitionBy("fit").orderBy(F.desc("confidence"), "prior"))).where(F.col("_r") <= most).drop("_r")


def prior_pairs(priors: DataFrame, least: float = 0.85) -> DataFrame:
    """a, b, score, duplicate and contradiction of pairs of priors that share a domain, or a form where that alone can reach `least` (up to 0.8)."""
    from sparkloom.functions import jaccard, tokens

    one = priors.groupBy("prior").agg(F.first("form").alias("form"), F.first("domain").alias("domain"), F.first("structure").alias("structure"), F.collect_set("param").alias("params"), F.map_from_entries(F.collect_list(F.struct("param", "sign"))).alias("signs"))
    x, y = (one.select(*[F.col(c).alias(f"{p}_{c}") for c in one.columns]) for p in ("a", "b"))
    # a pair meets by its domain; by its form only where that is enough, as few forms make many pairs
    met = [x.join(y, (F.col(f"a_{c}") == F.col(f"b_{c}")) & (F.col("a_prior") < F.col("b_prior"))) for c in (("domain", "form") if least <= 0.8 else ("domain",))]
    both = met[0] if len(met) == 1 else met[0].unionByName(met[1]).dropDuplicates(["a_prior", "b_prior"])
    alike = lambda c: (F.col(f"a_{c}") == F.col(f"b_{c}")).cast("double")
    score = 0.5 * alike("form") + 0.2 * alike("domain") + 0.2 * (jaccard(tokens(F.col("a_structure")), tokens(F.col("b_structure"))) >= 0.6).cast("double") + 0.1 * (jaccard(F.col("a_params"), F.col("b_params")) >= 0.6).cast("double")
    against = F.exists(F.array_intersect("a_params", "b_params"), lambda k: F.try_element_at("a_signs", k) * F.try_element_at("b_signs", k) < 0) & (alike("domain") == 1)
    return both.select(F.col("a_prior").alias("a"), F.col("b_prior").alias("b"), score.alias("score"), (score >= least).alias("duplicate"), against.alias("contradiction")).where("duplicate OR contradiction")


def fused(series: DataFrame, name: str, order: str, value: str) -> DataFrame:
    """a, b, r of each pair of series aligned by place and cut to the shortest, and the share of variance that two principal components of the correlations explain."""
    import numpy as np

    placed = series.withColumn("i", F.row_number().over(Window.partitionBy(name).orderBy(order)))
    names = [r[0] for r in series.select(name).distinct().orderBy(name).collect()]
    wide = placed.groupBy("i").pivot(name, names).agg(F.first(value)).dropna()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    told = wide.agg(*[F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")) for a, b in pairs]).first()
    m = np.eye(len(names))
    for (a, b), r in zip(pairs, told, strict=True):
        m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = r or 0.0
    explained = float(np.sort(np.linalg.eigvalsh(m))[-2:].sum() / max(1, len(names)))
    return series.sparkSession.createDataFrame([(a, b, r, explained) for (a, b), r in zip(pairs, told, strict=True)], "a string, b string, r double, explained double")


def _alike(a: Column, b: Column, least: float) -> Column:
    """Whether two texts' edit ratio is `least` or more: lengths first, they are cheap."""
    from sparkloom.functions import edit_ratio

    longest = F.greatest(F.length(a), F.length(b))
    return (F.abs(F.length(a) - F.length(b)) <= (1 - least) * longest) & (edit_ratio(a, b) >= least)


def fuzzy_best(asked: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """id, match_id and ratio: the most alike of the titles (match_id, other) that share a word with each asked one (id, title); ties to the smaller match_id. Equal texts are compared once."""
    from sparkloom.functions import edit_ratio, tokens

    questions = asked.withColumn("t", F.lower("title"))
    known = titles.groupBy(F.lower("other").alias("o")).agg(F.min("match_id").alias("match_id"))
    a = questions.select("t").distinct().select("t", F.explode(tokens(F.col("t"))).alias("w"))
    b = known.select("o", "match_id", F.explode(tokens(F.col("o"))).alias("w"))
    met = a.join(b, "w").where(_alike(F.col("t"), F.col("o"), least)).withColumn("ratio", edit_ratio(F.col("t"), F.col("o")))
    best = met.groupBy("t").agg(F.min_by(F.struct("match_id", "ratio"), F.struct(-F.col("ratio"), "match_id")).alias("b"))
    return questions.join(best, "t").select("id", "b.*")


def fuzzy_dedupe(rows: DataFrame, least: float) -> DataFrame:
    """Rows (id, title) that no row of a smaller id resembles; only rows that share a word are compared, by their whole texts with words sorted, equal ones once."""
    from sparkloom.functions import token_sort, tokens

    s = rows.select("id", token_sort(F.col("title")).alias("t"))
    # of equal texts with words all but the first go; a text is compared under its least and its greatest id
    texts = s.groupBy("t").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("t <> ''")
    a, b = (texts.select(F.col(i).alias(f"{p}_id"), F.col("t").alias(f"{p}_t"), F.explode(tokens(F.col("t"))).alias("w")) for p, i in (("a", "first"), ("b", "last")))
    met = a.join(b, "w").where("a_id < b_id").where("a_t <> b_t").where(_alike(F.col("a_t"), F.col("b_t"), least))
    beyond = met.groupBy(F.col("b_t").alias("t")).agg(F.min("a_id").alias("from"))
    same = texts.where("first < last").select("t", F.col("first").alias("from"))
    start = beyond.unionByName(same).groupBy("t").agg(F.min("from").alias("from"))
    gone = s.join(start, "t").where("id > from").select("id").distinct()
    return rows.join(gone, "id", "left_anti")


def signature_votes(asked: DataFrame, known: DataFrame, least: float = 0.5, most: int = 3) -> DataFrame:
    """Priors of signatures (shape, monotonic, domain, slope, bends, frequency) like the asked one, by summed similarity; two votes at least."""
    q = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    both = known.join(F.broadcast(q), F.col("p_partkey") != F.col("q_p_partkey"))
    few = lambda c: F.when(F.col(c) == 0, 0).when(F.col(c) <= 3, 1).when(F.col(c) <= 12, 2).otherwise(3)
    shape = F.when(F.col("shape") == F.col("q_shape"), 0.45).when(F.split("shape", " ")[0] == F.split("q_shape", " ")[0], 0.225).otherwise(0.0)
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    score = shape + one(F.col("monotonic") == F.col("q_monotonic"), 0.1) + one(F.col("domain") == F.col("q_domain"), 0.2) + one(F.col("slope") * F.col("q_slope") >= 0, 0.1) + one(few("bends") == few("q_bends"), 0.1) + one(F.col("frequency").isNull() == F.col("q_frequency").isNull(), 0.05)
    votes = both.withColumn("_s", score).where(F.col("_s") >= least).groupBy("prior").agg(F.sum("_s").alias("total"), F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
    return votes.where("n >= 2").orderBy(F.desc(F.round("total", 9)), F.desc("n"), "prior").limit(most)


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """status of each key: added, removed, changed or same; rows are compared by the hash of their other columns."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.xxhash64(*rest).alias("_a"))
    b = new.select(*keys, F.xxhash64(*rest).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))
