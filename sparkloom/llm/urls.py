"""URL filters: site rules first, a character language-model ratio for the rest.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, predict
each character from the longest run before it that the models know. Every run of the
labelled URLs is known, and so are all its endings; the table of runs grows with the
input and is never broadcast. For each
run of up to `longest` characters the table holds the log ratio of the two smoothed
probabilities of its last character, less that of its ending without the first
character; the sum over a URL's known runs is then the sum over its characters of
the ratio at the longest known one. Those of one place are the endings of the up to
`longest` characters before it, so distinct ends meet the table first. The texts' ends
meet the sums of the `frequent` most common ends at most by a broadcast, which leaves
one row for each text, and those of all others by a shuffle. The score is divided by the length and compared with a
threshold between the means of both classes, at equal numbers of their deviations.

Learning takes the URLs that the rules decide, and counts hosts with a term of TERMS
as rejected wherever the rules stand. All counts cover all rows. A null URL, or one
without `://`, has an empty host and path; an empty text scores 0. Without labelled
URLs of both kinds the threshold is 0 and all is allowed that scores 0. Each row is
judged alone, and repeated rows get equal results. Other columns are left out.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import kept

#: Parts of host names that mark unwanted sites.
TERMS = ("adult", "bets", "casino", "gambl", "malware", "phish", "pills", "poker", "porn", "spam", "xxx")
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    rest = F.substring_index(_after(url), "#", 1)
    return F.translate(F.substring_index(F.substring_index(rest, "?", 1), "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    rest = F.substring_index(F.substring_index(_after(url), "#", 1), "?", 1)
    cut = F.instr(rest, "/")
    return F.when(cut > 0, F.substring(rest, cut, F.length(rest))).otherwise(F.lit(""))


def _after(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of verdict and rule; null if none does."""
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        site, _, start = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _spelled(text: Column, use: Callable[[Column], Column]) -> Column:
    """use(characters), with the array of characters worked out once for a text."""
    return F.get(F.transform(F.array(F.split(F.concat(F.lit("^"), text), "")), use), F.lit(0))


def _runs(text: Column, longest: int) -> Column:
    """All runs of 1 to `longest` characters, spelled from the array of characters."""

    def all_runs(chars):
        at = F.sequence(F.lit(1), F.size(chars))
        return F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), i)), lambda n: F.array_join(F.slice(chars, i - n + 1, n), ""))))

    return _spelled(text, all_runs)


def _ends(text: Column, longest: int) -> Column:
    """For each character, the up to `longest` characters that end with it."""

    def all_ends(chars):
        return F.transform(F.sequence(F.lit(1), F.size(chars)), lambda i: F.array_join(F.slice(chars, F.greatest(F.lit(1), i - longest + 1), F.least(F.lit(longest), i)), ""))

    return _spelled(text, all_ends)


def fit(labelled: DataFrame, longest: int = 5, alpha: float = 0.5, alphabet: int = 64) -> DataFrame:
    """run and gain of the known runs. labelled: text, good (boolean)."""
    counts = labelled.select("good", F.explode(_runs(F.col("text"), longest)).alias("run")).groupBy("run").agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("r"))
    known = kept(counts)
    total = known.where(F.length("run") == 1).agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
    context = known.select(F.col("run").alias("before"), F.col("a").alias("ca"), F.col("r").alias("cr")).unionByName(total.select(F.lit("").alias("before"), F.col("ta").alias("ca"), F.col("tr").alias("cr")))
    with_context = known.withColumn("before", F.substring("run", 1, F.length("run") - 1)).join(context, "before", "left")
    share = lambda c, t: (F.col(c) + alpha) / (F.coalesce(F.col(t), F.lit(0)) + alpha * alphabet)
    ratio = with_context.select("run", F.log(share("a", "ca") / share("r", "cr")).alias("ratio"))
    ending = ratio.select(F.col("run").alias("ending"), F.col("ratio").alias("less"))
    return ratio.withColumn("ending", F.substring("run", 2, longest)).join(ending, "ending", "left").select("run", (F.col("ratio") - F.coalesce("less", F.lit(0.0))).alias("gain"))


def scores(texts: DataFrame, model: DataFrame, longest: int = 5, frequent: int = 10_000) -> DataFrame:
    """key and score (mean log ratio over the characters) of each row of texts (key, text)."""
    spread = texts.select("key", F.length("text").alias("n"), F.explode(_ends(F.col("text"), longest)).alias("end"))
    met = spread.groupBy("end").agg(F.count("*").alias("times"))
    runs = met.select("end", "times", F.explode(F.transform(F.sequence(F.lit(1), F.length("end")), lambda n: F.substring("end", F.length("end") - n + 1, n))).alias("run"))
    gains = kept(runs.join(model, "run").groupBy("end").agg(F.first("times").alias("times"), F.sum("gain").alias("gain")))
    least = (gains.agg(F.sum("times").alias("n")).first()["n"] or 0) / frequent
    often, seldom = (gains.where(c).select("end", "gain") for c in (F.col("times") >= least, F.col("times") < least))
    first = spread.join(F.broadcast(often), "end", "left")
    near = first.groupBy("key").agg(F.first("n").alias("n"), F.coalesce(F.sum("gain"), F.lit(0.0)).alias("gain"))
    far = first.where("gain IS NULL").select("key", "n", "end").join(seldom.hint("merge"), "end").select("key", "n", "gain")
    return near.unionByName(far).groupBy("key").agg(F.round(F.sum("gain") / F.greatest(F.first("n"), F.lit(1)), 9).alias("score"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", longest: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict, score of each row; rows without a rule follow the models."""
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    parts = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("by", rule_of(F.col("host"), F.col("path"), rules)).withColumn("text", F.concat("host", "path"))
    marked = F.col("host").rlike("|".join(TERMS))
    labelled = ruled.where(marked | F.col("by").isNotNull()).select("text", (F.coalesce(F.col("by.verdict") == "allow", F.lit(False)) & ~marked).alias("good"))
    model = fit(labelled, longest)
    texts = ruled.select(F.col("text").alias("key"), "text").distinct()
    scored = kept(scores(texts, model, longest))
    classes = {r["good"]: r for r in labelled.join(scored, labelled["text"] == scored["key"]).groupBy("good").agg(F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("d")).collect()}
    threshold = 0.0
    if len(classes) == 2:
        (ma, da), (mr, dr) = ((classes[g]["m"], classes[g]["d"]) for g in (True, False))
        threshold = round((ma * dr + mr * da) / (da + dr) if da + dr > 0 else (ma + mr) / 2, 9)
    judged = ruled.join(scored, ruled["text"] == scored["key"], "left")
    learned = F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", learned).alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"))
