"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Each Rule bounds one measure of a text; measures are SQL over the counts that
`measures` adds. A document passes if it passes the base test and every rule.

Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts have no words and fail the base
test. Each row is judged alone, so repeated rows get equal results. Columns of the
input other than the id and the text stay only in `accepted`.

Repeated three-word windows are found by their 64-bit hashes within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it not of on or that the they this to was were with you "
    "das dem den der des die ein eine für im ist mit nicht sich sie und von zu "
    "au aux dans de du elle en est et il la le les pour que qui sur un une "
    "al como con del el la las lo los no para por se su una y"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A measure (SQL over the counts) with the least and the most that passes; None: no bound."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None

    def condition(self, double: str = "D") -> str:
        parts = [f"{self.measure} {op} {bound}{double}" for op, bound in ((">=", self.least), ("<=", self.most)) if bound is not None]
        return "(" + " AND ".join(parts) + ")"


RULES = (
    Rule("word_length", "CAST(word_chars AS DOUBLE) / n_words", 2.5, 12.0),
    Rule("symbol_ratio", "CAST(n_symbols AS DOUBLE) / n_words", None, 0.1),
    Rule("stop_word_ratio", "CAST(n_stop_words AS DOUBLE) / n_words", 0.06, None),
    Rule("duplicate_line_ratio", "CAST(n_dup_lines AS DOUBLE) / n_lines", None, 0.4),
)
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
_SPACE = "[\\x20\\x09-\\x0D]+"


def _repeat_words(words: Column) -> Column:
    """Words of three-word windows that come twice or more: sort the windows' hashes, keep equal neighbours, add up what they cover."""
    hashes = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    return hashes


def _covered(ordered: Column) -> Column:
    last = F.size(ordered) - 1
    twice = F.filter(ordered, lambda x, j: ((j > 0) & (F.get(ordered, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(ordered, j + 1)["h"] == x["h"])))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of each row's text."""
    symbols = F.col("t")
    for s in SYMBOLS:
        symbols = F.replace(symbols, F.lit(s), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    read = read.select("doc_id", (F.length("t") - F.length(symbols)).cast("long").alias("n_symbols"), F.filter(F.split("t", _SPACE), lambda w: w != "").alias("words"), F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("lines"))
    words = F.col("words")
    counted = read.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        _repeat_words(words).alias("hashes"),
    )
    counted = counted.withColumn("ordered", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    counted = counted.withColumn("twice", F.when(F.col("ordered").isNotNull(), _covered(F.col("ordered"))))
    at = F.col("twice")
    covered = F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("p")), lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["p"])).alias("n"), i.alias("p")), lambda s: s["n"])
    return counted.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("hashes", "ordered", "twice")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: str = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of each row, base_failed, failed (names of the rules that the text breaks) and kept.

    A row's verdict is one struct that a generator hands on: the optimizer moves no filter or
    column of the caller through it, which would repeat the counts' expressions in each use.
    """
    failed = [f"IF({r.condition()}, NULL, '{r.name}')" for r in rules]
    found = measures(docs, id_col, text_col).withColumn("base_failed", F.expr(base))
    found = found.withColumn("failed", F.expr(f"IF(n_words = 0, ARRAY('empty'), ARRAY_COMPACT(ARRAY({', '.join(failed) or 'NULL'})))"))
    found = found.withColumn("kept", F.expr("NOT base_failed AND SIZE(failed) = 0"))
    return found.select(F.inline(F.array(F.struct(*found.columns))))


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns; judged in place, without a join."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"))
    return judge(packed, rules, id_col="row", text_col="text").where("kept").select("doc_id.*")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, ({BASE}) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(r.condition("") for r in RULES)} AS kept
FROM b
"""
