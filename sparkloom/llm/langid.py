"""Language identification by known words first, by shorter and shorter character runs for the rest.

fit() counts the words of labelled documents, at most about `rows_per_language` of
each language (a documented bound: all documents are predicted, a bounded sample is
learned from, picked by a hash of id and text, so that copies of one text don't come
all or not at all). Every word of the sample and every character run of 1 to
`longest` characters of its words is kept. The model is therefore bounded by the
sample alone and is broadcast as two tables of numbers. Languages are taken to be
few; the model has a number for each.

A known word scores its log frequency in each language, relative to the mean over
languages. An unseen word scores the mean over its known runs of the greatest length
that has any, weakened by `backoff` for each step down. A document's scores are the
sums over its words; the highest wins, ties go to the first language by name. The
score is that language's share of the softmax of the mean scores, from 0 to 1.

Null texts and texts without a letter give `und` with score 0, as do all texts when
there was nothing to learn from. Null languages are not learned. Rows count as often
as they come. Other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import kept

_WORD = re.compile(r"[^\W\d_]+")
_COUNTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
_UNSEEN = 1 << 17


def runs(word: str, n: int) -> list[str]:
    """The character runs of length n of a word between its ends, marked by spaces."""
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _runs(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))


def _count(batches):
    for batch in batches:
        by: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
        rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])


class Model:
    """words and runs: the row of `word_scores` and `run_scores`, which have a column for each language."""

    def __init__(self, languages: list[str], words: dict[str, int], word_scores: np.ndarray, runs: dict[str, int], run_scores: np.ndarray, longest: int, backoff: float):
        self.languages, self.words, self.word_scores, self.runs, self.run_scores, self.longest, self.backoff = languages, words, word_scores, runs, run_scores, longest, backoff

    def unseen(self, word: str) -> np.ndarray:
        weight = 1.0
        for n in range(self.longest, 0, -1):
            if found := [at for r in runs(word, n) if (at := self.runs.get(r)) is not None]:
                return weight * self.run_scores[found].mean(axis=0)
            weight *= self.backoff
        return np.zeros(len(self.languages))


def _relative(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    logs = np.log((counts + 0.5) / (totals + 1.0))
    return logs - logs.mean(axis=1, keepdims=True)


def counts(labelled: DataFrame, rows_per_language: int = 5000, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, word and n of the sample."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.try_element_at(F.create_map(*[x for k, n in sorted(size.items()) for x in (F.lit(k), F.lit(rows_per_language / n))]), F.col("lang")) if size else F.lit(0.0)
    sample = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")
    return sample.mapInArrow(_count, _COUNTED).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, rows_per_language: int = 5000, longest: int = 5, backoff: float = 0.7, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of the languages of `labelled`, with all words and runs of the sample."""
    counted = kept(counts(labelled, rows_per_language, id_col, lang_col, text_col))
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    if not languages:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)), longest, backoff)

    def gathered(df: DataFrame, key: str) -> tuple[list[str], np.ndarray]:
        found = df.groupBy(key).agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)]).toArrow()
        return found.column(0).to_pylist(), np.stack([c.to_numpy() for c in found.columns[1:]], axis=1).astype(float)

    words, n = gathered(counted, "word")
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    each = [F.when(F.length(text) >= k, _runs(text, k)).otherwise(F.array().cast("array<string>")) for k in range(1, longest + 1) for text in [padded if k > 1 else F.col("word")]]
    spelled, m = gathered(counted.select("lang", "n", F.explode(F.concat(*each)).alias("run")), "run")
    order = np.array([len(r) for r in spelled])
    sums = np.zeros((longest + 1, len(languages)))
    np.add.at(sums, order, m)
    return Model(languages, {w: i for i, w in enumerate(words)}, _relative(n, n.sum(axis=0)), {r: i for i, r in enumerate(spelled)}, _relative(m, sums[order]), longest, backoff)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        k = len(m.languages)

        class Places(dict):
            """Rows of `table` by word: those of the known words, then those of the unseen ones that were met."""

            def __missing__(self, word):
                nonlocal table
                if len(table) <= len(self):
                    table = np.concatenate((table, np.zeros((1 << 16, k))))
                table[len(self)] = m.unseen(word)
                self[word] = i = len(self)
                return i

        at, table = Places(m.words), m.word_scores
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = _WORD.findall(text.lower()) if text and k else []
                if not words or not any(c.isalpha() for w in words for c in w):
                    out.append(("und", 0.0))
                    continue
                if len(at) > len(m.words) + _UNSEEN:
                    at, table = Places(m.words), m.word_scores
                total = np.zeros(k)
                for i in range(0, len(words), 50_000):
                    rows = [at[w] for w in words[i : i + 50_000]]  # before the table is looked at, as it may grow
                    total += table[rows].sum(axis=0)
                mean = total / len(words)
                best = int(np.argmax(mean))
                out.append((m.languages[best], round(float(1 / np.exp(mean - mean[best]).sum()), 6)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], schema=_PREDICTED)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
