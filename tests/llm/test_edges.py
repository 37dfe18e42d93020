"""Every operator and the pipeline on empty tables, nulls, very long texts, repeated rows and columns with clashing names."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, census, debruijn, knn, langid, minhash, mixing, pii, quality, suffix_dedup, urls
from sparkloom.llm import queries as llm_queries

LONG = " ".join(f"the word{i % 977} of x{i}" for i in range(60_000))
ROWS = [(1, "a b c d e f g", "en", "s"), (1, "a b c d e f g", "en", "s"), (2, None, None, None), (3, "", "de", None), (4, LONG, "en", "t"), (None, "of the and 4845168114407329", "de", "t"), (None, None, None, None), (5, " \t\n", "fr", "s"), (6, LONG + " end", "en", "s")]
COLUMNS = "doc_id long, text string, lang string, source string, kept string, node int, row int, t string, found string, id long, data string, batch int, h string, words string, n int, key string, score string, page_id long, url string, slot int, component_id string"


def docs(spark, rows=ROWS):
    clash = ("x", 1, 2, "y", "z", 9, "w", 8, "v", "u", 7, "r", "q", 3, "http://casino.com/" + "a" * 20_000, 5, "c")
    return spark.createDataFrame([(*r, *clash) for r in rows], COLUMNS)


OPERATORS = {
    "minhash": lambda d: minhash.near_duplicates(d),
    "deduplicated": lambda d: minhash.deduplicated(d),
    "quality": lambda d: quality.judge(d),
    "accepted": lambda d: quality.accepted(d),
    "mixing": lambda d: mixing.mix(d, {"s": 2.0}, block=2, slots=10),
    "suffix": lambda d: suffix_dedup.remove_repeated_bytes(d),
    "urls": lambda d: urls.judge(d),
    "bpe": lambda d: bpe.decode(bpe.encode(d, llm_queries.vocabulary_path()), llm_queries.vocabulary_path()),
    "language": lambda d: langid.predict(d, langid.fit(d)),
    "debruijn": lambda d: debruijn.remove_repeated_words(d),
    "pii": lambda d: pii.pseudonymised(d, found_col="found"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_comes_back_or_is_dealt_with(spark, name):
    found = OPERATORS[name](docs(spark))
    got = found.collect()
    fewer = {"accepted": 0, "deduplicated": 8}
    assert len(got) == fewer.get(name, len(ROWS)) and len(set(found.columns)) == len(found.columns)
    if name in ("language", "urls", "suffix", "mixing", "pii"):
        assert OPERATORS[name](docs(spark, [])).count() == 0


def test_long_texts_are_read_whole(spark):
    n = len(LONG.split())
    long = {r.doc_id: r for r in debruijn.remove_repeated_words(docs(spark)).collect()}
    assert long[4].n_words == n and long[6].n_words == n + 1 and long[6].n_removed == n and bytes(long[6].kept) == b"end"
    judged = {r.doc_id: r.n_words for r in quality.judge(docs(spark)).collect()}
    assert judged[6] == n + 1
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark)).collect()}
    assert near[6] == near[4] == 4
    masked = [r.text for r in pii.pseudonymised(docs(spark)).where("doc_id IS NULL AND text IS NOT NULL").collect()]
    assert len(masked) == 1 and "4845168114407329" not in masked[0]


def test_vectors_with_clashing_columns(spark):
    rows = [(i, [float(i % 5), 1.0], "c", 7, 1.0) for i in range(60)] + [(None, [1.0, 1.0], "c", 7, 1.0), (7, [9.0, 9.0], "c", 7, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string, rank int, score double").withColumn("v", knn.scaled(F.col("embedding")))
    got = knn.top_k(df, df.where("vec_id % 50 = 0"), k=3).collect()
    assert Counter(r.query_id for r in got) == {0: 3, 50: 3} and all(r.rank in (1, 2, 3) for r in got)


def test_language_fold_is_held_out(spark):
    """The query learns from the rows of the other folds alone."""
    d = llm_queries._table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r for r in llm_queries.op8_language_id(spark, "/root/testdata/sf0.001").collect()}
    truth = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    told = [i for i in held if got[i].lang_pred != "und"]
    assert sum(got[i].lang_pred == truth[i] for i in told) >= 0.9 * len(told) > 0


def test_scores_are_those_of_a_plain_model(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("aba abb bab", "x"), ("cdc dcd cdd abb", "y"), ("aba baa", "x"), ("ddc", "y")] * 3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = Counter((w, k) for _, t, k in rows for w in t.split())
    def score(word, k):
        logs = {j: math.log((counts[word, j] + 0.5) / (sum(n for (_, x), n in counts.items() if x == j) + 1)) for j in "xy"}
        return logs[k] - sum(logs.values()) / 2
    for text in ("aba abb", "cdc aba ddc", "bab"):
        mean = {k: sum(score(w, k) for w in text.split()) / len(text.split()) for k in "xy"}
        best = max(sorted(mean), key=mean.get)
        got = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
        assert (got.lang_pred, got.score) == (best, pytest.approx(1 / sum(math.exp(v - mean[best]) for v in mean.values()), abs=2e-6))


def test_pseudonyms_are_one_to_one(spark):
    """Values of a kind keep apart, in their own format, and the same value gives the same pseudonym in every text."""
    values = [f"user{i}@site{j}.org" for i in range(40) for j in range(5)] + [f"10.{i}.{j}.7" for i in range(20) for j in range(10)] + [f"2{i:03d}-01-{j:02d}" for i in range(0, 40) for j in range(1, 6)]
    df = spark.createDataFrame([(i, f"see {v} and {v}") for i, v in enumerate(values)], "doc_id long, text string")
    said = {r.doc_id: r.text.split() for r in pii.pseudonymised(df).collect()}
    assert all(w[1] == w[3] for w in said.values()) and len({w[1] for w in said.values()}) == len(values)
    assert all(len(said[i][1]) == len(v) for i, v in enumerate(values) if "@" in v)


@pytest.mark.parametrize("name", ["accepted", "bpe", "quality"])
def test_empty_tables(spark, name):
    assert OPERATORS[name](docs(spark, [])).count() == 0


def test_slots_of_few_digits():
    import numpy as np

    c, hashes = census.Census(0), np.array([1 << 63, 5], np.uint64)
    assert c.ask(hashes, 3).num_rows >= 1 and len(c.repeated(hashes, [])) == 2


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    good = [(100 + i, " ".join(f"the w{i}x{k} of y{i}z{k} and" for k in range(30)), "en", f"src{i % 3}") for i in range(6)]
    for name, rows, want in (("odd", ROWS + good + good[:2], {100 + i for i in range(6)}), ("empty", [], set())):
        docs(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in got} - {4, 6} == want and all(r.slot is not None for r in got)
