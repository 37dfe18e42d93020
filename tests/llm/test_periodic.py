"""Periodic runs against a plain search of all periods."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import periodic
from sparkloom.llm import queries as llm_queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(words, exponent=4, shortest=6):
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            length = j - i + q
            run = words[i : i + length]
            if j > i and length >= max(shortest, exponent * q) and not any(all(a == b for a, b in zip(run, run[d:], strict=False)) for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(6)
    out = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "x y " * 9, "é b\x0bc " * 7, "A a " * 5]
    for _ in range(150):
        k = rng.choice([1, 2, 2, 3, 5])
        noise = [rng.choice("abcde"[:k]) for _ in range(rng.randint(0, 40))]
        base = [rng.choice("abcde"[:k]) for _ in range(rng.randint(1, 7))]
        words = noise[:10] + base * rng.randint(0, 9) + base[: rng.randint(0, len(base))] + noise[10:] + base * rng.randint(0, 6)
        out.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words))
    return out


def test_matches_all_periods(spark):
    rows = [(i % 140 if i % 11 else None, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(i, t, 1, "x", 5, "y") for i, t in rows], "doc_id long, text string, runs int, collapsed string, n_words int, period string")
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(words)
        want.append((i, len(words), tuple(runs), collapsed(words, runs)))
    got = [(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.repeats(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic.repeats(df.limit(0)).count() == 0


def test_other_exponents(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    for exponent, shortest in ((5, 6), (9, 7), (4, 30)):
        got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.repeats(df, exponent, shortest).collect()}
        assert got == {i: brute(re.findall(r"[^\x20\x09-\x0D]+", t or ""), exponent, shortest) for i, t in enumerate(texts())}


def test_vocabulary_of_squares_is_complete():
    """With two periods in place of four, every run of the text is found."""
    rng = random.Random(7)
    for _ in range(150):
        k = rng.choice([1, 2, 2, 3])
        w = [rng.randrange(k) for _ in range(rng.randint(1, 40))]
        base = [rng.randrange(k) for _ in range(rng.randint(1, 8))]
        w = w[:12] + base * rng.randint(0, 4) + w[12:] + base * 2
        numbers = np.unique(w, return_inverse=True)[1]
        got = periodic.runs_of(np.append(numbers, numbers.max() + 1), 2, 2)
        assert sorted(zip(*(c.tolist() for c in got), strict=True), key=lambda r: (r[0], r[2])) == brute(w, 2, 2)


def test_long_text_in_small_chunks(monkeypatch):
    rng = np.random.default_rng(8)
    words = rng.integers(1, 1 << 60, 60_000).astype(np.uint64)
    words = words[[i if i < 500 else 500 + (i - 500) % 9000 for i in range(60_000)]]
    words[:70] = words[:7].tolist() * 10
    monkeypatch.setattr(periodic, "_CHUNK", 5000)
    assert [r.tolist() for r in periodic.document_runs([words[:50], words, words[:0]])] == [[[0, 50, 7]], [[0, 70, 7], [500, 59_500, 9000]], []]


def plain_query(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute(w)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        told = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        out.append((i, len(runs), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_matches_a_plain_version(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in llm_queries._table(spark, DATA, "documents").collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 6000]
    empty = [(i, t) for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0 for t in ("", None, " ", "one", "a b c d e f g h i j k l m n o p q r s t")]
    spark.createDataFrame(short + empty + [(None, "a " * 8)], "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = llm_queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == plain_query(short + empty + [(None, "a " * 8)])
    assert sum(r.n_runs > 0 for r in got) > 10
