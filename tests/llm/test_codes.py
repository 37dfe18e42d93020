"""Vector codes against a plain version and against SQL."""

from __future__ import annotations

import hashlib
import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from sparkloom.llm import codes
from sparkloom.llm import queries as llm_queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "vec_id long, embedding array<double>, label string, code string, error int, v string, sum_of int, part int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: id, vector, label. What compressed() returns, with every distance worked out in full."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1]) if kept else 0
    whole = [(i, [math.floor(scale * x) for x in v], k) for i, v, k in kept if len(v) == dim]
    sizes = [dim // parts + (p < dim % parts) for p in range(parts)]
    cut = [sum(sizes[:p]) for p in range(parts + 1)]
    books = [[v[cut[p] : cut[p + 1]] for _, v, _ in whole[:entries]] for p in range(parts)]

    def best(v, p):
        part = v[cut[p] : cut[p + 1]]
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            found = [[] for _ in books[p]]
            for _, v, _ in whole:
                found[best(v, p)[1]].append(v[cut[p] : cut[p + 1]])
            new.append([[sum(c) // len(f) for c in zip(*f, strict=True)] if f else e for f, e in zip(found, books[p], strict=True)])
        books = new
    out, sums = [], Counter()
    for i, v, k in kept:
        told = [best([math.floor(scale * x) for x in v], p) for p in range(parts)] if len(v) == dim else None
        out.append((i, "".join(f"{j:02x}" for _, j in told) if told else None, sum(d for d, _ in told) if told else None, k))
        sums[k] += out[-1][2] or 0
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    seen = {k for _, _, e, k in out if e is not None}
    return sorted(((i, c, e, sums[k] if k in seen else None, digest) for i, c, e, k in out), key=str)


def odd_rows():
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * round(rng.random() * 2, 3) for _ in range(16)], rng.choice(["a", "b", None])) for i in range(70)]
    rows += [(i, [float((i + k) % 3) / 4 for k in range(16)], "tie") for i in range(70, 110)]
    return rows + [(5, [0.5] * 16, "a"), (5, [0.5] * 16, "a"), (None, [-0.25] * 16, "b"), (200, None, "a"), (201, [1.0, None] * 8, "a"), (202, [float("nan")] * 16, "a"), (203, [float("-inf")] * 16, "a"), (204, [1.0] * 5, "short"), (205, [], None)]


@pytest.mark.parametrize("parts", [8, 5])
def test_matches_a_plain_version(spark, parts):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA)
    got = codes.compressed(df, parts=parts).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, parts)


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(5)
    for _ in range(40):
        x, book = rng.integers(-4, 5, (60, rng.integers(1, 9))), None
        book = rng.integers(-4, 5, (rng.integers(1, 17), x.shape[1]))
        full = ((x[:, None, :] - book) ** 2).sum(axis=2)
        at, far = codes.nearest(x, book)
        assert (at == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()


def test_few_rows_many_labels_and_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert codes.compressed(empty).count() == 0
    rows = [(1, [0.5, 2.0, -1.0], "a"), (2, [0.25, 2.0, -1.0], "b")]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA)
    assert sorted(map(tuple, codes.compressed(df).collect()), key=str) == brute(rows)
    only_short = spark.createDataFrame([(1, [], "a", "x", 1, "y", 2, 3)], SCHEMA)
    assert codes.compressed(only_short).first().error == 0


def test_label_sums_join_by_salts(spark):
    df = spark.createDataFrame([(i, "c", i, "hot" if i % 3 else None) for i in range(300)], "vec_id long, code string, error long, label string")
    few, many = (sorted(map(tuple, codes.with_label_errors(df, few=n).collect()), key=str) for n in (10, 0))
    want = {k: sum(i for i in range(300) if ("hot" if i % 3 else None) == k) for k in ("hot", None)}
    assert few == many == sorted(((i, "c", i, k, want[k]) for i in range(300) for k in ["hot" if i % 3 else None]), key=str)


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in odd_rows()], SCHEMA)
    got = codes.encode(df, codes.fit(df))
    assert sorted(got.columns) == sorted(df.columns) and {r.v for r in got.collect()} == {"y"}


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    told = con.execute(codes.ORACLE_SQL)
    names = [c[0] for c in told.description]
    assert sorted(map(tuple, llm_queries.op11_vector_codes(spark, DATA).select(*names).collect())) == sorted(told.fetchall())
