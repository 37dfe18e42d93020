"""The attention classifier: held-out accuracy, a plain version of its score, its gradients, odd tables."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import attention
from sparkloom.llm import queries as llm_queries

DATA = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    """Nearly all held-out labels are told; at most 2 % of good documents are called bad."""
    got = {r.doc_id: r for r in llm_queries.op12_quality_classifier(spark, DATA).collect()}
    truth = {r.doc_id: r.quality for r in llm_queries._table(spark, DATA, "labels").collect()}
    assert len(got) == llm_queries._table(spark, DATA, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held) > 60
    good = [i for i in held if truth[i]]
    assert sum(got[i].predicted for i in good) >= 0.98 * len(good)


def plain_features(text, passage):
    words = text.split()
    out = []
    for i in range(0, max(1, len(words)), passage):
        part = words[i : i + passage]
        x = np.zeros(attention.N_FEATURES)
        if part:
            # bytes from the first word's start up to the next passage
            spans, at = [], 0
            for w in words:
                at = text.index(w, at)
                spans.append(at)
                at += len(w)
            chunk = text[spans[i] : spans[i + passage] if i + passage < len(words) else len(text)]
            end = b" " if i + passage >= len(words) else b""
            n = np.bincount(np.frombuffer(chunk + end, np.uint8), minlength=256)
            x[:256] = np.sqrt(n / n.sum())
            x[256:] = math.log1p(len(part)), math.log1p(n.sum() / len(part)), len(set(part)) / len(part), sum(a == b for a, b in zip(part, part[1:], strict=False)) / len(part)
        out.append(x)
    return np.array(out)


def test_features_are_those_of_a_plain_version():
    rng = random.Random(9)
    texts = [b"", b" \n", b"one", b"  a a a\tb\n", "é ü a".encode()] + [b"".join(rng.choice([b"x", b"yy", b"zzz", b"Q#"]) + rng.choice([b" ", b"  ", b"\n"]) for _ in range(rng.randint(1, 40))) for _ in range(20)]
    x, count = attention.features(texts, 5)
    want = [plain_features(t, 5) for t in texts]
    assert count.tolist() == [len(w) for w in want]
    assert np.allclose(x, np.concatenate(want), atol=1e-6)


def test_score_is_that_of_a_plain_version(spark):
    texts = ["good words are here " * 30, "## $$ ## " * 50, "", None, "mixed good words " * 40 + "## $$ " * 40]
    rows = [(i, texts[i % 5]) for i in range(40)]
    labels = [(i, int(i % 5 == 0)) for i in range(40)]
    m = attention.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), passage=16, epochs=15)
    p = m.weights
    for r in attention.predict(spark.createDataFrame(rows[:5], "doc_id long, text string"), m).collect():
        x = np.clip((plain_features((texts[r.doc_id] or "").encode(), 16) - m.mean) / m.scale, -6, 6)
        h = [np.tanh(v @ p["W"] + p["b"]) for v in x]
        gate = [math.exp((np.tanh(v @ p["V"] + p["v"]) / (1 + np.exp(-(v @ p["U"] + p["u"])))) @ p["w"]) for v in h]
        z = sum(g * v for g, v in zip(gate, h, strict=True)) / sum(gate)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(z @ p["c"] + p["c0"][0]))), abs=1e-4)


def test_gradients():
    rng = np.random.default_rng(10)
    x, count, y = rng.normal(size=(9, attention.N_FEATURES)), np.array([2, 3, 4]), np.array([1.0, 0.0, 1.0])
    m = attention.learn(x.astype(np.float32), count, y, 4, width=3, gates=2, epochs=1)
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}

    def loss():
        s = m.forward(x, count)["s"]
        return float(np.mean(np.log1p(np.exp(s)) - y * s))

    found = attention._gradients(m, x, count, y, 0.0)
    for k, w in m.weights.items():
        at = np.unravel_index(int(np.abs(found[k]).argmax()), w.shape)
        was, step = w[at], 1e-5
        w[at] = was + step
        up = loss()
        w[at] = was - step
        down = loss()
        w[at] = was
        assert found[k][at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 0), (1, "a b", "x", 0), (2, None, "y", 0), (None, "c", "z", 0), (3, "long " * 50_000, "w", 0), (4, "q" * 300_000, "v", 0)], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = attention.predict(docs, attention.fit(docs, labels)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "4", "None"] and all(0 <= r.score <= 1 for r in got)
    none = attention.fit(docs, labels.limit(0))
    assert {r.score for r in attention.predict(docs, none).collect()} == {0.5}
    assert attention.predict(docs.limit(0), none).count() == 0
    # the bound holds, whole documents at a time
    some = spark.createDataFrame([(i, "w " * 640) for i in range(200)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    assert 60 < attention.sample(some, marks, 100, 64, "doc_id", "text", "quality").count() < 140
