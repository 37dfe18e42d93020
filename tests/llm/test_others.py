from __future__ import annotations

import datetime
import math
import os
import random
import re
import statistics
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, knn, langid, minhash, mixing, pii, quality, urls
from sparkloom.llm import queries as llm_queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TRICKY = [None, "", " ", "\n\n", "a", "the the the the the the", "x" * 5000, "#$%&|<>* é ü\x0b\x0c tab\tend", "dup line\nother\ndup line\n\n"]


def repeat_words(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = TRICKY + ["\n".join(" ".join(rng.choice("the a of cat dog # runs".split()) for _ in range(rng.randint(0, 30))) for _ in range(6)) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.judge(df).collect():
        t = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat_words(words))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_accepted_keeps_columns(spark):
    good = " ".join(f"the w{i} of x{i} and y{i}" for i in range(40))
    df = spark.createDataFrame([(1, good, "x"), (2, "junk", "y"), (None, None, None)], "doc_id long, text string, kept string")
    assert [tuple(r) for r in quality.accepted(df).collect()] == [(1, good, "x")]


@pytest.mark.parametrize("name", ["op2_quality_rules", "op4_exact_top_k"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    told = con.execute(llm_queries.ORACLE_SQL[name])
    names = [c[0] for c in told.description]
    assert sorted(map(tuple, llm_queries.QUERIES[name](spark, DATA).select(*names).collect())) == sorted(told.fetchall())


def test_top_k_with_ties_nulls_and_lengths(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) / 4 for _ in range(3)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0]), (202, [float("nan")] * 3), (203, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (250, [1.0, 2.0]), (251, [1.0, 2.0]), (300, []), (301, []), (350, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").where(knn.usable(F.col("embedding"))).select("vec_id", knn.scaled(F.col("embedding")).alias("v"))
    v = {r.vec_id: r.v for r in df.collect() if r.vec_id is not None}
    df = df.withColumn("score", F.lit("clash"))
    got = knn.top_k(df, df.where("vec_id % 50 = 0"), k=5, pivots=7, block_rows=10).collect()
    assert knn.top_k(df.limit(0), df).count() == knn.top_k(df, df.limit(0)).count() == 0
    want = []
    for q in (x for x in v if x % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], x, strict=True)), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_repeated_ids(spark):
    """Each row is a candidate, and each row of a query's id a query."""
    rows = [(0, [1, 0]), (1, [5, 0]), (1, [3, 0]), (2, [4, 0]), (1, [5, 0]), (3, [0, 9]), (50, [0, 1]), (50, [1, 0]), (100, [2, 1]), (100, [2, 1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    got = Counter(map(tuple, knn.top_k(df, df.where("vec_id % 50 = 0"), k=3, pivots=3, block_rows=2).collect()))
    want = Counter()
    for q, v in (r for r in rows if r[0] % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in rows if i != q)[:3]
        want.update((q, n, i, -s) for n, (s, i) in enumerate(best, 1))
    assert got == want
    assert {(n, i, s) for q, n, i, s in got if q == 0} == {(1, 1, 5), (2, 1, 5), (3, 2, 4)}


def test_bounds_leave_out_far_clusters():
    """Of clustered vectors most pairs of query and cell are left out, and no cell that holds one of the best."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 300
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 20)
    cells = knn.Cells([p.astype(np.int64) for p in x[:64]])
    cell, away = cells.nearest(x)
    norm = np.sqrt((x**2).sum(axis=1))
    cells.summarise([(c, (cell == c).sum(), away[cell == c].max(), norm[cell == c].max()) for c in np.unique(cell)], 500)
    q, scores = x[::20], x[::20] @ x.T
    least = np.sort(scores, axis=1)[:, -6]
    i, c = cells.needed(q, least)
    pairs = set(zip(i.tolist(), c.tolist(), strict=True))
    assert {(j, int(cell[y])) for j, y in zip(*np.nonzero(scores >= least[:, None]), strict=True)} <= pairs
    assert len(pairs) < 0.35 * len(q) * len(np.unique(cell))


def edf(units):
    """A plain simulation of one period."""
    period, done, out = sum(u for _, u in units), {s: 0 for s, _ in units}, []
    for slot in range(period):
        ready = [(-(-(done[s] + 1) * period // u), s) for s, u in units if done[s] * period // u <= slot]
        s = min(ready)[1]
        done[s] += 1
        out.append(s)
    return out


def test_schedule_is_fair(spark):
    units = [("a", 7), ("b", 3), ("c", 1), ("d", 12)]
    got = mixing.schedule(spark.createDataFrame(units, "source string, units int")).orderBy("start").collect()
    assert [r.source for r in got] == edf(units)
    ran, period = Counter(), 23
    for slot, r in enumerate(got, 1):
        ran[r.source] += 1
        assert all(abs(Fraction(slot * u, period) - ran[s]) < 1 for s, u in units)


def plain_mix(rows, weights, block, default=1.0):
    """Block, slot and place of each (id, source), by plain loops."""
    import hashlib

    by_source: dict[str, list] = {}
    for i, source in rows:
        by_source.setdefault(source, []).append((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i))
    every = [Fraction(str(x)) for x in [*weights.values(), default]]
    unit = Fraction(math.gcd(*[x.numerator * math.lcm(*[y.denominator for y in every]) // x.denominator for x in every]), math.lcm(*[y.denominator for y in every]))
    power = {s: Fraction(str(weights.get("" if s is None else s, default))) for s in by_source}
    units = {s: int(power[s] / unit) for s in sorted(power, key=lambda s: (s is not None, s)) if power[s] > 0}
    ran = edf([((s is not None, s), u) for s, u in units.items()])
    starts = {s: [slot for slot, x in enumerate(ran) if x == (s is not None, s)] for s in units}
    out = {}
    for s, found in by_source.items():
        for n, (_, i) in enumerate(sorted(found)):
            b, place = divmod(n, block)
            out[i] = (b, b // units[s] * len(ran) + starts[s][b % units[s]], place) if s in units else (None, None, None)
    return out


def test_mix_holds_to_its_weights(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    weights = {"a": 1.0, "b": 3.0, "c": 0.0, "": 0.5}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=4, default=2.0)
    placed = got.select("row.doc_id", "source", "block", "slot", "place").collect()
    assert {r.doc_id: (r.block, r.slot, r.place) for r in placed} == plain_mix(rows, weights, 4, 2.0)
    assert all((r.slot is None) == (r.source == "c") for r in placed)
    until = mixing.balanced(got).first().until
    for slot in range(1, until + 1):
        ran = Counter(r.source for r in placed if r.slot is not None and r.slot < slot and r.place == 0)
        assert all(abs(ran[s] - Fraction(slot * units, 13)) < 1 for s, units in (("a", 2), ("b", 6), ("d", 4), (None, 1)))


@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 1 / 3, "c": 0.0004}, {"a": 4.0, "b": 3.0, "c": 0.5, "d": 1 / 7}, {"a": 0.123, "b": 0.877, "c": 0.77, "d": 0.01}])
def test_weights_are_held_exactly_over_periods(spark, weights):
    """Less than a block off the weights as given, at every slot of more than one period."""
    exact = {s: Fraction(str(w)).limit_denominator(1_000_000) for s, w in weights.items()}
    total = sum(exact.values())
    table = mixing.schedule(mixing.units(spark.createDataFrame([(s,) for s in exact], "source string"), weights, 1000, 0.7, "source"))
    ran = [r.source for r in table.orderBy("start").collect()]
    done = Counter()
    for slot, s in enumerate(ran + ran[: len(ran) // 3], 1):
        done[s] += 1
        assert all(abs(slot * w / total - done[x]) < 1 for x, w in exact.items())
    assert len(ran) > 100


def test_queries_weights_are_held_beyond_a_period(spark):
    """The query's own weights on twenty sources, over all slots of 60,000 rows in blocks of one."""
    exact = {f"src{i}": Fraction(str(llm_queries.TARGET_WEIGHTS.get(f"src{i}", 1.0))) for i in range(20)}
    rows = spark.range(60_000).selectExpr("id AS doc_id", "concat('src', id % 20) AS source")
    placed = mixing.mix(rows, llm_queries.TARGET_WEIGHTS, block=1)
    until, done = mixing.balanced(placed).first().until, Counter()
    for r in placed.where(F.col("slot") <= until).orderBy("slot").select("slot", "source").collect():
        done[r.source] += 1
        assert all(abs((r.slot + 1) * w / sum(exact.values()) - done[x]) < 1 for x, w in exact.items())
    assert until > 15_000


def test_many_sources_are_scheduled_in_time(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "concat('s', id % 1500) AS source")
    got = mixing.mix(rows, {}).agg(F.count("*"), F.count_distinct("slot")).first()
    assert tuple(got) == (6000, 1500)


def test_mix_keeps_every_row(spark):
    rows = [(i, ["a", "b", None][0 if i % 3 else i % 2 + 1], "t", 1) for i in range(500)] + [(7, "a", "t", 1), (None, "a", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int")
    assert Counter(map(tuple, mixing.mixed(df, block=4, slots=20).collect())) == Counter(rows)
    placed = mixing.mix(df, block=4, slots=20, weights={"a": 0.5, "b": 0.3, "": 0.2}).select("source", "slot", "place").collect()
    assert len({(r.slot, r.place) for r in placed}) == len(rows)
    assert all(len({r.source for r in placed if r.slot == s}) == 1 for s in {r.slot for r in placed})
    assert mixing.mixed(df.limit(0)).count() == 0
    assert mixing.mixed(df, weights={"b": 1.0}, default=0.0).select("source").distinct().collect() == [("b",)]


def test_bpe_agrees_with_the_library(spark):
    from tokenizers import Tokenizer

    path = llm_queries.vocabulary_path()
    library, rng = Tokenizer.from_file(path), random.Random(4)
    parts = ["a", "B", "'s", "é", "é", " ", "\n", "1", "²", "_", "Σ", "İ", "中", "\x1c", "\x85", "<|endoftext|>", "😀", "'LL", "thanedble", "12.5%"]
    texts = [t for t in TRICKY if t is not None] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(200)] + ["ab" * 3000]
    rows = list(enumerate(texts)) + [(9999, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in bpe.decode(bpe.encode(df, path), path).collect():
        ids = library.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_language_is_told_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where("doc_id % 4 <> 2"))
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 4 = 2 AND lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got) > 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ..."), (4, "²"), (5, "the")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect() if r.doc_id < 5} == dict.fromkeys([1, 2, 3, 4], "und")
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_language_model_keeps_all_words_and_runs(spark):
    rng = random.Random(6)
    letters = {"a": "abcdefghij", "b": "efghijklmn", "c": "ijklmnopqé"}
    rows = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randint(3, 9))) for _ in range(250)), k) for i, k in enumerate(["a", "b", "c"] * 60)]
    model, words, counts = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")), Counter(), Counter()
    for _, text, k in rows:
        for w in text.split():
            words[w, k] += 1
            counts.update((r, k) for n in range(1, 6) for r in langid.runs(w, n))
    assert set(model.words) == {w for w, _ in words} and len(model.words) > 30_000
    assert set(model.runs) == {r for r, _ in counts} and len(model.runs) > 60_000
    for known, scores, n, same in ((model.words, model.word_scores, words, lambda x, y: True), (model.runs, model.run_scores, counts, lambda x, y: len(x) == len(y))):
        for x in rng.sample(sorted(known), 20):
            logs = [math.log((n[x, k] + 0.5) / (sum(c for (y, j), c in n.items() if j == k and same(x, y)) + 1)) for k in "abc"]
            assert list(scores[known[x]]) == pytest.approx([v - sum(logs) / 3 for v in logs])
    assert {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()} == {i: k for i, _, k in rows}


def test_language_sample_takes_copies_of_a_text_one_by_one(spark):
    rows = [(i, "same words here", "a") for i in range(4000)]
    counted = langid.counts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=1000)
    assert {r.word for r in counted.collect()} == {"same", "words", "here"} and all(800 < r.n < 1200 for r in counted.collect())


def luhn(s):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    text = "und.34@mail7.example.com 97.51.17.173 4845168114407329 9807915762804490 +1 (017) 555-7713 123-45-6789 000-12-3456 2024-02-29 31/12/1999 30.02.2001 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    rows = [(1, text, "c"), (2, "4845-1681-1440-7329 und.34@mail7.example.com", "c"), (3, None, None), (4, "", ""), (5, "plain, no. 12", "c")]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string, found string")).collect()}
    mail, ip, card, decoy, *rest = got[1].text.split(" ")
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", mail) and mail != "und.34@mail7.example.com"
    assert ip != "97.51.17.173" and all(0 <= int(x) <= 255 for x in ip.split("."))
    assert card != "4845168114407329" and len(card) == 16 and luhn(card) and decoy == "9807915762804490"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", " ".join(rest[:3])) and rest[3] != "123-45-6789" and rest[4] == "000-12-3456"
    assert datetime.date.fromisoformat(rest[5]) and datetime.datetime.strptime(rest[6], "%d/%m/%Y") and rest[7] == "30.02.2001"
    assert re.search(r'token = "[0-9a-f]{40}"', got[1].text) and "04dbebab" not in got[1].text
    assert got[2].text.replace("-", "").split(" ")[0] == card and got[2].text.split(" ")[1] == mail
    assert (got[3].text, got[4].text, got[5].text) == (None, "", "plain, no. 12")


def test_number_permutation_is_one_to_one(spark):
    df = spark.range(189 * 7).select((F.col("id") / 7).cast("long").alias("a"), (F.col("id") % 7).alias("b"))
    got = df.select(pii.feistel_number("k", F.lit("t"), F.col("a"), F.col("b"), F.lit(189), F.lit(7)).alias("p")).select("p.a", "p.b").collect()
    assert len({tuple(r) for r in got}) == 189 * 7 and all(0 <= r.a < 189 and 0 <= r.b < 7 for r in got)


def test_url_parts_and_rules(spark):
    rows = [(1, "https://A.Example.NET/en/1?x#y"), (2, "http://example.com/de/9"), (3, "http://b.org/fr/"), (4, "http://x.net"), (5, None), (6, "no scheme/at all"), (7, "http://casino-win.example.com/en/1"), (8, "http://h?q/net/"), (9, "http://myexample.net/en/1"), (1, "https://A.Example.NET/en/1?x#y")]
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/") and got[2] == ("example.com", "/de/9", "example.com/de/")
    assert got[3] == ("b.org", "/fr/", "org/fr/") and got[4] == ("x.net", "", None) and got[5] == got[6] == ("", "", None)
    assert got[8] == ("h", "", None) and got[9] == ("myexample.net", "/en/1", "net/")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def plain_verdicts(pages):
    """Verdicts of learned rows from plain counts of all runs."""
    parts = {i: ((u := url.split("://", 1)[1]).partition("/")[0], "/" + u.partition("/")[2]) for i, url in pages}
    bad = lambda h: any(t in h for t in urls.TERMS)
    def by(h, p):
        found = [(len(r), v) for v, r in urls.RULES if (h == (x := r.partition("/"))[0] or h.endswith("." + x[0])) and p.startswith("/" + x[2])]
        return max(found)[1] if found else None
    spelled = lambda t: [t[i - n : i] for i in range(1, len(t) + 1) for n in range(1, min(5, i) + 1)]
    good, count = {}, Counter()
    for i, (h, p) in parts.items():
        if bad(h) or by(h, p):
            good[i] = by(h, p) == "allow" and not bad(h)
            count.update((r, good[i]) for r in spelled("^" + h + p))
    known = {r for r, _ in count}
    total = {g: sum(n for (r, k), n in count.items() if k == g and len(r) == 1) for g in (True, False)}
    def ratio(r):
        share = [(count[r, g] + 0.5) / ((count[r[:-1], g] if len(r) > 1 else total[g]) + 32) for g in (True, False)]
        return math.log(share[0] / share[1])
    gain = {r: ratio(r) - (ratio(r[1:]) if len(r) > 1 else 0) for r in known}
    score = {i: round(sum(gain.get(r, 0) for r in spelled("^" + h + p)) / len(h + p), 9) for i, (h, p) in parts.items()}
    (ma, da), (mr, dr) = ((statistics.mean(x), statistics.pstdev(x)) for g in (True, False) for x in [[score[i] for i in good if good[i] == g]])
    threshold = round((ma * dr + mr * da) / (da + dr), 9)
    return len(known), {i: by(*parts[i]) or ("allow" if score[i] >= threshold else "block") for i in parts}, score


def test_url_model_keeps_all_runs(spark):
    rng = random.Random(7)
    name = lambda cs: "".join(rng.choice(cs) for _ in range(12))
    pages = [(i, f"http://{name('abcdefgh')}.{h}{name('stuvwxyz0123456789')}") for i, h in enumerate(["example.net/en/", "example.com/de/", "casino.com/", "org/fr/", "site.info/", "other.info/"] * 200)]
    n, verdicts, score = plain_verdicts(pages)
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()
    assert n > 20_000 and {r.page_id: r.verdict for r in got} == verdicts
    assert all(r.score == pytest.approx(score[r.page_id], abs=2e-9) for r in got)
    texts = spark.createDataFrame([(u, u) for _, u in pages[:50]], "key string, text string")
    model = urls.fit(spark.createDataFrame([(u, i % 2 == 0) for i, u in pages], "text string, good boolean"))
    same = [{r.key: round(r.score, 8) for r in urls.scores(texts, model, frequent=k).collect()} for k in (1, 50, 10_000)]
    assert same[0] == same[1] == same[2] and len(same[0]) == 50


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    got = {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()}
    passed = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert got and got <= passed


def test_pipeline_rows(spark):
    import hashlib

    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [tuple(r) for r in pii.pseudonymised(minhash.deduplicated(quality.accepted(docs), size=5, percent=80)).select("doc_id", "source", "text").collect()]
    library = Tokenizer.from_file(llm_queries.vocabulary_path())
    placed, want = plain_mix([(i, s) for i, s, _ in texts], llm_queries.TARGET_WEIGHTS, 32), Counter()
    for i, _, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        told = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want[i, len(ids), *told, *placed[i]] += 1
    got = corpus_pipeline.run(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "block", "slot", "place")
    assert Counter(map(tuple, got.collect())) == want and len(want) > 32 and len({r[5] for r in want}) > 1
