"""Event-time state over several batches: out of order, late, restarted; against plain versions."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter, OrderedDict

from pyspark.sql import functions as F

from sparkloom.plans import streams
from sparkloom.streaming import timed

START = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, id long, v double"


def written(spark, folder, batches, first=0):
    """A file for each batch, in the order in which the stream reads them."""
    import os
    import shutil

    os.makedirs(folder, exist_ok=True)
    for n, rows in enumerate(batches, first):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}-parts/{n}")
        part = next(f for f in os.listdir(f"{folder}-parts/{n}") if f.startswith("part-"))
        shutil.copy(f"{folder}-parts/{n}/{part}", f"{folder}/{n:04d}.parquet")
        os.utime(f"{folder}/{n:04d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))


def stream_of(spark, folder, files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def shuffled(n=600, batches=4, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice("aaab"), START + dt.timedelta(seconds=rng.randint(0, 40_000)), i, round(rng.random() * 100, 2)) for i in range(n)]
    return [rows[i::batches] for i in range(batches)]


def test_rolling_windows_of_several_batches_out_of_order(spark, tmp_path):
    batches = shuffled()
    written(spark, f"{tmp_path}/e", batches)
    got = streams._ended(timed.rolling(stream_of(spark, f"{tmp_path}/e"), "k", "ts", "v", 20, 1800.0), "update", ["k"]).collect()
    for r in got:
        rows = sorted((t, v) for k, t, _, v in sum(batches, []) if k == r.k)[-20:]
        rows = [(t, v) for t, v in rows if t >= rows[-1][0] - dt.timedelta(seconds=1800)]
        assert (r.n, r.total) == (len(rows), math.fsum(v for _, v in rows))
    assert {r.k for r in got} == {"a", "b"}


def test_one_key_of_many_frames(spark, tmp_path):
    """The last values of a key are right also where its rows fill several frames in any order."""
    rng = random.Random(2)
    rows = [("a", START + dt.timedelta(seconds=i), i, float(i)) for i in range(25_000)]
    rng.shuffle(rows)
    written(spark, f"{tmp_path}/e", [rows])
    r = streams._ended(timed.rolling(stream_of(spark, f"{tmp_path}/e"), "k", "ts", "v", 20), "update", ["k"]).first()
    assert (r.n, r.mean) == (20, 24_989.5)


def test_late_rows_are_dropped_and_silent_keys_forgotten(spark, tmp_path):
    t = lambda h: START + dt.timedelta(hours=h)
    batches = [[("a", t(1), 1, 1.0), ("b", t(1), 2, 5.0)], [("a", t(30), 3, 3.0)], [("a", t(31), 4, 4.0), ("a", t(2), 5, 100.0)], [("a", t(32), 6, 6.0)]]
    written(spark, f"{tmp_path}/e", batches)
    found = timed.rolling(stream_of(spark, f"{tmp_path}/e"), "k", "ts", "v", 10, lateness="1 hour", forget=10 * 3600.0)
    got = {r.k: (r.n, r.total) for r in streams._ended(found, "update", ["k"]).collect()}
    assert got["b"] == (0, 0.0)
    assert got["a"] == (4, 14.0)  # the row of hour 2 came behind the watermark


def plain_limited(rows, span, most, until):
    fired, out = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if t >= until:
            continue
        recent = [f for f in fired.get(k, []) if f > t - dt.timedelta(seconds=span)]
        out[i] = "not_satisfied" if v <= 60 else "fired" if len(recent) < most else "rate_limited"
        fired[k] = recent + ([t] if out[i] == "fired" else [])
    return out


def test_firing_limits_do_not_depend_on_batches(spark, tmp_path):
    rows = sum(shuffled(300, 1, seed=3), [])
    rows.sort(key=lambda r: r[1])
    rng = random.Random(4)
    near = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randint(0, 1500)))  # out of order within the lateness
    end = max(r[1] for r in rows)
    want = plain_limited(rows, 3600, 3, end - dt.timedelta(seconds=1800))
    for name, batches in (("one", [rows]), ("four", [near[i : i + 75] for i in range(0, 300, 75)])):
        if name == "four":  # and rows behind the watermark, which decide nothing
            batches = [*batches, [("a", START, 1000, 99.0), ("b", START + dt.timedelta(seconds=60), 1001, 99.0)]]
        written(spark, f"{tmp_path}/{name}", batches)
        found = timed.limited(stream_of(spark, f"{tmp_path}/{name}"), "k", "ts", "id", "v > 60", 3600, 3, "30 minutes")
        got = {r.id: r.outcome for r in streams._collected(found).collect()}
        assert got == want
    assert set(Counter(want.values())) == {"fired", "rate_limited", "not_satisfied"}


def test_seen_set_is_bounded(spark, tmp_path):
    rng = random.Random(5)
    batches = [[(str(rng.randint(0, 30)), START + dt.timedelta(seconds=60 * b + i), 0, 0.0) for i in range(40)] for b in range(3)]
    written(spark, f"{tmp_path}/e", batches)
    got = streams._collected(timed.first_seen(stream_of(spark, f"{tmp_path}/e"), "k", "ts", size=12, shards=1)).collect()
    seen, want = OrderedDict(), []
    for rows in batches:
        for k, t, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
            if k not in seen:
                want.append((k, int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)))
            seen[k] = None
            seen.move_to_end(k)
            if len(seen) > 12:
                seen.popitem(last=False)
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 31


def analyse(window):
    kinds = window.groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    most = kinds.agg(F.max_by("k", F.struct("n", "k")).alias("top"))
    return kinds.crossJoin(most).select(F.concat("k", F.when(F.col("mean") > 50, "high").otherwise("low")).alias("identity"), F.concat(F.lit("kind "), "k").alias("title"), F.expr("IF(k = top, k, NULL)").alias("regime"))


def test_rolling_analysis_tells_changes_and_restarts(spark, tmp_path):
    """Three batches, then a fourth after a restart: findings are told once, regimes when they change."""
    at = lambda n: START + dt.timedelta(seconds=n)
    batches = [[("a", at(i), i, 10.0) for i in range(20)], [("b", at(100 + i), i, 90.0) for i in range(5)], [("b", at(200 + i), i, 90.0) for i in range(20)], [("b", at(50), 1, 5.0), *[("c", at(300 + i), i, 1.0) for i in range(25)]]]
    written(spark, f"{tmp_path}/e", batches[:3])
    folder = f"{tmp_path}/told"
    timed.rolling_analysis(stream_of(spark, f"{tmp_path}/e"), analyse, folder, ["ts", "id"], rows=24)
    read = lambda: {n: sorted((r.kind, r.subject or "", r.size or 0) for r in spark.read.parquet(f"{folder}/events").where(F.col("batch") == n).collect()) for n in range(4)}
    first = read()
    assert first[0] == [("new_finding", "kind a", 0), ("regime_changed", "kind a", 0), ("window_advanced", "", 20)]
    assert first[1] == [("new_finding", "kind b", 0), ("window_advanced", "", 24)]
    assert first[2] == [("regime_changed", "kind b", 0), ("window_advanced", "", 24)]
    written(spark, f"{tmp_path}/e", batches[3:], first=3)
    timed.rolling_analysis(stream_of(spark, f"{tmp_path}/e"), analyse, folder, ["ts", "id"], rows=24)
    assert read()[3] == [("new_finding", "kind c", 0), ("regime_changed", "kind c", 0), ("window_advanced", "", 24)] and {n: read()[n] for n in range(3)} == {n: first[n] for n in range(3)}
