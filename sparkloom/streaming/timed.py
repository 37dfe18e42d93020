"""Streaming operators with event-time state and timers: rolling windows, firing limits, bounded seen-sets, rolling analysis.

State is kept by RocksDB, a list for each key; a batch's rows come in frames, which are merged
into the list one by one and cut at once, so a task holds one frame and what is kept. Rows may
come out of order; rows behind the watermark are dropped by Spark. Sums are rounded once
(math.fsum), so they don't depend on the order of arrival.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ready(spark: SparkSession) -> None:
    """State with timers needs the RocksDB provider, in the session that starts the stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _in_time(frame: pd.DataFrame, timerValues) -> pd.DataFrame:
    """The rows that aren't behind the watermark; Spark's own filter lags a batch."""
    return frame[frame["timed_at"] >= timerValues.getCurrentWatermarkInMs() * 1000]


class _Rolling(StatefulProcessor):
    """The last `size` values of a key that are at most `age` microseconds older than its newest."""

    def __init__(self, key: str, size: int | None, age: int | None, forget: int | None, timely: bool):
        self.key, self.size, self.age, self.forget, self.timely = key, size, age, forget, timely

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, value double")

    def _cut(self, rows: list[tuple[int, float]]) -> list[tuple[int, float]]:
        rows.sort()
        if self.size is not None:
            del rows[: -self.size]
        if self.age is not None and rows:
            newest = rows[-1][0]
            rows = [r for r in rows if r[0] >= newest - self.age]
        return rows

    def _told(self, key: tuple, rows: list[tuple[int, float]]) -> pd.DataFrame:
        total = math.fsum(v for _, v in rows)
        return pd.DataFrame({self.key: [key[0]], "n": [len(rows)], "total": [total], "mean": [total / len(rows) if rows else math.nan], "newest": [rows[-1][0] if rows else -1]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(r[0]), float(r[1])) for r in self.held.get()] if self.held.exists() else []
        for frame in rows:
            frame = _in_time(frame, timerValues) if self.timely else frame
            held = self._cut(held + list(zip(frame["timed_at"].tolist(), frame["timed_value"].tolist(), strict=True)))
        if not held:
            return
        self.held.put(held)
        if self.forget is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer((held[-1][0] + self.forget) // 1000)
        yield self._told(key, held)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield self._told(key, [])

    def close(self) -> None:
        pass


def rolling(events: DataFrame, key: str, at: str, value: str, size: int | None = None, age: float | None = None, lateness: str | None = None, forget: float | None = None) -> DataFrame:
    """After each micro-batch a row of each key that got rows: n, total, mean and newest (microseconds) of its last `size` values, at most `age` seconds older than its newest.

    With `lateness` rows behind the watermark are dropped, and with `forget` a key whose
    newest row lies so many seconds behind it is put out once more with n = 0 and its state
    is freed. Without rows or values a key has no state; null keys, times and values are left out.
    """
    if size is None and age is None:
        raise ValueError("a rolling window needs a size or an age")
    if forget is not None and lateness is None:
        raise ValueError("forgetting goes by the watermark, which needs a lateness")
    _ready(events.sparkSession)
    rows = events.dropna(subset=[key, at, value])
    rows = rows.withWatermark(at, lateness) if lateness else rows
    rows = rows.select(key, at, F.unix_micros(at).alias("timed_at"), F.col(value).cast("double").alias("timed_value"))
    told = f"`{key}` {dict(events.dtypes)[key]}, n long, total double, mean double, newest long"
    micros = [None if s is None else round(s * 1_000_000) for s in (age, forget)]
    return rows.groupBy(key).transformWithStateInPandas(_Rolling(key, size, *micros, lateness is not None), told, "Update", "EventTime" if lateness else "None")


class _Limited(StatefulProcessor):
    """Decides waiting rows in the order of their times, once the watermark has passed them."""

    def __init__(self, key: str, span: int, most: int):
        self.key, self.span, self.most = key, span, most

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, satisfied boolean")
        self.fired = handle.getListState("fired", "at long")

    def _wait(self, waiting: list) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if waiting:
            self.handle.registerTimer(min(w[0] for w in waiting) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = _in_time(frame, timerValues)
            if len(frame):
                self.waiting.appendList(list(zip(frame["timed_at"].tolist(), frame["timed_id"].tolist(), frame["timed_satisfied"].tolist(), strict=True)))
        self._wait([tuple(r) for r in self.waiting.get()] if self.waiting.exists() else [])
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, waiting = [w for w in every if w[0] < mark], [w for w in every if w[0] >= mark]
        fired = [int(r[0]) for r in self.fired.get()] if self.fired.exists() else []
        out = []
        for at, number, satisfied in ready:
            fired = [f for f in fired if f > at - self.span]
            told = "not_satisfied" if not satisfied else "fired" if len(fired) < self.most else "rate_limited"
            if told == "fired":
                fired.append(at)
            out.append((number, at, told))
        # what is kept: rows that wait, and at most `most` firings
        self.fired.put([(f,) for f in fired]) if fired else self.fired.clear()
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        self._wait(waiting)
        if out:
            yield pd.DataFrame({self.key: [key[0]] * len(out), "id": [o[0] for o in out], "at": [o[1] for o in out], "outcome": [o[2] for o in out]})

    def close(self) -> None:
        pass


def limited(events: DataFrame, key: str, at: str, identity: str, satisfied: str, span: float, most: int, lateness: str) -> DataFrame:
    """id, at (microseconds) and outcome of each row that the watermark has passed: fired, rate_limited (`most` have fired for the key within the last `span` seconds) or not_satisfied (by the SQL predicate).

    Rows wait until the watermark passes them and are decided in the order of time and id, so
    the outcome doesn't depend on how they are split into batches. Rows behind it are dropped.
    """
    _ready(events.sparkSession)
    rows = events.dropna(subset=[key, at, identity]).withWatermark(at, lateness)
    rows = rows.select(key, at, F.unix_micros(at).alias("timed_at"), F.col(identity).cast("long").alias("timed_id"), F.coalesce(F.expr(satisfied), F.lit(False)).alias("timed_satisfied"))
    told = f"`{key}` {dict(events.dtypes)[key]}, id long, at long, outcome string"
    return rows.groupBy(key).transformWithStateInPandas(_Limited(key, round(span * 1_000_000), most), told, "Append", "EventTime")


class _Seen(StatefulProcessor):
    """The `size` identities of a shard that were met last."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle) -> None:
        self.seen = handle.getListState("seen", "identity string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = dict.fromkeys(r[0] for r in self.seen.get()) if self.seen.exists() else {}
        for frame in rows:
            fresh = []
            for identity, at in sorted(zip(frame["timed_identity"].tolist(), frame["timed_at"].tolist(), strict=True), key=lambda r: (r[1], r[0])):
                if known.pop(identity, self) is self:
                    fresh.append((identity, at))
                known[identity] = None
                if len(known) > self.size:
                    del known[next(iter(known))]
            if fresh:
                yield pd.DataFrame({"identity": [f[0] for f in fresh], "at": [f[1] for f in fresh]})
        self.seen.put([(k,) for k in known])

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, identity: str, at: str, size: int = 5000, shards: int = 8) -> DataFrame:
    """identity and at (microseconds) of the rows whose identity is not among those that were met last: `size` in all, the same number in each of `shards` parts by hash. Meeting one anew makes it the newest."""
    _ready(events.sparkSession)
    name = F.col(identity).cast("string")
    rows = events.where(name.isNotNull()).select(F.pmod(F.xxhash64(name), F.lit(shards)).cast("int").alias("shard"), name.alias("timed_identity"), F.coalesce(F.unix_micros(at), F.lit(-1)).alias("timed_at"))
    return rows.groupBy("shard").transformWithStateInPandas(_Seen(max(1, size // shards)), "identity string, at long", "Append", "None")


def first_times(events: DataFrame, identity: str, at: str) -> DataFrame:
    """identity and at (microseconds) of the first row of every identity, of any number of them: a least time for each, kept in Spark's own state; nothing is forgotten.

    In update mode a row that comes late but is earlier puts its identity out once more, so the last row of an identity counts.
    """
    _ready(events.sparkSession)
    name = F.col(identity).cast("string")
    return events.where(name.isNotNull()).groupBy(name.alias("identity")).agg(F.min(F.unix_micros(at)).alias("at"))


def rolling_analysis(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], folder: str, order: list[str], rows: int | None = 10_000, age: float | None = None, each: str | None = None, remembered: int = 5000) -> None:
    """Runs analyse() on the last rows of a stream after each of its micro-batches and tells what changed.

    The window is the last `rows` rows by `order`, and at most `age` seconds older than the
    newest by order's first column. `analyse` gives findings: identity, title and regime
    (null where a finding isn't one of a regime). Events of a batch are rows of `kind`,
    `subject` and `size`: window_advanced (size of the window), new_finding (an identity that
    isn't among the last `remembered`), and regime_changed (the first regime by title is
    another one than told last). Each batch reads what the one before has written under
    `folder` and writes its own, so a batch that is run again writes the same; `each` is the
    folder of the stream's own offsets if it is another one.
    """
    spark = stream.sparkSession
    if rows is None and age is None:
        raise ValueError("a rolling window needs a number of rows or an age")
    if rows is not None and rows > 1_000_000:
        raise ValueError("a window of rows is sorted by one task in the end: at most 1,000,000; use an age")

    def before(part: str, number: int, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{part}/batch={number - 1}") if number else spark.createDataFrame([], schema)

    def step(batch: DataFrame, number: int) -> None:
        window = before("window", number, batch.schema).unionByName(batch)
        if age is not None:
            newest = window.agg(F.max(order[0])).first()[0]
            window = window.where(F.unix_micros(order[0]) >= F.unix_micros(F.lit(newest)) - round(age * 1_000_000)) if newest is not None else window
        if rows is not None:
            window = window.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(rows)
        window.write.mode("overwrite").parquet(f"{folder}/window/batch={number}")
        window = spark.read.schema(batch.schema).parquet(f"{folder}/window/batch={number}")
        analyse(window).select(F.col("identity").cast("string").alias("identity"), "title", "regime").write.mode("overwrite").parquet(f"{folder}/findings/batch={number}")
        found = spark.read.parquet(f"{folder}/findings/batch={number}")
        seen = before("seen", number, "identity string, last long")
        told = found.select("identity", "title").groupBy("identity").agg(F.min("title").alias("title")).join(seen.select("identity"), "identity", "left_anti")
        kept = seen.unionByName(found.select("identity", F.lit(number).cast("long").alias("last"))).groupBy("identity").agg(F.max("last").alias("last"))
        kept.orderBy(F.desc("last"), "identity").limit(remembered).write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")
        now = found.where("regime IS NOT NULL").agg(F.min("title").alias("title"))
        last = before("regime", number, "title string")
        both = now.crossJoin(last.agg(F.max("title").alias("was")))
        both.select(F.coalesce("title", "was").alias("title")).write.mode("overwrite").parquet(f"{folder}/regime/batch={number}")
        changed = both.where("title IS NOT NULL AND NOT (title <=> was)").select(F.lit("regime_changed").alias("kind"), F.col("title").alias("subject"), F.lit(None).cast("long").alias("size"))
        advanced = window.agg(F.count("*").alias("size")).select(F.lit("window_advanced").alias("kind"), F.lit(None).cast("string").alias("subject"), "size")
        fresh = told.select(F.lit("new_finding").alias("kind"), F.col("title").alias("subject"), F.lit(None).cast("long").alias("size"))
        advanced.unionByName(fresh).unionByName(changed).write.mode("overwrite").parquet(f"{folder}/events/batch={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", each or f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
