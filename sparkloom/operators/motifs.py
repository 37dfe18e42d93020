"""Motifs and discords of long series without the distances of all pairs of windows.

Windows are dealt out to the nearest of about 3 * sqrt(n) pivots, windows of the series
itself. Distances within a cell bound each window's distance to its nearest other from
above; the bounds tell how near a motif must be (tau) and how far a discord. Then

- two windows at most tau apart lie in one cell, or one of them within tau / 2 of the plane
  halfway between their pivots: it visits the other's cell, and nothing else is compared;
- windows whose bound is below a distance that is surely reached are no discords; others
  visit the cells of more pivots, and what is left after that meets every window.

Where that gives too few, the bounds are widened and the step is done again; series that are
short, or that a few rounds don't settle, go by slices.profile, all pairs. Cells compare windows in whole numbers (`_scaled`), exact in any order of summing,
with room for the rounding; what is reported is measured on the values themselves. Distances
are compared by nine decimals, ties go to the smaller place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.lineage import kept
from sparkloom.operators import slices
from sparkloom.operators.slices import WIDTH, _picked, _standard, _together, sized

#: Windows of a series up to which all pairs are compared at once.
SHORT = 5000
#: How often the bounds are set before all pairs are compared.
ROUNDS = 5
#: Bounds looked at to choose a first tau and a first distance of discords.
LOOK = 256
#: Pivots whose cells a window visits that may be a discord.
VISITS = 32
#: Windows that are compared at a time with pivots and with windows, and that go to a slice in one row.
SOME, BLOCK, MANY = 128, 512, 2000


def _scale(window: int) -> int:
    """Steps of a standardised value, so that squared distances are whole numbers below 2^24."""
    return max(1, min(256, int(np.sqrt(2**24 / (4 * window)))))


def _scaled(z: np.ndarray, window: int) -> np.ndarray:
    return np.rint(np.round(z, 9) * _scale(window)).astype(np.int16)


def _shapes(z: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's values to nine decimals."""
    h = np.full(len(z), 0x9E3779B97F4A7C15, np.uint64)
    for c in np.rint(z * 1e9).astype(np.int64).astype(np.uint64).T:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _firsts(shape: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Which windows are among the first `most` of their shape, in the order of their places."""
    order = np.lexsort((at, shape))
    s = shape[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
    nth = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return np.sort(order[nth < most])


def _left(a: np.ndarray) -> np.ndarray:
    return np.column_stack([a, (a**2).sum(axis=1), np.ones(len(a), a.dtype)])


def _right(b: np.ndarray) -> np.ndarray:
    """The squared distances of rows of a and b are one product, _left(a) @ _right(b)."""
    return np.ascontiguousarray(np.column_stack([-2 * b, np.ones(len(b), b.dtype), (b**2).sum(axis=1)]).T)


def _apart(d: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, apart: int) -> np.ndarray:
    """Squared distances, infinite between windows that overlap too much; at_b ascends."""
    lo, hi = np.searchsorted(at_b, at_a - apart, "right"), np.searchsorted(at_b, at_a + apart, "left")
    n = hi - lo
    r = np.repeat(np.arange(len(at_a)), n)
    d[r, np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) + lo[r]] = np.inf
    return d


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(mask), mask.shape[1]) if mask.size else (np.zeros(0, int), np.zeros(0, int))


def _bytes(packs: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(p).tobytes() for p in packs], pa.binary())


def _parts(table: pa.Table, window: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, shapes and scaled values of the windows of a cell's packs, by what they are there for."""
    what = table.column("what").to_pylist()
    packs = [table.column(c).to_pylist() for c in ("ats", "shapes", "values")]
    out = {}
    for kind in (0, 1, 2):
        at, shape, values = (b"".join([b for b, k in zip(p, what, strict=True) if k == kind]) for p in packs)
        out[kind] = np.frombuffer(at, np.int64), np.frombuffer(shape, np.uint64), np.frombuffer(values, np.int16).reshape(-1, window).astype(np.float32)
    return out


class _Search:
    """The steps of one search; its methods are closures over names, widths and schemas."""

    def __init__(self, cut: DataFrame, keys: list[str], window: int, most: int, width: int):
        self.cut, self.keys, self.window, self.most, self.width = cut, keys, window, most, width
        self.apart = max(1, window // 2)
        #: Of windows of one shape those after so many can neither be picked nor be a nearest one: what is picked earlier overlaps fewer.
        self.firsts = 2 * most * (2 * window - 1) + 2 * self.apart + 1
        self.top = 2 * float(np.sqrt(window)) + 1
        types = dict(cut.dtypes)
        self.named = [f"`{k}` {types[k]}" for k in keys]

    def run(self, df: DataFrame, by: list[str], kernel, columns: str) -> DataFrame:
        """applyInArrow with the keys put before what the kernel gives."""
        keys, schema = self.keys, ", ".join([*self.named, columns])

        def each(table: pa.Table) -> pa.Table:
            found = kernel(table)
            n = found.num_rows
            of = [pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in keys]
            return pa.table([*of, *found.columns], [*keys, *found.column_names])

        return df.groupBy(*by).applyInArrow(each, schema)

    def told(self, df: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
        """Rows with the columns that a table of a row for each series has."""
        return df.join(sized(small), self.keys, how)

    def windows(self):
        """A function from a slice's row to its standardised windows and their places."""
        window, width = self.window, self.width

        def of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            z = _standard(table.column("xs")[0].values.to_numpy(), window, width)
            return z, table.column("start")[0].as_py() + np.arange(len(z))

        return of

    def pivots(self, sizes: DataFrame) -> DataFrame:
        """Scaled windows of each series, chosen by a digest of their places."""
        sizes = sizes.withColumn("step", F.greatest(F.lit(1.0), F.sqrt("windows") / 3).cast("long"))
        windows, window = self.windows(), self.window

        def choose(table: pa.Table) -> pa.Table:
            z, at = windows(table)
            digest = (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            some = (digest % np.uint64(table.column("step")[0].as_py()) == 0) | (at == 0)
            return pa.table([_bytes(list(np.unique(_scaled(z[some], window), axis=0)))], ["pivot"])

        chosen = self.run(self.told(self.cut, sizes), [*self.keys, "slice"], choose, "pivot binary")
        chosen = chosen.groupBy(*self.keys).agg(F.sort_array(F.collect_set("pivot")).alias("pivots"))
        return kept(chosen)

    def packs(self, pivots: DataFrame, tau: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
        """cell, what (0 lives there, 1 visits it as tau tells, 2 was asked for), and the places, shapes and scaled values of the windows of one slice."""
        windows, window, firsts, width = self.windows(), self.window, self.firsts, self.width
        rows = self.told(self.cut, pivots)
        if tau is not None:
            rows = self.told(rows, tau.select(*self.keys, "tau"))
            lists = asked.groupBy(*self.keys, F.floor(F.col("at") / width).cast("int").alias("slice")).agg(F.collect_list("at").alias("asked"))
            rows = rows.join(sized(lists), [*self.keys, "slice"], "left")

        def deal(table: pa.Table) -> pa.Table:
            z, at = windows(table)
            shape = _shapes(z)
            some = _firsts(shape, at, firsts)
            q, at, shape = _scaled(z[some], window), at[some], shape[some]
            p = np.frombuffer(b"".join(table.column("pivots")[0].as_py()), np.int16).reshape(-1, window).astype(np.float32)
            pp = (p**2).sum(axis=1)
            wide = 2 * np.sqrt(float(pp.max())) if len(p) else 0.0
            of_pivots = np.ascontiguousarray(np.column_stack([2 * p, -pp]).T)
            near = None
            if "tau" in table.column_names:
                # half of tau, and of the roundings of both windows
                tau = table.column("tau")[0].as_py()
                near = (tau * _scale(window) + np.sqrt(window)) / 2 if tau > 0 else 0.0
                want = np.isin(at, table.column("asked")[0].as_py() or [])
            who, cell, what = [], [], []
            for i in range(0, len(q), SOME):
                x = q[i : i + SOME].astype(np.float32)
                score = np.column_stack([x, np.ones(len(x), x.dtype)]) @ of_pivots
                own = score.argmax(axis=1)
                best = score[np.arange(len(x)), own]
                told = [(np.arange(len(x)), own, 0)]
                if near is not None and near > 0:
                    r, c = _where(score >= (best - np.float32(2 * near * wide))[:, None])
                    gap = np.sqrt(((p[c] - p[own[r]]) ** 2).sum(axis=1))
                    ok = (c != own[r]) & (best[r] - score[r, c] <= 2 * near * gap * 1.000001 + 1)
                    told.append((r[ok], c[ok], 1))
                if near is not None:
                    r = np.flatnonzero(want[i : i + SOME])
                    c = np.argsort(-score[r], axis=1, kind="stable")[:, 1 : VISITS + 1]
                    told.append((np.repeat(r, c.shape[1]), c.ravel(), 2))
                for r, c, kind in told:
                    who.append(i + r)
                    cell.append(c)
                    what.append(np.full(len(r), kind))
            who, cell, what = (np.concatenate([np.zeros(0, int), *v]) for v in (who, cell, what))
            order = np.lexsort((who, what, cell))
            who, cell, what = who[order], cell[order], what[order]
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(what) != 0)) + 1
            first = np.concatenate([[0], cuts]).astype(int) if len(who) else np.zeros(0, int)
            parts = np.split(who, cuts) if len(who) else []
            return pa.table(
                [pa.array(cell[first], pa.int32()), pa.array(what[first], pa.int32()), _bytes([at[w] for w in parts]), _bytes([shape[w] if k == 0 else shape[:0] for w, k in zip(parts, what[first], strict=True)]), _bytes([q[w] for w in parts])],
                ["cell", "what", "ats", "shapes", "values"],
            )

        return self.run(rows, [*self.keys, "slice"], deal, "cell int, what int, ats binary, shapes binary, values binary")

    def living(self):
        """A function from a cell's parts to the places, shapes and values of what lives there."""
        firsts = self.firsts

        def of(parts: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at, shape, q = parts[0]
            order = np.argsort(at)
            order = order[_firsts(shape[order], at[order], firsts)]
            return at[order], shape[order], q[order]

        return of

    def bounds(self, packs: DataFrame) -> DataFrame:
        """at, distance and nearest of every window within its cell: exact (0, of the same shape), or bounds from above."""
        living, window, apart, top = self.living(), self.window, self.apart, self.top

        def within(table: pa.Table) -> pa.Table:
            at, shape, q = living(_parts(table, window))
            far, near, exact = np.full(len(at), top), np.full(len(at), -1), np.zeros(len(at), bool)
            all_ = _right(q)
            for i in range(0, len(at), BLOCK):
                d = _apart(_left(q[i : i + BLOCK]) @ all_, at[i : i + BLOCK], at, apart)
                j = d.argmin(axis=1)
                least = d[np.arange(len(d)), j]
                for r in np.flatnonzero(least == 0):
                    same = np.flatnonzero((d[r] == 0) & (shape == shape[i + r]))
                    if len(same):
                        j[r], exact[i + r] = same[0], True
                some = np.isfinite(least)
                far[i : i + BLOCK][some], near[i : i + BLOCK][some] = (np.sqrt(least[some]) + np.sqrt(window)) / _scale(window) + 1e-6, at[j[some]]
            far = np.where(exact, 0.0, np.minimum(far, top))
            return pa.table([pa.array(at), pa.array(far), pa.array(near), pa.array(exact)], ["at", "distance", "nearest", "exact"])

        return self.run(packs, [*self.keys, "cell"], within, "at long, distance double, nearest long, exact boolean")

    def meetings(self, packs: DataFrame, tau: DataFrame) -> DataFrame:
        """at, nearest and distance: of pairs that may be nearest ones within tau, both ways, and (nearest null) new bounds of the windows asked for."""
        living, window, apart = self.living(), self.window, self.apart

        def meet(table: pa.Table) -> pa.Table:
            parts = _parts(table, window)
            at, shape, q = living(parts)
            # windows of a shape that is met again far enough away know their nearest
            order = np.lexsort((at, shape))
            start = np.searchsorted(shape[order], shape)
            end = np.searchsorted(shape[order], shape, "right") - 1
            open_ = (at - at[order][start] < apart) & (at[order][end] - at < apart) if len(at) else np.zeros(0, bool)
            scale, room = _scale(window), np.sqrt(window)
            tau = table.column("tau")[0].as_py()
            limit = tau * scale + room + 1
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            all_ = _right(q)
            for what in (0, 1, 2) if tau > 0 else (2,):
                at_v, _, v = parts[what] if what else (at, shape, q)
                for i in range(0, len(v) if len(at) else 0, BLOCK):
                    places = at_v[i : i + BLOCK]
                    d = _left(v[i : i + BLOCK]) @ all_
                    if what == 2:
                        d = _apart(d, places, at, apart)
                        least = d.min(axis=1)
                        ok = np.isfinite(least)
                        found.append((places[ok], np.full(ok.sum(), -1), (np.sqrt(least[ok]) + room) / scale + 1e-6))
                        continue
                    r, c = _where(d <= np.float32(limit**2))
                    far_enough = np.abs(places[r] - at[c]) >= apart
                    r, c = r[far_enough], c[far_enough]
                    if not len(r):
                        continue
                    far = np.sqrt(d[r, c])
                    # only what may be the nearest, once both are measured
                    for mine, other, asks, a, b in ((r, c, open_[i : i + BLOCK] if not what else np.ones(len(d), bool), places, at), (c, r, open_, at, places)):
                        least = np.full(len(asks), np.inf)
                        np.minimum.at(least, mine, far)
                        ok = (far <= least[mine] + 2 * room) & asks[mine]
                        found.append((a[mine[ok]], b[other[ok]], far[ok] / scale))
            a, b, d = (np.concatenate(v) for v in zip(*found, strict=True))
            return pa.table([pa.array(a), pa.array(b, mask=b < 0), pa.array(d)], ["at", "nearest", "distance"])

        return self.run(self.told(packs, tau.select(*self.keys, "tau")), [*self.keys, "cell"], meet, "at long, nearest long, distance double")

    def values(self, places: DataFrame) -> DataFrame:
        """The standardised windows (z) at each place of a table of places."""
        width, windows = self.width, self.windows()
        lists = places.groupBy(*self.keys, F.floor(F.col("at") / width).cast("int").alias("slice")).agg(F.collect_set("at").alias("asked"))
        rows = self.cut.join(sized(lists), [*self.keys, "slice"])

        def look(table: pa.Table) -> pa.Table:
            z, at = windows(table)
            asked = np.array(table.column("asked")[0].as_py(), np.int64)
            return pa.table([pa.array(asked), _bytes(list(z[asked - at[0]]))], ["at", "z"])

        return self.run(rows, [*self.keys, "slice"], look, "at long, z binary")

    def measured(self, pairs: DataFrame) -> DataFrame:
        """at, distance and nearest: of pairs (at, nearest) each window's nearest, measured on the values."""
        pairs = kept(pairs.select(*self.keys, "at", "nearest").distinct())
        z = kept(self.values(pairs.select(*self.keys, "at").union(pairs.select(*self.keys, F.col("nearest").alias("at")))))
        few = sized(z)
        both = pairs.join(few, [*self.keys, "at"]).join(few.select(*self.keys, F.col("at").alias("nearest"), F.col("z").alias("other")), [*self.keys, "nearest"])

        def measure(batches):
            for b in batches:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), float).reshape(b.num_rows, -1) for c in ("z", "other"))
                d = np.round(np.sqrt(((x - y) ** 2).sum(axis=1)), 9)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*self_keys, "at", "nearest"]), pa.array(d)], [*self_keys, "at", "nearest", "distance"])

        self_keys = self.keys
        told = both.select(*self.keys, "at", "nearest", "z", "other").mapInArrow(measure, ", ".join([*self.named, "at long, nearest long, distance double"]))
        return self.least(told)

    def least(self, told: DataFrame) -> DataFrame:
        best = told.groupBy(*self.keys, "at").agg(F.min(F.struct("distance", "nearest")).alias("b"))
        return best.select(*self.keys, "at", "b.distance", "b.nearest")

    def against_all(self, places: DataFrame) -> DataFrame:
        """at, distance and nearest of the windows at some places, each compared with every window of its series; blocks of them meet slices, a task each."""
        nth = F.row_number().over(Window.partitionBy(*self.keys).orderBy("at"))
        places = kept(places.select(*self.keys, "at", F.floor((nth - 1) / MANY).cast("int").alias("block")))
        blocks = self.values(places).join(sized(places), [*self.keys, "at"])
        blocks = kept(blocks.groupBy(*self.keys, "block").agg(F.collect_list("at").alias("ats"), F.collect_list("z").alias("zs")))
        rows = self.cut.join(sized(blocks, 100), self.keys)
        windows, window, apart = self.windows(), self.window, self.apart

        def meet(table: pa.Table) -> pa.Table:
            z, at = windows(table)
            asked = np.array(table.column("ats")[0].as_py(), np.int64)
            x = np.frombuffer(b"".join(table.column("zs")[0].as_py()), float).reshape(-1, window)
            who, near, far, all_ = [], [], [], _right(z)
            for i in range(0, len(x) if len(z) else 0, 64):
                d = _apart(_left(x[i : i + 64]) @ all_, asked[i : i + 64], at, apart)
                least = d.min(axis=1)
                j = (d <= least[:, None] + 1e-9).argmax(axis=1)
                ok = np.isfinite(least)
                who.append(asked[i : i + 64][ok])
                near.append(at[j[ok]])
                far.append(np.round(np.sqrt(((x[i : i + 64][ok] - z[j[ok]]) ** 2).sum(axis=1)), 9))
            who, near, far = (np.concatenate([np.zeros(0, t), *v]) for v, t in ((who, np.int64), (near, np.int64), (far, float)))
            return pa.table([pa.array(who), pa.array(near), pa.array(far)], ["at", "nearest", "distance"])

        return self.least(self.run(rows, [*self.keys, "slice", "block"], meet, "at long, nearest long, distance double"))

    def ends(self, rows: DataFrame, kind: str) -> DataFrame:
        """The LOOK first rows of each series as a motif or a discord is picked."""
        first = F.col("distance") if kind == "motif" else -F.col("distance")
        nth = F.row_number().over(Window.partitionBy(*self.keys).orderBy(first, "at"))
        return rows.withColumn("_n", nth).where(F.col("_n") <= LOOK).drop("_n")


def _last(picks: list[DataFrame], keys: list[str], most: int, name: str) -> DataFrame:
    """The distance of the last of `most` picks, for series that have so many."""
    return picks[most - 1].select(*keys, F.col("distance").alias(name))


def motifs_and_discords(df: DataFrame, keys: list[str], order: list[str], value: str, window: int, most: int = 3, width: int = WIDTH) -> DataFrame:
    """kind, rank, at, other and distance, as slices.motifs_and_discords tells of the whole profile."""
    if not keys:
        return motifs_and_discords(df.withColumn("_series", F.lit(0)), ["_series"], order, value, window, most, width).drop("_series")
    cut = kept(slices.slices(slices.numbered(df, keys, order, [value]), keys, window - 1, width).withColumn("xs", F.flatten("xs")))
    own = F.greatest(F.lit(0), F.least(F.lit(width), F.size("xs") - window + 1))
    sizes = kept(cut.groupBy(*keys).agg(F.sum(own).alias("windows")))
    long_ = sizes.where(F.col("windows") > SHORT)
    short = sizes.where(F.col("windows") <= SHORT).select(*keys)
    out, unsettled = _settled(_Search(cut.join(sized(long_.select(*keys)), keys, "left_semi"), keys, window, most, width), long_) if not long_.isEmpty() else ([], None)
    rest = short if unsettled is None else short.unionByName(unsettled.select(*keys))
    if out and rest.isEmpty():
        return _together(out)
    told = slices.profile(df.join(sized(rest), keys, "left_semi"), keys, order, value, window, width)
    if unsettled is None:
        return slices.motifs_and_discords(told, keys, window, most)
    done = unsettled.select(*keys, "kinds")
    whole = sizes.select(*keys).join(sized(done), keys, "left").withColumn("kinds", F.coalesce("kinds", F.array(F.lit("motif"), F.lit("discord"))))
    last = slices.motifs_and_discords(told, keys, window, most).join(sized(whole), keys)
    return _together([*out, last.where(F.array_contains("kinds", F.col("kind"))).drop("kinds")])


def _settled(s: _Search, sizes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables of motifs and discords, and the series with the kinds that are not settled."""
    keys, window, most = s.keys, s.window, s.most
    pivots = s.pivots(sizes)
    found = kept(s.bounds(s.packs(pivots)))
    zero, open_ = found.where("exact").drop("exact"), found.where(~F.col("exact")).drop("exact")
    # a first tau: the last of the nearest bounds that overlap no other; a first distance of discords: of the furthest bounds, measured
    low = _last(_picked(kept(s.ends(found.drop("exact"), "motif")), keys, window, "motif", most), keys, most, "tau")
    high = kept(s.ends(found, "discord"))
    known = kept(s.against_all(high.where(~F.col("exact"))).unionByName(high.where("exact").drop("exact")))
    reach = _last(_picked(known, keys, window, "discord", most), keys, most, "reach")
    state = s.told(s.told(sizes, low, "left"), reach, "left")
    state = kept(state.select(*keys, F.coalesce("tau", F.lit(0.25)).alias("tau"), F.coalesce("reach", F.lit(s.top / 2)).alias("reach"), F.lit(True).alias("motif"), F.lit(True).alias("discord")))
    out: list[DataFrame] = []
    for _ in range(ROUNDS):
        # windows of a distance of 0 know their nearest
        may = kept(s.told(open_, state.where("discord")).where("distance >= reach").select(*keys, "at", "distance"))
        asks = state.withColumn("tau", F.when(F.col("motif"), F.col("tau")).otherwise(0.0))
        met = kept(s.meetings(s.packs(pivots, asks, may), asks))
        near = s.measured(met.where("nearest IS NOT NULL").join(zero.select(*keys, "at"), [*keys, "at"], "left_anti"))
        near = kept(s.told(zero.unionByName(near), state.where("motif")).where("distance <= tau").select(*keys, "at", "distance", "nearest"))
        left = may.unionByName(met.where("nearest IS NULL").select(*keys, "at", "distance")).groupBy(*keys, "at").agg(F.min("distance").alias("distance"))
        left = kept(s.told(left, state.where("discord")).where("distance >= reach").select(*keys, "at"))
        far = kept(s.told(zero.unionByName(s.against_all(left)), state.where("discord")).where("distance >= reach").select(*keys, "at", "distance", "nearest"))
        again = state
        for kind, rows in (("motif", near), ("discord", far)):
            picks = _picked(rows, keys, window, kind, most)
            done = picks[-1].select(*keys, F.lit(True).alias("_done"))
            out += [s.told(p, done).drop("_done") for p in picks]
            again = s.told(again, done, "left").withColumn(kind, F.col(kind) & F.col("_done").isNull()).drop("_done")
        again = again.withColumn("tau", F.greatest(F.col("tau") * 1.5, F.lit(0.25))).withColumn("reach", F.col("reach") * 0.8)
        state = kept(again.where("motif OR discord"))
        if state.isEmpty():
            break
    kinds = F.array_compact(F.array(F.when(F.col("motif"), F.lit("motif")), F.when(F.col("discord"), F.lit("discord"))))
    return out, state.select(*keys, kinds.alias("kinds"))
