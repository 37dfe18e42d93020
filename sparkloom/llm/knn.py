"""Exact top-k inner products by a Voronoi join.

Data and queries are vectors of integers. Pivots, taken from the data, divide it into
cells, each vector belonging to its nearest pivot. There are about as many pivots as the
square root of the rows, `pivots` at most. Cells are summarised by their size, their
radius and their longest vector, and packed into groups of about `block_rows` vectors
that one task solves; a cell of more vectors is dealt out over several groups.

1. Each query goes to the groups of its own cell, whose k-th score bounds its best from
   below.
2. From the summaries each query gets, for each other cell, a bound on the score of any
   vector in it: with the least distance d that the cell leaves between query and vector
   (by its radius, and by the hyperplane between the cell's pivot and the query's own),
   q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + longest^2 - d^2) / 2, and
   q.x <= q.p + |q| * radius. It is sent once to each group that holds a cell whose bound
   reaches the k-th score, with the list of those cells, and nothing else is compared.

Queries stream past a group's vectors, so a task holds one group and one batch. Where
vectors point in random directions of many dimensions, no bound on cells can leave much
out; where they lie in clusters, most cells are.

Vectors that are null or hold null or non-finite components take no part, nor do rows
without an id. Rows that share an id are each a candidate and each a query, which finds none
of them; a query row gets k rows of its own. Vectors of different lengths are never compared; empty ones score 0 among themselves. Ties go to
the smaller id. Components are cut to 64 bits, and a score beyond 64 bits wraps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import kept


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x, as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks).flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _by_length(batch: pa.RecordBatch, column: int):
    """Rows of a batch by the length of their vectors."""
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        yield int(dim), batch.take(pa.array(np.flatnonzero(sizes == dim)))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products; in doubles (exact below 2^53) where the sizes allow it, else in 64-bit integers."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    if largest < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


#: Cells, beside those of the pivots, for vectors of a length that no pivot has.
REST = 16
_DEALT = pa.schema([("group", pa.int32()), ("kind", pa.int32()), ("cell", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.int64())), ("cells", pa.list_(pa.int32())), ("asked", pa.int64())])
_DEALT_SQL = "group int, kind int, cell int, id long, v array<bigint>, cells array<int>, asked long"
_FOUND = pa.schema([("asked", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Cells:
    """The pivots and, once summarised, what the driver knows of each cell: a few numbers for each pivot."""

    def __init__(self, pivots: list[np.ndarray]):
        self.pivots = pivots
        self.of = {d: np.flatnonzero([len(p) == d for p in pivots]) for d in {len(p) for p in pivots}}

    def matrix(self, dim: int) -> np.ndarray:
        return np.array([self.pivots[i] for i in self.of[dim]], np.float64).reshape(-1, dim)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row of x, and the distance to its pivot."""
        dim = x.shape[1]
        if dim not in self.of:
            return np.full(len(x), len(self.pivots) + dim % REST), np.zeros(len(x))
        p = self.matrix(dim)
        d = (p**2).sum(axis=1) - 2 * (x @ p.T)
        near = d.argmin(axis=1)
        return self.of[dim][near], np.sqrt(((x - p[near]) ** 2).sum(axis=1))

    def summarise(self, told: list, block_rows: int) -> None:
        """told: cell, n, radius, longest of the cells that hold vectors. Neighbouring cells share a group."""
        self.size, self.radius, self.longest = (np.zeros(len(self.pivots) + REST) for _ in range(3))
        for cell, n, radius, longest in told:
            self.size[cell], self.radius[cell], self.longest[cell] = n, radius, longest
        order: list[int] = []
        for cells in self.of.values():
            if len(cells):
                p = self.matrix(len(self.pivots[cells[0]]))
                order += cells[np.argsort(((p - p[0]) ** 2).sum(axis=1), kind="stable")].tolist()
        self.first, self.blocks = np.zeros(len(self.size), np.int64), np.ones(len(self.size), np.int64)
        group, filled = 0, 0.0
        for cell in [*order, *range(len(self.pivots), len(self.pivots) + REST)]:
            n = self.size[cell]
            if n > block_rows:
                group += filled > 0
                self.first[cell], self.blocks[cell] = group, -(-n // block_rows)
                group, filled = group + int(self.blocks[cell]), 0.0
                continue
            if filled + n > block_rows:
                group, filled = group + 1, 0.0
            self.first[cell], filled = group, filled + n
        self.groups = group + 1

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells that queries of this length can meet, and for each query and such cell the most that a vector in it can score."""
        dim = q.shape[1]
        if dim not in self.of:
            return np.array([len(self.pivots) + dim % REST]), np.full((len(q), 1), np.inf)
        p, cells = self.matrix(dim), self.of[dim]
        qp, qq = q @ p.T, (q**2).sum(axis=1)
        square = np.maximum(0.0, qq[:, None] + (p**2).sum(axis=1) - 2 * qp)
        own = square.argmin(axis=1)
        between = np.sqrt(np.maximum(0.0, (p**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * (p @ p.T)))[own]
        plane = (square - square[np.arange(len(q)), own][:, None]) / (2 * np.maximum(between, 1e-300))
        plane[np.arange(len(q)), own] = 0.0
        least = np.maximum(0.0, np.maximum(np.sqrt(square) - self.radius[cells], np.where(between > 0, plane, 0.0)))
        far = (qq[:, None] + self.longest[cells] ** 2 - least**2) / 2
        straight = qp + np.sqrt(qq)[:, None] * self.radius[cells]
        slack = 1e-9 * (qq[:, None] + self.longest[cells] ** 2 + np.abs(qp)) + 1e-6
        return cells, np.minimum(far, straight) + slack

    def needed(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and cell of each pair whose bound reaches the query's k-th score."""
        cells, most = self.bounds(q)
        i, c = np.nonzero((most >= least[:, None]) & (self.size[cells] > 0))
        return i, cells[c]


def _solver(k: int):
    """Streams queries past the vectors of each group; partitions are sorted by group, vectors before queries."""

    def best(part: pa.RecordBatch, held: dict) -> list:
        found = []
        for dim, asked in _by_length(part, 4):
            if dim not in held:
                continue
            x, ids, cell = held[dim]
            q, own = _matrix(asked.column(4), dim), asked.column(3).to_numpy()
            wanted, names = asked.column(5), asked.column(6).to_numpy()
            for a in range(0, len(q), 128):
                scores = _scores(q[a : a + 128], x)
                for j, s in enumerate(scores, a):
                    may = (ids != own[j]) & np.isin(cell, wanted[j].values.to_numpy())
                    s, i = s[may], ids[may]
                    if len(s) > k:
                        top = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                        s, i = s[top], i[top]
                    order = np.lexsort((i, -s))[:k]
                    found.append((np.full(len(order), names[j]), i[order], s[order]))
        return found

    def run(batches):
        group, waiting, held = None, [], {}
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cut = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]))) if batch.num_rows else []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                part = batch.slice(a, b - a)
                if keys[0, a] != group:
                    group, waiting, held = keys[0, a], [], {}
                if keys[1, a] == 0:
                    waiting.append(part)
                    continue
                if waiting:
                    for piece in waiting:
                        for dim, rows in _by_length(piece, 4):
                            held.setdefault(dim, []).append((_matrix(rows.column(4), dim), rows.column(3).to_numpy(), rows.column(2).to_numpy()))
                    held, waiting = {d: tuple(np.concatenate(c) for c in zip(*parts, strict=True)) for d, parts in held.items()}, []
                found = best(part, held)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], schema=_FOUND)

    return run


def top_k(data: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 1024, block_rows: int = 20_000) -> DataFrame:
    """query_id, rank (from 1), vec_id and score. data and queries: vec_id long, v array<long>; a query never finds its own id."""
    rows = data.where("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v")
    # equal queries are answered once
    asked = queries.where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id", "v").agg(F.count("*").cast("int").alias("times")).select("vec_id", "v", F.xxhash64("vec_id", "v").alias("asked"), "times")
    wanted = min(pivots, math.isqrt(rows.count()) + 1)
    cells = Cells([np.array(r["v"], np.int64) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(wanted).collect()])

    def celled(batches):
        for batch in batches:
            for dim, part in _by_length(batch, 1):
                x = _matrix(part.column(1), dim).astype(np.float64)
                cell, away = cells.nearest(x)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), part.column(0), part.column(1), pa.array(away), pa.array(np.sqrt((x**2).sum(axis=1)))], ["cell", "vec_id", "v", "away", "norm"])

    placed = rows.mapInArrow(celled, "cell int, vec_id long, v array<bigint>, away double, norm double")
    # a row for each pivot, and REST more, at most
    cells.summarise([tuple(r) for r in placed.groupBy("cell").agg(F.count("*"), F.max("away"), F.max("norm")).collect()], block_rows)

    def grouped(batches):
        for batch in batches:
            cell, ids = batch.column(0).to_numpy(), batch.column(1)
            group = cells.first[cell] + ids.to_numpy() % cells.blocks[cell]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(np.zeros(n), pa.int32()), batch.column(0), ids, batch.column(2), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.int64())], schema=_DEALT)

    def routed(home: bool):
        def run(batches):
            for batch in batches:
                for dim, part in _by_length(batch, 1):
                    q = _matrix(part.column(1), dim).astype(np.float64)
                    own = cells.nearest(q)[0]
                    if home:
                        i, cell = np.arange(len(q)), own
                    else:
                        i, cell = cells.needed(q, part.column(3).to_numpy(zero_copy_only=False).astype(np.float64))
                        i, cell = i[cell != own[i]], cell[cell != own[i]]
                    times = cells.blocks[cell]
                    group = np.repeat(cells.first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    i, cell = np.repeat(i, times), np.repeat(cell, times)
                    order = np.lexsort((group, i))
                    i, group, cell = i[order], group[order], cell[order]
                    first = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (group[1:] != group[:-1])))) if len(i) else np.zeros(0, np.int64)
                    ends = np.concatenate((first, [len(i)]))
                    step = max(1, 2_000_000 // max(1, dim))
                    for a in range(0, len(first), step):
                        at, offsets = first[a : a + step], ends[a : a + step + 1]
                        sent = part.take(pa.array(i[at]))
                        lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(cell[offsets[0] : offsets[-1]], pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array(group[at], pa.int32()), pa.array(np.ones(len(at)), pa.int32()), pa.array(np.full(len(at), -1), pa.int32()), sent.column(0), sent.column(1), lists, sent.column(2)], schema=_DEALT)

        return run

    def solved(sent: DataFrame) -> DataFrame:
        both = placed.mapInArrow(grouped, _DEALT_SQL).unionByName(sent)
        return both.repartition("group").sortWithinPartitions("group", "kind").mapInArrow(_solver(k), "asked long, vec_id long, score long")

    sent = asked.select("vec_id", "v", "asked")
    near = kept(solved(sent.mapInArrow(routed(True), _DEALT_SQL)))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    bound = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("asked", F.col("score").cast("double").alias("least"))
    rest = sent.join(bound, "asked", "left").select("vec_id", "v", "asked", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    found = near.unionByName(solved(rest.mapInArrow(routed(False), _DEALT_SQL)))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    told = asked.select("asked", F.col("vec_id").alias("query_id"), F.explode(F.array_repeat(F.lit(True), F.col("times"))).alias("once"))
    return best.join(told, "asked").select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
