"""Compression of vectors to codes of a few bits a part, with partial-distance search.

Each component x becomes the integer floor(scale * x). Vectors are cut into `parts`
consecutive parts (of equal length; where that can't be, the first ones are longer by one),
and each part position has a codebook of `entries` entries. It begins as that part of the
first vectors by id; each round assigns every part to its nearest entry and replaces each
entry by the floor of the mean of its parts, entries without parts stay.

The nearest entry is searched by partial distances: dimensions go by descending variance
of the codebook, the first candidate is the entry nearest in the first of them, and each
other entry is dropped for those rows whose sum of squares so far is strictly greater than
their best complete distance, by masks over a batch of rows. Sums are of integers, ties go
to the entry of the lower index, so results don't depend on batches or order.

A round is one pass over the vectors: each task returns the sums and counts of its parts
(entries x components numbers), which Spark adds up; the driver holds the codebooks only.
Nothing is shuffled by a vector, and no group of vectors meets anywhere.

Rows whose vector is null or holds null or non-finite components are dropped. The length of
the vector of the smallest id is the codebooks'; rows of another length stay, with a null
code and error. Rows without an id come last in the order; rows that share an id are ordered
by their vectors, and all count. With fewer rows than entries the codebooks are smaller.
Components saturate where a distance would not fit 64 bits (for 64 components at 2^27, or
x = 32768 at a scale of 4096). Other columns are kept, but those named like the added ones.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .knn import usable
from .storage import kept

#: Columns that encode() adds.
ADDED = ("code", "error")


def cuts(dim: int, parts: int) -> np.ndarray:
    """Where each part begins, and the end."""
    size, longer = divmod(dim, parts)
    return np.concatenate(([0], np.cumsum([size + (p < longer) for p in range(parts)])))


def integers(flat: np.ndarray, rows: int, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of `rows` rows of `dim` components."""
    most = math.isqrt((1 << 62) // max(1, dim)) // 2
    return np.clip(np.floor(flat.astype(np.float64) * scale), -most, most).astype(np.int64).reshape(rows, dim)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the index of its nearest entry, ties to the lower one, and the squared distance."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    columns, book = np.ascontiguousarray(x[:, order].T), book[:, order]
    first = np.abs(columns[0][:, None] - book[:, 0]).argmin(axis=1)
    at, best = first.copy(), ((columns - book[first].T) ** 2).sum(axis=0)
    for j, entry in enumerate(book):
        rows = np.flatnonzero(first != j)
        far = np.zeros(len(rows), np.int64)
        for values, centre in zip(columns, entry.tolist(), strict=True):
            far = far + (values[rows] - centre) ** 2
            near = far <= best[rows]
            rows, far = rows[near], far[near]
            if not len(rows):
                break
        better = (far < best[rows]) | (j < at[rows])
        at[rows[better]], best[rows[better]] = j, far[better]
    return at, best


class Codebooks:
    """scale, dim and, for each part position, a matrix of entries."""

    def __init__(self, scale: int, dim: int, books: list[np.ndarray]):
        self.scale, self.dim, self.books = scale, dim, books
        self.cuts = cuts(dim, len(books))

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vectors that have the codebooks' length, and their integers."""
        at = np.flatnonzero(column.value_lengths().to_numpy(zero_copy_only=False) == self.dim)
        return at, integers(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), len(at), self.dim, self.scale)

    def assigned(self, x: np.ndarray):
        """For each part position the parts, their entries and their distances."""
        for p, book in enumerate(self.books):
            part = x[:, self.cuts[p] : self.cuts[p + 1]]
            yield part, *nearest(part, book)

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def _usable(data: DataFrame, column: str) -> DataFrame:
    return data.where(usable(F.col(f"`{column}`")))


def _moved(data: DataFrame, books: Codebooks, column: str) -> Codebooks:
    """The codebooks after one round."""

    def sums(batches):
        n = [np.zeros(len(b), np.int64) for b in books.books]
        total = [np.zeros(b.shape, np.int64) for b in books.books]
        for batch in batches:
            for p, (part, entry, _) in enumerate(books.assigned(books.rows(batch.column(0))[1])):
                n[p] += np.bincount(entry, minlength=len(n[p]))
                for e in np.unique(entry):
                    total[p][e] += part[entry == e].sum(axis=0)
        rows = [(p, e, int(c), t[e].tolist()) for p, (k, t) in enumerate(zip(n, total, strict=True)) for e, c in enumerate(k) if c]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["part", "entry", "n", "total"])

    each = data.select(F.col(f"`{column}`")).mapInArrow(sums, "part int, entry int, n long, total array<long>")
    added = each.select("part", "entry", "n", F.posexplode_outer("total").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    new = [b.copy() for b in books.books]
    # at most entries x components rows
    for r in added.where("place IS NOT NULL").collect():
        new[r["part"]][r["entry"], r["place"]] = r["x"] // r["n"]
    return Codebooks(books.scale, books.dim, new)


def fit(data: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """The codebooks after all rounds; `data` is read once a round."""
    rows = _usable(data, vector_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    order = (F.col("id").asc_nulls_last(), F.col("v"))
    first = rows.orderBy(*order).first()
    dim = len(first["v"]) if first else 0
    same = rows.where(F.size("v") == dim)
    began = same.orderBy(*order).limit(entries).collect()
    x = integers(np.array([v for r in began for v in r["v"]], np.float64), len(began), dim, scale)
    at = cuts(dim, parts)
    books = Codebooks(scale, dim, [x[:, a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
    for _ in range(rounds if first else 0):
        books = _moved(same, books, "v")
    return books


def encode(data: DataFrame, books: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """The usable rows with `code` (of each part the entry's index in hex digits) and `error` (the squared distances of all parts)."""
    rows = _usable(data, vector_col).drop(*ADDED)
    digits = max(2, len(f"{max((len(b) for b in books.books), default=1) - 1:x}"))
    hexes = np.array([f"{e:0{digits}x}" for e in range(max([1, *(len(b) for b in books.books)]))], object)
    vector = rows.columns.index(vector_col)

    def run(batches):
        for batch in batches:
            v = batch.column(vector)
            at, x = books.rows(v)
            code, error = np.full(len(v), None, object), np.zeros(len(v), np.int64)
            if len(at):
                told = [(entry, far) for _, entry, far in books.assigned(x)]
                text = hexes[told[0][0]]
                for entry, _ in told[1:]:
                    text = text + hexes[entry]
                code[at], error[at] = text, np.sum([far for _, far in told], axis=0)
            missing = np.ones(len(v), bool)
            missing[at] = False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.string()), pa.array(error, pa.int64(), mask=missing)], [*batch.schema.names, *ADDED])

    return rows.mapInArrow(run, T.StructType(list(rows.schema.fields)).add("code", "string").add("error", "long"))


def with_label_errors(encoded: DataFrame, label_col: str = "label", salts: int = 64, few: int = 100_000) -> DataFrame:
    """`encoded` with label_error, the sum of `error` over the rows of an equal label, nulls together.

    Sums are made before anything is shuffled. They are broadcast if there are at most `few`
    labels, which is counted; else they are joined on label and a salt, so that a label of
    a third of all rows is dealt over many tasks.
    """
    label = F.col(f"`{label_col}`")
    sums = encoded.groupBy(label.alias("sum_of")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= few:
        told = F.broadcast(sums)
        return encoded.join(told, label.eqNullSafe(told["sum_of"]), "left").drop("sum_of")
    told = sums.withColumn("sum_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = encoded.withColumn("dealt_salt", F.pmod(F.xxhash64("code", "error", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    return dealt.join(told, label.eqNullSafe(told["sum_of"]) & (dealt["dealt_salt"] == told["sum_salt"]), "left").drop("sum_of", "sum_salt", "dealt_salt")


def compressed(data: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable row."""
    books = fit(data, parts, entries, rounds, scale, id_col, vector_col)
    named = data.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    rows = kept(encode(named, books, "v").drop("v"))
    return with_label_errors(rows).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, dim: int = 64) -> str:
    """The same in SQL, each round two steps, for vectors of one length."""
    size = dim // parts
    steps = [
        f"""k AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS r,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""x AS MATERIALIZED (
  SELECT r, CAST(floor(i / {size}) AS INTEGER) AS part, i % {size} AS place, e[i + 1] AS v
  FROM (SELECT r, e, unnest(range({dim})) AS i FROM k))""",
        f"""c0 AS MATERIALIZED (
  SELECT part, r - 1 AS entry, place, v FROM x WHERE r <= {entries})""",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, part, entry, d FROM (
    SELECT x.r, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d
    FROM x JOIN c{n} c ON x.part = c.part AND x.place = c.place
    GROUP BY x.r, x.part, c.entry) t
  QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, c.place, coalesce(m.v, c.v) AS v
  FROM c{n} c LEFT JOIN (
    SELECT a.part, a.entry, x.place, CAST(floor(CAST(sum(x.v) AS DOUBLE) / count(*)) AS BIGINT) AS v
    FROM a{n} a JOIN x ON a.r = x.r AND a.part = x.part
    GROUP BY a.part, a.entry, x.place) m
  ON c.part = m.part AND c.entry = m.entry AND c.place = m.place)""")
    steps.append(f"""told AS (
  SELECT k.vec_id, k.label, g.code, g.error
  FROM k JOIN (
    SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM a{rounds} GROUP BY r) g ON k.r = g.r)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) FROM c{rounds}) AS codebooks_sha256
FROM told"""


ORACLE_SQL = oracle_sql()
