"""Substring dedup on a compacted de Bruijn graph of words.

The graph's nodes are the windows of `length` words, its edges the runs of one word
more: a document is a walk. Which words are covered by a window that also starts in a
document with a smaller id?

1. Counting pass (census.py). Windows seen once end here; they can't repeat.
2. Edges. A batch of documents sends each distinct window that is left, with the edge
   that leaves it and the one that enters it, or a mark if it has several of a kind.
   Edges meet by their window, which gives its out- and in-degree over all documents;
   the end and the begin of a document count as edges of their own.
3. Compaction. Along a document, windows whose common edge is the only one that leaves
   the first and the only one that enters the second lie on one nonbranching path, and
   so do they in every document. Each path is one row, under a digest of its words
   (BLAKE2b, 128 bits), and equal paths are joined by Spark: each batch sends its
   distinct ones once, so that a passage in a third of all documents costs one row for
   each batch.
4. Verification. The source coordinates (document and word offset) of each path whose
   words also stand in a document of a smaller id mark the repeated spans.

Windows are told apart by 64-bit hashes and edges by 48 bits more, which could only cut
a path at the wrong place; what is removed was compared by digests of whole paths.

Null texts have no words. Rows with a null id are returned whole and remove nothing.
Rows that share an id are one document. Other columns are left out.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .census import ANSWER, ANSWER_SQL, SLOTS_SQL, Census, dealt, rows_of
from .hashing import join, pack, unpack, words_of
from .suffix_dedup import _SPANS, spans_of

NODES = 1_000_000
_48 = np.uint64((1 << 48) - 1)
_NONE, _SEVERAL = np.uint64(0), _48

_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPANS), ("kept", pa.binary())])
_OUT_SQL = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
_EDGES = pa.schema([("range", pa.int32()), ("batch", pa.int32()), ("node", pa.binary()), ("next", pa.binary()), ("prev", pa.binary())])
_EDGES_SQL = "range int, batch int, node binary, next binary, prev binary"
_PATHS = pa.schema([("batch", pa.int32()), ("place", pa.int32()), ("words", pa.binary()), ("least", pa.int64())])
#: No column is null, so that no filter on nulls tells the two uses of the paths apart, and Spark works them out once.
_PATHS_TYPE = T.StructType([T.StructField(n, t, False) for n, t in (("batch", T.IntegerType()), ("place", T.IntegerType()), ("words", T.BinaryType()), ("least", T.LongType()))])
SEEN, OUT, IN = 1, 2, 4


class _Batch:
    """The words of a batch, one document after another, as hashes; of each window its hash and its edges."""

    def __init__(self, table: pa.Table, length: int):
        self.length, self.rows = length, rows_of(table)
        words = words_of([t for _, t in self.rows])
        self.begin = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        h = np.concatenate([*words, np.zeros(length, np.uint64)])
        n = 1
        while 2 * n <= length:
            h = join(h[:-n], h[n:])
            n *= 2
        self.hash = h if n == length else join(h[: len(h) - (length - n)], h[length - n :])
        total = int(self.begin[-1])
        self.hash = self.hash[:total]
        valid = np.zeros(total, bool)
        for (i, _), a, b in zip(self.rows, self.begin[:-1], self.begin[1:], strict=True):
            if i is not None:
                valid[a : max(a, b - length + 1)] = True
        self.at = np.flatnonzero(valid)
        self.node = self.hash[self.at]
        follows = np.concatenate((self.at[1:] == self.at[:-1] + 1, [False])) if len(self.at) else np.zeros(0, bool)
        self.follows = follows
        mark = (self.node & _48) | np.uint64(1)  # never like a begin or an end
        mark = np.where(mark == _SEVERAL, np.uint64(1), mark)
        self.next, self.prev = np.zeros(len(mark), np.uint64), np.zeros(len(mark), np.uint64)
        self.next[follows] = mark[1:][follows[:-1]]
        self.prev[1:][follows[:-1]] = mark[:-1][follows[:-1]]

    def edges(self, census: Census, answers: list[dict], ranges: int):
        """Distinct windows that go on, by range: hash, next, prev; which entry each of them is, and which windows they are."""
        going = np.flatnonzero(census.repeated(self.node, answers))
        node, first, own, times = np.unique(self.node[going], return_index=True, return_inverse=True, return_counts=True)
        ends = []
        for edge in (self.next[going], self.prev[going]):
            seen = edge[first]
            differ = np.zeros(len(node), bool)
            np.logical_or.at(differ, own, edge != seen[own])
            ends.append(np.where(differ, _SEVERAL, seen))
        bucket = (node % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        flags = (np.where(times > 1, SEEN, 0) | np.where(ends[0] == _SEVERAL, OUT, 0) | np.where(ends[1] == _SEVERAL, IN, 0)).astype(np.uint8)
        return node[order], ends[0][order], ends[1][order], flags[order], rank[own], going, np.searchsorted(bucket[order], np.arange(ranges + 1))

    def paths(self, census: Census, answers: list[dict], ranges: int):
        """Document, first word and number of windows of each nonbranching path that repeats; which distinct path it is; digest and smallest id of those."""
        _, _, _, flags, own, going, begin = self.edges(census, answers, ranges)
        for r in answers:
            if r["kind"] == 2:
                i = begin[r["range"]]
                told = np.frombuffer(r["a"], np.uint8)
                flags[i : i + len(told)] |= told
        flag = flags[own]
        seen = (flag & SEEN) > 0
        going, flag = going[seen], flag[seen]
        linked = (going[1:] == going[:-1] + 1) & self.follows[going[:-1]] & ((flag[:-1] & OUT) == 0) & ((flag[1:] & IN) == 0) if len(going) else np.zeros(0, bool)
        first = np.flatnonzero(np.concatenate(([True], ~linked))) if len(going) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((first, [len(going)])))
        place = self.at[going[first]]
        doc = np.searchsorted(self.begin, place, "right") - 1
        numbers: dict[bytes, int] = {}
        path, spelled, last = [], [], -1
        for d, p, n in zip(doc.tolist(), (place - self.begin[doc]).tolist(), size.tolist(), strict=True):
            if d != last:
                spelled, last = self.rows[d][1].split(), d
            path.append(numbers.setdefault(blake2b(b" ".join(spelled[p : p + n + self.length - 1]), digest_size=16).digest(), len(numbers)))
        path = np.array(path, np.int64)
        ids = np.array([i or 0 for i, _ in self.rows], np.int64)[doc]
        least = np.full(len(numbers), np.iinfo(np.int64).max)
        np.minimum.at(least, path, ids)
        return place, size, ids, path, list(numbers), least

    def removed(self, census: Census, answers: list[dict], ranges: int) -> list[np.ndarray]:
        """A mask of the removed words of each row."""
        place, size, ids, path, _, least = self.paths(census, answers, ranges)
        least = least.copy()
        for r in answers:
            if r["kind"] == 3:
                least[r["range"]] = min(least[r["range"]], int.from_bytes(r["a"], "big", signed=True))
        gone = least[path] < ids if len(path) else np.zeros(0, bool)
        depth = np.zeros(int(self.begin[-1]) + 1, np.int32)
        np.add.at(depth, place[gone], 1)
        np.add.at(depth, place[gone] + size[gone] + self.length - 1, -1)
        mask = np.cumsum(depth) > 0
        return [mask[a:b] for a, b in zip(self.begin[:-1], self.begin[1:], strict=True)]


def _degrees(table: pa.Table) -> pa.Table:
    """Of the windows of one range: whether several batches have them, and whether more than one edge leaves or enters them."""
    rows = table.to_pylist()
    node = [np.frombuffer(r["node"], "<u8") for r in rows]
    size = np.cumsum([0] + [len(x) for x in node])
    node = np.concatenate(node)
    order = np.argsort(node, kind="stable")
    fresh = np.flatnonzero(np.concatenate(([True], node[order][1:] != node[order][:-1])))
    times = np.diff(np.concatenate((fresh, [len(node)])))
    flag = np.where(times > 1, SEEN, 0)
    for name, bit in (("next", OUT), ("prev", IN)):
        edge = np.concatenate([unpack(r[name], 6) for r in rows])[order]
        several = (np.minimum.reduceat(edge, fresh) != np.maximum.reduceat(edge, fresh)) | (edge[fresh] == _SEVERAL)
        flag |= np.where(several, bit, 0)
    out = np.empty(len(node), np.uint8)
    out[order] = np.repeat(flag, times)
    return pa.Table.from_pylist([{"batch": r["batch"], "kind": 2, "range": r["range"], "a": out[i:j].tobytes(), "b": b""} for r, i, j in zip(rows, size[:-1], size[1:], strict=True)], ANSWER)


def remove_repeated_words(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed runs, as word offsets) and kept (words joined by one space, UTF-8)."""
    texts, total = dealt(docs, id_col, text_col, batch_bytes)
    census, ranges = Census(total // 6), max(1, -(-(total // 6) // NODES))

    def count(table: pa.Table) -> pa.Table:
        return census.ask(_Batch(table, length).node, table.column("batch")[0].as_py())

    def edges(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], _EDGES)
        batch = table.column("batch")[0].as_py()
        node, after, before, _, _, _, begin = _Batch(table, length).edges(census, answers.to_pylist(), ranges)
        return pa.Table.from_pylist([{"range": k, "batch": batch, "node": node[i:j].astype("<u8").tobytes(), "next": pack(after[i:j], 6), "prev": pack(before[i:j], 6)} for k, (i, j) in enumerate(zip(begin[:-1], begin[1:], strict=True)) if i < j], _EDGES)

    def compacted(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], _PATHS)
        *_, digests, least = _Batch(table, length).paths(census, answers.to_pylist(), ranges)
        batch = table.column("batch")[0].as_py()
        return pa.Table.from_arrays([pa.array(np.full(len(least), batch), pa.int32()), pa.array(np.arange(len(least)), pa.int32()), pa.array(digests, pa.binary()), pa.array(least, pa.int64())], schema=_PATHS)

    def end(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], _OUT)
        b = _Batch(table, length)
        masks = b.removed(census, answers.to_pylist(), ranges)
        kept = [b" ".join(t.split() if not m.any() else compress(t.split(), (~m).tolist())) for (_, t), m in zip(b.rows, masks, strict=True)]
        return pa.Table.from_pydict({"doc_id": [i for i, _ in b.rows], "n_words": [len(m) for m in masks], "n_removed": [int(m.sum()) for m in masks], "spans": [spans_of(m) if m.any() else [] for m in masks], "kept": kept}, _OUT)

    batches = texts.groupBy("batch")
    counted = batches.applyInArrow(count, SLOTS_SQL).groupBy("range").applyInArrow(lambda t: census.meet(t), ANSWER_SQL)
    degrees = batches.cogroup(counted.groupBy("batch")).applyInArrow(edges, _EDGES_SQL).groupBy("range").applyInArrow(_degrees, ANSWER_SQL)
    known = counted.unionByName(degrees)
    paths = batches.cogroup(known.groupBy("batch")).applyInArrow(compacted, _PATHS_TYPE).repartition("words")
    # the source of each path: the batch and place of the one with the smallest id
    smallest = paths.groupBy("words").agg(F.min(F.struct("least", "batch", "place")).alias("source"))
    told = paths.join(smallest, "words").where("source.least < least AND (source.batch <> batch OR source.place <> place)")
    told = told.select("batch", F.lit(3).alias("kind"), F.col("place").alias("range"), F.unhex(F.lpad(F.hex("source.least"), 16, "0")).alias("a"), F.lit(b"").alias("b"))
    return batches.cogroup(known.unionByName(told).groupBy("batch")).applyInArrow(end, _OUT_SQL)
