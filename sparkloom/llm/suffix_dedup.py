"""Suffix-array dedup: the bytes of repeated substrings are removed, the first document keeps them.

Suffixes are ordered only as deep as `length` bytes, by most-significant-digit passes,
and each pass drops the groups of one:

1. Counting pass. Digits are the first DIGIT bytes of suffixes; those whose hash falls
   into one class of SAMPLE are counted over all documents (census.py). A suffix all of
   whose counted digits, within its first `length` bytes, come again goes on; another
   can't be equal to any. Equal suffixes have equal digits, so none is lost.
2. Dealing. Suffixes that go on stand side by side in passages. A passage is cut where
   the smallest-hashed run of RUN bytes within a suffix's first `length` changes, and
   goes to the bucket of that run, which equal suffixes share. A batch sends each
   distinct piece once, with its smallest id, so that a passage in a third of all
   documents costs a few pieces for each batch, not for each document.
3. Sorting. A bucket sorts its suffixes by their first eight bytes, then each group by
   the next eight, and so on through `length` bytes. The groups that are left are
   exactly the repeated windows, compared byte by byte; no hash decides.
4. Each batch is told which suffixes of its pieces also start in a document of a smaller
   id, and marks their bytes.

All distinct surroundings of one run that repeat in full windows meet in one bucket.

Null texts are empty. Rows with a null id are returned whole and remove nothing.
Rows that share an id are one document: they remove nothing from each other.
Texts shorter than `length` bytes are returned whole. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .census import ANSWER, ANSWER_SQL, SLICE, SLOTS_SQL, Census, dealt, rows_of
from .hashing import BYTE, join, mix, pack_ids, unpack_ids

DIGIT, SAMPLE, RUN, BUCKET = 24, 4, 12, 4_000_000

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPANS), ("kept", pa.binary())])
_OUT_SQL = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
_PIECES = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("data", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])
_PIECES_SQL = "bucket int, batch int, data binary, sizes binary, ids binary"


def spans_of(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


class _Batch:
    """The texts of a batch, one after another, and where windows and digits fit in one text."""

    def __init__(self, table: pa.Table, length: int):
        self.length, self.rows = length, rows_of(table)
        self.data = b"".join(t for _, t in self.rows)
        self.begin = np.concatenate(([0], np.cumsum([len(t) for _, t in self.rows]))).astype(np.int64)
        self.buf = np.frombuffer(self.data + b"\0" * (2 * length), np.uint8)
        self.digit = min(DIGIT, length)
        self.fits, self.counted = np.zeros(len(self.buf), bool), np.zeros(len(self.buf), bool)
        for (i, t), a in zip(self.rows, self.begin[:-1], strict=True):
            if i is not None and len(t) >= length:
                self.fits[a : a + len(t) - length + 1] = True
                self.counted[a : a + len(t) - self.digit + 1] = True

    def _slices(self):
        """Start of each slice and the hashes of its runs of 1, 2, 4, ... bytes."""
        for a in range(0, len(self.data), SLICE):
            h = {1: BYTE[self.buf[a : a + SLICE + 2 * self.length]]}
            n = 1
            while 2 * n <= max(self.digit, RUN):
                h[2 * n] = join(h[n][:-n], h[n][n:])
                n *= 2
            yield a, h

    @staticmethod
    def _run(h: dict[int, np.ndarray], n: int) -> np.ndarray:
        p = 1 << (n.bit_length() - 1)
        return h[p] if p == n else join(h[p][: len(h[p]) - (n - p)], h[p][n - p :])

    def digits(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of the digits that are counted."""
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, h in self._slices():
            run = self._run(h, self.digit)[:SLICE]
            at = np.flatnonzero((run % np.uint64(SAMPLE) == 0) & self.counted[a : a + len(run)])
            places.append(at + a)
            hashes.append(run[at])
        return np.concatenate(places), np.concatenate(hashes)

    def alive(self, census: Census, answers: list[dict]) -> np.ndarray:
        """Of each place: whether its window goes on after the counting pass."""
        places, hashes = self.digits()
        single = np.zeros(len(self.buf) + 1, np.int32)
        single[places[~census.repeated(hashes, answers)] + 1] = 1
        single = np.cumsum(single, dtype=np.int32)
        inside = self.length - self.digit + 1
        out = np.zeros(len(self.buf), bool)
        n = len(self.data)
        out[:n] = self.fits[:n] & (single[inside : n + inside] == single[:n])
        return out

    def pieces(self, alive: np.ndarray, buckets: int):
        """Place, number of windows and distinct piece of each piece; bytes, smallest id and bucket of each distinct one."""
        run, count = min(RUN, self.length), self.length - min(RUN, self.length) + 1
        place, size, bucket = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        low = np.uint64((1 << 20) - 1)
        for a, h in self._slices():
            here = alive[a : a + SLICE]
            if not here.any():
                continue
            r = self._run(h, run)
            key = (r & ~low) | np.arange(len(r), dtype=np.uint64)
            n = 1
            while 2 * n <= count:
                key = np.minimum(key[:-n], key[n:])
                n *= 2
            if n < count:
                key = np.minimum(key[: len(key) - (count - n)], key[count - n :])
            at = np.flatnonzero(here)
            anchor = (key[at] & low).astype(np.int64)
            fresh = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])))
            first = np.flatnonzero(fresh)
            place.append(at[first] + a)
            size.append(np.diff(np.concatenate((first, [len(at)]))))
            bucket.append((mix(r[anchor[first]]) % np.uint64(buckets)).astype(np.int64))
        place, size, bucket = np.concatenate(place), np.concatenate(size), np.concatenate(bucket)
        doc = np.searchsorted(self.begin, place, "right") - 1
        ids = np.array([i or 0 for i, _ in self.rows], np.int64)[doc]
        numbers: dict[bytes, int] = {}
        own = np.array([numbers.setdefault(self.data[p : p + n], len(numbers)) for p, n in zip(place.tolist(), (size + self.length - 1).tolist(), strict=True)], np.int64)
        least, where = np.full(len(numbers), np.iinfo(np.int64).max), np.zeros(len(numbers), np.int64)
        np.minimum.at(least, own, ids)
        where[own] = bucket
        order = np.argsort(where, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        distinct = list(numbers)
        return place, size, ids, rank[own], [distinct[k] for k in order], least[order], np.searchsorted(where[order], np.arange(buckets + 1))

    def removed(self, census: Census, buckets: int, answers: list[dict]) -> list[np.ndarray]:
        """A mask of the removed bytes of each row."""
        place, size, ids, own, _, least, begin = self.pieces(self.alive(census, answers), buckets)
        spans = [np.zeros((0, 2), np.int64)]
        whole = ids > least[own] if len(own) else np.zeros(0, bool)
        spans.append(np.stack([place[whole], place[whole] + size[whole]], axis=1))
        told = [(np.frombuffer(r["a"], "<u4") + begin[r["range"]], np.frombuffer(r["b"], np.uint8).reshape(-1, 2)) for r in answers if r["kind"] == 2]
        if told:
            # the pieces of the smallest id lose the windows that start in a still smaller document
            piece, runs = np.concatenate([t[0] for t in told]), np.concatenate([t[1] for t in told]).astype(np.int64)
            order = np.argsort(piece, kind="stable")
            piece, runs = piece[order], runs[order]
            mine = np.flatnonzero(~whole)
            a, b = np.searchsorted(piece, own[mine]), np.searchsorted(piece, own[mine], "right")
            at = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())
            start = np.repeat(place[mine], b - a) + runs[at, 0]
            spans.append(np.stack([start, start + runs[at, 1]], axis=1))
        spans = np.concatenate(spans)
        depth = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(depth, spans[:, 0], 1)
        np.add.at(depth, spans[:, 1] + self.length - 1, -1)
        mask = np.cumsum(depth, dtype=np.int32) > 0
        return [mask[a:b] for a, b in zip(self.begin[:-1], self.begin[1:], strict=True)]


def radix_groups(data: bytes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at these places that come twice or more through `length` bytes, and the number of each one's group.

    Most significant digit first, eight bytes a pass; groups of one drop out at each pass.
    """
    words = np.ndarray((max(0, len(data) - 7),), ">u8", data, 0, (1,))
    left, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for offset in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        digit = words[at[left] + offset].astype(np.uint64)
        order = np.argsort(digit, kind="stable")
        if offset:
            order = order[np.argsort(group[order], kind="stable")]
        left, group, digit = left[order], group[order], digit[order]
        if not len(left):
            break
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
        number = np.cumsum(fresh) - 1
        several = (np.bincount(number) > 1)[number]
        left, group = left[several], number[several]
    return left, group


def _sorted_bucket(table: pa.Table, length: int) -> pa.Table:
    """Answers for the pieces of one bucket: their windows that also start in a document of a smaller id."""
    rows = table.to_pylist()
    sizes = [np.frombuffer(r["sizes"], "<u2").astype(np.int64) for r in rows]
    size, piece_id = np.concatenate(sizes), np.concatenate([unpack_ids(r["ids"]) for r in rows])
    begin, n = np.cumsum(size) - size, size - length + 1
    piece = np.repeat(np.arange(len(size)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left, group = radix_groups(b"".join(r["data"] for r in rows), begin[piece] + offset, length)
    if not len(left):
        return pa.Table.from_pylist([], ANSWER)
    ids = piece_id[piece[left]]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    group = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(group)]))))
    gone = np.sort(left[np.minimum.reduceat(ids, first)[group] < ids])
    if not len(gone):
        return pa.Table.from_pylist([], ANSWER)
    fresh = np.concatenate(([True], (gone[1:] != gone[:-1] + 1) | (piece[gone[1:]] != piece[gone[:-1]])))
    start = np.flatnonzero(fresh)
    runs = np.stack([offset[gone[start]], np.diff(np.concatenate((start, [len(gone)])))], axis=1).astype(np.uint8)
    owner = piece[gone[start]]
    cut = np.searchsorted(owner, np.cumsum([0] + [len(s) for s in sizes]))
    base = np.cumsum([0] + [len(s) for s in sizes])
    out = [{"batch": r["batch"], "kind": 2, "range": r["bucket"], "a": (owner[i:j] - b).astype("<u4").tobytes(), "b": runs[i:j].tobytes()} for r, i, j, b in zip(rows, cut[:-1], cut[1:], base[:-1], strict=True) if i < j]
    return pa.Table.from_pylist(out, ANSWER)


def remove_repeated_bytes(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs, as byte offsets) and kept (bytes) of each row; length: 12 to 255."""
    texts, total = dealt(docs, id_col, text_col, batch_bytes)
    census, buckets = Census(total // SAMPLE), max(1, -(-total // BUCKET))

    def count(table: pa.Table) -> pa.Table:
        return census.ask(_Batch(table, length).digits()[1], table.column("batch")[0].as_py())

    def deal(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], _PIECES)
        batch, b = table.column("batch")[0].as_py(), _Batch(table, length)
        _, _, _, _, distinct, least, begin = b.pieces(b.alive(census, answers.to_pylist()), buckets)
        rows = [{"bucket": k, "batch": batch, "data": b"".join(distinct[i:j]), "sizes": np.array([len(x) for x in distinct[i:j]], "<u2").tobytes(), "ids": pack_ids(least[i:j])} for k, (i, j) in enumerate(zip(begin[:-1], begin[1:], strict=True)) if i < j]
        return pa.Table.from_pylist(rows, _PIECES)

    def end(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], _OUT)
        b = _Batch(table, length)
        masks = b.removed(census, buckets, answers.to_pylist())
        kept = [t if not m.any() else np.frombuffer(t, np.uint8)[~m].tobytes() for (_, t), m in zip(b.rows, masks, strict=True)]
        return pa.Table.from_pydict({"doc_id": [i for i, _ in b.rows], "n_bytes": [len(t) for _, t in b.rows], "n_removed": [int(m.sum()) for m in masks], "spans": [spans_of(m) if m.any() else [] for m in masks], "kept": kept}, _OUT)

    batches = texts.groupBy("batch")
    counted = batches.applyInArrow(count, SLOTS_SQL).groupBy("range").applyInArrow(lambda t: census.meet(t), ANSWER_SQL)
    pieces = batches.cogroup(counted.groupBy("batch")).applyInArrow(deal, _PIECES_SQL)
    solved = pieces.groupBy("bucket").applyInArrow(lambda t: _sorted_bucket(t, length), ANSWER_SQL)
    return batches.cogroup(counted.unionByName(solved).groupBy("batch")).applyInArrow(end, _OUT_SQL)
