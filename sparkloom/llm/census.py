"""Batches of documents, and the counting pass that both operators on repeated windows begin with.

Documents are dealt by a hash of their id into batches of bounded bytes. A batch gives
each digit (a hash of a run of tokens) a slot, the hash's leading bits, and sends its
distinct slots, sorted and coded in a few bits each. Slots meet by ranges; each batch is
told which of its slots another batch has too. A slot may hold several digits, which
only lets a digit that is seen once pass for a repeated one: later passes are exact.

Rows of a batch are put in an order that depends on their content alone, so that a
batch that is read again, after a lost executor too, numbers its entries alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots for each digit there may be; tokens of a slice that is hashed at once; digits in one range of slots.
SPARE, SLICE, RANGE = 4, 1 << 17, 2_000_000

SLOTS = pa.schema([("range", pa.int32()), ("batch", pa.int32()), ("n", pa.int32()), ("code", pa.binary())])
SLOTS_SQL = "range int, batch int, n int, code binary"
ANSWER = pa.schema([("batch", pa.int32()), ("kind", pa.int32()), ("range", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
ANSWER_SQL = "batch int, kind int, range int, a binary, b binary"


def dealt(docs: DataFrame, id_col: str, text_col: str, batch_bytes: int) -> tuple[DataFrame, int]:
    """Rows of id, data (bytes) and batch, and the bytes in all. Null ids are dealt by their text."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    key = F.coalesce(F.xxhash64(F.col(id_col).cast("long")), F.xxhash64(text_col))
    batches = max(1, -(-total // batch_bytes))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("data"), F.pmod(key, F.lit(batches)).cast("int").alias("batch")), total


def rows_of(table: pa.Table) -> list[tuple[int | None, bytes]]:
    """Id and text of a batch's rows, in an order that depends on them alone."""
    rows = [(i, t or b"") for i, t in zip(table.column("id").to_pylist(), table.column("data").to_pylist(), strict=True)]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def encode(slots: np.ndarray, universe: int) -> bytes:
    """Sorted distinct numbers below universe: leading bits in unary by steps, the rest as they are."""
    n = len(slots)
    low = max(0, int(math.log2(universe / n)))
    steps = np.zeros(n + (universe >> low) + 1, np.uint8)
    steps[(slots >> np.uint32(low)).astype(np.int64) + np.arange(n)] = 1
    rest = np.unpackbits(np.ascontiguousarray(slots.astype("<u4")).view(np.uint8).reshape(n, 4), axis=1, bitorder="little")[:, :low]
    return np.packbits(steps).tobytes() + np.packbits(rest).tobytes()


def decode(code: bytes, n: int, universe: int) -> np.ndarray:
    low = max(0, int(math.log2(universe / n)))
    size = n + (universe >> low) + 1
    raw = np.frombuffer(code, np.uint8)
    cut = -(-size // 8)
    high = np.flatnonzero(np.unpackbits(raw[:cut], count=size)) - np.arange(n)
    rest = np.zeros((n, 32), np.uint8)
    rest[:, :low] = np.unpackbits(raw[cut:], count=n * low).reshape(n, low)
    return ((high << low) + np.packbits(rest, axis=1, bitorder="little").view("<u4").ravel()).astype(np.uint32)


class Census:
    """How digits are given slots: `bits` for a slot, of which the first `ranges` tell its range."""

    def __init__(self, digits: int):
        self.ranges = max(0, math.ceil(math.log2(max(1, digits) / RANGE)))
        self.bits = max(self.ranges + 8, math.ceil(math.log2(SPARE * max(2, digits))))
        self.universe = 1 << (self.bits - self.ranges)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def ask(self, hashes: np.ndarray, batch: int) -> pa.Table:
        """The distinct slots of a batch, a row for each range."""
        slots = np.unique(self.slots(hashes))
        cut = self._cut(slots)
        inside = np.uint64(self.universe - 1)
        rows = [{"range": k, "batch": batch, "n": int(j - i), "code": encode((slots[i:j] & inside).astype(np.uint32), self.universe)} for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
        return pa.Table.from_pylist(rows, SLOTS)

    def _cut(self, slots: np.ndarray) -> np.ndarray:
        return np.searchsorted(slots, np.arange((1 << self.ranges) + 1, dtype=np.uint64) << np.uint64(self.bits - self.ranges))

    def meet(self, table: pa.Table) -> pa.Table:
        """Of the slots of one range: which ones several batches have."""
        once, twice = np.zeros(self.universe, bool), np.zeros(self.universe, bool)
        rows = table.to_pylist()
        found = []
        for r in rows:
            s = decode(r["code"], r["n"], self.universe)
            twice[s] |= once[s]
            once[s] = True
            found.append(s)
        return pa.Table.from_pylist([{"batch": r["batch"], "kind": 1, "range": r["range"], "a": np.packbits(twice[s]).tobytes(), "b": b""} for r, s in zip(rows, found, strict=True)], ANSWER)

    def repeated(self, hashes: np.ndarray, answers: list[dict]) -> np.ndarray:
        """Of a batch's digits, in the order of `hashes`: whether their slot comes again in this batch or in another."""
        slots, at, times = np.unique(self.slots(hashes), return_inverse=True, return_counts=True)
        again = times > 1
        cut = self._cut(slots)
        for r in answers:
            if r["kind"] == 1:
                i, j = cut[r["range"]], cut[r["range"] + 1]
                again[i:j] |= np.unpackbits(np.frombuffer(r["a"], np.uint8), count=int(j - i)).astype(bool)
        return again[at]
