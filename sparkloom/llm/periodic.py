"""Periodic runs of words, by the linear method for tandem repeats of Gusfield and Stoye.

A run is a stretch of consecutive words with a smallest period q that no neighbouring
word extends keeping that period. Runs of `exponent` periods (4, or more) and of
`shortest` words (6, or more) are looked for, document by document:

1. Whatever lies in no such run is put aside. In a run every three-word window comes three
   times, so only stretches of such windows are looked at; nothing else can hold a run.
   The stretches of a batch of documents stand side by side, parted by words of their own.
2. A suffix array and the ranks of all windows of 1, 2, 4, ... words are made by doubling;
   ranks tell how far any two places agree, forwards and backwards.
3. The Lempel-Ziv blocks of the text give the squares (a word sequence written twice) that
   cover every leftmost one: of each block its last boundary, with periods up to its length,
   and its first boundary, with periods up to the length of it and the next.
4. From each of them a walk goes to the next rotation: along the text while the period
   holds, else by the suffix link (the suffixes that begin with what is left without the
   first word), to a branch by the first word. Rotations that were met end a walk. This
   completes the vocabulary: the squares that occur anywhere, each with its suffixes.
5. The suffixes of each square are its occurrences; those of one period that follow one
   another merge into a run.

Squares of squares are left out, as their period is not the smallest. Words are told apart
by 64-bit hashes.

`repeats` returns a row for each row, with its id: n_words, the runs by start and period
(word numbers from 0), and the text without the words of any run after its first period,
its other words joined by one space. Null texts and texts without words have none of these
(0 words, no runs, an empty text). Ids may be null or repeated and other columns have any
name; they are left out. A document is read whole by one task, as its runs may span all of
it: memory grows with the longest text, about 100 bytes for each byte of its stretches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing

#: Text of a batch that is looked at together.
SLICE = 2_000_000
_CHUNK = 1 << 19
_REPEATS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.binary())])


class Suffixes:
    """The suffixes of a text of small numbers, which ends with a number found nowhere else."""

    def __init__(self, text: np.ndarray):
        self.text, self.n = text, len(text)
        rank, self.levels = text.astype(np.int64), []
        while True:
            self.levels.append(np.append(rank, -1).astype(np.int32))
            if rank.max(initial=0) == self.n - 1:
                break
            step = 1 << (len(self.levels) - 1)
            then = np.zeros(self.n, np.int64)
            then[: self.n - step] = rank[step:] + 1
            rank = np.unique(rank * (self.n + 1) + then, return_inverse=True)[1]
        self.rank = rank
        self.order = np.empty(self.n, np.int64)
        self.order[rank] = np.arange(self.n)
        common = np.zeros(self.n, np.int32)
        common[1:] = self.ahead(self.order[:-1], self.order[1:])
        self.least = [common]
        while 2 << (len(self.least) - 1) <= self.n:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i on are those from j on; i is nowhere j."""
        a, b = i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][a] == self.levels[k][b]
            a[same] += 1 << k
            b[same] += 1 << k
        return a - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers before i are those before j; i is nowhere j."""
        a, b = i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = 1 << k
            same = (a >= step) & (b >= step)
            same[same] = self.levels[k][a[same] - step] == self.levels[k][b[same] - step]
            a[same] -= step
            b[same] -= step
        return i - a

    def locus(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last suffix in order that begin as the one at i does, for so many numbers."""
        first, last = self.rank[i], self.rank[i]
        for k in range(len(self.least) - 1, -1, -1):
            step, table = 1 << k, self.least[k]
            at = first - step
            wide = at >= 0
            wide[wide] = table[at[wide] + 1] >= length[wide]
            first = np.where(wide, at, first)
            wide = last + step < self.n
            wide[wide] = table[last[wide] + 1] >= length[wide]
            last = np.where(wide, last + step, last)
        return first, last

    def branch(self, first: np.ndarray, last: np.ndarray, depth: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of suffixes that agree for `depth` numbers, one that goes on with `number`, and whether there is one."""
        low, high = first.copy(), last + 1
        while (open_ := low < high).any():
            mid = (low + high) // 2
            small = open_ & (self.text[np.minimum(self.order[np.minimum(mid, self.n - 1)] + depth, self.n - 1)] < number)
            low = np.where(small, mid + 1, low)
            high = np.where(open_ & ~small, mid, high)
        at = self.order[np.minimum(low, self.n - 1)]
        return at, (low <= last) & (self.text[np.minimum(at + depth, self.n - 1)] == number)

    def blocks(self) -> np.ndarray:
        """The starts of the Lempel-Ziv blocks, and the end of the text."""
        before, after, stack = [-1] * self.n, [-1] * self.n, []
        for x in self.order.tolist():
            while stack and stack[-1] > x:
                after[stack.pop()] = x
            before[x] = stack[-1] if stack else -1
            stack.append(x)
        here, longest = np.arange(self.n), np.zeros(self.n, np.int64)
        for other in (np.array(before), np.array(after)):
            known = other >= 0
            longest[known] = np.maximum(longest[known], self.ahead(here[known], other[known]))
        reach, at, starts = np.maximum(longest, 1).tolist(), 0, []
        while at < self.n:
            starts.append(at)
            at += reach[at]
        return np.array([*starts, self.n])


def _counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry its index n times, beside 0, 1, ... n - 1."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _chunks(sizes: np.ndarray):
    """Slices of entries with about _CHUNK in all."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _CHUNK, "right")))
        yield slice(a, b)
        a = b


def covering(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of squares whose rotations along the text cover every leftmost square."""
    b = s.blocks()
    size = np.diff(b)
    boundary = np.concatenate((b[1:-1], b[1:-1]))
    # the end of a block, backwards; then its start, forwards, through the next block
    sign = np.repeat([-1, 1], len(b) - 2)
    most = np.concatenate((size[:-1], size[1:] + np.append(size[2:], 0)))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for part in _chunks(most):
        owner, period = _counted(most[part])
        h, forward, period = boundary[part][owner], sign[part][owner] > 0, period + 1
        q = np.where(forward, h + period, h - period)
        inside = (q >= 0) & (q < s.n)
        h, q, period, forward = h[inside], q[inside], period[inside], forward[inside]
        same = (s.text[h] == s.text[q]) & (~forward | (s.text[h - 1] == s.text[np.maximum(q - 1, 0)]))
        h, q, period, forward = h[same], q[same], period[same], forward[same]
        after, before = s.ahead(h, q), s.behind(h, q)
        left = np.where(forward, h, q)
        square = after + before >= period
        found.append((np.maximum(left - before, left - period + 1)[square], period[square]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _primitive(s: Suffixes, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether no smaller period that divides this one holds for two of its periods."""
    smallest = np.arange(int(period.max(initial=1)) + 1)
    for p in range(2, int(len(smallest) ** 0.5) + 1):
        if smallest[p] == p:
            multiples = smallest[p * p :: p]
            multiples[multiples == np.arange(p * p, len(smallest), p)] = p
    rest, whole = period.copy(), np.ones(len(period), bool)
    while (more := np.flatnonzero(rest > 1)).size:
        prime = smallest[rest[more]]
        shorter = period[more] // prime
        whole[more] &= s.ahead(start[more], start[more] + shorter) < 2 * period[more] - shorter
        rest[more] //= prime
    return whole


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return tuple(c[new] for c in columns)


def vocabulary(s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last suffix and period of every square that isn't one of squares."""
    start, period = covering(s)
    seen, words = set(), [(np.zeros(0, np.int64),) * 3]
    while len(start):
        start, period = _distinct(start - s.behind(start, start + period), period)
        fresh = np.array([x not in seen for x in zip(start.tolist(), period.tolist(), strict=True)], bool)
        start, period = start[fresh], period[fresh]
        seen.update(zip(start.tolist(), period.tolist(), strict=True))
        whole = _primitive(s, start, period)
        start, period = start[whole], period[whole]
        along = s.ahead(start, start + period) - period
        turns = np.minimum(along, period - 1) + 1
        for part in _chunks(turns):
            owner, turn = _counted(turns[part])
            q = period[part][owner]
            words.append(_distinct(*s.locus(start[part][owner] + turn, 2 * q), q))
        broken = along < period - 1
        at, period = (start + along)[broken], period[broken]
        found, there = s.branch(*s.locus(at + 1, 2 * period - 1), 2 * period - 1, s.text[at])
        start, period = found[there], period[there]
    return _distinct(*(np.concatenate(c) for c in zip(*words, strict=True)))


def runs_of(text: np.ndarray, exponent: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs of a text of small numbers, which ends with a number found nowhere else."""
    s = Suffixes(text)
    first, last, period = vocabulary(s)
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in _chunks(last - first + 1):
        owner, at = _counted((last - first + 1)[part])
        starts.append(s.order[first[part][owner] + at])
        periods.append(period[part][owner])
    q, at = _distinct(np.concatenate(periods), np.concatenate(starts))
    begins = np.ones(len(q), bool)
    begins[1:] = (q[1:] != q[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(begins)
    q, at, length = q[heads], at[heads], np.diff(np.append(heads, len(q))) - 1 + 2 * q[heads]
    long = length >= np.maximum(shortest, exponent * q)
    return at[long], length[long], q[long]


def _stretches(words: np.ndarray, doc: np.ndarray, repeats: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the stretches whose three-word windows all come `repeats` times in their document, or seem to."""
    n = len(words) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    window = hashing.join(hashing.join(hashing.join(words[:-2], words[1:-1]), words[2:]), doc[2:].astype(np.uint64))
    bits = max(10, min(26, int(n).bit_length() + 2))
    slot = (window >> np.uint64(64 - bits)).astype(np.int64)
    often = np.zeros(n + 2, bool)
    often[1:-1] = (np.bincount(slot, minlength=1 << bits)[slot] >= repeats) & (doc[2:] == doc[:-2])
    edge = np.flatnonzero(often[1:] != often[:-1])
    start, end = edge[::2], edge[1::2]
    # windows of two documents that touch are parted by windows that lie in both
    long = end - start >= shortest - 2
    return start[long], (end - start + 2)[long]


def document_runs(documents: list[np.ndarray], exponent: int = 4, shortest: int = 6) -> list[np.ndarray]:
    """For each document, given as the hashes of its words, its runs: rows of start, length and period, by start and period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    offset = np.cumsum(sizes) - sizes
    words = np.concatenate([np.zeros(0, np.uint64), *documents])
    doc = np.repeat(np.arange(len(documents)), sizes)
    start, length = _stretches(words, doc, min(exponent, max(exponent, shortest) - 1) - 1, shortest)
    found = []
    for part in _chunks(length):
        owner, at = _counted(length[part])
        place = start[part][owner] + at
        numbers = np.unique(hashing.join(words[place], doc[place].astype(np.uint64)), return_inverse=True)[1]
        ends = np.cumsum(length[part])
        text = np.insert(numbers, ends, numbers.max(initial=0) + 1 + np.arange(len(ends)))
        at, size, period = runs_of(text, exponent, shortest)
        segment = np.searchsorted(ends + np.arange(len(ends)), at, "right")
        begin = np.append(0, ends + 1 + np.arange(len(ends)))
        first = start[part][segment] + at - begin[segment]
        found.append(np.stack((doc[first], first - offset[doc[first]], size, period), axis=1))
    found = np.concatenate([np.zeros((0, 4), np.int64), *found])
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    cut = np.searchsorted(found[:, 0], np.arange(len(documents) + 1))
    return [found[a:b, 1:] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def collapsed(text: bytes, runs: np.ndarray) -> bytes:
    """The words of a text that no run holds after its first period, joined by one space."""
    words = text.split()
    if len(runs):
        inside = np.zeros(len(words) + 1, np.int64)
        np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
        np.add.at(inside, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(inside)[:-1] == 0).tolist()]
    return b" ".join(words)


def repeats(docs: DataFrame, exponent: int = 4, shortest: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and collapsed of each row."""
    if exponent < 4 or shortest < 6:
        raise ValueError("runs of fewer than four periods or six words are not looked for")

    def run(batches):
        for batch in batches:
            for part in hashing.bounded(batch, 1, SLICE):
                texts = [t or b"" for t in part.column(1).to_pylist()]
                words = hashing.words_of(texts)
                runs = document_runs(words, exponent, shortest)
                sizes = np.cumsum([0] + [len(r) for r in runs])
                fields = [pa.array(c, pa.int64()) for c in np.concatenate([np.zeros((0, 3), np.int64), *runs]).T]
                told = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in words], pa.int64()), told, pa.array([collapsed(t, r) for t, r in zip(texts, runs, strict=True)], pa.binary())], schema=_REPEATS)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
