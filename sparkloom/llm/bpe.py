"""BPE encoding and decoding with a public vocabulary file, fragment by fragment.

Two neighbouring bytes that stand side by side inside no token of the vocabulary can
never be merged, so a cut between them is certain. Each word is cut there, and the
fragments are encoded on their own and put together again. Spark deals out the rows;
inside a task, words that come again are looked up in a bounded cache.

The vocabulary file is read once by the driver and travels with the task (a few MB,
whatever the data). Null texts are empty. Special tokens in a text are found first,
as the file says. Other columns are left out.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Sequence
from itertools import pairwise
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import bounded

#: The words, digits and other signs that the vocabulary's file asks for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for the standard library's classes, which agree on the characters that _OTHER leaves.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_FULL = regex.compile(PATTERN)
_OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞]")
_CACHE = 1 << 18
_LONG = 32
_LINE = 500


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself if it has one, else the next free code point from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary and its merges."""

    def __init__(self, text: str):
        told = json.loads(text)
        model = told["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(self.ids.values()) + 1
        self.rank = {self.ids[x] * self.size + self.ids[y]: k for k, (x, y) in enumerate(pairs)}
        self.made = [self.ids[x + y] for x, y in pairs]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = np.empty(max([*self.ids.values(), *self.special.values()]) + 1, object)
        for table in (self.ids, self.special):
            for token, k in table.items():
                self.tokens[k] = token
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        bare = [t.removesuffix(self.end) if self.end else t for t in self.ids]
        self.joined = {t[i : i + 2] for t in bare for i in range(len(t) - 1)}
        self.signs = byte_signs()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def fragments(self, signs: str) -> list[str]:
        joined = self.joined
        cuts = [i for i in range(1, len(signs)) if signs[i - 1 : i + 1] not in joined]
        return [signs[a:b] for a, b in pairwise([0, *cuts, len(signs)])] if cuts else [signs]

    def merge(self, parts: list[int]) -> list[int]:
        """Merges the pair of lowest rank, the leftmost first, until none is left."""
        if len(parts) > _LINE:
            return self._merge_long(parts)
        rank, made, size, none = self.rank.get, self.made, self.size, len(self.made)
        ranks = [rank(x * size + y, none) for x, y in pairwise(parts)]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            parts[i : i + 2] = [made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] * size + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] * size + parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap, as looking through a long list for each merge would take its square."""
        n, rank, size = len(parts), self.rank.get, self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank(parts[i] * size + parts[j]) != r:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank(parts[i] * size + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank(parts[before[i]] * size + parts[i])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> bytes:
        """The ids of one word, as 32-bit integers."""
        found = self.new.get(word) or self.old.get(word)
        if found is None:
            ids, tokens = self.ids, []
            *first, last = self.fragments("".join([self.signs[b] for b in word.encode()]))
            for f in first:
                tokens += self.merge([ids[x] for x in f])
            tokens += self.merge([*(ids[x] for x in last[:-1]), ids[last[-1] + self.end]])
            found = pack(f"<{len(tokens)}i", *tokens)
        if len(word) <= _LONG:
            if len(self.new) >= _CACHE:
                self.old, self.new = self.new, {}
            self.new[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        out = []
        for part in self.split.split(text) if self.split and "<" in text else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], "<i4").tobytes())
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            get, word = self.new.get, self.word
            out += [get(w) or word(w) for w in (_FULL if _OTHER.search(part) else _PLAIN).findall(part)]
            del get
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by spaces, as the file names no decoder of its own."""
        return " ".join(self.tokens[ids].tolist())


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(text: str) -> Vocabulary:
    if text not in _loaded:
        _loaded.clear()
        _loaded[text] = Vocabulary(text)
    return _loaded[text]


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))


def _with(schema: str, docs: DataFrame, carried: Sequence[str]) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(schema).fields, *(docs.schema[c] for c in carried)])


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, ids (array<int>) and the `carried` columns of each row."""
    text = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_text(encoding="utf-8"))

    def run(batches):
        v = _vocabulary(text.value)
        for batch in batches:
            for part in bounded(batch, 1, 1 << 21):
                found = [v.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(found), *part.columns[2:]], ["doc_id", "ids", *carried])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carried).mapInArrow(run, _with("doc_id long, ids array<int>", docs, carried))


def decode(encoded: DataFrame, vocabulary_path: str, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, ids, decoded (text) and the `carried` columns of each row of encode()."""
    text = encoded.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_text(encoding="utf-8"))

    def run(batches):
        v = _vocabulary(text.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = part.column(1)
                flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0] + ids.value_lengths().to_pylist())
                said = [v.decode(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(said, pa.string()), *part.columns[2:]], ["doc_id", "ids", "decoded", *carried])

    return encoded.select("doc_id", "ids", *carried).mapInArrow(run, _with("doc_id long, ids array<int>, decoded string", encoded, carried))
