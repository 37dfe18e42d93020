"""Vectorised hashing of bytes, words and runs of them, used inside Arrow tasks.

Everything here works on one bounded slice of a batch; Spark partitions and
shuffles the batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

A = np.uint64(0x9E3779B97F4A7C15)
B = np.uint64(0xD6E8FEB86659FD93)
C = np.uint64(0xC2B2AE3D27D4EB4F)
_32, _29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> _32)
    x *= B
    x ^= x >> _29
    x *= C
    x ^= x >> _32
    return x


def join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The hash of two runs put together, from the hashes of both."""
    z = x * A
    z += y
    z ^= z >> _32
    z *= B
    z ^= z >> _29
    return z


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * A)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RADIX = np.uint64(0xA0761D6478BD642F)
_INVERSE = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        m = max(n, 1 << 18)
        for name, base in (("up", _RADIX), ("down", _INVERSE)):
            ones = np.full(m, base, np.uint64)
            ones[0] = 1
            _powers[name] = np.multiply.accumulate(ones)
    return _powers["up"][:n], _powers["down"]


def _slice_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a slice that begins and ends between words."""
    inside = np.empty(len(buf) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(SPACE[buf], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[buf] * up, out=total[1:])
    words = (total[end] - total[start]) * down[start] if len(start) else np.zeros(0, np.uint64)
    return mix(words + (end - start).astype(np.uint64) * A), start


def words_of(texts: list[bytes], limit: int = 1 << 18) -> list[np.ndarray]:
    """The 64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of each text, in order.

    Small texts are hashed together; a long one is cut between words into slices
    of about `limit` bytes, so memory stays bounded.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            begin = np.cumsum([0] + [len(t) + 1 for t in group])
            words, start = _slice_words(np.frombuffer(b"\n".join(group), np.uint8))
            cut = np.searchsorted(start, begin)
            out.extend(words[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True))
            group, size = [], 0

    for text in texts:
        if len(text) > limit:
            flush()
            parts, at = [], 0
            view = np.frombuffer(text, np.uint8)
            while at < len(text):
                end = min(at + limit, len(text))
                while end < len(text) and not SPACE[view[end]]:
                    end += 1
                parts.append(_slice_words(view[at:end])[0])
                at = end
            out.append(np.concatenate(parts))
            continue
        group.append(text)
        size += len(text) + 1
        if size >= limit:
            flush()
    flush()
    return out


def bounded(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each, one row at least."""
    ends = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield batch.slice(a, b - a)
        a = b


def pack(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpack(data: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, size)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :size] = raw
    return out.view("<u8").ravel()


def pack_ids(x: np.ndarray) -> bytes:
    """64-bit ids with equal bytes side by side, which the shuffle's codec then shrinks."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()
