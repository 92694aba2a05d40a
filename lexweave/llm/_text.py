"""Vectorised word and shingle hashing over Arrow string columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer text is hashed alone.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C55
_U = np.uint64
#: Words up to this many bytes are hashed as a sum over their bytes and places; longer ones by BLAKE2b.
LONG_WORD = 128


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), PIECE + 1)
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    a = np.full(m, b, dtype=_U)
                    a[0] = 1
                    setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def pieces(off: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together take ``limit`` bytes at most, one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


_PLACES = mix(np.arange(1, LONG_WORD + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def words(raw: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACE):
    """Words of consecutive texts: (hash, start, end, first word of each text and the total).

    ``raw`` holds the texts back to back, ``off`` their offsets from 0. A-Z count as a-z. A word's
    hash is the sum of its bytes, each times a factor of its place that follows no pattern, so that
    neither order nor repetition makes two words agree.
    """
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(_U), z, z, np.zeros(len(off), np.int64)
    low = LOWER[raw]
    inside = ~breaks[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(s):
        return np.zeros(0, _U), s, e, np.zeros(len(off), np.int64)
    size = e - s
    own = low[inside]
    begin = np.cumsum(size) - size
    place = np.arange(len(own), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
    with np.errstate(over="ignore"):
        parts = _PLACES.take(place, mode="clip")
        parts *= own.astype(_U) + _U(1)
        h = mix(np.add.reduceat(parts, begin) + size.astype(_U))
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(low[s[k] : e[k]].tobytes(), digest_size=8).digest(), "little")
    return h, s, e, np.searchsorted(s, off)


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words.

    A text of fewer words, but not none, has one shingle: the whole sequence.
    """
    h, _, _, first = words(raw, off)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(h) - size + 1), dtype=_U)
        places = mix(np.arange(1, size + 1, dtype=_U)) | _U(1)  # without a pattern, so that no two orders of the same words agree
        for k in range(size):
            runs += h[k : k + len(runs)] * places[k]
        runs = mix(runs)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                x = _U(b - a)
                for w in h[a:b]:
                    x = x * _U(_BASE) + w
                yield mix(np.array([x], dtype=_U))
            else:
                yield np.zeros(0, dtype=_U)
