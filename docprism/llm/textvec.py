"""Vectorised text primitives over Arrow string buffers.

Everything here works on the contiguous UTF-8 bytes of a whole Arrow column
slice at once: word boundaries come from a 256-entry byte table, word hashes
from one wrapping prefix sum of a polynomial over the ring of 64-bit integers.
Separators are always ASCII, so multi-byte characters never split.  Memory is
bounded by ``BLOCK`` bytes of text (or by one single longer word), never by a
document: long documents are cut at separators and their words concatenated.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(int(_P), -1, 1 << 64))


def release() -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only glibc has it
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, releasing memory when the task's input ends."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def _byte_values(salt: int) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(salt)).integers(1, 1 << 63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]  # A-Z hash as a-z
    return values


_VALUES = _byte_values(11)
_VALUES_B = _byte_values(12)
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, BLOCK + 1)
        a, b = np.full(size, _P, U64), np.full(size, _P_INV, U64)
        a[0] = b[0] = 1
        _pow, _inv = np.cumprod(a), np.cumprod(b)
    return _pow[:n], _inv[:n]


def word_bytes(separators: str) -> np.ndarray:
    """Table of the bytes that belong to words, given the ASCII separators."""
    table = np.ones(256, bool)
    table[[ord(c) for c in separators]] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = word_bytes(" \t\n\v\f\r")
#: lower-cased text, then ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``; A-Z count as their lower case
ALNUM = word_bytes("".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def row_blocks(offsets: np.ndarray, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, at least one row each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Words:
    """Words of the rows of one block: ``start``/``end`` byte places, ``hash``, and ``first[r]:first[r+1]`` per row."""

    __slots__ = ("start", "end", "hash", "first")

    def __init__(self, start, end, hash_, first):
        self.start, self.end, self.hash, self.first = start, end, hash_, first


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int, salt_b: bool = False) -> np.ndarray:
    """Hash of each ``data[start:end]`` (A-Z as a-z); the ranges lie in ``data``, whose first byte has place ``base``."""
    n = len(data)
    if not len(start):
        return np.zeros(0, U64)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((_VALUES_B if salt_b else _VALUES)[data] * power[:n], out=total[1:])
    s, e = start - base, end - base
    return mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> Words:
    """All words of all rows."""
    base, stop = int(offsets[0]), int(offsets[-1])
    starts, ends, hashes = [], [], []
    a = base
    while a < stop:
        b = min(stop, a + BLOCK)
        while b < stop and table[data[b - 1]] and table[data[b]]:  # move the cut to a separator
            hop = table[data[b : b + 4096]]
            cut = int(np.argmin(hop)) if not hop.all() else len(hop)
            b += cut
        part = data[a:b]
        inside = table[part]
        edge = np.empty(len(part) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = inside[0], inside[-1]
        lo, hi = np.searchsorted(offsets, a, "left"), np.searchsorted(offsets, b, "right")
        begin = np.empty(len(part) + 1, bool)
        begin[:-1] = edge[:-1] & inside
        begin[-1] = False
        finish = np.empty(len(part) + 1, bool)
        finish[1:] = edge[1:] & inside
        finish[0] = False
        rows = np.unique(offsets[lo:hi]) - a
        at = rows[rows < len(part)]
        begin[at] |= inside[at]
        at = rows[rows > 0]
        finish[at] |= inside[at - 1]
        s, e = np.flatnonzero(begin) + a, np.flatnonzero(finish) + a
        starts.append(s)
        ends.append(e)
        hashes.append(range_hashes(part, s, e, a))
        a = b
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    hash_ = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    return Words(start, end, hash_, np.searchsorted(start, offsets))


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], U64)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (``len(h) - k + 1`` values)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(0x9E3779B97F4A7C15)
        out += h[j : j + n]
    return mix(out ^ U64(k))


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts of code points: ``c[e] - c[s]`` are those that begin in ``data[s:e]``."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
