"""Periodic runs of words (method: Gusfield and Stoye's linear method for tandem repeats).

A run is a maximal stretch of a text's words with smallest period ``q``, at least
``max(least, EXPONENT * q)`` words long.  Per block of whole documents:

1. Reduction without loss: of a run of L words, the windows of W words,
   W = least * (EXPONENT - 1) / EXPONENT, that begin in its first L - q words stand
   again q words later.  So only stretches covered by windows that stand twice in
   their document go on; they are joined by separators that occur once.
2. Suffix tree of these stretches, held as a suffix array with the names of all
   substrings of 2^k words (prefix doubling).  A node is an interval of suffixes and a
   depth; the suffix link of a node with suffix i leads to that of suffix i + 1.  Two
   names compare any two substrings, so longest common extensions take log steps.
3. LZ blocks: each begins with the longest stretch that began earlier as well.
   Extensions on both sides of the block borders give squares that cover the
   leftmost place of every square, the repeats of composed period left out.
4. Suffix-link walks from each covering square: the next suffix's node at the same
   depth holds the rotated square as long as the word that leaves comes back.  With
   them the vocabulary of squares is complete.
5. The suffixes below each node of the vocabulary are all places of its square.
   Places of one period that follow each other merge into a run.

Words count as equal by their bytes, case included (no hashes decide).  Memory is
bounded by ``LIVE`` words of such stretches or by one single document.

Defined results: a null or empty text has no words and no runs; a null id has runs as
any other; repeated rows give repeated results; of runs with the same exponent the
smallest start, then the smallest period, is the greatest; other columns never take
part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprism.llm import textvec as tv

LEAST = 24
EXPONENT = 3
#: Words of repeating stretches that are treated at a time, and pairs (border, period) that are tested at a time: bounds of memory.
LIVE = 1 << 18
PAIRS = 1 << 20
U64 = np.uint64


class Tree:
    """Suffix array of ``x`` with the names of its substrings of 2^k values; the last value of ``x`` occurs once."""

    def __init__(self, x: np.ndarray):
        self.n = n = len(x)
        name = np.unique(x, return_inverse=True)[1].astype(np.int32)
        self.names = [np.append(name, np.int32(-1))]  # place n equals nothing
        size = 1
        while int(name.max()) < n - 1:
            key = name.astype(np.int64) * (n + 1)
            key[: n - size] += name[size:] + 1
            name = np.unique(key, return_inverse=True)[1].astype(np.int32)
            self.names.append(np.append(name, np.int32(-1)))
            size *= 2
        self.rank = name
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[name] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch from ``i`` and ``j`` on (``i != j``)."""
        i, j = i.copy(), j.copy()
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            step = (self.names[k][i] == self.names[k][j]).astype(np.int64) << k
            i += step
            j += step
            length += step
        return length

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends before ``i`` and ``j``."""
        i, j = i.copy(), j.copy()
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            inside = (a >= 0) & (b >= 0)
            step = (inside & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])).astype(np.int64) << k
            i -= step
            j -= step
            length += step
        return length

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``length`` (at least 2^level, under 2^(level + 1)) from ``i`` and ``j`` agree."""
        out = np.zeros(len(i), bool)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            if k >= len(self.names):  # no stretch as long stands twice
                out[at] = i[at] == j[at]
                continue
            names, a, b = self.names[k], i[at], j[at]
            rest = length[at] - (1 << int(k))
            out[at] = (names[a] == names[b]) & (names[np.minimum(a + rest, self.n)] == names[np.minimum(b + rest, self.n)]) & (np.maximum(a, b) + length[at] <= self.n)
        return out

    def nodes(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks ``lo, hi`` of the suffixes that begin with the stretch of ``length`` at ``i``: doubling steps out, halving steps in."""
        level = np.frexp(length.astype(np.float64))[1] - 1
        rank = self.rank[i].astype(np.int64)
        ends = []
        for side in (-1, 1):
            reach, step = np.zeros(len(i), np.int64), np.ones(len(i), np.int64)
            open_ = np.arange(len(i))
            most = np.zeros(len(i), np.int64)
            while len(open_):
                at = rank[open_] + side * (reach[open_] + step[open_])
                inside = (at >= 0) & (at < self.n)
                good = np.zeros(len(open_), bool)
                good[inside] = self.same(i[open_[inside]], self.suffixes[at[inside]], length[open_[inside]], level[open_[inside]])
                reach[open_[good]] += step[open_[good]]
                most[open_[~good]] = step[open_[~good]]
                step[open_[good]] *= 2
                open_ = open_[good]
            open_ = np.flatnonzero(most > 1)
            while len(open_):
                most[open_] //= 2
                at = rank[open_] + side * (reach[open_] + most[open_])
                inside = (at >= 0) & (at < self.n)
                good = np.zeros(len(open_), bool)
                good[inside] = self.same(i[open_[inside]], self.suffixes[at[inside]], length[open_[inside]], level[open_[inside]])
                reach[open_[good]] += most[open_[good]]
                open_ = open_[most[open_] > 1]
            ends.append(rank + side * reach)
        return ends[0], ends[1] + 1


def lz_blocks(tree: Tree) -> np.ndarray:
    """Borders of the LZ blocks, the text's end included; each but new words is the longest stretch with an earlier start."""
    sa, n = tree.suffixes.tolist(), tree.n
    before, after = [-1] * n, [-1] * n  # nearest smaller starts in the order of suffixes
    stack: list[int] = []
    for s in sa:
        while stack and stack[-1] > s:
            after[stack.pop()] = s
        if stack:
            before[s] = stack[-1]
        stack.append(s)
    longest = np.zeros(n, np.int64)
    place = np.arange(n)
    for other in (np.array(before), np.array(after)):
        has = np.flatnonzero(other >= 0)
        longest[has] = np.maximum(longest[has], tree.ahead(place[has], other[has]))
    hop = np.maximum(longest, 1).tolist()
    borders, i = [0], 0
    while i < n:
        i += hop[i]
        borders.append(i)
    return np.array(borders, np.int64)


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0..s-1 for each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _chunks(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(owner, 1..size)`` of all owners, about ``PAIRS`` at a time."""
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
        yield np.repeat(np.arange(a, b), sizes[a:b]), _ramp(sizes[a:b]) + 1
        a = b


def covering_squares(tree: Tree, borders: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``start, period`` of squares, periods up to ``most``, that cover the leftmost places of all: tests around both borders of each block."""
    word = tree.names[0]
    size = np.diff(borders)
    h, h1 = borders[:-1], borders[1:]
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for of, k in _chunks(np.minimum(size, most)):  # across the end of the block
        end = h1[of]
        q = end - k
        at = np.flatnonzero(word[np.minimum(end, tree.n)] == word[q])
        end, q, k = end[at], q[at], k[at]
        k1, k2 = tree.ahead(end, q), tree.behind(end, q)
        good = k1 + k2 >= k
        starts.append(np.maximum(q - k2, q - k + 1)[good])
        periods.append(k[good])
    for of, k in _chunks(np.minimum(size + np.append(size[1:], 0), most)):  # across its beginning
        begin, end = h[of], h1[of]
        q = begin + k
        at = np.flatnonzero((word[np.minimum(q, tree.n)] == word[begin]) & (q < tree.n) & (begin > 0))
        begin, end, q, k = begin[at], end[at], q[at], k[at]
        k1, k2 = tree.ahead(begin, q), tree.behind(begin, q)
        start = np.maximum(begin - k2, begin - k + 1)
        good = (k1 + k2 >= k) & (k2 > 0) & (start + k <= end)
        starts.append(start[good])
        periods.append(k[good])
    return np.concatenate(starts), np.concatenate(periods)


def _primitive(tree: Tree, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the square at ``start`` has no shorter period that divides its own."""
    out = np.ones(len(start), bool)
    if not len(start):
        return out
    least = np.arange(int(period.max()) + 1)  # the least prime factor of each number
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            tail = least[p * p :: p]
            tail[tail == np.arange(p * p, len(least), p)] = p
    left = period.copy()
    at = np.flatnonzero(left > 1)
    while len(at):
        p = least[left[at]]
        short = period[at] // p
        out[at] &= tree.ahead(start[at], start[at] + short) < 2 * period[at] - short
        left[at] //= p
        at = at[out[at] & (left[at] > 1)]
    return out


def vocabulary(tree: Tree, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``lo, hi, period``: the nodes of all squares.  A walk follows suffix links while the rotated square goes on, at most once around."""
    key = np.unique(period * (tree.n + 1) + start)
    period, start = key // (tree.n + 1), key % (tree.n + 1)
    keep = _primitive(tree, start, period)
    start, period = start[keep], period[keep]
    steps = np.minimum(tree.ahead(start, start + period) - period + 1, period)
    place, period = np.repeat(start, steps) + _ramp(steps), np.repeat(period, steps)
    lo, hi = tree.nodes(place, 2 * period)
    _, first = np.unique(period * (tree.n + 1) + lo, return_index=True)
    return lo[first], hi[first], period[first]


def runs_of(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of all runs of two periods or more, periods up to ``most``; the last value of ``x`` occurs once."""
    tree = Tree(x)
    start, period = covering_squares(tree, lz_blocks(tree), most)
    lo, hi, period = vocabulary(tree, start, period)
    places = tree.suffixes[np.repeat(lo, hi - lo) + _ramp(hi - lo)]
    key = np.unique(np.repeat(period, hi - lo) * (2 * tree.n) + places)
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.append(True, np.diff(key) != 1))
    places = np.diff(np.append(first, len(key)))
    period, start = key[first] // (2 * tree.n), key[first] % (2 * tree.n)
    return start, places - 1 + 2 * period, period


def _stretches(ids: np.ndarray, first: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches that windows which stand twice in their document cover."""
    hashes = tv.windows(tv.mix(ids.astype(U64) + U64(1)), width)
    sizes = np.diff(first)
    row = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.flatnonzero(row[: len(hashes)] == row[width - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    key = tv.mix(hashes[whole] ^ tv.mix(row[whole].astype(U64) + U64(77)))
    held = np.sort(key)
    twice = np.unique(held[1:][held[1:] == held[:-1]])
    if not len(twice):
        return (np.zeros(0, np.int64),) * 2
    begin = whole[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
    change = np.zeros(len(ids) + 1, np.int64)
    change[begin] += 1
    np.subtract.at(change, begin + width, 1)
    covered = np.append(np.cumsum(change[:-1]) > 0, False)
    edge = covered[1:] != covered[:-1]
    cut = np.zeros(len(ids) + 1, bool)
    cut[first] = True
    starts = np.flatnonzero(covered[:-1] & (np.append(True, edge[:-1]) | cut[:-1]))
    ends = np.flatnonzero(covered[:-1] & (edge | cut[1:])) + 1
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def runs_in(ids: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of the runs of all documents, ``first`` giving their first words in ``ids``; sorted by start, then period."""
    begin, end = _stretches(ids, first, -(-least * (EXPONENT - 1) // EXPONENT), least)
    size = end - begin
    total = np.cumsum(size + 1)
    found = [(np.zeros(0, np.int64),) * 3]
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + LIVE, "right")))
        joined = np.full(int((size[a:b] + 1).sum()), -1, np.int64)
        at = np.cumsum(size[a:b] + 1) - size[a:b] - 1
        joined[np.repeat(at, size[a:b]) + _ramp(size[a:b])] = ids[np.repeat(begin[a:b], size[a:b]) + _ramp(size[a:b])]
        stops = np.flatnonzero(joined == -1)
        joined[stops] = int(ids.max()) + 1 + np.arange(len(stops))
        start, length, period = runs_of(joined, int(size[a:b].max()) // EXPONENT)
        keep = length >= np.maximum(least, EXPONENT * period)
        of = np.searchsorted(at, start[keep], "right") - 1
        found.append((start[keep] - at[of] + begin[a:b][of], length[keep], period[keep]))
        a = b
    start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's plant: documents whose crc32 ends in 0 repeat a stretch of their words to the end."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def _blocks(batch: pa.RecordBatch, edit: Callable | None) -> Iterator[tuple[int, int, list[list[bytes]], np.ndarray, tuple]]:
    """``i, j, words, first, runs`` of about a million bytes of documents at a time; columns 0 and 1 are id and text."""
    data, off = tv.buffers(batch.column(1))
    for i, j in tv.row_blocks(off, 1 << 20):
        doc_ids = batch.column(0).slice(i, j - i).to_pylist()
        split = [data[off[r] : off[r + 1]].tobytes().split() for r in range(i, j)]  # bytes.split() parts at 20, 09-0D
        words = [edit(d, w) for d, w in zip(doc_ids, split)] if edit else split
        number: dict[bytes, int] = defaultdict(count().__next__)
        first = np.append(0, np.cumsum([len(w) for w in words]))
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(first[-1]))
        yield i, j, words, first, runs_in(ids, first)


def _runs(edit):
    def run(batches):
        for batch in batches:
            for i, j, _, first, (start, length, period) in _blocks(batch, edit):
                row = np.searchsorted(first, start, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + row)), pa.array(start - first[row]), pa.array(length), pa.array(period)], names=["doc_id", "start", "length", "period"])

    return tv.tidy(run)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(keep)])


def _per_document(batch: pa.RecordBatch, edit) -> Iterator[tuple[int, list[tuple[int, list, bytes]]]]:
    """For each block its first row and, by row, the document's runs and collapsed text."""
    for i, j, words, first, (start, length, period) in _blocks(batch, edit):
        cut = np.searchsorted(start, first)
        found = []
        for r in range(j - i):
            a, b = cut[r], cut[r + 1]
            runs = list(zip((start[a:b] - first[r]).tolist(), length[a:b].tolist(), period[a:b].tolist()))
            found.append((len(words[r]), runs, _collapsed(words[r], runs)))
        yield i, found


_REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long"


def _digest(edit):
    def run(batches):
        for batch in batches:
            out = []
            for _, found in _per_document(batch, edit):
                for n, runs, text in found:
                    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
                    milli = None if best[0] is None else 1000 * best[1] // best[2]
                    lines = "".join("%d,%d,%d\n" % r for r in runs)
                    out.append((len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), n))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[c.split()[0] for c in _REPORT.split(", ")])

    return tv.tidy(run)


def runs(docs: DataFrame, edit: Callable | None = None) -> DataFrame:
    """``doc_id, start, length, period`` of every run; ``edit(doc_id, words)`` may change a document's words first."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_runs(edit), "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with each text that has runs replaced by its words without those that a run repeats, joined by one space; other texts stay as they are."""

    @F.arrow_udf("string")
    def shorter(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                out = []
                for i, found in _per_document(pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], names=["doc_id", "text"]), None):
                    out += [text.decode() if runs else texts[i + r].as_py() for r, (_, runs, text) in enumerate(found)]
                yield pa.array(out, pa.string())
        finally:
            tv.release()

    return docs.withColumn("text", shorter("text"))


def report(docs: DataFrame, edit: Callable | None = periodic_tail) -> DataFrame:
    """One row a document: number of runs, the greatest one, digests of all runs and of the collapsed text, and ``n_words``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digest(edit), _REPORT)
