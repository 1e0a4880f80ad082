"""N-gram Jaccard join (method: token-combination prefixes).

Documents with a Jaccard similarity of word-shingle sets of at least a threshold
are linked; the result has each document's class (component of links).

1. Each document becomes its set of 64-bit shingle hashes; equal sets are one
   node from here on, so copies never meet each other.
2. The same scan counts shingles by lossy counting: the table of frequent ones
   has at most ``MAX_FREQUENT`` entries whatever the corpus, as the cut-off rises
   with the total.  Words are counted alike, into a table of slots.  Both define
   the global order: rare shingles first, those of rare words before others, then
   classes of rising frequency.  So the prefix of a set has few shingles that only
   chance has put into several sets, however many sets there are.
3. A set indexes its first rare shingles one by one.  Where they do not reach
   the prefix bound, the prefix is extended into the frequent classes, and
   pairs of frequent shingles of one hash cell are indexed instead of single
   ones: a cell with c shingles loses c - 1 of them before its last pair goes,
   so pairs are taken until the bound is met again.  Signatures carry the size
   class; a set near a class border signs for both.
4. Signatures with the same nodes are one list.  The nodes of a list are compared
   by histograms of their sets, as wide as the sets need them: a lower bound of
   the symmetric difference.  Long lists are reduced to leaders: first within
   each task that signs, so that a list that a third of all sets are in enters
   the shuffle as a few leaders of each task, then as they stream by.  Only a
   forest of the pairs that may be similar leaves.
5. Every candidate is compared exactly with its least neighbour in that forest,
   group by group, large groups in slices.  Texts travel there, and sets are made
   on arrival: 64-bit hashes do not compress and would be several times as large.  Where candidates are still apart,
   their groups are compared in blocks: only against the others, never within
   what is linked already.
6. Components of the verified links are the result.

Defined results: without words a document has the empty set and is linked with
nothing; so is a row with a null ``doc_id`` (its ``component_id`` is null);
repeated rows are one node and get equal rows; an id that comes with two sets is
two nodes, each in its own class; classes with the same least id stay apart in
:func:`keep_one`, whose ties go to the least id, then the least set.  Sets are
compared by 64-bit hashes of shingles and of whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprism.llm import textvec as tv
from docprism.llm.components import connected
from docprism.llm.store import Bitmap, drop_materialized, materialize

U64 = np.uint64
WORDS, PERCENT = 5, 80
#: Entries of the table of frequent shingles, and least count there.
MAX_FREQUENT, LEAST_FREQUENT = 1 << 21, 32
#: Shingles counted at a time, and least count in that window to be reported.
COUNT_WINDOW, WINDOW_LEAST = 1 << 20, 4
#: Bits of the slots of word counts.
WORD_BITS = 20
#: Signatures that a signing task holds at a time, and nodes of a list that it reduces to leaders.
SIGN_WINDOW, LOCAL_LIST = 1 << 19, 64
#: Nodes of a signature that are compared all with all; above, by leaders.
LIST_PAIRS, LIST_CHUNK = 256, 1 << 14
#: Members that a task compares with one candidate, and sizes of a block of candidates that are compared all with all.
STAR_NODES, BLOCK_NODES, BLOCK_SHINGLES = 4096, 1024, 1 << 21
#: Rows of one signature that a task holds to tell which others have the same nodes.
HOLD_LIST = 1 << 20
#: Buckets of a histogram: least and most, and shingles a bucket of a large set.
SKETCH, SKETCH_MOST, SKETCH_LOAD = 64, 4096, 16
#: Buckets of the wide histograms in a block.
WIDE = 1024
#: Histogram cells that are compared at a time.
CELLS = 1 << 21
_SCANNED = "kind int, doc_id long, n long, node long, sketch binary"
_SIGNED = "sig long, node long, info long"
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U64)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of all words together, where there are fewer."""
    if not len(h):
        return h
    return np.unique(tv.windows(h, min(k, len(h))))


def node_of(s: np.ndarray) -> int:
    """64-bit identity of a set, as a signed long."""
    n = np.arange(1, len(s) + 1, dtype=U64)
    return int(tv.mix(np.array([np.bitwise_xor.reduce(tv.mix(s ^ (n * _MULTIPLY[0])))], U64) + U64(len(s)))[0].astype(np.int64))


def shape_of(s: np.ndarray) -> np.ndarray:
    """Histogram of a set, a byte a bucket: wide enough that large sets without much in common differ by more than similar ones may."""
    size = SKETCH
    while size < SKETCH_MOST and size * SKETCH_LOAD < len(s):
        size *= 2
    return np.minimum(np.bincount((s & U64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8)


class Shapes:
    """Histograms of several nodes; a wide one folds into any narrower one."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.data, self.start, self.size = data, start, size

    @staticmethod
    def of(column: pa.Array | list[np.ndarray]) -> Shapes:
        if isinstance(column, list):
            size = np.array([len(x) for x in column], np.int64)
            return Shapes(np.concatenate([np.zeros(0, np.uint8), *column]), np.cumsum(size) - size, size)
        _, off, data = column.cast(pa.large_binary()).buffers()
        off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
        return Shapes(np.frombuffer(data, np.uint8), off[:-1], np.diff(off))

    def take(self, rows) -> Shapes:
        return Shapes(self.data, self.start[rows], self.size[rows])

    def joined(self, other: Shapes) -> Shapes:
        own, more = self.packed(), other.packed()
        return Shapes(np.concatenate([own.data, more.data]), np.append(own.start, more.start + len(own.data)), np.append(own.size, more.size))

    def packed(self) -> Shapes:
        """Without the bytes of nodes that were left behind."""
        if int(self.size.sum()) == len(self.data):
            return self
        end = np.cumsum(self.size)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(self.start - (end - self.size), self.size)
        return Shapes(self.data[at], end - self.size, self.size)

    def at(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Histograms of ``size`` buckets of the given rows."""
        out = np.empty((len(rows), size), np.int16)
        for own in np.unique(self.size[rows]):
            held = np.flatnonzero(self.size[rows] == own)
            cells = self.data[self.start[rows[held]][:, None] + np.arange(own)]
            out[held] = cells if own == size else cells.reshape(len(held), own // size, size).sum(1, dtype=np.int16)
        return out

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Least symmetric difference of the pairs of rows."""
        out, size = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        for width in np.unique(size):
            pairs = np.flatnonzero(size == width)
            for lo in range(0, len(pairs), max(1, CELLS // int(width))):
                k = pairs[lo : lo + max(1, CELLS // int(width))]
                out[k] = np.abs(self.at(i[k], width) - self.at(j[k], width)).sum(1, dtype=np.int64)
        return out


def _words(column) -> Iterator[tuple[int, np.ndarray]]:
    data, off = tv.buffers(column)
    for i, j in tv.row_blocks(off, 1 << 20):
        w = tv.words(data, off[i : j + 1])
        for r in range(i, j):
            yield r, w.hash[w.first[r - i] : w.first[r - i + 1]]


def _sets(column, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for r, h in _words(column):
        yield r, shingle_set(h, k)


class _Recent:
    """Whether a task meets a set for the first time; may forget (copies are then only work, not errors)."""

    def __init__(self):
        self.slots = np.zeros(1 << 16, np.int64)

    def fresh(self, node: int) -> bool:
        if self.slots[node & 0xFFFF] == node:
            return False
        self.slots[node & 0xFFFF] = node
        return True


class _Often:
    """Counts of the shingles (kind 1) or words (kind 2) that recur in a window."""

    def __init__(self, window: int, least: int, kind: int = 1):
        self.values, self.filled, self.least, self.kind = np.empty(window, U64), 0, least, kind

    def add(self, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        while len(s):
            part, s = s[: len(self.values) - self.filled], s[len(self.values) - self.filled :]
            self.values[self.filled : self.filled + len(part)] = part
            self.filled += len(part)
            if self.filled == len(self.values):
                yield self.flush()

    def flush(self) -> pa.RecordBatch:
        v = self.values[: self.filled]
        v.sort()
        self.filled = 0
        run = max(len(v) - self.least + 1, 0)
        token = np.unique(v[:run][v[:run] == v[len(v) - run :]])
        counts = np.searchsorted(v, token, "right") - np.searchsorted(v, token, "left")
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(token), self.kind, np.int32)), none, pa.array(counts), pa.array(token.view(np.int64)), pa.nulls(len(token), pa.binary())], names=["kind", "doc_id", "n", "node", "sketch"])


def _describe(k: int):
    """Of each document its set's size, identity and histogram (kind 0); counts of recurring shingles and words (kinds 1 and 2: ``node`` is the shingle or word)."""
    window, least = COUNT_WINDOW, WINDOW_LEAST

    def run(batches):
        often, often_words, recent = _Often(window, least), _Often(window, least, 2), _Recent()
        for batch in batches:
            n, nodes, shapes = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), [None] * len(batch)
            for r, h in _words(batch.column(1)):
                s = shingle_set(h, k)
                if len(s):
                    n[r], nodes[r], shapes[r] = len(s), node_of(s), shape_of(s).tobytes()
                    if recent.fresh(nodes[r]):
                        yield from often.add(s)
                        yield from often_words.add(h)
            kinds = pa.array(np.zeros(len(batch), np.int32))
            yield pa.RecordBatch.from_arrays([kinds, batch.column(0), pa.array(n), pa.array(nodes), pa.array(shapes, pa.binary())], names=["kind", "doc_id", "n", "node", "sketch"])
        yield often.flush()
        yield often_words.flush()

    return tv.tidy(run)


class Frequent:
    """Class (rising with frequency, 0 for rare) of shingles, from a table of slots by hash.

    A rare shingle that shares the slot of a frequent one counts as frequent, in
    every set alike: any order that all sets share keeps the guarantee.  So does
    the order of rare ones by the counts of their words, whose slots are shared too.
    """

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, words: np.ndarray, word_counts: np.ndarray):
        bits = min(24, max(16, (8 * len(tokens)).bit_length()))
        self.shift = U64(64 - bits)
        self.slots = np.zeros(1 << bits, np.uint8)
        np.maximum.at(self.slots, (tokens >> self.shift).astype(np.int64), (1 + np.log2(np.maximum(counts, 1)).astype(np.uint8)).astype(np.uint8))

        self.words = np.zeros(1 << WORD_BITS, np.uint16)
        self.words[words] = (4 * np.log2(1 + word_counts)).astype(np.uint16)

    def of(self, s: np.ndarray) -> np.ndarray:
        return self.slots[(s >> self.shift).astype(np.int64)]

    def ranked(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The shingle set of a text's words, and how frequent each shingle's words are together."""
        if not len(h):
            return h, np.zeros(0, np.uint16)
        k = min(k, len(h))
        of_words = self.words[(h >> U64(64 - WORD_BITS)).astype(np.int64)]
        m = len(h) - k + 1
        rank = np.zeros(m, np.uint16)
        for j in range(k):
            rank += of_words[j : j + m]
        s = tv.windows(h, k)
        order = np.argsort(s)
        s = s[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        return s[first], rank[order[first]]


def signatures(s: np.ndarray, classes: np.ndarray, percent: int, rank: np.ndarray | None = None) -> np.ndarray:
    """Signatures of a set: two sets that reach the threshold share at least one.  ``rank``: order of the rare shingles, alike in all sets."""
    n = len(s)
    if rank is not None:
        order = np.argsort(rank, kind="stable")
        s, classes = s[order], classes[order]
    need = n - (percent * n + 99) // 100 + 1  # shingles that cannot all be missing from a similar set
    level = n.bit_length() - 1
    out = []
    for view in (level, level + 1) if n * 100 // percent >= 2 << level else (level,):
        tag = tv.mix(np.array([view + 1], U64))[0]
        rare = s if view < 4 else s[classes == 0]
        out.append(tv.mix(rare[:need] * _MULTIPLY[0] + tag))
        if len(rare) >= need:
            continue
        rest = need - len(rare)
        often = s[classes > 0]
        often = often[np.lexsort((often, classes[classes > 0]))]
        cell = ((often >> U64(8)) % U64((1 << view) // 4)).astype(np.int64)
        new = np.zeros(len(often), np.int64)
        new[np.unique(cell, return_index=True)[1]] = 1
        take = int(np.searchsorted(np.cumsum(1 - new), rest, "left")) + 1
        often, cell = often[:take], cell[:take]
        order = np.lexsort((often, cell))
        often, cell = often[order], cell[order]
        for gap in range(1, len(often)):
            same = np.flatnonzero(cell[gap:] == cell[:-gap])
            if not len(same):
                break
            out.append(tv.mix(often[same] * _MULTIPLY[1] + often[same + gap] * _MULTIPLY[2] + tag))
    return np.unique(np.concatenate(out))


def _bound(percent: int):
    """Largest symmetric difference of similar sets with so many shingles together."""
    return lambda total: total - 2 * (-(-percent * total // (100 + percent)))


class Leaders:
    """Leaders of one list: each node is within ``reach`` of its leader; never loses a pair that may be similar.

    ``info`` of a node: 0, or for a leader of another task's nodes their largest
    set (shifted by 31 bits) and the radius around it in which they lie.
    """

    def __init__(self, bound):
        self.bound, self.reach, self.top = bound, 0, 0
        self.nodes, self.radii = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.shapes = np.zeros((0, SKETCH_MOST), np.int16)

    def absorb(self, node, n, shapes: Shapes, info) -> tuple[np.ndarray, np.ndarray]:
        """Edges from leaders to the given nodes."""
        most, radius = info >> 31, info & ((1 << 31) - 1)
        self.top = max(self.top, int(n.max()), int(most.max()))
        self.reach = max(self.reach, self.bound(2 * self.top), self.bound(2 * self.top - 1))  # the bound rises over even and over odd totals, not from one to the next
        width = min(self.shapes.shape[1], int(shapes.size.min()))
        self.shapes = self.shapes.reshape(len(self.shapes), self.shapes.shape[1] // width, width).sum(1, dtype=np.int16)
        a, b = [], []
        step = max(1, CELLS // width)
        for lo in range(0, len(node), step):
            rows = np.arange(lo, min(len(node), lo + step))
            self._absorb(node[rows], shapes.at(rows, width), radius[rows], a, b)
        return np.concatenate(a), np.concatenate(b)

    def _absorb(self, node, shape, radius, a, b):
        free = np.arange(len(node))
        new, new_radii, k = [], [], 0
        while len(free):
            known = k < len(self.nodes)
            center = self.shapes[k] if known else shape[free[0]]
            away = np.abs(shape[free] - center).sum(1, dtype=np.int64) + radius[free]
            near = away <= self.reach
            if not known:
                near[0] = True
                new.append(free[0])
                new_radii.append(0)
            if near.any():
                held = free[near]
                a.append(np.full(len(held), self.nodes[k] if known else node[free[0]]))
                b.append(node[held])
                if known:
                    self.radii[k] = max(self.radii[k], away[near].max())
                else:
                    new_radii[-1] = int(away[near].max())
                free = free[~near]
            k += 1
        if new:
            self.nodes, self.radii = np.append(self.nodes, node[new]), np.append(self.radii, new_radii)
            self.shapes = np.concatenate([self.shapes, shape[new]])

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges between the leaders whose nodes may be similar."""
        a, b = [], []
        for k in range(1, len(self.nodes)):
            apart = np.abs(self.shapes[:k] - self.shapes[k]).sum(1, dtype=np.int64)
            close = np.flatnonzero(apart <= self.radii[:k] + self.radii[k] + self.reach)
            a.append(self.nodes[close])
            b.append(np.full(len(close), self.nodes[k]))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def info(self) -> np.ndarray:
        return (np.int64(self.top) << 31) | self.radii


class _Window:
    """Signatures of some of a task's sets; of long lists only leaders go on, and edges to them (``info`` -1: ``sig`` and ``node`` are linked)."""

    def __init__(self, bound, most: int, long: int):
        self.bound, self.most, self.long = bound, most, long
        self._clear()

    def _clear(self):
        self.sigs, self.nodes, self.n, self.shapes, self.size = [], [], [], [], 0

    def add(self, node: int, s: np.ndarray, sigs: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.sigs.append(sigs)
        self.nodes.append(node)
        self.n.append(len(s))
        self.shapes.append(shape_of(s))
        self.size += len(sigs)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.nodes:
            return
        sig = np.concatenate(self.sigs)
        owner = np.repeat(np.arange(len(self.nodes)), [len(x) for x in self.sigs])
        node, n, shapes = np.array(self.nodes, np.int64), np.array(self.n, np.int64), Shapes.of(self.shapes)
        self._clear()
        order = np.argsort(sig, kind="stable")
        sig, owner = sig[order], owner[order]
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        sizes = np.diff(np.append(starts, len(sig)))
        info, keep = np.zeros(len(sig), np.int64), np.ones(len(sig), bool)
        met: dict[bytes, tuple] = {}  # copies with few edits share most of their lists
        a, b = [], []
        for start, size in zip(starts[sizes > self.long], sizes[sizes > self.long]):
            members = owner[start : start + size]
            if (key := members.tobytes()) not in met:
                held = Leaders(self.bound)
                x, y = held.absorb(node[members], n[members], shapes.take(members), np.zeros(size, np.int64))
                a.append(x)
                b.append(y)
                by_node = np.argsort(held.nodes)
                at = by_node[np.minimum(np.searchsorted(held.nodes[by_node], node[members]), len(by_node) - 1)]
                met[key] = held.nodes[at] == node[members], held.info()[at]
            keep[start : start + size], info[start : start + size] = met[key]
        yield pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), pa.array(node[owner[keep]]), pa.array(info[keep])], names=["sig", "node", "info"])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            a, b = _forest(a[a != b], b[a != b])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), -1, np.int64))], names=["sig", "node", "info"])


def _sign(shared, k: int, percent: int):
    most, long = SIGN_WINDOW, LOCAL_LIST

    def run(batches):
        frequent, recent, window = shared.value, _Recent(), _Window(_bound(percent), most, long)
        for batch in batches:
            for _, h in _words(batch.column(0)):
                s, rank = frequent.ranked(h, k)
                if len(s) and recent.fresh(node := node_of(s)):
                    yield from window.add(node, s, signatures(s, frequent.of(s), percent, rank))
        yield from window.flush()

    return tv.tidy(run)


def _shared():
    """Of rows sorted by (sig, node), edges, and the lists of signatures that several nodes have.

    A list goes by the hash of its rows in place of its signature, so that lists
    with the same rows are one; a task emits it once.  Only a list too long to
    hold keeps a name of its own.
    """
    most = HOLD_LIST

    def run(batches):
        seen = np.zeros(1 << 18, U64)
        held, open_ = None, None  # rows of the last signature; the last signature, if part of its rows have gone already
        for batch in _with_end(batches):
            rows = np.zeros((3, 0), np.int64)
            if batch is not None:
                rows = np.stack([batch.column(c).to_numpy() for c in range(3)])
                edges = rows[2] == -1
                if edges.any():
                    yield _signed(rows[:, edges])
                    rows = rows[:, ~edges]
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
                held = None
            if not rows.shape[1]:
                continue
            first = np.flatnonzero(np.append(True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])))
            top, radius = np.maximum.reduceat(rows[2] >> 31, first), np.maximum.reduceat(rows[2] & ((1 << 31) - 1), first)
            rows = np.stack([rows[0, first], rows[1, first], (top << 31) | radius])
            starts = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
            if open_ is not None:
                end = starts[1] if len(starts) > 1 else rows.shape[1]
                if rows[0, 0] == open_:
                    yield _signed(rows[:, :end])
                    rows = rows[:, end:]
                    if not rows.shape[1]:
                        continue
                    starts = starts[1:] - end
                open_ = None
            if batch is not None:
                held, rows, starts = rows[:, starts[-1] :], rows[:, : starts[-1]], starts[:-1]
                if held.shape[1] >= most:
                    yield _signed(held)
                    held, open_ = None, held[0, 0]
            sizes = np.diff(np.append(starts, rows.shape[1]))
            rows, sizes = rows[:, np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
            if not len(sizes):
                continue
            starts = np.cumsum(sizes) - sizes
            name = tv.mix(rows[1].view(U64) * _MULTIPLY[0] + rows[2].view(U64) * _MULTIPLY[1])
            name = tv.mix(np.add.reduceat(name, starts) + sizes.astype(U64))
            fresh = np.zeros(len(name), bool)
            fresh[np.unique(name, return_index=True)[1]] = True
            slot = (name >> U64(64 - 18)).astype(np.int64)
            fresh &= seen[slot] != name
            seen[slot] = name
            rows[0] = np.repeat(name.view(np.int64), sizes)
            yield _signed(rows[:, np.repeat(fresh, sizes)])

    return tv.tidy(run)


def _signed(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["sig", "node", "info"])


def _short_lists(percent: int):
    """Of whole short lists, the pairs that may be similar: place by place over all lists at once, each pair once."""
    bound = _bound(percent)
    seen = np.zeros(1 << 18, U64)  # pairs met before, direct-mapped

    def run(sig, node, n, shapes):
        found_a, found_b = [], []
        for gap in range(1, len(sig)):
            at = np.flatnonzero(sig[gap:] == sig[:-gap])
            if not len(at):
                break
            small, large = np.minimum(n[at], n[at + gap]), np.maximum(n[at], n[at + gap])
            at = at[100 * small >= percent * large]
            x, y = np.minimum(node[at], node[at + gap]), np.maximum(node[at], node[at + gap])
            key = tv.mix(x.view(U64) * _MULTIPLY[0] + y.view(U64))
            slot = (key >> U64(64 - 18)).astype(np.int64)
            new = seen[slot] != key
            seen[slot] = key
            at, x, y = at[new], x[new], y[new]
            close = shapes.apart(at, at + gap) <= bound(n[at] + n[at + gap])
            found_a.append(x[close])
            found_b.append(y[close])
        if not found_a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return _forest(np.concatenate(found_a), np.concatenate(found_b))

    return run


def _may_link(percent: int):
    """Forest edges among the nodes of each list that the histograms cannot tell apart (rows ``sig, node, n, info, sketch`` sorted by list)."""
    pairs, chunk = LIST_PAIRS, LIST_CHUNK

    def part(now, rows):
        return [*(x[rows] for x in now[:4]), now[4].take(rows)]

    def run(batches):
        bound, short = _bound(percent), _short_lists(percent)
        held, going, going_sig = None, None, None  # rows of the list that the last batch cut; leaders of a list too long to hold

        def ended(leaders):
            yield from _edges(*leaders.close())

        for batch in _with_end(batches):
            now = [*(batch.column(c).to_numpy() for c in range(4)), Shapes.of(batch.column(4))] if batch is not None and len(batch) else None
            if batch is not None and now is None:
                continue
            if held is not None:
                now = [*(np.concatenate([x, y]) for x, y in zip(held[:4], now[:4])), held[4].joined(now[4])] if now is not None else held
                held = None
            if going is not None and (now is None or now[0][0] != going_sig):
                yield from ended(going)
                going = None
            if now is None:
                continue
            sig = now[0]
            starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            sizes = np.diff(np.append(starts, len(sig)))
            if batch is not None:  # the last list may go on
                tail = part(now, slice(starts[-1], None))
                more = going is not None and going_sig == tail[0][0]
                if more or sizes[-1] >= chunk:
                    if not more:
                        going, going_sig = Leaders(bound), tail[0][0]
                    yield from _edges(*going.absorb(tail[1], tail[2], tail[4], tail[3]))
                else:
                    held = [*tail[:4], tail[4].packed()]
                now, starts, sizes = part(now, slice(0, starts[-1])), starts[:-1], sizes[:-1]
                if more or not len(starts):
                    continue
            long = sizes > pairs
            long |= np.maximum.reduceat(now[3], starts) > 0
            if going is not None and going_sig == sig[0]:
                long[0] = True
            for k in np.flatnonzero(long):
                rows = part(now, slice(starts[k], starts[k] + sizes[k]))
                leaders = going if k == 0 and going is not None and going_sig == rows[0][0] else Leaders(bound)
                if leaders is going:
                    going = None
                yield from _edges(*leaders.absorb(rows[1], rows[2], rows[4], rows[3]))
                yield from ended(leaders)
            rows = part(now, np.repeat(~long, sizes))
            yield from _edges(*short(rows[0], rows[1], rows[2], rows[4]))

    return tv.tidy(run)


def _with_end(batches):
    yield from batches
    yield None


def _edges(a, b):
    a, b = _forest(a[a != b], b[a != b])
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (least node, other) of the components of the edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if not len(nodes):
        return a, b
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, x, root[y])
        np.minimum.at(least, y, root[x])
        least = least[least]
        if (least == root).all():
            break
        root = least
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[other]], nodes[other]


def _common(s: np.ndarray, t: np.ndarray) -> int:
    """Shared elements of two sorted sets."""
    if len(s) < len(t):
        s, t = t, s
    return int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())


def _check_stars(k: int, percent: int):
    """Links of the members to the center of their group (rows ``grp, slice, role, node, text`` sorted by group, the center first)."""

    def run(batches):
        center, of = None, None
        for batch in batches:
            group, center_here, node = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            a, b = [], []
            for r, s in _sets(batch.column(4), k):
                if not len(s) or node_of(s) != node[r]:  # another text of the same id
                    continue
                if center_here[r] == 0:
                    center, of = s, group[r]
                elif of == group[r]:
                    both = _common(center, s)
                    if 100 * both >= percent * (len(s) + len(center) - both):
                        a.append(group[r][0])
                        b.append(node[r])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return tv.tidy(run)


def links_of(sets: list[np.ndarray], percent: int, group: np.ndarray | None = None, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (positions a, b) of the pairs of sets that reach the threshold, exactly.

    Wide histograms bound the symmetric difference from below; pairs they leave
    are counted exactly, nearest first, unless links already connect them.
    ``group``: what is linked already; ``block``: only sets of two blocks are compared.
    """
    n = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    shape = np.zeros((m, WIDE), np.int16)
    for k, s in enumerate(sets):
        shape[k] = np.minimum(np.bincount((s & U64(WIDE - 1)).astype(np.int64), minlength=WIDE), 32_000)
    group = np.arange(m) if group is None else np.unique(group, return_inverse=True)[1]
    a, b = [], []
    for i in range(1, m):
        total = n[:i] + n[i]
        able = (group[:i] != group[i]) & (100 * np.minimum(n[:i], n[i]) >= percent * np.maximum(n[:i], n[i]))
        if block is not None:
            able &= block[:i] != block[i]
        near = np.flatnonzero(able)
        if not len(near):
            continue
        apart = np.abs(shape[near] - shape[i]).sum(1, dtype=np.int64)
        ok = apart <= _bound(percent)(total[near])
        near = near[ok][np.argsort(apart[ok], kind="stable")]
        while len(near):
            j = near[0]
            both = _common(sets[i], sets[j])
            if 100 * both >= percent * (n[i] + n[j] - both):
                a.append(j)
                b.append(i)
                group[group == group[i]] = group[j]
                near = near[group[near] != group[j]]
            else:
                near = near[1:]
    return np.array(a, np.int64), np.array(b, np.int64)


def _check_blocks(k: int, percent: int):
    """Links between the sets of two blocks, and in home parts within them (rows sorted by class and part): ``cls, part, home, block, node, comp, text``."""

    def run(batches):
        held: dict[int, tuple] = {}
        key, home = None, True

        def done():
            nodes = np.array(list(held), np.int64)
            block = None if home else np.array([x[1] for x in held.values()])
            a, b = links_of([x[2] for x in held.values()], percent, np.array([x[0] for x in held.values()], np.int64), block)
            if len(a):
                a, b = _forest(nodes[a], nodes[b])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cls, part, homes, blocks, nodes, comps = (batch.column(c).to_pylist() for c in range(6))
            for r, s in _sets(batch.column(6), k):
                if (cls[r], part[r]) != key:
                    yield from done()
                    held, key, home = {}, (cls[r], part[r]), homes[r]
                if len(s) and nodes[r] not in held and node_of(s) == nodes[r]:
                    held[nodes[r]] = comps[r], blocks[r], s
        yield from done()

    return tv.tidy(run)


def _candidates(docs: DataFrame, scanned: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b``: a forest of the pairs of nodes that may be similar."""
    spark = docs.sparkSession
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cut = max(LEAST_FREQUENT, -(-total // MAX_FREQUENT))
    counted = scanned.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= cut).toArrow()  # about total / cut <= MAX_FREQUENT rows
    slot = F.shiftrightunsigned("node", 64 - WORD_BITS).alias("slot")
    words_counted = scanned.where("kind = 2").groupBy(slot).agg(F.sum("n").alias("n")).toArrow()  # at most 2^WORD_BITS rows
    shared = spark.sparkContext.broadcast(Frequent(counted["node"].to_numpy().view(U64), counted["n"].to_numpy(), words_counted["slot"].to_numpy(), words_counted["n"].to_numpy()))
    signed = docs.where("doc_id is not null").select("text").mapInArrow(_sign(shared, words, percent), _SIGNED)
    several = materialize(signed.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_shared(), _SIGNED), "signatures")
    lists = several.where("info >= 0").distinct().join(nodes.select("node", "n", "sketch"), "node").select("sig", "node", "n", "info", "sketch")
    linked = lists.repartition("sig").sortWithinPartitions("sig").mapInArrow(_may_link(percent), "a long, b long")
    edges = linked.unionByName(several.where("info = -1").select(F.col("sig").alias("a"), F.col("node").alias("b")))
    forest = materialize(edges.distinct(), "candidates")
    drop_materialized(spark, several)
    return forest


def _verified(docs: DataFrame, forest: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """``node, root, least``: each candidate with the component of its verified links."""
    spark = docs.sparkSession
    members = materialize(forest.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "least", "n"), "node"), "members")
    near = docs.where(Bitmap(members, "least").has(F.col("doc_id")))  # most texts never travel

    def with_texts(rows: DataFrame) -> DataFrame:
        return rows.join(members.select("node", F.col("least").alias("_least")), "node").join(near, F.col("_least") == near["doc_id"]).select(*rows.columns, "text")

    parents = forest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("grp"))
    slices = parents.groupBy("grp").agg(F.ceil(F.count("*") / STAR_NODES).cast("int").alias("slices"))
    around = parents.join(slices, "grp").select("grp", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("role"), "node")
    centers = slices.select("grp", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("role"), F.col("grp").alias("node"))
    stars = with_texts(centers.unionByName(around)).repartition("grp", "slice").sortWithinPartitions("grp", "slice", "role")
    first = connected(stars.mapInArrow(_check_stars(words, percent), "a long, b long"))
    of = members.join(first, "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("comp"))
    of = materialize(of, "linked")

    side = lambda name: of.select(F.col("node").alias(name), F.col("comp").alias(f"c{name}"))
    apart = forest.join(side("a"), "a").join(side("b"), "b").where("ca <> cb")
    apart = materialize(apart.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "apart")
    if apart.isEmpty():
        drop_materialized(spark, members, apart)
        return of.select("node", "least", F.col("comp").alias("root"))
    placed = _placed(of, connected(apart))
    rows = with_texts(placed.select("cls", "part", "home", "block", "node", "comp"))
    links = rows.repartition("cls", "part").sortWithinPartitions("cls", "part").mapInArrow(_check_blocks(words, percent), "a long, b long")
    more = connected(links.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    drop_materialized(spark, members, apart)
    return of.join(more.select(F.col("node").alias("comp"), "root"), "comp", "left").select("node", "least", F.coalesce("root", "comp").alias("root"))


def _placed(of: DataFrame, groups: DataFrame) -> DataFrame:
    """``node, comp, cls, block, part, home``: members of classes that hold several components, in the pairs of blocks in which they meet.

    The largest component of a class has blocks of its own, which never meet each
    other.  A class of two nodes was its only pair, which is checked already.
    """
    inside = of.join(groups.select(F.col("node").alias("comp"), F.col("root").alias("cls")), "comp")
    sizes = inside.groupBy("cls", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    main = F.max(F.struct("m", "comp", "t"))
    classes = sizes.groupBy("cls").agg(main.alias("main"), F.sum("m").alias("m"), F.sum("t").alias("t")).where("m > 2")
    blocks = lambda m, t: F.greatest(F.ceil(m / BLOCK_NODES), F.ceil(t / BLOCK_SHINGLES)).cast("int")
    classes = classes.select("cls", F.col("main.comp").alias("_main"), blocks(F.col("main.m"), F.col("main.t")).alias("_mb"), blocks(F.col("m") - F.col("main.m"), F.col("t") - F.col("main.t")).alias("_ob"))
    rows = inside.join(classes, "cls")
    held = F.xxhash64("node")
    is_main = F.col("comp") == F.col("_main")
    rows = rows.withColumn("block", F.when(is_main, F.pmod(held, F.col("_mb"))).otherwise(F.col("_mb") + F.pmod(held, F.col("_ob"))).cast("int"))
    rows = rows.withColumn("_all", F.col("_mb") + F.col("_ob")).withColumn("_from", F.when(is_main, F.col("_mb")).otherwise(F.lit(0)))
    rows = rows.withColumn("_other", F.explode(F.expr("filter(sequence(_from, _all - 1), b -> b <> block)")))
    first, second = F.least("block", "_other"), F.greatest("block", "_other")
    return rows.select("node", "comp", "cls", "block", (first.cast("long") * F.col("_all") + second).alias("part"), (first == 0).alias("home"))


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The result of :func:`classes` and the tables that it reads."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = materialize(docs.mapInArrow(_describe(words), _SCANNED), "sets")
    described = scanned.where("kind = 0")
    real = described.where("n > 0 and doc_id is not null")
    nodes = materialize(real.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    forest = _candidates(docs, scanned, nodes, words, percent)
    roots = _verified(docs, forest, nodes, words, percent)
    groups = roots.groupBy("root").agg(F.min("least").alias("_component"))
    of_node = nodes.select("node", "least").join(roots.join(groups, "root").select("node", "root", "_component"), "node", "left")
    of_node = materialize(of_node.select(F.col("node").alias("_node"), F.coalesce("root", "node").alias("_class"), F.coalesce("_component", "least").alias("_component")), "components")
    drop_materialized(spark, nodes, forest)
    out = described.join(of_node, (described["node"] == of_node["_node"]) & (described["n"] > 0) & described["doc_id"].isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_component", "doc_id").alias("component_id"), "node", "_class"), [scanned, of_node]


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each document; ``percent``: the threshold."""
    return _classes(docs, words, percent)[0].select("doc_id", "n_shingles", "component_id")


def _node(text: Column, k: int) -> Column:
    """Identity of each text's set; null without words."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in batches:
                out = [None] * len(batch)
                for r, s in _sets(batch, k):
                    if len(s):
                        out[r] = node_of(s)
                yield pa.array(out, pa.int64())
        finally:
            tv.release()

    return run(text)


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each class: the row of the least id, and of its sets the one with the least hash.

    Rows are told apart by id and set, so an id that comes with several unlike
    texts stays once in the class of each.  Of rows with the same id and set one
    stays; rows without an id stay; of rows without words with the same id and
    text one stays.
    """
    spark = docs.sparkSession
    found, read = _classes(docs, words, percent)
    real = found.where("doc_id is not null")
    if real.groupBy("doc_id").count().where("count > 1").isEmpty():  # then an id says all
        gone = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "copies")
        drop_materialized(spark, *read)
        maybe = Bitmap(gone, "doc_id").has(F.col("doc_id"))
        return docs.where(maybe).join(gone, "doc_id", "left_anti").select(docs.columns).unionByName(docs.where(~maybe))
    stays = real.where("component_id = doc_id and n_shingles > 0").groupBy("_class").agg(F.min("node").alias("_stays"))
    gone = real.where("n_shingles > 0").join(stays, "_class").where("component_id <> doc_id or node <> _stays").select(F.col("doc_id").alias("_gone"), F.col("node").alias("_gone_node")).distinct()
    gone = materialize(gone, "copies")
    drop_materialized(spark, *read)
    named = docs.where("doc_id is not null").withColumn("_set", _node(F.col("text"), words))
    kept = named.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("_set") == F.col("_gone_node")), "left_anti")
    single = kept.where("_set is not null").dropDuplicates(["doc_id", "_set"]).unionByName(kept.where("_set is null").dropDuplicates(["doc_id", "text"]))
    return single.select(docs.columns).unionByName(docs.where("doc_id is null"))
