"""Benchmark decontamination (method: broadcast hash set of test n-grams).

Benchmark texts become hashed windows of 13 consecutive words (an item with
fewer words is one shorter window).  Their set is sent to every executor; each
scans its training texts once, looks all token windows up in a bitmap and then
in the sorted hash table, and verifies every hit word by word.  There is no
shuffle and nothing per document leaves its row.

The broadcast is bounded: a benchmark of more than ``block_windows`` windows is
processed in blocks of that many, one after another.  Each is a scan of its own
that writes the hits of the texts it hits; they join back by text at the end.  So
what the driver and an executor hold at a time never depends on the benchmark.

Defined results: null or wordless text has no words, is never hit; a null or
wordless item has no window; a null ``item_id`` reads as ``null`` in the digest; repeated items
with one id count once; repeated documents give equal rows.  With several blocks
a text is known by its 64-bit hash.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docprism.llm import textvec as tv
from docprism.llm.store import Bitmap, materialize

WIDTH = 13
#: Benchmark windows that are broadcast at a time.
BLOCK_WINDOWS = 500_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Windows:
    """Hash table of benchmark windows: per window length, sorted hashes, the words to verify, the items."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        found: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in items:
            data, off = tv.buffers(pa.array([text], pa.large_string()))
            w = tv.words(data, off, tv.ALNUM)
            raw = data.tobytes().lower()  # bytes.lower() changes A-Z only
            tokens = [raw[s:e] for s, e in zip(w.start, w.end)]
            k = min(width, len(tokens))
            if k:
                into = found.setdefault(k, {})
                for i in range(len(tokens) - k + 1):
                    into.setdefault(tuple(tokens[i : i + k]), set()).add(item)
        self.by_length = []
        for k, into in sorted(found.items()):
            grams = list(into)
            flat = [w for g in grams for w in g]
            data, ends = b"".join(flat), np.cumsum([0, *map(len, flat)])
            h = tv.range_hashes(np.frombuffer(data, np.uint8), ends[:-1], ends[1:], 0)
            hashes = np.array([tv.windows(h[i * k : (i + 1) * k], k)[0] for i in range(len(grams))], np.uint64)
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.by_length.append((k, hashes[order], [grams[i] for i in order], [into[grams[i]] for i in order], bits))

    def scan(self, raw: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Verified hits of one document as (first word, length), and the items hit."""
        spans, items = [], set()
        for k, hashes, grams, owners, bits in self.by_length:
            win = tv.windows(h, k)
            at = np.flatnonzero(bits[(win >> np.uint64(44)).astype(np.int64)])
            if not len(at):
                continue
            left = np.searchsorted(hashes, win[at], "left")
            right = np.searchsorted(hashes, win[at], "right")
            for i, a, b in zip(at[left < right], left[left < right], right[left < right]):
                gram = tuple(raw[s:e].lower() for s, e in zip(start[i : i + k], end[i : i + k]))
                for j in range(a, b):
                    if grams[j] == gram:
                        spans.append((int(i), k))
                        items |= owners[j]
        return spans, items


def _blocks(benchmark: DataFrame, block_windows: int, width: int) -> Iterator[Windows]:
    """The benchmark in blocks of at most ``block_windows`` windows (one item at least), read as a stream."""
    rows, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        data, off = tv.buffers(pa.array([row[1]], pa.large_string()))
        n = len(tv.words(data, off, tv.ALNUM).start)  # at least the number of windows
        if rows and size + n > block_windows:
            yield Windows(rows, width)
            rows, size = [], 0
        rows.append((row[0] if row[0] is not None else "null", row[1]))
        size += n
    if rows:
        yield Windows(rows, width)


def _found(table: Windows, column: pa.Array) -> Iterator[tuple[int, int, list[int], set[str]]]:
    """Of each text its row, number of words, hit words as first, length pairs, and items."""
    data, off = tv.buffers(column)
    for i, j in tv.row_blocks(off, 1 << 20):
        w = tv.words(data, off[i : j + 1], tv.ALNUM)
        for r in range(i, j):
            a, b = w.first[r - i], w.first[r - i + 1]
            hit, items = table.scan(_View(data), w.start[a:b], w.end[a:b], w.hash[a:b]) if b > a else ([], set())
            yield r, int(b - a), [x for s in hit for x in s], items


def _text_key(column: pa.Array) -> list[int]:
    return [int.from_bytes(hashlib.blake2b((x.as_py() or "").encode(), digest_size=8).digest(), "little", signed=True) for x in column]


def _several(docs: DataFrame, first: Windows, rest: Iterator[Windows]) -> DataFrame:
    """``__dp_key, __dp_spans, __dp_items`` of the texts that any block hits; one scan a block."""
    spark, hits = docs.sparkSession, None
    for block in itertools.chain([first], rest):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                texts = batch.column(0)
                found = [(r, spans, sorted(items)) for r, _, spans, items in _found(shared.value, texts) if spans]
                keys = _text_key(texts.take(pa.array([x[0] for x in found], pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int32())), pa.array([x[2] for x in found], pa.list_(pa.string()))], names=["__dp_key", "__dp_spans", "__dp_items"])

        part = materialize(docs.select("text").mapInArrow(tv.tidy(run), "__dp_key long, __dp_spans array<int>, __dp_items array<string>").distinct(), "hits")
        shared.destroy()
        hits = part if hits is None else hits.unionByName(part)
    return materialize(hits.groupBy("__dp_key").agg(F.flatten(F.collect_list("__dp_spans")).alias("__dp_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__dp_items")))).alias("__dp_items")), "hits")


@F.arrow_udf(T.LongType())
def _key_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array(_text_key(batch), pa.int64())


def _with_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``docs`` with ``__dp_spans`` and ``__dp_items`` (null where nothing is hit); texts that surely have no hit do not travel."""
    keyed = docs.withColumn("__dp_text_key", _key_of(F.col("text")))
    maybe = Bitmap(hits, "__dp_key").has(F.col("__dp_text_key"))
    near = keyed.where(maybe).join(hits, F.col("__dp_text_key") == F.col("__dp_key"), "left").drop("__dp_text_key", "__dp_key")
    far = keyed.where(~maybe).drop("__dp_text_key")
    return near.unionByName(far, allowMissingColumns=True)


def _judged(rows: list[tuple[int, list[int], set[str] | list[str]]]) -> dict[str, list]:
    """Columns of the digest from (words, hit spans, items)."""
    hits = [int(hit_mask(n, spans).sum()) if spans else 0 for n, spans, _ in rows]
    return {
        "n_words": [n for n, *_ in rows], "n_hit": hits, "n_items": [len(items) for *_, items in rows],
        "items_sha256": [hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() for *_, items in rows],
        "contaminated": [h > 0 and 20 * h >= n for h, (n, *_) in zip(hits, rows)],
    }


def _n_words(column: pa.Array) -> list[int]:
    data, off = tv.buffers(column)
    return [int(n) for i, j in tv.row_blocks(off, 1 << 20) for n in np.diff(tv.words(data, off[i : j + 1], tv.ALNUM).first)]


class _View:
    """Slices of a byte array as bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def __getitem__(self, s: slice) -> bytes:
        return self.data[s].tobytes()


def hit_mask(n_words: int, spans: list[int]) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    for first, k in zip(spans[::2], spans[1::2]):
        edge[first] += 1
        edge[first + k] -= 1
    return np.cumsum(edge[:-1]) > 0


_DIGEST = (("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()))


def _first_two(benchmark: DataFrame, block_windows: int, width: int) -> tuple[Windows, Iterator[Windows] | None]:
    """The first block, and all blocks after it if there are any."""
    blocks = _blocks(benchmark, block_windows, width)
    first = next(blocks, None) or Windows([], width)
    second = next(blocks, None)
    return first, None if second is None else itertools.chain([second], blocks)


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row a document with the contamination digest (columns of ``SCHEMA``)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first, rest = _first_two(benchmark, block_windows, width)
    rows = docs if rest is None else _with_hits(docs, _several(docs, first, rest))
    shared = docs.sparkSession.sparkContext.broadcast(first if rest is None else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is not None:
                found = [x[1:] for x in _found(shared.value, batch.column(1))]
            else:
                found = [(n, spans or [], items or []) for n, spans, items in zip(_n_words(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            columns = _judged(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[c], kind) for c, kind in _DIGEST)], names=["doc_id", *(c for c, _ in _DIGEST)])

    return rows.mapInArrow(tv.tidy(run), SCHEMA)


def _cut(text: str | None, n_words: int, spans: list[int]) -> str | None:
    """The text without its hit words; None where nothing is hit."""
    if not spans:
        return None
    raw = np.frombuffer(text.encode(), np.uint8)
    w = tv.words(raw, np.array([0, len(raw)]), tv.ALNUM)
    m = hit_mask(n_words, spans)
    cut = np.zeros(len(raw) + 1, np.int64)
    np.add.at(cut, w.start[m], 1)
    np.add.at(cut, w.end[m], -1)
    return raw[np.cumsum(cut[:-1]) == 0].tobytes().decode()


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Rows of ``docs`` with contaminated documents dropped, or (``mode="spans"``) with the hit words cut out of the text.

    Of a kept document only the text travels to Python, and it does not come back.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    first, rest = _first_two(benchmark, block_windows, width)
    rows = docs if rest is None else _with_hits(docs, _several(docs, first, rest))
    shared = docs.sparkSession.sparkContext.broadcast(first if rest is None else None)

    def found(text, spans):
        if shared.value is not None:
            return [(n, spans) for _, n, spans, _ in _found(shared.value, text)]
        return [(n, x or []) for n, x in zip(_n_words(text), spans.to_pylist())]

    @F.arrow_udf("boolean")
    def bad(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for text, spans in batches:
                yield pa.array(_judged([(n, x, ()) for n, x in found(text, spans)])["contaminated"], pa.bool_())
        finally:
            tv.release()

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for text, spans in batches:
                yield pa.array([_cut(t.as_py(), n, x) if x else None for t, (n, x) in zip(text, found(text, spans))], pa.string())
        finally:
            tv.release()

    known = F.lit(None).cast("array<int>") if rest is None else F.col("__dp_spans")
    if mode == "documents":
        return rows.where(~bad(F.col("text"), known)).select(docs.columns)
    return rows.withColumn("text", F.coalesce(cut(F.col("text"), known), F.col("text"))).select(docs.columns)
