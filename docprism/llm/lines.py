"""Line dedup (method: explode, hash, count documents per hash, drop, reassemble).

Every whole text is split at ``\\n``; a line's key is the line stripped of ASCII
white space and with A-Z lower-cased.  Keys of at least ``min_chars`` code points
found in at least ``min_docs`` documents lose their lines everywhere except in
the largest ``doc_id`` that holds them.

Plan: one scan writes each document's distinct 128-bit key hashes; counting
is a two-step aggregation with partial sums, so that a line held by a third of
all documents is spread over every task.  The hashes to drop join back as rows
``(hash, keeper)`` by a shuffled equi-join whose hot keys adaptive execution can
split, are gathered by document, and meet the text once by ``doc_id``.

Defined results: null text is one empty line; repeated rows of one ``doc_id``
count as one document and are treated alike; rows whose ``doc_id`` is null are
not counted and stay as they are; ties cannot occur between distinct ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprism.llm import textvec as tv
from docprism.llm.store import materialize

MIN_CHARS, MIN_DOCS = 20, 3
SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def line_keys(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """Lines of rows: row, byte start, byte end, two key hashes, whether the key is long enough."""
    base, n = int(offsets[0]), len(offsets) - 1
    part = data[base : offsets[-1]]
    breaks = np.flatnonzero(part == 10) + base
    row_of = np.searchsorted(offsets, breaks, "right") - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, offsets[1:]])
    rows_s, rows_e = np.concatenate([np.arange(n), row_of]), np.concatenate([row_of, np.arange(n)])
    order = np.lexsort((start, rows_s))
    start, row = start[order], rows_s[order]
    end = end[np.lexsort((end, rows_e))]
    # strip: the first and the last byte that is not white space, from running positions
    solid = ~_SPACE[part]
    places = np.arange(len(part), dtype=np.int64)
    last = np.maximum.accumulate(np.where(solid, places, -1)) if len(part) else places
    following = np.minimum.accumulate(np.where(solid, places, len(part))[::-1])[::-1] if len(part) else places
    following = np.append(following, len(part))
    last = np.append(last, -1)  # index -1 reads this
    s = np.minimum(following[start - base], end - base)
    e = np.maximum(last[end - base - 1] + 1, s)
    e = np.where(end > start, e, s)
    points = tv.code_points(part)
    long = points[e] - points[s] >= min_chars
    h1 = tv.range_hashes(part, s, e, 0)
    h2 = tv.range_hashes(part, s, e, 0, salt_b=True)
    return row, start, end, h1, h2, long


def _blocks(column, min_chars):
    data, off = tv.buffers(column)
    for i, j in tv.row_blocks(off, 1 << 20):
        yield (i, j, data, *line_keys(data, off[i : j + 1], min_chars))


def _keys(min_chars):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, _, row, _, _, h1, h2, long in _blocks(batch.column(1), min_chars):
                rec = np.empty(int(long.sum()), [("r", "i8"), ("a", "u8"), ("b", "u8")])
                rec["r"], rec["a"], rec["b"] = row[long], h1[long], h2[long]
                rec = np.unique(rec)
                yield pa.RecordBatch.from_arrays([pa.array(rec["a"].view("i8")), pa.array(rec["b"].view("i8")), pa.array(ids[i + rec["r"]].astype("i8"))], names=["h1", "h2", "doc_id"])

    return run


def drop_list(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, __dp_drop``: each document's key hashes (two longs in a struct) whose lines go."""
    found = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tv.tidy(_keys(min_chars)), "h1 long, h2 long, doc_id long")
    held = materialize(found, "line-keys")
    common = held.distinct().groupBy("h1", "h2").agg(F.count("*").alias("_n"), F.max("doc_id").alias("_keeper")).where(F.col("_n") >= min_docs)
    common = materialize(common.select("h1", "h2", "_keeper"), "common-lines")  # so that adaptive execution can split the join's hot keys
    gone = held.join(common, ["h1", "h2"]).where("doc_id <> _keeper")
    return gone.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("__dp_drop"))


def _kept(column, drops, min_chars):
    """Per row: number of lines, number dropped, remaining bytes."""
    for i, j, data, row, start, end, h1, h2, long in _blocks(column, min_chars):
        first = np.searchsorted(row, np.arange(j - i + 1))
        for r in range(i, j):
            a, b = first[r - i], first[r - i + 1]
            lo, hi = int(start[a]), int(end[b - 1])
            drop = drops[r]
            if drop is None or not len(drop[0]):
                yield b - a, 0, data[lo:hi].tobytes()
                continue
            order = np.argsort(drop[0], kind="stable")
            d1, d2 = drop[0][order], drop[1][order]
            at = np.minimum(np.searchsorted(d1, h1[a:b]), len(d1) - 1)
            gone = long[a:b] & (d1[at] == h1[a:b]) & (d2[at] == h2[a:b])
            keep = np.flatnonzero(~gone) + a
            yield b - a, int(gone.sum()), b"\n".join(data[start[k] : end[k]].tobytes() for k in keep)


def _drops(column: pa.Array) -> list:
    out, valid = [], column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    h1, h2 = (flat.field(k).to_numpy().view("u8") for k in (0, 1))
    sizes = np.where(valid, column.value_lengths().fill_null(0).to_numpy(), 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for r in range(len(column)):
        out.append((h1[ends[r] : ends[r + 1]], h2[ends[r] : ends[r + 1]]) if valid[r] else None)
    return out


def _joined(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    drops = drop_list(docs, min_chars, min_docs).withColumnRenamed("doc_id", "__dp_drop_id")
    return docs.join(drops, docs["doc_id"] == drops["__dp_drop_id"], "left").drop("__dp_drop_id")


def report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row a document: lines before dropping, lines dropped, digest of the rest (columns of ``SCHEMA``)."""

    def run(batches):
        for batch in batches:
            rows = list(_kept(batch.column(1), _drops(batch.column(2)), min_chars))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in rows], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_chars, min_docs).mapInArrow(tv.tidy(run), SCHEMA)


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; a document that loses every line becomes empty.

    Only texts that lose lines travel to Python.
    """

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for text, drops in batches:
                yield pa.array([x[2].decode() if x[1] else None for x in _kept(text, _drops(drops), min_chars)], pa.string())
        finally:
            tv.release()

    joined = _joined(docs, min_chars, min_docs)
    shorter = cut(F.when(F.col("__dp_drop").isNotNull(), F.col("text")), F.col("__dp_drop"))
    return joined.withColumn("text", F.coalesce(shorter, F.col("text"))).select(docs.columns)
