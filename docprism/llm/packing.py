"""Best-fit packing (method: best-two-fit).

Documents become token ids plus the end id; longer ones are cut so that only the
first piece may be shorter than ``capacity``.  Sequences are filled greedily with
the longest pieces that fit; then a sequence's shortest piece is replaced by two
unpacked pieces that fill its expanded gap more tightly.

Two pieces of one length are interchangeable, so the whole plan is made on the
histogram of lengths: at most ``capacity`` counters, whatever the corpus.  The
planner repeats each found filling as often as the counters allow.  A piece of
full length is a sequence of its own and needs no number among its like.  The
others are numbered within (length, salt), the salts of a length are lined up by
a running sum over their counts, and the number picks sequence and offset from
the plan.  A length has about the square root of its count in salts, so that
neither the rows of a salt nor the salts of a length fill a task.

Defined results: null text is empty and gives one piece with the end id alone;
repeated rows are packed each; ties between equal pieces are broken by
``doc_id``, piece and checksum and may fall either way for repeated rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docprism.llm import textvec as tv
from docprism.llm.store import materialize

CAPACITY, END_ID = 2048, 0
#: Least number of pieces of one length and salt.
SALT_ROWS = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = PIECES + ", sequence_id long, offset long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece (columns of ``PIECES``). ``tokenizer``: path on the executors; by default the public byte-level BPE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docprism.llm.bpe import encoder as encoder_of

        encoder = encoder_of(tokenizer or tokenizer_path())
        for batch in batches:
            data, off = tv.buffers(batch.column(1))
            ids = batch.column(0)
            for i, j in tv.row_blocks(off, 1 << 20):
                flat, ends = encoder.encode(data, off[i : j + 1])
                rows, numbers, starts, lengths, sums = [], [], [], [], []
                for r in range(i, j):
                    doc = np.append(flat[ends[r - i] : ends[r - i + 1]], np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range((len(doc) - 1) % capacity + 1, len(doc) + 1, capacity)]
                    for k in range(len(cuts) - 1):
                        rows.append(r)
                        numbers.append(k)
                        starts.append(cuts[k])
                        lengths.append(cuts[k + 1] - cuts[k])
                        sums.append(zlib.crc32(doc[cuts[k] : cuts[k + 1]]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tv.tidy(run), PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Fillings ``([(length, times), ...], repeats)`` by best-two-fit; ``counts``: pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        left[length] = n
    fillings = []
    while len(live := np.flatnonzero(left)):
        taken: dict[int, int] = {}
        gap = capacity
        while gap and len(live):  # greedy: the longest that fits, as often as it fits
            k = int(np.searchsorted(live, gap, "right")) - 1
            if k < 0:
                break
            length = int(live[k])
            times = min(gap // length, int(left[length]))
            taken[length] = times
            gap -= times * length
            live = live[:k]
        free = left.copy()
        for length, times in taken.items():
            free[length] -= times
        while gap:  # the shortest piece makes way for two that fill more
            shortest = min(taken)
            best = _two(free, shortest + gap)
            if best is None or sum(best) <= shortest:
                break
            taken[shortest] -= 1
            free[shortest] += 1
            if not taken[shortest]:
                del taken[shortest]
            for length in best:
                taken[length] = taken.get(length, 0) + 1
                free[length] -= 1
            gap -= sum(best) - shortest
        repeats = min(int(left[length]) // times for length, times in taken.items())
        for length, times in taken.items():
            left[length] -= repeats * times
        fillings.append((sorted(taken.items(), reverse=True), repeats))
    return fillings


def _two(free: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two free lengths with the largest sum up to ``gap``."""
    have = np.flatnonzero(free[: gap + 1] > 0)
    if not len(have):
        return None
    at = np.searchsorted(have, gap - have, "right") - 1
    fits = at >= 0
    a, b = have[fits], have[at[fits]]
    same = (a == b) & (free[a] < 2)
    b = np.where(same, have[np.maximum(at[fits] - 1, 0)], b)
    valid = (a != b) | (free[a] >= 2)
    if not valid.any():
        return None
    total = np.where(valid, a + b, -1)
    k = int(total.argmax())
    return int(a[k]), int(b[k])


class Places:
    """From (length, number within the length) to (sequence, offset)."""

    def __init__(self, fillings):
        entries: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for filling, repeats in fillings:
            offset = 0
            for length, times in filling:
                entries.setdefault(length, []).append((used.get(length, 0), times, sequence, offset))
                used[length] = used.get(length, 0) + repeats * times
                offset += length * times
            sequence += repeats
        self.n_sequences = sequence
        self.entries = {length: np.array(rows, np.int64).T for length, rows in entries.items()}

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for value in np.unique(length):
            at = np.flatnonzero(length == value)
            first, times, base, begin = self.entries[int(value)]
            k = np.searchsorted(first, number[at], "right") - 1
            i = number[at] - first[k]
            sequence[at] = base[k] + i // times[k]
            offset[at] = begin[k] + i % times[k] * value
        return sequence, offset


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece with its place (columns of ``SCHEMA``)."""
    spark = docs.sparkSession
    parts = materialize(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most capacity rows
    full = counts.pop(capacity, 0)
    plan_of = Places(plan(counts, capacity))
    places = spark.sparkContext.broadcast(plan_of)
    salts = spark.createDataFrame([(length, -(-n // max(SALT_ROWS, math.isqrt(n)))) for length, n in counts.items()], "length long, _salts long")  # at most capacity rows
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts"))
    short = parts.where(F.col("length") < capacity).join(F.broadcast(salts), "length").withColumn("_salt", salt)
    sizes = short.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = (
        short.withColumn("_row", F.row_number().over(within) - 1)
        .join(firsts, ["length", "_salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_row")).alias("_number"))
    )

    def run(batches):
        for batch in batches:
            sequence, offset = places.value.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    out = numbered.mapInArrow(tv.tidy(run), SCHEMA)
    if not full:
        return out
    own = F.lit(plan_of.n_sequences) + F.monotonically_increasing_id()
    alone = parts.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out.unionByName(alone)
