"""Quality rules (method: adaptive thresholds from mergeable quantile sketches).

The base rules are fixed.  Beyond them, each measure (mean word length, signs per
word, repeated lines per line, words of repeated windows per word) is judged
against thresholds learned for its language and source from quantile sketches.

A sketch counts values in log-linear buckets: a bucket is never wider than 1/64 of
its values, so every quantile is right within that share, whatever the scale, and
no value is cut off.  Sketches of two parts of the corpus add up to that of the
whole; they merge in any order, in partial aggregation, and a group that a third
of all rows share costs no more than any other.  Values are whole numbers
(hundred-thousandths), so the result does not depend on order or machine.

Word lengths are kept within ``SPREAD`` interquartile ranges of the quartiles.  The
other measures are 0 for most documents; of the group's documents that show the
trait at all, those are rejected that lie above both the 95th percentile and
``TAIL`` interquartile ranges over the upper quartile.  A group with fewer than
``min_group`` such values takes its language's sketch, which is the sum of its
sources', or that of all documents; with fewer even there, nothing is rejected.
The thresholds join back by language and source.

Defined results: null text has no words and fails; a null language or source is
a group of its own; repeated rows count each and are judged alike; ties within
a bucket are equal, and the bucket of a threshold is kept; further columns take
no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprism.llm import textvec as tv
from docprism.llm.store import materialize

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_ALL = [*COUNTS, "n_lines"]
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Interquartile ranges beyond the quartiles, for word lengths and for the other measures; values that a group must have.
SPREAD, TAIL, MIN_GROUP = 6, 2, 20
#: Measures as (part, whole): hundred-thousandths of the whole.  ``n_lines``: lines with a word.
MEASURES = {"word_length": ("word_chars", "n_words"), "symbol_rate": ("n_symbols", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words")}
SCALE = 100_000
#: Values up to this are buckets of their own.
EXACT = 128
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = tv.buffers(batch.column(batch.num_columns - 1))
        out = np.zeros((len(_ALL), len(batch)), np.int64)
        for i, j in tv.row_blocks(off, 1 << 20):
            base, stop = int(off[i]), int(off[j])
            part, rows = data[base:stop], off[i : j + 1]
            w = tv.words(data, rows)
            out[0, i:j] = np.diff(w.first)
            points = tv.code_points(part)
            lengths = np.append(0, np.cumsum(points[w.end - base] - points[w.start - base]))
            out[1, i:j] = np.diff(lengths[w.first])
            out[2, i:j] = np.diff(np.append(0, np.cumsum(_SYMBOL[part]))[rows - base])
            breaks = np.flatnonzero(part == 10) + base
            line_start = np.unique(np.concatenate([rows[:-1][np.diff(rows) > 0], breaks + 1]))
            line_start = line_start[line_start < stop]
            line_end = np.append(line_start[1:], stop)
            newline = (line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else np.zeros(0, bool)
            exact = _exact(part, line_start - base, line_end - base - newline)
            solid = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
            line_row = np.searchsorted(rows, line_start, "right") - 1
            lr, lh = line_row[solid], exact[solid]
            out[5, i:j] = np.bincount(lr, minlength=j - i)
            order = np.lexsort((lh, lr))
            same = np.zeros(len(lr), bool)
            same[1:] = (lr[order][1:] == lr[order][:-1]) & (lh[order][1:] == lh[order][:-1])
            out[3, i:j] = np.bincount(lr[order][same], minlength=j - i)
            h = _exact(data[base:stop], w.start - base, w.end - base)
            for r in range(i, j):
                a, b = w.first[r - i], w.first[r - i + 1]
                if b - a < 4:
                    continue
                _, inverse, counts = np.unique(tv.windows(h[a:b], 3), return_inverse=True, return_counts=True)
                twice = counts[inverse] > 1
                if twice.any():
                    covered = np.zeros(b - a, bool)
                    for k in range(3):
                        covered[k : k + len(twice)] |= twice
                    out[4, r] = covered.sum()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, out)], names=[*batch.schema.names[:-1], *_ALL])


def _exact(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Case-kept hashes of ranges."""
    from docprism.llm.bpe import _hashes

    return _hashes(part, start, end) if len(start) else np.zeros(0, np.uint64)


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` the base counts (``COUNTS``) and ``n_lines`` of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text").mapInArrow(tv.tidy(_stats), "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _ALL))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def bucket(value: Column) -> Column:
    """Log-linear bucket of a whole number: the number itself below ``EXACT``, else its exponent and its first seven bits."""
    shift = F.length(F.bin(value)) - 7
    return F.when(value < EXACT, value).otherwise(shift.cast("long") * 64 + F.call_function("shiftright", value, shift))


def bucket_low(number: Column) -> Column:
    shift = (F.floor(number / 64) - 1).cast("int")
    return F.when(number < EXACT, number).otherwise(F.call_function("shiftleft", 64 + number % 64, shift))


def bucket_high(number: Column) -> Column:
    shift = (F.floor(number / 64) - 1).cast("int")
    return F.when(number < EXACT, number).otherwise(F.call_function("shiftleft", 65 + number % 64, shift) - 1)


def _value(measure: str) -> Column:
    part, whole = MEASURES[measure]
    return F.call_function("div", SCALE * F.col(part), F.greatest(F.col(whole), F.lit(1)))


def sketches(stats: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n``: the merged sketches of the non-zero values of documents that pass the base rules."""
    columns = [F.struct(F.lit(m).alias("measure"), _value(m).alias("value")) for m in MEASURES]
    rows = stats.where(~base_failed()).select("lang", "source", F.explode(F.array(*columns)).alias("m")).where("m.value > 0")
    return rows.groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket(F.col("m.value")).alias("bucket")).agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Buckets of the quartiles and of the 95th percentile, and the number of values, of each sketch."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "measure")
    upto = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(by))
    least = lambda q: F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * q, F.col("bucket")))
    names = {k: f"{prefix}{k}" for k in (*keys, "measure")}
    out = ranked.groupBy(*keys, "measure").agg(F.struct(F.max("_all").alias("size"), least(25).alias("q25"), least(75).alias("q75"), least(95).alias("q95")).alias(f"{prefix}q"))
    return out.withColumnsRenamed(names)


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """``lang, source`` and ``low_``/``high_`` bounds of each measure; null where there are too few values anywhere."""
    own, broad, every = _quantiles(sketch, ["lang", "source"], ""), _quantiles(sketch, ["lang"], "b_"), _quantiles(sketch, [], "e_")
    rows = own.join(broad, F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("measure") == F.col("b_measure"))).join(F.broadcast(every), F.col("measure") == F.col("e_measure"))  # one row a measure
    chosen = F.when(F.col("q.size") >= min_group, F.col("q")).when(F.col("b_q.size") >= min_group, F.col("b_q")).when(F.col("e_q.size") >= min_group, F.col("e_q"))
    rows = rows.select("lang", "source", "measure", chosen.alias("c"))
    low, high = bucket_low(F.col("c.q25")), bucket_high(F.col("c.q75"))
    length = F.col("measure") == "word_length"
    fences = rows.select(
        "lang", "source", "measure", F.when(length, low - SPREAD * (high - low)).alias("low"),
        F.when(length, high + SPREAD * (high - low)).otherwise(F.greatest(bucket_high(F.col("c.q95")), high + TAIL * (high - low))).alias("high"),
    )
    return fences.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}") for m in MEASURES for side in ("low", "high")])


def judge(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and ``kept`` of each document."""
    stats = materialize(counts(docs), "quality")
    limits = thresholds(sketches(stats), min_group).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = stats.join(limits, stats["lang"].eqNullSafe(limits["_lang"]) & stats["source"].eqNullSafe(limits["_source"]), "left")
    inside = F.lit(True)
    for measure in MEASURES:
        value = _value(measure)
        inside = inside & F.coalesce(value <= F.col(f"high_{measure}"), F.lit(True)) & F.coalesce(value >= F.col(f"low_{measure}"), F.lit(True))
    return joined.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"), "n_lines")
