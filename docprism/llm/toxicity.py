"""Toxicity (method: multiple-instance learning with noisy-or).

A document is a bag of sentences.  A sentence's probability is a logistic
function of its hashed words; the document is toxic unless none of its
sentences is: ``1 - prod(1 - p)``.  Only document labels train the model; the
sentence probabilities then locate the offending sentences.

Training takes at most ``max_train`` labelled documents for each label (those
with the least hash of their id) and ``max_words`` words in all, weighted back to
the labels' true counts, and never one whose ``crc32(doc_id as text) mod 4`` is 2.  Words that fewer
bags hold than the square root of the number of toxic ones get no weight.  The sample's ids are a
bounded table that is joined to the corpus in the scan; only hashed words of
these documents reach the driver.  Scoring is one scan without a shuffle: words,
sentences and their products are array operations over whole Arrow batches.
Language, source, id and label are never inputs of a score.

Defined results: a text without words (null, empty, white space) has no sentence
and scores 0; without labels of both kinds every document scores 0; repeated or
conflicting labels of an id count each; repeated rows score alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docprism.llm import textvec as tv

BITS = 19
#: Besides the whole word, its first so many bytes are features of their own, for inflected languages.
PREFIXES = (4, 5, 6)
MAX_TRAIN = 2500
#: Words of the training sample; a document that would pass it is left out of the sample, so long texts or repeated ids cannot fill the driver.
MAX_TRAIN_WORDS = 6_000_000
THRESHOLD = 0.3
HELD_OUT_PART = 2
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == HELD_OUT_PART


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tv.Words]:
    """Buckets of each word (a row a kind: whole word, then prefixes), whether it begins a sentence, and the words."""
    w = tv.words(data, offsets, tv.ALNUM)
    base = int(offsets[0])
    breaks = np.append(0, np.cumsum(_BREAK[data[base : int(offsets[-1])]]))
    number = breaks[w.start - base]
    begins = np.ones(len(number), bool)
    begins[1:] = number[1:] != number[:-1]
    begins[w.first[:-1][w.first[:-1] < len(begins)]] = True
    kinds = [w.hash]
    for size in PREFIXES:
        kinds.append(_prefix_hashes(data, w, size))
    return np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in kinds]), begins, w


def _prefix_hashes(data: np.ndarray, w: tv.Words, size: int) -> np.ndarray:
    """Hash of the first ``size`` bytes (A-Z as a-z) of longer words; the shorter share one bucket."""
    h = np.full(len(w.start), size, np.uint64)
    long = np.flatnonzero(w.end - w.start > size)
    value = np.zeros(len(long), np.uint64)
    for k in range(size):
        value = value * np.uint64(257) + _LOWER[data[w.start[long] + k]]
    h[long] = tv.mix(value + np.uint64(size << 56))
    return h


class NoisyOr:
    """Weights of hashed words and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def sentences(self, bucket: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """``log(1 - p)`` of each sentence."""
        if not len(begins):
            return np.zeros(0)
        z = np.add.reduceat(self.weights[bucket].sum(0, dtype=np.float64), np.flatnonzero(begins)) + self.bias
        return -np.logaddexp(0, z)

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, begins, w = features(data, offsets)
        quiet = np.append(0, np.cumsum(self.sentences(bucket, begins)))
        upto = np.append(0, np.cumsum(begins))
        return np.clip(-np.expm1(quiet[upto[w.first[1:]]] - quiet[upto[w.first[:-1]]]), 0.0, 1.0)


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], weight: dict[int, float], rounds: int = 100, rate: float = 0.5, l1: float = 3e-5, l2: float = 1e-5, least: int | None = None) -> NoisyOr:
    """Weighted maximum likelihood of the document labels by adaptive gradient steps.

    Words in under ``least`` bags stay out: unless given, the square root of the
    number of toxic bags, which is how far counts among them stray by chance.
    Empties ``bags``.
    """
    size = 1 << BITS
    if len({y for *_, y in bags}) < 2:
        return NoisyOr(np.zeros(size, np.float32), -np.inf)
    bags[:] = [b for b in bags if len(b[1])]
    per_bag = np.array([b[1].sum() for b in bags])
    bag_first = np.cumsum(per_bag) - per_bag
    y = np.array([b[2] for b in bags])
    begins = np.concatenate([b[1] for b in bags])
    words = [np.concatenate([b[0][k] for b in bags]) for k in range(1 + len(PREFIXES))]
    held = np.zeros(size, np.int64)
    for b in bags:
        held[np.unique(b[0])] += 1
    bags.clear()  # the arrays hold all from here on
    first = np.flatnonzero(begins)
    wt = np.array([weight[k] for k in y])
    wt = wt / wt.sum()
    live = held >= (math.ceil(math.sqrt((y == 1).sum())) if least is None else least)
    sentence_of = np.cumsum(begins, dtype=np.int32) - 1
    weights, bias = np.zeros(size, np.float32), float(-np.log(per_bag.mean()) - 5)
    seen, seen_b = np.full(size, 1e-12), 1e-12
    for _ in range(rounds):
        each = weights[words[0]]
        for w in words[1:]:
            each += weights[w]
        z = np.add.reduceat(each, first, dtype=np.float64) + bias
        p = np.exp(-np.logaddexp(0, -z))
        quiet = np.add.reduceat(-np.logaddexp(0, z), bag_first)
        toxic = np.maximum(-np.expm1(quiet), 1e-9)
        pull = np.where(y == 1, np.exp(quiet) / toxic, -1.0) * wt
        g = np.repeat(pull, per_bag) * p  # of the log likelihood by z
        each = g[sentence_of]
        step = -l2 * weights.astype(np.float64)
        for w in words:
            step += np.bincount(w, weights=each, minlength=size) * live
        seen += step * step
        weights = np.maximum(weights + rate * (step - l1) / np.sqrt(seen), 0).astype(np.float32)  # words may only add to toxicity
        gb = float(g.sum())
        seen_b += gb * gb
        bias += rate * gb / np.sqrt(seen_b)
    return NoisyOr(weights.astype(np.float32), bias)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = tv.buffers(batch.column(1))
        for i, j in tv.row_blocks(off, 1 << 20):
            bucket, begins, w = features(data, off[i : j + 1])
            spans = [(w.first[r], w.first[r + 1]) for r in range(j - i)]
            bucket = bucket.T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array([bucket[a:b].astype("<i4").tobytes() for a, b in spans], pa.binary()), pa.array([begins[a:b].tobytes() for a, b in spans], pa.binary())],
                names=["toxic", "words", "begins"],
            )


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_words: int = MAX_TRAIN_WORDS) -> NoisyOr:
    """Fit on at most ``max_train`` labelled documents of each label outside the held-out part, and ``max_words`` words."""
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id is not null and _toxic in (0, 1)").where(~held_out(F.col("_id")))
    total = {r[0]: r[1] for r in usable.groupBy("_toxic").count().collect()}
    chosen = None
    for label in (0, 1):
        part = usable.where(F.col("_toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_toxic", "text")  # at most 2 * max_train ids
    bags, number = [], {0: 0, 1: 0}
    held = 0
    for toxic, words, begins in rows.mapInArrow(tv.tidy(_bags), "toxic int, words binary, begins binary").toLocalIterator():
        if held + len(begins) > max_words:
            continue
        held += len(begins)
        bags.append((np.frombuffer(words, "<i4").reshape(-1, 1 + len(PREFIXES)).T, np.frombuffer(begins, bool), toxic))
        number[toxic] += 1
    return fit(bags, {k: total.get(k, 0) / max(1, n) for k, n in number.items()})


def scores(text: Column, model: NoisyOr) -> Column:
    """Score of each text; only the text travels to Python and only the score comes back."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in batches:
                data, off = tv.buffers(batch)
                out = np.zeros(len(batch))
                for i, j in tv.row_blocks(off, 1 << 20):
                    out[i:j] = shared.value.documents(data, off[i : j + 1])
                yield pa.array(out)
        finally:
            tv.release()

    return run(text)


def score(docs: DataFrame, model: NoisyOr, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document."""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scores(F.col("text"), model).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: NoisyOr, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more."""
    return docs.where(scores(F.col("text"), model) < threshold)


def offending(docs: DataFrame, model: NoisyOr, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, sentence, score, span`` of every sentence that alone scores ``threshold`` or more; ``span`` holds its words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, off = tv.buffers(batch.column(1))
            ids, places, scores, spans = [], [], [], []
            for i, j in tv.row_blocks(off):
                bucket, begins, w = features(data, off[i : j + 1])
                if not len(begins):
                    continue
                p = -np.expm1(shared.value.sentences(bucket, begins))
                first = np.flatnonzero(begins)
                last = np.append(first[1:], len(begins)) - 1
                row = np.searchsorted(w.first, first, "right") - 1
                number = np.arange(len(first)) - np.append(0, np.cumsum(begins))[w.first[row]]
                for k in np.flatnonzero(p >= threshold):
                    ids.append(i + row[k])
                    places.append(number[k])
                    scores.append(p[k])
                    spans.append(data[w.start[first[k]] : w.end[last[k]]].tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(places, pa.int64()), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "sentence", "score", "span"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tv.tidy(run), "doc_id long, sentence long, score double, span string")
