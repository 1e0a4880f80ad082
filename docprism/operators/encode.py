"""Text encoders as one surface: windows of texts to vectors, in the tasks that hold the texts.

An encoder is any object that can be pickled and has ``encode(texts)``, which gives a
matrix with a row for each text.  It is broadcast once and unpickled once a task, which
gets whole Arrow batches, so a model encodes many windows at a time.  The windows of a document
stay an array in its row: no step from the text to the measure shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprism.functions import numeric as nm
from docprism.functions import text as tx

#: Windows that an encoder gets at a time.
CHUNK = 4096


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedProjection:
    """A test model without weights: the sum over the words of the digits of their digests, each less the mean digit (32 numbers)."""

    def encode(self, texts: list[str]) -> np.ndarray:
        words = [[w for w in t.split(" ") if w] for t in texts]
        number = {w: k for k, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        if not number:
            return np.zeros((len(texts), 32))
        held = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in number), np.uint8).reshape(-1, 16)
        digits = np.stack([held >> 4, held & 15], 2).reshape(-1, 32) - 7.5
        upto = np.append(0, np.cumsum([len(ws) for ws in words]))
        total = np.zeros((int(upto[-1]) + 1, 32))
        np.cumsum(digits[[number[w] for ws in words for w in ws]], axis=0, out=total[1:])
        return total[upto[1:]] - total[upto[:-1]]


def encoded(rows: DataFrame, texts: str, encoder: Encoder, to: str = "vectors") -> DataFrame:
    """``rows`` with the vectors of an array of texts (null stays null)."""
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(encoder))  # classes of a notebook too

    @F.arrow_udf("array<array<double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = cloudpickle.loads(shared.value)
        for batch in batches:
            flat = batch.flatten().to_pylist()
            parts = [np.asarray(model.encode([x or "" for x in flat[a : a + CHUNK]]), np.float64) for a in range(0, len(flat), CHUNK)]
            matrix = np.concatenate(parts) if parts else np.zeros((0, 0))
            size = matrix.shape[1]
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * size, pa.int32()), pa.array(matrix.reshape(-1)))
            count = np.array([0 if n is None else n for n in batch.value_lengths().to_pylist()], np.int64)
            yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), vectors)

    return rows.withColumn(to, F.when(F.col(texts).isNotNull(), run(texts)))


def windows(sentences: Column, width: int = 2) -> Column:
    """Every ``width`` consecutive sentences of an array, joined by a space."""
    out = sentences
    for k in range(1, width):
        count = F.greatest(F.size(sentences) - k, F.lit(0))
        out = F.zip_with(F.slice(out, 1, count), F.slice(sentences, k + 1, count), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def coherence_of(vectors: Column) -> Column:
    """Struct of ``variance`` (population), ``mean_similarity`` and ``n_pairs`` of the cosines of consecutive vectors; (0, 1) under two vectors."""
    n = F.greatest(F.size(vectors) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(vectors, 1, n), F.slice(vectors, 2, n), nm.cosine)
    total = lambda x, f: F.aggregate(x, F.lit(0.0), lambda a, y: a + f(y))
    # an array of one, so that what the next step needs twice is made once
    held = F.transform(F.array(pairs), lambda p: F.struct(p.alias("p"), (total(p, lambda y: y) / F.size(p)).alias("mean")))
    measured = F.transform(held, lambda h: F.struct((total(h["p"], lambda y: (y - h["mean"]) * (y - h["mean"])) / F.size(h["p"])).alias("variance"), h["mean"].alias("mean_similarity"), F.size(h["p"]).cast("long").alias("n_pairs")))
    none = F.struct(F.lit(0.0).alias("variance"), F.lit(1.0).alias("mean_similarity"), F.lit(0).cast("long").alias("n_pairs"))
    return F.when(n > 0, measured[0]).otherwise(none)


def text_coherence(rows: DataFrame, encoder: Encoder, text: str = "text", width: int = 2, limit: int | None = None) -> DataFrame:
    """``rows`` with ``variance, mean_similarity, n_pairs`` of their windows under the encoder; null and short texts have none.

    Texts are read whole, or up to ``limit`` characters where a query defines its measure so.
    """
    held = rows.withColumn("_s", tx.sentences(F.coalesce(text, F.lit("")), limit=limit)).withColumn("_windows", windows(F.col("_s"), width))
    held = encoded(held.select(*rows.columns, "_windows"), "_windows", encoder, "_vectors")
    return held.withColumn("_c", coherence_of(F.col("_vectors"))).select(*rows.columns, "_c.variance", "_c.mean_similarity", "_c.n_pairs")
