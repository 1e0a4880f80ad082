"""Language-model scores (method: interpolated modified Kneser-Ney, counted in Spark, read from mapped sorted hash arrays).

Training takes all documents outside the held-out part:

1. Words (A-Z as a-z) and one end for each document are counted; their sorted hashes
   are the vocabulary.  Words are numbered by the size of their counts, frequent ones
   first (equal sizes: by shard and place), which packs n-grams well.
2. Each chunk of documents counts its n-grams of the highest order and deals them out
   by a hash of their context, packed; a task adds them up by shard, writes the shard's
   counts and its contexts' totals, and passes each different n-gram's suffix on to the
   next lower order, where it counts once.  So lower orders hold continuation counts.
3. The counts of counts of each order give its three discounts.  Neighbouring shards
   are joined, so that a batch of tokens meets few files, however large the corpus.

A text's tokens are scored from the uniform distribution over the vocabulary and one
unknown word upwards: ``p = max(a - D(a), 0) / T + (D1 N1 + D2 N2 + D3 N3) / T * p``, with
the order's count ``a``, the context's total ``T`` and its numbers of words that follow
it once, twice, more often; unseen contexts leave p as it is.  ``order - 1`` start signs
stand before each text, so every context's probabilities add up to 1.

No n-gram is pruned and none is sampled: the model grows with the corpus.  What a task
holds is bounded by ``CHUNK`` tokens, or a shard of about ``SHARD`` tokens; a frequent
context is one row for each chunk and following word before the shuffle.  Workers map
the files of the shared folder; the driver gets one row of sums an order.  N-grams are
told apart by at least 48 bits of their hashes.

Defined results: a null or empty text is one token, the end; a null id is not held out
and trains; repeated rows count each and score alike; without training documents every
token has probability 1; where a count of counts is 0 the order's discounts are 1/2, 1
and 3/2; other columns never take part; an empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprism.llm import arrays
from docprism.llm import textvec as tv

ORDER = 3
HELD_OUT_OF, HELD_OUT_PART = 7, 2
#: Tokens of n-grams that a task counts at a time, different words likewise, tokens of a shard, and shards of the vocabulary (a power of two).
CHUNK = 1 << 21
WORDS = 1 << 21
SHARD = 1 << 20
VOCABULARY_BITS = 6
DIGITS = 64
U64 = np.uint64
_END = U64(0xE7D1F3A59B8C2461)  # hash of the end
_FACTOR = U64(0x9E3779B97F4A7C15)
_TOTALS = ("t", "n1", "n2", "n3")
_DEALT = "shard int, kind int, data binary, sums array<long>"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_OF == HELD_OUT_PART, F.lit(False))


@dataclasses.dataclass(frozen=True)
class Model:
    """Where the arrays are, and the sums of each order; ``context[k]``: T, N1, N2, N3 of the empty context at k = 1."""

    folder: str
    order: int
    bits: int
    first: np.ndarray  # by binary digits of a count and vocabulary shard, the number of the first such word
    tokens: int
    words: int
    discounts: dict[int, tuple[float, float, float, float]]
    context: tuple[int, int, int, int]
    joined: int = 0  # binary digits of how many shards are one

    @property
    def start(self) -> int:
        return self.words

    @property
    def unknown(self) -> int:
        return self.words + 1

    @property
    def kind(self):
        return np.uint32 if self.words + 2 < 1 << 32 else np.uint64


def _digits(count: np.ndarray) -> np.ndarray:
    """Binary digits of each count."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64)


def _folded(ids: list[np.ndarray]) -> np.ndarray:
    """Hash of each row of word numbers."""
    h = np.full(len(ids[0]), U64(len(ids)))
    for a in ids:
        h = tv.mix((h ^ a.astype(U64)) * _FACTOR + U64(1))
    return h


def _keys(ids: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the contexts, and of the n-grams, which lie in their context's shard (single words in one of their own)."""
    whole = _folded(ids)
    if len(ids) == 1:
        return whole, whole
    context = _folded(ids[:-1])
    return context, context if not len(context) else _in_shard(context, whole, bits)


def _in_shard(context: np.ndarray, whole: np.ndarray, bits: int) -> np.ndarray:
    return whole if not bits else (context >> U64(64 - bits) << U64(64 - bits)) | (whole >> U64(bits))


def _shard_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def _dealt(shard: np.ndarray, values: list[np.ndarray]):
    """A packed row for each shard."""
    order = np.argsort(shard.astype(np.uint16) if not len(shard) or shard.max() < 1 << 16 else shard, kind="stable")  # short numbers are sorted by their digits
    shard = shard[order]
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
    values = [v[order] for v in values]
    rows = [(int(shard[a]), arrays.pack(*(v[a:b] for v in values))) for a, b in zip(cuts, np.append(cuts[1:], len(shard)))]
    return _batch([r[0] for r in rows], [0] * len(rows), [r[1] for r in rows], [None] * len(rows))


def _batch(shard, kind, data, sums):
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary()), pa.array(sums, pa.list_(pa.int64()))], names=["shard", "kind", "data", "sums"])


def _order(keys: list[np.ndarray]) -> np.ndarray:
    """Places of the rows in the order of their keys: a key of up to 32 bits joins the rank of those before it in one of 64 bits."""
    if any(k.itemsize > 4 for k in keys[1:]) or len(keys) > 1 and keys[0].itemsize > 4:
        return np.lexsort(keys[::-1])
    if len(keys) == 1:
        return arrays.sorted_places(keys[0])
    order, rank = None, keys[0]
    for key in keys[1:]:
        joint = rank.astype(U64) << U64(32) | (key if order is None else key[order])
        then = np.argsort(joint, kind="stable") if order is None else arrays.sorted_places(joint)  # rows come in sorted stretches, which a stable sort merges
        order, joint = then if order is None else order[then], joint[then]
        rank = np.cumsum(np.append(False, joint[1:] != joint[:-1])) if key is not keys[-1] else None
    return order


def _added(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of equal keys added up, sorted."""
    if not len(counts):
        return keys, counts
    order = _order(keys)
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.add.reduceat(counts[order], first)


def _tallied(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows, sorted, and how often each is there: as :func:`_added` with counts of 1, by sorting numbers of 64 bits that hold whole rows, where they do."""
    widths = [max(int(k.max()).bit_length(), 1) if len(k) else 1 for k in keys]
    if not len(keys[0]) or sum(widths) > 64:
        return _added(keys, np.ones(len(keys[0]), np.int64))
    joint = keys[0].astype(U64)
    for k, width in zip(keys[1:], widths[1:]):
        joint = joint << U64(width % 64) | k.astype(U64)
    joint.sort()
    first = np.flatnonzero(np.append(True, joint[1:] != joint[:-1]))
    counts, joint = np.diff(first, append=len(joint)), joint[first]
    out = []
    for k, width in zip(keys[::-1], widths[::-1]):
        out.append((joint & U64((1 << width) - 1)).astype(k.dtype))
        joint = joint >> U64(width % 64)
    return out[::-1], counts


def _held(texts: pa.Array, rows: int = 1 << 21):
    """Words of about ``rows`` bytes of documents at a time: ``i, j, hashes, first word of each``."""
    data, off = tv.buffers(texts)
    for i, j in tv.row_blocks(off, rows):
        w = tv.words(data, off[i : j + 1])
        yield i, j, w.hash, w.first


def _count_words(batches):
    keys, counts, n = [], [], 0

    def dealt():
        (key,), count = _added([np.concatenate(keys)], np.concatenate(counts))
        return _dealt(_shard_of(key, VOCABULARY_BITS), [key, count.astype(U64)])

    for batch in batches:
        for i, j, hashes, _ in _held(batch.column(0)):
            key, count = np.unique(hashes, return_counts=True)
            keys += [key, np.array([_END])]
            counts += [count, np.array([j - i])]
            n += len(key)
            if n > WORDS:
                yield dealt()
                keys, counts, n = [], [], 0
    if keys:
        yield dealt()


def _grouped(batches):
    """``shard, blobs, passed``: the packed rows of one shard after the other; sorted input.  Rows of sums pass through."""
    shard, held, passed = None, [], []
    for batch in batches:
        for s, kind, data, sums in zip(*(batch.column(c) for c in range(4))):
            if kind.as_py():
                passed.append((s.as_py(), kind.as_py(), sums.as_py()))
                continue
            if s.as_py() != shard:
                if held:
                    yield shard, held, []
                shard, held = s.as_py(), []
            held.append(arrays.unpack(data.as_buffer().to_pybytes()))
    yield shard, held, passed


def _keep_words(folder: str):
    def run(batches):
        for shard, held, _ in _grouped(batches):
            if held:
                (key,), count = _added([np.concatenate([h[0] for h in held])], np.concatenate([h[1] for h in held]).astype(np.int64))
                digits = _digits(count)
                order = np.argsort(digits, kind="stable")
                sizes = np.bincount(digits, minlength=DIGITS)
                local = np.empty(len(key), np.uint32)
                local[order] = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                arrays.write_shard(folder, "words", shard, VOCABULARY_BITS, key, {"n": count}, {"local": local})
                yield _batch([shard], [1], [None], [[int(count.sum()), *sizes.tolist()]])

    return tv.tidy(run)


def _numbers(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word hash (``unknown`` for others) and its count."""
    hashes, back = arrays.different(hashes)
    place, count, local = arrays.look_up(model.folder, "words", VOCABULARY_BITS, hashes, ("n", "local"))
    number = model.first[_digits(count), _shard_of(hashes, VOCABULARY_BITS)] + local
    return np.where(place < 0, model.unknown, number).astype(model.kind)[back], count[back]


def _sequences(model: Model, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all documents with start signs and ends, the places of tokens there, each document's first token, and tokens' counts."""
    n, docs = model.order, len(first) - 1
    row = np.repeat(np.arange(docs), np.diff(first))
    number, count = _numbers(model, np.append(hashes, _END))
    seq = np.full(len(hashes) + docs * n, model.start, model.kind)
    counts = np.zeros(len(seq), np.int64)
    at = np.arange(len(hashes)) + row * n + n - 1
    seq[at], counts[at] = number[:-1], count[:-1]
    ends = first[1:] + np.arange(1, docs + 1) * n - 1
    seq[ends], counts[ends] = number[-1], count[-1]
    token = np.ones(len(seq), bool)
    token[(first[:-1] + np.arange(docs) * n)[:, None] + np.arange(n - 1)] = False
    places = np.flatnonzero(token)
    return seq, places, first[:-1] + np.arange(docs), counts[places]


def _count_grams(model: Model):
    def run(batches):
        held, n = [], 0

        def dealt():
            number, rank = arrays.different(np.concatenate([seq for seq, _ in held]))  # a chunk's words in fewer bits, in the same order
            base = np.cumsum([0, *(len(seq) for seq, _ in held)])
            places = np.concatenate([at + b for (_, at), b in zip(held, base)])
            grams, count = _tallied([rank[places - k] for k in range(model.order - 1, -1, -1)])
            grams = [number[g] for g in grams]
            return _dealt(_shard_of(_keys(grams, model.bits)[0], model.bits), [*grams, count.astype(np.uint32)])

        for batch in batches:
            for _, _, hashes, first in _held(batch.column(0)):
                seq, places, *_ = _sequences(model, hashes, first)
                for a in range(0, len(places), CHUNK):
                    part = places[a : a + CHUNK]
                    begin = part[0] - model.order + 1
                    held.append((seq[begin : part[-1] + 1], part - begin))
                    n += len(part)
                    if n >= CHUNK:
                        yield dealt()
                        held, n = [], 0
        if held:
            yield dealt()

    return tv.tidy(run)


def _keep_grams(model: Model, k: int):
    """Writes the shards of order ``k``; yields the suffixes' packed rows, of several shards at a time, and the order's sums."""

    def run(batches):
        suffixes, n = [], 0

        def dealt():
            *below, different = (np.concatenate(x) for x in zip(*suffixes))
            below, different = _added(below, different)
            return _dealt(_shard_of(_keys(below, model.bits)[0], model.bits), [*below, different.astype(np.uint32)])

        for shard, held, passed in _grouped(batches):
            if passed:
                yield _batch([p[0] for p in passed], [p[1] for p in passed], [None] * len(passed), [p[2] for p in passed])
            if not held:
                continue
            grams, count = _added([np.concatenate([h[i] for h in held]) for i in range(k)], np.concatenate([h[k] for h in held]).astype(np.int64))
            held.clear()
            context, key = _keys(grams, model.bits)
            order = arrays.sorted_places(key)
            arrays.write_shard(model.folder, f"grams{k}", shard, model.bits, key[order], {"n": count[order]})
            kinds = np.minimum(count, 3)
            sums = [*(int((count == c).sum()) for c in (1, 2, 3, 4)), int(count.sum()), *(int((kinds == c).sum()) for c in (1, 2, 3))]
            yield _batch([shard], [k], [None], [sums])
            if k == 1:
                continue
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))  # grams are sorted, equal contexts adjoin
            order = arrays.sorted_places(context[first])
            totals = {"t": np.add.reduceat(count, first)} | {f"n{c}": np.add.reduceat((kinds == c).astype(np.int64), first) for c in (1, 2, 3)}
            arrays.write_shard(model.folder, f"contexts{k}", shard, model.bits, context[first][order], {c: v[order] for c, v in totals.items()})
            below, different = _tallied(grams[1:])
            suffixes.append([*below, different])
            n += len(different)
            if n >= CHUNK:
                yield dealt()
                suffixes, n = [], 0
        if suffixes:
            yield dealt()

    return tv.tidy(run)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """What counts of 0, 1, 2, and 3 or more lose."""
    if not (n1 and n2 and n3 and n4):
        return 0.0, 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return 0.0, *(min(max(d, 0.0), float(c)) for c, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count all ``docs`` that are not held out."""
    spark = docs.sparkSession
    texts = docs.where(~held_out(F.col("doc_id"))).select("text")
    folder = arrays.mounted_folder(spark, "language-model")

    def dealt(df: DataFrame, run) -> DataFrame:
        return df.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, _DEALT)

    words = dealt(texts.mapInArrow(tv.tidy(_count_words), _DEALT), _keep_words(folder)).select("shard", "sums").collect()  # 2^VOCABULARY_BITS rows at most
    sizes = np.zeros((DIGITS, 1 << VOCABULARY_BITS), np.int64)
    for r in words:
        sizes[:, r.shard] = r.sums[1:]
    tokens = sum(r.sums[0] for r in words)
    falling = sizes[::-1].reshape(-1)  # most digits first
    first = (np.cumsum(falling) - falling).reshape(sizes.shape)[::-1]
    bits = max(0, (-(-tokens // SHARD) - 1).bit_length())
    model = Model(folder, order, bits, first, tokens, int(sizes.sum()), {}, (0, 0, 0, 0))
    rows = texts.mapInArrow(_count_grams(model), _DEALT)
    for k in range(order, 0, -1):
        rows = dealt(rows, _keep_grams(model, k))
    sums = [F.sum(F.col("sums")[i]) for i in range(8)]
    found = {r[0]: r[1:] for r in rows.where("kind > 0").groupBy("kind").agg(*sums).collect()}
    joined = arrays.join_shards(spark, folder, bits, {f"grams{k}": ("n",) for k in range(1, order + 1)} | {f"contexts{k}": _TOTALS for k in range(2, order + 1)})
    low = found.get(1, (0,) * 8)
    return dataclasses.replace(model, discounts={k: discounts(*r[:4]) for k, r in found.items()}, context=tuple(int(x) for x in low[4:8]), joined=joined)


def _weights(model: Model, k: int, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Total of each context of order ``k``, and what its counts lose."""
    _, total, *follow = arrays.look_up(model.folder, f"contexts{k}", model.bits, contexts, _TOTALS, model.joined)
    return total, sum(d * f for d, f in zip(model.discounts[k][1:], follow))


def probabilities(model: Model, seq: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Probability of each token given those before it; different n-grams short of the highest order are looked up once, as grams and as contexts."""
    p = np.full(len(places), 1.0 / (model.words + 1))
    weights, total = None, None  # of each token's context
    ends = np.zeros(len(seq), bool)
    ends[places] = ends[places - 1] = True  # the last start sign ends a context only
    at, mine = np.flatnonzero(ends), (np.cumsum(ends) - 1)[places]
    for k in range(1, model.order + 1):
        if k not in model.discounts:
            continue
        if k == 1:
            total = np.full(len(places), model.context[0])
            weights = np.full(len(places), sum(d * f for d, f in zip(model.discounts[1][1:], model.context[1:])))
        if k < model.order:
            grams, back = _different([seq[at - i] for i in range(k - 1, -1, -1)])
            this, before = back[mine], back[mine - 1]
        else:
            grams, this, before = [seq[places - i] for i in range(k - 1, -1, -1)], slice(None), None
        _, key = _keys(grams, model.bits)
        count = arrays.look_up(model.folder, f"grams{k}", model.bits, key, ("n",), model.joined)[1][this]
        lost = np.array(model.discounts[k])
        seen = total > 0
        kept = np.maximum(count - lost[np.minimum(count, 3)], 0) + weights * p
        p[seen] = kept[seen] / total[seen]
        if k < model.order and k + 1 in model.discounts:
            total, weights = (x[before] for x in _weights(model, k + 1, _folded(grams)))
    return p


def _different(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows, and which of them each row is."""
    values, rank = arrays.different(columns[0])
    rows = [values]
    for c in columns[1:]:
        values, own = arrays.different(c)
        width = U64(len(values).bit_length())
        joint, rank = arrays.different(rank.astype(U64) << width | own.astype(U64))
        rows = [r[(joint >> width).astype(np.int64)] for r in rows] + [values[(joint & ((U64(1) << width) - U64(1))).astype(np.int64)]]
    return rows, rank


_SCORED = "n_tokens long, n_known long, base_score double, score double"


def _score(model: Model):
    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for _, _, hashes, first in _held(batch.column(2)):
                seq, places, begin, count = _sequences(model, hashes, first)
                base = np.log10((count + 1) / (model.tokens + model.words + 1))
                score = np.log10(probabilities(model, seq, places))
                out[0].append(np.diff(np.append(begin, len(places))))
                out[1].append(np.add.reduceat((count > 0).astype(np.int64), begin))
                out[2].append(np.add.reduceat(base, begin))
                out[3].append(np.add.reduceat(score, begin))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(np.concatenate(x) if x else np.zeros(0, kind), kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64())))],
                names=["doc_id", "held_out", *(c.split()[0] for c in _SCORED.split(", "))],
            )

    return tv.tidy(run)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens, perplexity`` of each document."""
    doc_id = F.col("doc_id").cast("long")
    scored = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text").mapInArrow(_score(model), f"doc_id long, held_out boolean, {_SCORED}")
    return scored.withColumns({"train_tokens": F.lit(model.tokens).cast("long"), "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))})


def report(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    return score(docs, train(docs, order))
