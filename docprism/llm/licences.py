r"""Licence scans (method: trained paragraph classifier; DataFrame functions only).

Paragraphs are separated by blank lines.  Of a paragraph the lines count that hold
a licence word, joined, so that a hard-wrapped notice is read as a whole and a
one-line notice within other text is not drowned.  Word n-grams (one to three
words, with a licence word in each) are the sparse features of a multinomial
logistic regression whose classes are licence families and *unknown*.

It is trained here, on the driver, from the paragraphs in ``licence_texts``, whole
and in pieces, and against sentences of no family and paragraphs of the corpus
itself: at most ``SAMPLE_DOCS`` documents (those with the least hash of their id),
``SAMPLE_PARAGRAPHS`` paragraphs each and ``SAMPLE_TOKENS`` tokens of a paragraph, of
which those that hold a template are no counter-examples.  The sample is taken in the
order of these hashes and of the paragraphs, so it is the same in every run.  A fifth of all examples is held out; on it the temperature of
the probabilities is set, and the least probability at which a family counts: the
lowest at which at most ``MAX_ERROR`` of the held-out examples that would count
are wrong.  A prediction is confirmed if it and one of the family's templates
share most of the n-grams of the shorter one.

A licence word is one that templates use and other text seldom does; a paragraph
without any has no feature, so passing it over decides nothing.  Scoring is one
scan without a shuffle: n-grams are looked up by hash in literal tables, and compared
there as strings; those that share a slot move on to the next, smaller table, so that
none is lost.

Defined results: null and empty texts have no paragraphs and no licence; repeated
rows get equal rows; of equal probabilities the family that comes first in the
alphabet is reported; further columns take no part.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprism.llm.licence_texts import TEMPLATES, other_sentences

UNKNOWN = "unknown"
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, SAMPLE_TOKENS = 300, 4, 400
MAX_ERROR = 0.01
#: Slots of the first table of n-grams.
SLOTS = 1 << 14
#: Share of the shorter one's n-grams, and least number, that confirm a prediction.
CONFIRM, CONFIRM_GRAMS = 0.6, 2
_TOKEN = "[a-z0-9]+(?:[.][0-9]+)*"
_GAP = r"\n[ \t\r\f\x0B]*\n"


def tokens_of(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def _grams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + k]) for k in (1, 2, 3) for i in range(len(tokens) - k + 1)}


@dataclass(frozen=True)
class Model:
    """``words``: licence words; ``grams``: known n-grams, in the order of the rows of ``weights`` (a column a class, the last *unknown*)."""

    words: tuple[str, ...]
    grams: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    families: tuple[str, ...]
    threshold: float
    error: float  # share of wrong ones among the held-out examples that count
    recall: float  # share of held-out notices that count, rightly
    templates: tuple[tuple[int, tuple[int, ...]], ...]  # class, rows of its n-grams


def _pieces(notice: str) -> list[str]:
    """A notice in the spellings and cuts in which it occurs."""
    words = notice.split()
    out = [notice, f"this document is {notice}", f"{notice} see the file for details", f"copyright 2020 the authors {notice}", f"this file is {notice} please read it"]
    out += [" ".join(words[i : i + 10]) for i in range(0, max(1, len(words) - 9), 5)] if len(words) > 14 else []
    return list(dict.fromkeys(spelt for x in out for spelt in (x, x.replace("license", "licence"))))


def _held_out(text: str) -> bool:
    return zlib.crc32(text.encode()) % 5 == 0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sample(docs: DataFrame) -> list[str]:
    """Paragraphs of a bounded sample of documents, as token strings."""
    ids = [r[0] for r in docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    if not ids:
        return []
    paragraph = F.posexplode(F.slice(F.split(F.coalesce("text", F.lit("")), _GAP), 1, SAMPLE_PARAGRAPHS)).alias("_k", "_p")
    tokens = F.slice(F.regexp_extract_all(F.lower("_p"), F.lit(f"({_TOKEN})"), 1), 1, SAMPLE_TOKENS)
    rows = docs.where(F.col("doc_id").isin(ids)).select(F.xxhash64("doc_id").alias("_h"), paragraph).select("_h", "_k", F.array_join(tokens, " ").alias("_t"))
    rows = rows.orderBy("_h", "_k", "_t").limit(SAMPLE_DOCS * SAMPLE_PARAGRAPHS).collect()  # ids that come again could give more
    return sorted(r["_t"] for r in rows)


def train(corpus: list[str], rounds: int = 120, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Fit on the templates and against sentences of no family and ``corpus`` paragraphs."""
    families = (*sorted(TEMPLATES), UNKNOWN)
    notices = [(tokens_of(x), families.index(f)) for f, texts in TEMPLATES.items() for x in texts]
    others = [tokens_of(x) for x in [*other_sentences(), *corpus]]
    seldom: dict[str, int] = {}
    for t in others:
        for w in set(t):
            seldom[w] = seldom.get(w, 0) + 1
    plain = max(3, len(others) // 50)
    used = {w for t, _ in notices for w in t if len(w) > 1}
    words = {w for w in used if seldom.get(w, 0) <= plain} | {w for w in used if w.startswith(("licen", "copyright", "permission", "reserved"))}
    kept = lambda t: {g for g in _grams(t) if not words.isdisjoint(g.split(" "))}
    examples = [(kept(tokens_of(v)), y, _held_out(v)) for f, texts in TEMPLATES.items() for y in (families.index(f),) for x in texts for v in _pieces(x)]
    at = {g for grams, _, _ in examples for g in grams}
    grams = tuple(sorted(at))
    row = {g: k for k, g in enumerate(grams)}
    templates = tuple((y, tuple(sorted(row[g] for g in kept(t) if g in row))) for t, y in notices)
    for t in others:
        found = {row[g] for g in kept(t) if g in row}
        if not any(_confirms(found, set(rows)) for _, rows in templates):
            examples.append((kept(t), len(families) - 1, _held_out(" ".join(t))))
    examples += [(set(), len(families) - 1, False)] * 20
    x = np.zeros((len(examples), len(grams)), np.float32)
    for k, (found, _, _) in enumerate(examples):
        x[k, [row[g] for g in found if g in row]] = 1
    y, held = np.array([e[1] for e in examples]), np.array([e[2] for e in examples])
    unknown = len(families) - 1
    share = np.where(y == unknown, 1 / (y == unknown).sum(), 1 / (y != unknown).sum())  # notices and others weigh the same
    scaled = x / (1 + np.sqrt(x.sum(1, keepdims=True)))
    weights, bias = np.zeros((len(grams), len(families)), np.float32), np.zeros(len(families))
    seen, seen_b = np.full_like(weights, 1e-10), np.full(len(families), 1e-10)
    train_x, train_y, train_w = scaled[~held], np.eye(len(families))[y[~held]], (share[~held] / share[~held].sum())[:, None]
    for _ in range(rounds):
        pull = ((train_y - _softmax(train_x @ weights + bias)) * train_w).astype(np.float32)
        step = train_x.T @ pull - decay * weights / len(train_x)
        seen += step * step
        weights += rate * step / np.sqrt(seen)
        seen_b += pull.sum(0) ** 2
        bias += rate * pull.sum(0) / np.sqrt(seen_b)
    z, target = scaled[held] @ weights + bias, y[held]
    heat = min(np.geomspace(0.2, 5, 60), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), target] + 1e-12).mean())
    weights, bias = np.round((weights / heat).astype(np.float64), 3), bias / heat  # thousandths, which add up alike in any order
    p = _softmax(scaled[held] @ weights + bias)[:, :-1]
    top, right = p.max(1), p.argmax(1) == target
    threshold = 1.0
    for least in sorted(set(np.round(top, 6)), reverse=True):
        if least >= 0.2 and (~right)[top >= least].sum() <= MAX_ERROR * (top >= least).sum():
            threshold = float(least)
    counts, notice = top >= threshold, target != unknown
    error = float((~right)[counts].mean()) if counts.any() else 0.0
    return Model(tuple(sorted(words)), grams, weights, bias, families, threshold, error, float((counts & right)[notice].mean()), templates)


def _confirms(found: set[int], template: set[int]) -> bool:
    both = len(found & template)
    return both >= min(CONFIRM_GRAMS, len(template)) and both >= CONFIRM * min(len(found), len(template)) and both > 0


def _tables(grams: tuple[str, ...]) -> list[tuple[int, list[int]]]:
    """``shift, numbers``: slots of n-grams (from 1; 0: none) by ``crc32 / shift % size``; what shares a slot is in a later table."""
    left, out, shift = list(range(len(grams))), [], 1
    while left:
        size = SLOTS if not out else 4 * len(left) + 1
        while True:
            slots, rest = [0] * size, []
            for k in left:
                at = zlib.crc32(grams[k].encode()) // shift % size
                if slots[at]:
                    rest.append(k)
                else:
                    slots[at] = k + 1
            if not out or len(rest) * 4 <= len(left):
                break
            size += 2
            if size > 64 * len(left) + 64:
                raise ValueError("n-grams with one hash")
        out.append((shift, slots))
        left, shift = rest, 7
    return out


def _table(values, kind: str) -> Column:
    """A literal array; parsed once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def _alternatives(words: tuple[str, ...]) -> str:
    """Pattern of whole words, by first letter, so that most places need one comparison."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(re.escape(w[1:]))
    return r"(?<![a-z0-9.])(?:" + "|".join(f"{re.escape(k)}(?:{'|'.join(sorted(v, key=lambda x: (-len(x), x)))})" for k, v in sorted(by.items())) + r")(?![a-z0-9])"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_paragraphs, families, n_confirmed, licence, probability`` of each document; see :func:`scan`."""
    classes = len(model.families)
    tables, known = [(shift, len(slots), _table(slots, "int")) for shift, slots in _tables(model.grams)], _table(["", *model.grams], "string")
    thousandths = np.rint(model.weights * 1000).astype(int)
    gate = _alternatives(model.words)
    blocks = F.split(F.lower(F.coalesce("text", F.lit(""))), _GAP)
    lines = F.transform(blocks, lambda b: F.array_join(F.filter(F.split(b, "\n"), lambda x: x.rlike(gate)), " "))
    rows = docs.select("doc_id", F.filter(lines, lambda b: b != "").alias("_p"))
    rows = rows.withColumn("_t", F.transform("_p", lambda p: F.regexp_extract_all(p, F.lit(f"({_TOKEN})"), 1)))

    def grams(t: Column) -> Column:
        def of(k: int) -> Column:
            runs = F.transform(F.sequence(F.lit(0), F.size(t) - k), lambda i: F.array_join(F.slice(t, i + 1, k), " "))
            return F.when(F.size(t) >= k, runs).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.concat(of(1), of(2), of(3)))

    def number(g: Column) -> Column:
        hash_ = F.crc32(g)
        out = F.lit(0)
        for shift, size, slot in reversed(tables):
            k = slot[(F.floor(hash_ / shift) % size).cast("int")]
            out = F.when(known[k] == g, k).otherwise(out)
        return out

    rows = rows.withColumn("_g", F.transform("_t", lambda t: F.filter(F.transform(grams(t), number), lambda k: k > 0)))

    def logit(g: Column, c: int) -> Column:
        column = _table([0, *thousandths[:, c].tolist()], "int")
        total = F.aggregate(g, F.lit(0).cast("long"), lambda a, k: a + column[k])
        return F.lit(float(model.bias[c])) + total / 1000 / (1 + F.sqrt(F.size(g).cast("double")))

    rows = rows.withColumn("_z", F.transform("_g", lambda g: F.array(*[logit(g, c) for c in range(classes)])))
    rows = rows.withColumn("_e", F.transform("_z", lambda z: F.transform(z, lambda x: F.exp(x - F.array_max(z)))))
    rows = rows.withColumn("_f", F.transform("_e", lambda e: F.transform(F.slice(e, 1, classes - 1), lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))))
    best = F.transform("_f", lambda f: F.struct(F.array_max(f).alias("p"), (F.array_position(f, F.array_max(f)) - 1).cast("int").alias("k")))

    def confirmed(b: Column, g: Column) -> Column:
        out = F.lit(False)
        for c in range(classes - 1):
            tests = []
            for held in (rows_ for y, rows_ in model.templates if y == c and rows_):
                both = F.size(F.array_intersect(g, F.array(*[F.lit(r + 1) for r in held])))
                tests.append((both >= max(1, min(CONFIRM_GRAMS, len(held)))) & (both >= CONFIRM * F.least(F.size(g), F.lit(len(held)))))
            any_ = tests[0]
            for test in tests[1:]:
                any_ = any_ | test
            out = F.when(b["k"] == c, any_).otherwise(out)
        return out

    names = F.array(*[F.lit(f) for f in model.families[:-1]])
    rows = rows.withColumn("_c", F.zip_with(best, "_g", lambda b, g: F.struct(b["p"].alias("p"), names[b["k"]].alias("family"), g.alias("g"), b["k"].alias("k"))))
    rows = rows.withColumn("_c", F.filter("_c", lambda c: c["p"] >= F.lit(model.threshold)))
    rows = rows.withColumn("_c", F.transform("_c", lambda c: F.struct(c["p"].alias("p"), c["family"].alias("family"), confirmed(c, c["g"]).alias("ok"))))
    rows = rows.withColumn("_best", F.array_sort(F.transform(F.filter("_c", lambda c: c["ok"]), lambda c: F.struct((-c["p"]).alias("p"), c["family"].alias("family")))))
    first = F.try_element_at("_best", F.lit(1))
    return rows.select(
        "doc_id", F.size("_p").cast("long").alias("n_paragraphs"), F.array_join(F.sort_array(F.array_distinct(F.transform("_c", lambda c: c["family"]))), ",").alias("families"),
        F.size("_best").cast("long").alias("n_confirmed"), first["family"].alias("licence"), F.round(-first["p"], 6).alias("probability"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_paragraphs, families, n_confirmed, licence, probability`` of each document.

    ``n_paragraphs``: those with a licence word; ``families``: sorted families of its
    paragraphs, joined by commas; ``licence`` and ``probability``: the most probable
    confirmed one, else null.
    """
    return score(docs, train(sample(docs)))
