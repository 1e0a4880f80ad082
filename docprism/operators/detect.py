"""Per-document detectors: keyword density, text traces, coherence, cues, sustained repetition."""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docprism.functions import folding
from docprism.functions import numeric as nm
from docprism.functions import text as tx
from docprism.operators.order import exact_quantiles
from docprism.operators.prep import ALIASES, BLOCK_START, SKILLS, replace_words

MIN_HITS, WEIGHT = 3, 0.05


def keyword_measures(rows: DataFrame, text: str = "text", words=SKILLS, aliases=ALIASES) -> DataFrame:
    """``n_words, hits, concentration, keyword_score`` of each row.

    The mean gap of sorted hit positions telescopes to (last - first) / (hits - 1),
    so only the first and the last hit are looked for, and only where there are
    enough hits for a concentration.  Aliases are replaced where their words stand.
    """
    low = F.lower(F.col(text))
    may = F.lit(False)
    for alias in aliases:
        may = may | functools.reduce(Column.__and__, [F.contains(low, F.lit(w.lower())) for w in alias.split()])
    t = F.when(may, tx.canonical_aliases(low, aliases)).otherwise(low)
    pattern = r"\b(" + "|".join(sorted(words)) + r")\b"
    toks = rows.withColumn("_w", tx.tokens(t))
    where = F.filter(F.transform("_w", lambda w, i: F.when(w.rlike(pattern), i)), lambda i: i.isNotNull())
    toks = toks.withColumn("hits", F.regexp_count(F.array_join("_w", " "), F.lit(pattern)).cast("long"))
    toks = toks.withColumn("_at", F.when(F.col("hits") > MIN_HITS, where)).withColumn("n_words", F.size("_w").cast("long"))
    gap = (F.array_max("_at") - F.array_min("_at")) / (F.col("hits") - 1)
    reach = F.col("n_words") / 20
    concentration = F.coalesce(F.when((F.col("hits") > MIN_HITS) & (gap < reach), 1 - gap / reach), F.lit(0.0))
    out = toks.withColumn("concentration", concentration)
    return out.withColumn("keyword_score", F.coalesce(F.try_divide("hits", "n_words"), F.lit(0.0)) + WEIGHT * F.col("concentration")).drop("_w", "_at")


def keyword_budgets(rows: DataFrame, key: str, budgets: tuple[int, ...], text: str = "text") -> DataFrame:
    """``rows`` for each ``budget`` with the ``keyword_score`` after :func:`prep.replace_words` of that share.

    Words are ranked once: a budget replaces those whose digest is below its
    order statistic, so from the digests of the hits alone it is known which
    survive, and no text is built.  Texts without a hit score 0 and are not
    ranked.  Only where an alias of several words may stand are texts built, as
    replacing a word of it changes the number of words.
    """
    t = tx.canonical_aliases(F.lower(F.col(text)), ALIASES)
    slow = F.coalesce(F.lower(F.col(text)).rlike(_MAY_ALIAS.pattern), F.lit(False))
    pattern = r"\b(" + "|".join(sorted(SKILLS)) + r")\b"
    digest = lambda i: F.md5(F.concat(F.col("_key"), F.lit(":"), i.cast("string")))
    plain = rows.where(~slow).withColumn("_key", F.col(key).cast("string")).withColumn("_w", tx.tokens(t))
    found = F.filter(F.transform("_w", lambda w, i: F.when(w.rlike(pattern), F.struct(i.alias("i"), F.regexp_count(w, F.lit(pattern)).cast("long").alias("c")))), lambda x: x.isNotNull())
    plain = plain.withColumns({"_n": F.size("_w"), "_hits": found}).drop("_w")
    ranks = F.when((F.size("_hits") > 0) & (F.col("_n") > 0), F.sort_array(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), digest)))
    plain = plain.withColumns({"_ranks": ranks, "_hits": F.transform("_hits", lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c"), digest(x["i"]).alias("h")))})
    limit = lambda b: F.element_at("_ranks", F.floor(F.col("_n") * b / 100).cast("int") + 1)  # noqa: E731  # the first that stays
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), (limit(b) if b < 100 else F.lit(None).cast("string")).alias("limit")) for b in budgets])).alias("_b")
    plain = plain.select(*rows.columns, "_n", "_hits", each).select(*rows.columns, "_n", "_b.budget", F.filter("_hits", lambda x: x["h"] >= F.col("_b.limit")).alias("_left"))
    hits = F.aggregate("_left", F.lit(0).cast("long"), lambda a, x: a + x["c"])
    plain = plain.withColumns({"_hit": hits, "_first": F.array_min(F.transform("_left", lambda x: x["i"])), "_last": F.array_max(F.transform("_left", lambda x: x["i"]))})
    gap, reach = (F.col("_last") - F.col("_first")) / (F.col("_hit") - 1), F.col("_n") / 20
    concentration = F.coalesce(F.when((F.col("_hit") > MIN_HITS) & (gap < reach), 1 - gap / reach), F.lit(0.0))
    plain = plain.select(*rows.columns, "budget", (F.coalesce(F.try_divide("_hit", "_n"), F.lit(0.0)) + WEIGHT * concentration).alias("keyword_score"))
    built = rows.where(slow).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    built = keyword_measures(built.withColumn("_moved", replace_words(F.col(text), F.col(key), F.col("budget"))), "_moved")
    return plain.unionByName(built.select(*rows.columns, "budget", "keyword_score"))


_SPACE = re.compile(tx.SPACE)
_SKILL = re.compile(r"\b(" + "|".join(sorted(SKILLS)) + r")\b", re.ASCII)
_ALIAS = [(re.compile(r"(?i)\b" + tx.SPACE.join(re.escape(w) for w in a.split()) + r"\b", re.ASCII), ALIASES[a]) for a in sorted(ALIASES, key=lambda a: (-len(a), a))]
#: First words of aliases of several words: near these an insertion may make or break an alias.
_MAY_ALIAS = re.compile(r"\b(" + "|".join(sorted({a.split()[0] for a in ALIASES if " " in a})) + r")(?:[ \t\n\r\f\x0B]|$)", re.ASCII)


def _digest(*key) -> int:
    return int(hashlib.md5(":".join(str(k) for k in key if k is not None).encode()).hexdigest()[:6], 16)


def _score(n: int, hits: int, first: int, last: int) -> float:
    gap, reach = (last - first) / (hits - 1) if hits > 1 else 0.0, n / 20
    concentration = 1 - gap / reach if hits > MIN_HITS and gap < reach else 0.0
    return (hits / n if n else 0.0) + WEIGHT * concentration


def _measured(text: str) -> tuple[int, int, int, int]:
    """Words, hits, place of the first and of the last hit: as :func:`keyword_measures` finds them."""
    t = text.lower()
    for pattern, name in _ALIAS:
        t = pattern.sub(name, t)
    words = [w for w in _SPACE.split(t) if w]
    joined = " ".join(words)
    found = [m.start() for m in _SKILL.finditer(joined)]
    if not found:
        return len(words), 0, -1, -1
    return len(words), len(found), joined.count(" ", 0, found[0]), joined.count(" ", 0, found[-1])


def _attack(key, text: str | None, threshold: float, generations: int, tries: int) -> tuple[float, str | None]:
    words = [w for w in _SPACE.split(text or "") if w]
    now, moved = _measured(text or ""), False
    slow = _MAY_ALIAS.search((text or "").lower()) is not None
    for g in range(generations):
        limit = threshold * (0.8 + 0.2 * _digest(key, g, "limit") / 16**6)
        best = None
        for k in range(tries):
            h = _digest(key, g, k)
            at, word = h % (len(words) + 1), SKILLS[h % len(SKILLS)]
            if slow:
                then = _measured(" ".join([*words[:at], word, *words[at:]]))
            else:
                n, hits, first, last = now
                then = (n + 1, hits + 1, min(at, first + (first >= at)) if hits else at, max(at, last + (last >= at)) if hits else at)
            score = _score(*then)
            if score < limit and (best is None or score > best[0]):
                best = score, at, word, then
        if best is None:
            break
        _, at, word, now = best
        words.insert(at, word)
        moved = True
    return _score(*now), " ".join(words) if moved else text


def adaptive_search(rows: DataFrame, threshold: float = 0.05, generations: int = 20, tries: int = 5) -> DataFrame:
    """``doc_id, text, keyword_score`` after a greedy search against the keyword detector.

    In each generation the insertion that scores highest below the limit stays; a
    document is stuck, and ends, when none is below.  The limit moves between 0.8
    and 1 times the threshold.  Chance is the digest of id, generation and try.
    The search of a document needs no other row, so one pass does it; a word put
    in shifts the places of the hits, and texts are not scored again.
    """

    def run(batches):
        for batch in batches:
            found = [_attack(k, t, threshold, generations, tries) for k, t in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for _, t in found], pa.string()), pa.array([x for x, _ in found], pa.float64())], names=["doc_id", "text", "keyword_score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", F.col("doc_id").cast("string").alias("_key")).mapInArrow(run, f"doc_id {kind}, text string, keyword_score double")


def p95_of_clean(rows: DataFrame, score: str, label: str = "is_adversarial") -> DataFrame:
    """One row: the linear 95th percentile of the clean scores and what guards it."""
    guards = rows.agg(F.count_if(~F.col(label).isin(0, 1) | F.col(label).isNull()).alias("bad_labels"), F.count_distinct(label).alias("n_classes"))
    held = exact_quantiles(rows.where(F.col(label) == 0), [], score, [0.95]).select(F.col("quantiles")[0].alias("threshold"))
    return guards.join(F.broadcast(held), how="left").select("threshold", "bad_labels", "n_classes")


def calibrate(rows: DataFrame, score: str, label: str = "is_adversarial") -> float:
    threshold, bad, classes = p95_of_clean(rows, score, label).first()
    if bad or classes != 2 or threshold is None or not threshold > 0:
        raise ValueError(f"can't calibrate: threshold {threshold}, {bad} bad labels, {classes} classes")
    return threshold


def anomaly(score: Column, threshold) -> Column:
    return F.least(F.lit(1.0), F.try_divide(score, 2 * F.lit(threshold)))


def trace_flags(traces: DataFrame, pages: DataFrame, layers: DataFrame) -> DataFrame:
    """Flags of each text trace.

    ``traces``: doc_id, page, trace_idx, x0, y0, x1, y1, size, render_type, opacity, color, layer;
    ``pages``: doc_id, page, px0, py0, px1, py1, images, fills (arrays of structs; fills with ``dark``);
    ``layers``: doc_id, layer, is_on.
    """
    off = layers.where(~F.col("is_on")).select("doc_id", "layer").distinct().withColumn("hidden_layer", F.lit(True))
    rows = traces.join(pages, ["doc_id", "page"], "left").join(off, ["doc_id", "layer"], "left")
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    over_image = F.coalesce(F.exists("images", lambda r: nm.covers(r, *box)), F.lit(False))
    over_dark = F.coalesce(F.exists("fills", lambda r: r["dark"] & nm.covers(r, *box)), F.lit(False))
    light = F.size("color").isin(1, 3) & F.forall("color", lambda c: c > 0.95)
    flags = {
        "invisible": ((F.col("render_type") == 3) | (F.col("opacity") == 0)) & ~over_image,
        "no_area": (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= 0.01,
        "off_page": (F.col("x1") <= F.col("px0")) | (F.col("x0") >= F.col("px1")) | (F.col("y1") <= F.col("py0")) | (F.col("y0") >= F.col("py1")),
        "hidden_layer": F.coalesce("hidden_layer", F.lit(False)),
        "tiny": F.col("size") <= 1.5,
        "white": light & ~over_image & ~over_dark,
    }
    return rows.select("doc_id", "page", "trace_idx", "x0", "y0", "x1", "y1", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])


FLAGS = ("invisible", "no_area", "off_page", "hidden_layer", "tiny", "white")


def trace_summary(flags: DataFrame) -> DataFrame:
    """Counters of each flag, flagged traces and the score ``min(1, flagged / 10)`` of each document."""
    any_flag = F.greatest(*[F.col(f) for f in FLAGS])
    return flags.groupBy("doc_id").agg(*[F.count_if(F.col(f)).alias(f"n_{f}") for f in FLAGS], F.count_if(any_flag).alias("n_flagged"), F.count("*").alias("n_traces")).withColumn("trace_score", F.least(F.lit(1.0), F.col("n_flagged") / 10))


MAX_PAGES, MAX_TRACES, MAX_LISTED = 20, 20_000, 200


def trace_errors(traces: DataFrame, encrypted: DataFrame | None = None) -> DataFrame:
    """``doc_id, error`` of documents whose traces cannot be judged: encrypted, too many pages or traces, or a box that is not finite.

    ``encrypted``: ids of documents that could not be opened.
    """
    finite = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    per = traces.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("n"), F.bool_and(finite).alias("finite"))
    error = F.when(F.col("pages") > MAX_PAGES, "too_many_pages").when(F.col("n") > MAX_TRACES, "too_many_traces").when(~F.col("finite"), "box_not_finite")
    found = per.select("doc_id", error.alias("error")).where("error is not null")
    if encrypted is None:
        return found
    closed = encrypted.select("doc_id", F.lit("encrypted").alias("error")).distinct()
    return found.join(closed, "doc_id", "left_anti").unionByName(closed)


def trace_findings(flags: DataFrame, layers: DataFrame) -> DataFrame:
    """Of each document its first ``MAX_LISTED`` flagged traces, the number left out, and the layers that are off."""
    flagged = flags.where(F.greatest(*[F.col(f) for f in FLAGS]))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "trace_idx"))
    listed = flagged.withColumn("_k", place).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_k") <= MAX_LISTED, F.struct("page", "trace_idx")))).alias("listed"), F.greatest(F.count("*") - MAX_LISTED, F.lit(0)).alias("omitted"),
    )
    hidden = layers.where(~F.col("is_on")).groupBy("doc_id").agg(F.count_distinct("layer").alias("hidden_layers"))
    return listed.join(hidden, "doc_id", "full").withColumn("hidden_layers", F.coalesce("hidden_layers", F.lit(0).cast("long")))


def cluster_traces(flags: DataFrame, corner: float = 1.0, gap: float = 3.0, overlap: float = -5.0) -> DataFrame:
    """Flagged traces of one page and flag set, merged in trace order while boxes are the same point or their facing edges are close.

    Sorted traces stream by; a task holds the clusters of the page and flag set at hand.
    """

    named = F.array_join(F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in FLAGS]), lambda x: x.isNotNull()), ",")
    rows = flags.withColumn("flags", named).where("flags <> ''").select("doc_id", "page", "trace_idx", "flags", "x0", "y0", "x1", "y1")
    group = ["doc_id", "page", "flags"]
    sorted_rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "flags", "x0", "y0", "x1", "y1", "trace_idx").repartition(*group).sortWithinPartitions(*group, "trace_idx", "x0", "y0", "x1", "y1")
    names = [*group, "x0", "y0", "x1", "y1", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, done = None, [], []

        def closed() -> pa.RecordBatch:
            columns = zip(*done) if done else [()] * 8
            kinds = (pa.int64(), pa.int32(), pa.string(), *(pa.float64(),) * 4, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            for *here, x0, y0, x1, y1 in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if here != key:
                    done += [(*key, *c) for c in open_]
                    key, open_ = here, []
                for c in open_:
                    near = max(abs(c[0] - x0), abs(c[1] - y0), abs(c[2] - x1), abs(c[3] - y1)) < corner
                    across = min(c[2], x1) - max(c[0], x0)
                    down = min(abs(y0 - c[3]), abs(c[1] - y1))
                    if near or (across > overlap and down <= gap):
                        c[:] = min(c[0], x0), min(c[1], y0), max(c[2], x1), max(c[3], y1), c[4] + 1
                        break
                else:
                    open_.append([x0, y0, x1, y1, 1])
            if done:
                yield closed()
                done = []
        done += [(*key, *c) for c in open_] if key else []
        yield closed()

    return sorted_rows.mapInArrow(run, "doc_id long, page int, flags string, x0 double, y0 double, x1 double, y1 double, n long")


def coherence(windows: DataFrame, doc: str = "doc_id", index: str = "w_idx", embedding: str = "embedding") -> DataFrame:
    """Mean and population variance of the cosines of consecutive window embeddings; (0, 1) under two windows."""
    before = F.lag(embedding).over(Window.partitionBy(doc).orderBy(index))
    pairs = windows.withColumn("_prev", before).withColumn("_cos", F.when(F.col("_prev").isNotNull(), nm.cosine(F.col(embedding), F.col("_prev"))))
    return pairs.groupBy(doc).agg(F.coalesce(F.var_pop("_cos"), F.lit(0.0)).alias("variance"), F.coalesce(F.avg("_cos"), F.lit(1.0)).alias("mean_similarity"), F.count("_cos").alias("n_pairs"))


def sentence_windows(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, w_idx, window``: each sentence with the next one."""
    rows = docs.select(doc, F.posexplode(tx.sentences(F.col(text))).alias("w_idx", "_s"))
    following = F.lead("_s").over(Window.partitionBy(doc).orderBy("w_idx"))
    return rows.withColumn("_n", following).where("_n is not null").select(doc, "w_idx", F.concat_ws(" ", "_s", "_n").alias("window"))


def explain_units(units: DataFrame, limit: int = 64) -> DataFrame:
    """What the variance of a document loses without each unit, for at most ``limit`` evenly spaced ones, ranked by heat.

    ``units``: doc_id, w_idx, embedding, cue (boolean).  Windows are the means of two
    consecutive units; the measure is the population variance of the cosines of
    consecutive windows, 0 under three units.  Leaving a unit out takes at most
    three cosines away and adds two, so sums over the document and five vectors
    around the unit give its contribution; nothing is computed again, and only the
    chosen units meet in a window by document.  Contributions over the largest
    positive one are the heat; a cue lifts it to 0.85 at least; 0.5 and more is
    suspicious.  Equal heats are ranked by place.
    """
    by = Window.partitionBy("doc_id").orderBy("w_idx")
    near = {f"_{k}": F.lag("embedding", -k).over(by) for k in (-2, -1, 1, 2)}
    rows = units.select("doc_id", "w_idx", "embedding", "cue", (F.row_number().over(by) - 1).alias("_i"), *[v.alias(k) for k, v in near.items()])
    u = F.col("embedding")
    pooled = {"_w2": nm.mean_pool(F.col("_-2"), F.col("_-1")), "_w1": nm.mean_pool(F.col("_-1"), u), "_w0": nm.mean_pool(u, F.col("_1")), "_x1": nm.mean_pool(F.col("_1"), F.col("_2")), "_new": nm.mean_pool(F.col("_-1"), F.col("_1"))}
    rows = rows.select("doc_id", "w_idx", "cue", "_i", *[v.alias(k) for k, v in pooled.items()])
    cosine = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), nm.cosine(F.col(a), F.col(b)))
    pairs = {"_a": ("_w2", "_w1"), "_b": ("_w1", "_w0"), "_c": ("_w0", "_x1"), "_d": ("_w2", "_new"), "_e": ("_new", "_x1")}
    rows = rows.select("doc_id", "w_idx", "cue", "_i", *[cosine(*p).alias(k) for k, p in pairs.items()])
    whole = rows.groupBy("doc_id").agg(F.count("*").alias("_n"), F.coalesce(F.sum("_b"), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(F.col("_b") * F.col("_b")), F.lit(0.0)).alias("_q"))
    chosen = rows.join(whole, "doc_id").where(F.array_contains(nm.even_indices(F.col("_n"), limit), F.col("_i").cast("long")))
    first, last = F.col("_i") == 0, F.col("_i") == F.col("_n") - 1
    sign = {"_a": -1, "_b": -1, "_c": -1, "_d": 1, "_e": 1}  # windows beside the first and last unit just go
    change = lambda f: sum((k * F.when((first | last) & F.lit(k > 0), 0.0).otherwise(F.coalesce(f(F.col(c)), F.lit(0.0))) for c, k in sign.items()), F.lit(0.0))
    variance = lambda s, q, m: F.when(m > 0, F.greatest(q / F.greatest(m, F.lit(1)) - (s / F.greatest(m, F.lit(1))) ** 2, F.lit(0.0))).otherwise(0.0)
    n = F.col("_n")
    gain = variance(F.col("_s"), F.col("_q"), n - 2) - variance(F.col("_s") + change(lambda x: x), F.col("_q") + change(lambda x: x * x), n - 3)
    out = chosen.select("doc_id", "w_idx", "cue", gain.alias("contribution"))
    top = F.max("contribution").over(Window.partitionBy("doc_id"))
    heat = F.when((top > 0) & (F.col("contribution") > 0), F.least(F.lit(1.0), F.col("contribution") / top)).otherwise(0.0)
    out = out.withColumn("heat", F.when(F.col("cue"), F.greatest(heat, F.lit(0.85))).otherwise(heat))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("heat", 9)), "w_idx")).cast("long")
    return out.select("doc_id", "w_idx", "contribution", "heat", (F.round("heat", 9) >= 0.5).alias("suspicious"), place.alias("rank"))


def explain_texts(docs: DataFrame, encoder, limit: int = 64) -> DataFrame:
    """:func:`explain_units` of the display units of texts, with the units; ``docs``: doc_id, text."""
    from docprism.operators import encode

    held = encode.encoded(docs.select("doc_id", tx.display_units(F.coalesce("text", F.lit(""))).alias("_u")), "_u", encoder, "_v")
    units = held.select("doc_id", F.posexplode(F.arrays_zip("_u", "_v")).alias("w_idx", "_x"))
    units = units.select("doc_id", F.col("w_idx").cast("long").alias("w_idx"), F.col("_x._u").alias("unit"), F.col("_x._v").alias("embedding"))
    cue = F.size(cues(F.col("unit"))) > 0
    found = explain_units(units.withColumn("cue", cue), limit)
    return found.join(units.select("doc_id", "w_idx", "unit"), ["doc_id", "w_idx"])


# Cues: commands that address an automated reader.  Patterns run on folded lower-case text.

_WHO = r"(?:candidate|applicant|application|profile|person|resume|me|them)"
_IN = r"[^.!?;\n]"
OVERRIDES = {
    "override": rf"\b(?:ignore|disregard|forget|overlook)\b{_IN}{{0,40}}\b(?:previous|earlier|prior|above)\b{_IN}{{0,20}}\b(?:instructions?|guidance|rules?|prompts?)\b",
    "override_stop": rf"\b(?:stop following|do not follow|no longer follow)\b{_IN}{{0,30}}\b(?:instructions?|guidance|rules?|prompts?)\b",
    "override_es": rf"\b(?:ignora|olvida|descarta)\b{_IN}{{0,40}}\binstrucciones\b",
}
OUTCOMES = {
    "place_first": rf"\b(?:rank|place|put)\b{_IN}{{0,30}}\b{_WHO}\b{_IN}{{0,20}}\b(?:first|on top|at the top)\b",
    "set_score": rf"\b(?:set|give|raise)\b{_IN}{{0,30}}\bscore\b{_IN}{{0,20}}\b(?:maximum|highest|100)\b",
    "top_of_list": rf"\b(?:move|put|keep)\b{_IN}{{0,40}}\btop of (?:the|your) (?:shortlist|list|ranking)\b",
    "first_choice": rf"\b(?:choose|select|pick)\b{_IN}{{0,30}}\b(?:first|only) choice\b",
    "must_hire": rf"\b{_WHO}\b{_IN}{{0,20}}\bmust be (?:hired|accepted|selected)\b",
    "credential_met": rf"\b(?:treat|count|regard)\b{_IN}{{0,30}}\b(?:missing|absent|lacking)\b{_IN}{{0,30}}\bas (?:met|satisfied|fulfilled)\b",
    "force_outcome": rf"\b(?:force|fix|lock)\b{_IN}{{0,30}}\b(?:disposition|outcome|verdict)\b",
    "reuse_outcome": rf"\b(?:reuse|repeat|copy)\b{_IN}{{0,20}}\b(?:same|exact|that) (?:outcome|verdict|decision)\b",
    "full_marks": rf"\bwrite\b{_IN}{{0,40}}\brecommendation\b{_IN}{{0,30}}\bfull marks\b",
    "perfect_match": rf"\b(?:treat|see|consider)\b{_IN}{{0,40}}\b(?:perfect|ideal) (?:match|fit)\b",
    "highest_score": rf"\b(?:allocate|assign|award)\b{_IN}{{0,30}}\b(?:highest|maximum|top) (?:score|rating|mark)\b",
    "mark_suitable": rf"\bmark\b{_IN}{{0,30}}\b(?:eligible|suitable|qualified)\b",
    "return_decision": rf"\breturn\b{_IN}{{0,20}}\bdecision\b{_IN}{{0,40}}\b(?:eligible|suitable|positive)\b",
    "do_not_reject": r"\bdo not reject\b",
    "hire_now": rf"\b(?:hire|accept)\b{_IN}{{0,20}}\b(?:immediately|now|at once)\b",
    "advance": rf"\badvance\b{_IN}{{0,20}}\b{_WHO}\b{_IN}{{0,20}}\bto the (?:final|next) (?:round|stage)\b",
    "score_es": rf"\b(?:asigna|otorga)\b{_IN}{{0,30}}\bpuntuación\b",
    "mark_es": rf"\b(?:marca|considera)\b{_IN}{{0,30}}\b(?:apto|elegible|cualificado)\b",
}
PATTERNS = OVERRIDES | OUTCOMES
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}


def _anchors(pattern: str) -> tuple[str, ...]:
    """Words of which a match of the pattern holds one: of its groups that must be there, the one whose shortest word is longest."""
    groups = [tuple(re.sub(r"[a-z]\?.*", "", w) for w in g.split("|")) for g in re.findall(r"\(\?:([^()]*)\)(?![?{])", pattern)]
    groups = groups or [(max(re.findall("[a-z]{3,}(?: [a-z]+)*", pattern.replace(_IN, " ").replace(r"\b", " ")), key=len),)]
    return max(groups, key=lambda g: min(map(len, g)))


def _one_of(words: set[str]) -> str:
    """Pattern of the words' beginnings, with a first letter tried once; a word that begins with another one needs no place of its own."""
    by: dict[str, list[str]] = {}
    for w in sorted(words):
        if not any(w != x and w.startswith(x) for x in words):
            by.setdefault(w[0], []).append(re.escape(w[1:]))
    return r"\b(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items()) + ")"


ANCHORS = {name: _anchors(p) for name, p in PATTERNS.items()}
#: Matches wherever some pattern does: anchors are whole words' beginnings, looked for in one pass.
ANY_ANCHOR = _one_of({w for words in ANCHORS.values() for w in words})
_ANY_ANCHOR = re.compile(ANY_ANCHOR)
_BYPASS = re.compile(r"\b(?:regardless|even if|no matter|despite|without checking|whether or not)\b")
_CONDITION = re.compile(rf"\b(?:if|when|provided|only if|once|as long as)\b{_IN}*\b(?:meets?|qualif\w+|requirements?|experience|verified)\b")
_INVENTED = re.compile(rf"\b(?:pretend|assume|claim|invent|make up|act as though)\b{_IN}{{0,60}}\b(?:degree|credentials?|certificates?|requirements?|experience|qualif\w+)\b")
_DIRECTIVE = re.compile(r"(?:^|[,:]\s*)(?:please|now|then|you must|you should|always|and|reviewer|assistant|model|system)?[,:]?\s*$")
_LABEL = re.compile(rf"\b(?:example|quoted?|research|legitimate|sample|fixture)\b{_IN}{{0,64}}$")
_APPLY = re.compile(r"\b(?:decode|apply|execute|follow|obey|carry out)\b")
_QUOTES = {'"': '"', "“": "”", "«": "»", "'": "'"}
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{16,}+={0,2}+(?![A-Za-z0-9+/=])")
_WRAPPED = re.compile(r"(?i)\b(?:decode|apply|execute|follow)\b(?:[\s,:]+(?:and|then|the|this|these|block|text|message|apply|decode|follow|it|below|following|now)\b){0,12}[\s,:]*\n(?P<run>[ \t]*[A-Za-z0-9+/]{8,}(?:[ \t]*\n[ \t]*[A-Za-z0-9+/]{4,}={0,2})+={0,2})(?![A-Za-z0-9+/=])")


def native_cues(text: Column) -> Column:
    """Names of the patterns that match the lower-case text as it stands (no views, no context rules); patterns run where an anchor stands."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in PATTERNS.items()]), lambda x: x.isNotNull())
    return F.when(low.rlike(ANY_ANCHOR), found).when(text.isNotNull(), F.array().cast("array<string>"))


def _carriers(text: str) -> list[tuple[int, int, str]]:
    """Encoded passages as (begin, end, decoded text): unbroken runs, and wrapped blocks behind a directive; of overlapping ones the earliest, then the longest."""
    import base64

    spans = [m.span() for m in _BASE64.finditer(text)] + [m.span("run") for m in _WRAPPED.finditer(text) if m.start("run") - m.start() <= 80]
    out, upto = [], 0
    for begin, end in sorted(spans, key=lambda x: (x[0], -x[1])):
        if begin < upto:
            continue
        upto = end
        try:
            raw = base64.b64decode("".join(text[begin:end].split()), validate=True).decode()
        except ValueError:
            continue
        if len(raw) >= 8 and all(c.isprintable() or c in "\r\n\t" for c in raw):
            out.append((begin, end, raw))
    return out


_STOP = re.compile(r"[.!?;\n]")


class View:
    """A folded text with the places of its clauses' ends, found once."""

    def __init__(self, text: str):
        self.text = text
        self.stops = [m.start() for m in _STOP.finditer(text)]

    def clause(self, start: int, end: int) -> tuple[int, int]:
        """Begin and end of the clause around a match."""
        left, right = bisect_left(self.stops, start), bisect_left(self.stops, end)
        begin = self.stops[left - 1] + 1 if left else 0
        stop = self.stops[right] if right < len(self.stops) else len(self.text)
        if self.text[stop + 1 : stop + 2] in ('"', "”", "»", "'"):  # a closing quote behind the sign belongs to the clause
            stop += 2
        return begin, stop

    def matches(self) -> Iterator[tuple[str, int, int]]:
        """``pattern, start, end`` of all matches whose clause does not take the cue back; nothing is tried without an anchor."""
        anchors = {m[0] for m in _ANY_ANCHOR.finditer(self.text)}
        for name, pattern in _COMPILED.items():
            if not anchors.isdisjoint(ANCHORS[name]) or any(a.startswith(w) or w.startswith(a) for a in anchors for w in ANCHORS[name]):
                for m in pattern.finditer(self.text):
                    if not self.benign(name, *m.span()):
                        yield name, *m.span()

    def benign(self, name: str, start: int, end: int) -> bool:
        """Whether the clause shows that the cue is a condition on qualification, a description, quoted, or labelled as an example; rules in order."""
        begin, stop = self.clause(start, end)
        text = self.text
        clause, before, after = text[begin:stop], text[begin:start], text[end:stop]
        if not _BYPASS.search(clause):
            if name in OUTCOMES and _CONDITION.search(after):
                at = min(stop + 1, len(text))
                if not _INVENTED.search(text[begin : min(self.clause(at, at)[1], begin + 320)]):
                    return True
            if name == "highest_score" and not _DIRECTIVE.search(before):
                return True
        return _quoted(before, after) or bool(_LABEL.search(before))


def _quoted(before: str, after: str) -> bool:
    """Whether a quotation opens before and closes behind; apostrophes within words are none."""
    before, after = re.sub(r"(?<=\w)'(?=\w)", "", before), re.sub(r"(?<=\w)'(?=\w)", "", after)
    for open_, close in _QUOTES.items():
        opened = before.count(open_) % 2 == 1 if open_ == close else before.rfind(open_) > before.rfind(close)
        if opened and close in after:
            return True
    return False


def cue_matches(text: str | None, view: tuple[str, Sequence[int] | None] | None = None) -> list[dict]:
    """Actionable cues: pattern, kind of view, span in the original (of the carrier for decoded views).

    ``view``: the folded text and the places of its characters, if they are there already.
    """
    if not text:
        return []
    out = []
    if view is None or view[1] is None:
        folded, spans = tx.fold_spans(text)
        around = lambda start, end: (spans[start][0], spans[end - 1][1])
    else:
        folded, places = view
        around = lambda start, end: (int(places[start]), int(places[end - 1]) + 1)
    for name, start, end in View(folded).matches():
        begin, stop = around(start, end)
        out.append({"pattern": name, "kind": "plain", "start": begin, "end": stop})
    carriers = [(begin, end, names) for begin, end, raw in _carriers(text) if (names := dict.fromkeys(name for name, _, _ in View(tx.fold_text(raw)).matches()))]
    low = View(text.lower() if carriers else "")
    for begin, end, names in carriers:
        first = low.clause(begin, end)
        beside = low.text[max(0, begin - 160) : begin] + " " + low.text[end : end + 160]
        if _LABEL.search(low.text[max(first[0], begin - 160) : begin]) and not _APPLY.search(beside) or _quoted(low.text[first[0] : begin], low.text[end : first[1]]):
            continue
        for name in names:
            out.append({"pattern": name, "kind": "base64", "start": begin, "end": end})
    return sorted(out, key=lambda x: (x["start"], x["end"], x["pattern"]))


CUE = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(T.ArrayType(CUE))
def _cues(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        texts = batch.tolist()
        other = [k for k, t in enumerate(texts) if t and not t.isascii()]
        views = {k: (t.casefold(), range(len(t))) for k, t in enumerate(texts) if t and t.isascii()}
        views |= dict(zip(other, zip(*folding.fold_batch([texts[k] for k in other]))))
        yield pd.Series([cue_matches(t, views.get(k)) for k, t in enumerate(texts)])


#: Letters beyond ASCII that folding leaves as they are, or that no pattern holds.
_PLAIN = r"\u00C0-\u012F\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E"


def may_have_cues(text: Column) -> Column:
    """False only where :func:`cue_matches` finds nothing: no anchor of a pattern in the plain text, no letter that folds into others, no encoded run."""
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    encoded = text.rlike(r"[A-Za-z0-9+/]{16}") | text.rlike(r"[A-Za-z0-9+/]{8}[ \t]*\n[ \t]*[A-Za-z0-9+/]{4}")
    other = (F.octet_length(text) != F.length(text)) & text.rlike(rf"[^\x00-\x7F](?<![{_PLAIN}])")  # the wide class is tried at letters beyond ASCII alone
    return other | plain.rlike(ANY_ANCHOR) | encoded


def cues(text: Column) -> Column:
    """Actionable cues of a text; only texts that may have any travel to Python."""
    return F.coalesce(_cues(F.when(may_have_cues(text), text)), F.array().cast(T.ArrayType(CUE)))


def cue_count(matches: Column) -> Column:
    """Distinct patterns with an actionable match."""
    return F.size(F.array_distinct(F.transform(matches, lambda m: m["pattern"]))).cast("long")


def source_spans(matches: Column) -> Column:
    """Distinct spans in the original text, in order."""
    spans = F.array_distinct(F.transform(F.filter(matches, lambda m: m["start"] >= 0), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    return F.array_sort(spans)


def sustained(text: Column, words=SKILLS, widths: int = 12, least: int = 32) -> Column:
    """Struct of ``width, position`` of a text's sustained periodic run of mostly skill words; both are null without one.

    A run of period w is an island of tokens that equal the one w places before.
    It counts when run + w >= max(least, 8 w) and half of a period are skill words.
    The least width wins, then the earliest place.  Each whole period of such a run
    holds as many skill words, so texts with fewer of them than the shortest run of
    any width has are never cut into tokens; the others are, one by one, in the tasks that hold them.
    """
    needed = min(max(least, 8 * w) // w * -(-w // 2) for w in range(1, widths + 1))
    skills = r"\b(?:" + "|".join(re.escape(w) for w in sorted(words)) + r")(?![a-z0-9_])"
    low = F.lower(text)

    @F.pandas_udf("width long, position long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([t and _sustained(t, words, widths, least) or (None, None) for t in batch], columns=["width", "position"], dtype="Int64")

    return run(F.when(F.regexp_count(low, F.lit(skills)) >= needed, low))


def repetition(docs: DataFrame, doc: str = "doc_id", text: str = "text", words=SKILLS, widths: int = 12, least: int = 32) -> DataFrame:
    """``doc, width, position`` of documents with a run of :func:`sustained`."""
    found = docs.select(doc, sustained(F.col(text), words, widths, least).alias("_r")).select(doc, "_r.width", "_r.position").where("width is not null")
    return found.groupBy(doc).agg(F.min(F.struct("width", "position")).alias("b")).select(doc, "b.width", "b.position")


_TOKEN = re.compile(r"[a-z0-9_+#.]*[a-z0-9_+#]")


def _sustained(text: str, words: Sequence[str], widths: int, least: int) -> tuple[int, int] | None:
    """Width and place of the run of :func:`repetition` in one lower-case text, if there is one."""
    toks = _TOKEN.findall(text)
    number = {t: k for k, t in enumerate(dict.fromkeys(toks))}
    at = np.array([number[t] for t in toks], np.int64)
    skills = np.append(0, np.cumsum(np.isin(at, [number[w] for w in words if w in number])))
    for w in range(1, min(widths, len(at) - 1) + 1):
        inside = skills[w + 1 :] - skills[1 : len(at) - w + 1]  # skill words of the period that ends at each place from w on
        edge = np.flatnonzero(np.diff(np.concatenate([[0], at[w:] == at[:-w], [0]])))
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - begin + w >= max(least, 8 * w) and 2 * inside[begin:end].max() >= w:
                return w, begin + w
    return None


def hidden_block(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit(BLOCK_START)).cast("double"), F.lit(0.0))


def simple_baseline(text: Column) -> Column:
    """Three fixed phrases, whatever their case: the baseline that others are compared with."""
    return F.coalesce(text.rlike(r"(?i)previous guidance|earlier instructions|fit score"), F.lit(False))
