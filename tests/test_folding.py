"""Batch folding against character-wise and whole folding by the library."""

import random
import unicodedata

from pyspark.sql import functions as F

from docprism.functions import folding
from docprism.functions.text import LOOK_ALIKES


def plain(text):
    """Folded text and places, one character after the other; no places where the whole differs."""
    whole = "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if unicodedata.category(c) != "Cf")
    parts = [folding.folded_char(c) for c in text]
    places = [k for k, p in enumerate(parts) for _ in p] if "".join(parts) == whole else None
    out, k = list(whole), 0
    while k < len(out):
        end = k
        while end < len(out) and out[end].isalnum():
            end += 1
        if any(unicodedata.name(c, "").startswith("LATIN") for c in out[k:end]):
            out[k:end] = [LOOK_ALIKES.get(c, c) for c in out[k:end]]
        k = max(end, k + 1)
    return "".join(out), places


CASES = ["", "plain Text", "Ｉgn​ore", "pаss", "ар", "a​b", "éx", "éа", "ﬁne ﬀ", "Straße İ", "가각", "각", "ệ ậ", "ΒΕΤΑ βeta Ⅳ", "pαlοchka Ӏl", "a_ре_b", "x²½™", "🙂 é\n\tZ", "퟿豈", "ΑΒ τhe χy μm"]


def test_fold_batch():
    rng = random.Random(12)
    pool = [chr(c) for c in (*range(32, 127), *range(0xC0, 0x250), *range(0x300, 0x345), *range(0x370, 0x400), *range(0x400, 0x500), 0x200B, 0x200D, 0x1100, 0x1161, 0x11A8, 0xAC00, 0xFB01, 0x2168, 0xFF21, 0x4E00, 0x1F642, 0x0130) if unicodedata.category(chr(c)) != "Cn"]
    texts = CASES + ["".join(rng.choice(pool if rng.random() < 0.5 else "abcа е.") for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts.insert(3, None)
    folded, places = folding.fold_batch(texts)
    for t, f, p in zip(texts, folded, places):
        want = (None, None) if t is None else plain(t)
        assert (f, None if p is None else p.tolist()) == want, t
    assert sum(p is None for p in places) > 20
    assert folding.fold_batch([]) == ([], []) and folding.fold_batch([None, ""])[0] == [None, ""]


def test_folded_column(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([None, *CASES])], "k int, t string").repartition(1)
    got = {r.k: (r.f.text, r.f.places) if r.f is not None else None for r in rows.select("k", folding.folded(F.col("t")).alias("f")).collect()}
    assert got[0] in (None, (None, None))
    for k, t in enumerate(CASES, 1):
        assert got[k] == plain(t), t


def test_fold_in_bounded_slices(monkeypatch):
    """What a fold holds beside its result is bounded by a slice, not by the batch."""
    texts = ["Ärger \u0430bc", None, "", "x" * 50, "e\u0301tude"] * 40
    whole = folding.fold_batch(texts)
    seen = []
    fold = folding._fold_slice
    monkeypatch.setattr(folding, "SLICE", 64)
    monkeypatch.setattr(folding, "_fold_slice", lambda part: seen.append(sum(len(t or "") for t in part)) or fold(part))
    cut = folding.fold_batch(texts)
    assert len(seen) > 1 and max(seen) <= 64
    assert cut[0] == whole[0] and all((a is None) == (b is None) and (a is None or a.tolist() == b.tolist()) for a, b in zip(cut[1], whole[1]))


def test_tables_bound_the_batches(spark, tmp_path):
    """Tables of the plans bound what is handed to Python at a time."""
    from docprism.sources.tables import BATCHES, table

    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    other = spark.newSession()
    assert table(other, str(tmp_path), "t").count() == 3
    assert {k: other.conf.get(k) for k in BATCHES} == BATCHES


def test_controls_go_by_different_characters(monkeypatch):
    """A long text with marks asks for the category of each different character, not of each place."""
    text = "e\u0301x\u200b\u00ad y\u0300" * 5000
    folding.fold_batch([text[:7]])
    asked, category = [], unicodedata.category
    monkeypatch.setattr(unicodedata, "category", lambda c: asked.append(c) or category(c))
    folded, places = folding.fold_batch([text])
    assert folded == ["\u00e9x \u1ef3" * 5000] and places == [None]
    assert len(asked) < 100


def test_density_with_aliases_and_few_hits(spark):
    """Places of hits are looked for only where there are enough of them; aliases count wherever their words stand."""
    from docprism.operators import detect

    texts = ["PY  Spark and K8S", "py and spark", "sql " * 4 + "word " * 400, "sql sql sql " + "word " * 400, "structured query\tlanguage kafka docker sql " + "word " * 300, None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.hits, r.concentration) for r in detect.keyword_measures(rows).collect()}
    assert {k: v[:2] for k, v in got.items()} == {0: (3, 2), 1: (3, 1), 2: (404, 4), 3: (403, 3), 4: (304, 4), 5: (0, 0), 6: (0, 0)}
    assert [k for k, v in got.items() if v[2] > 0] == [2, 4] and abs(got[2][2] - (1 - 1 / 20.2)) < 1e-12
