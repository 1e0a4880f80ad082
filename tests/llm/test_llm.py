"""Operators against the plain restatements in ``brute``, on awkward fixtures and with small internal limits."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docprism.llm import bpe, chat, decontaminate, jaccard, licences, lines, packing, quality, suffixes, toxicity, urls
from docprism.llm import textvec as tv
from docprism.llm.components import connected
from docprism.llm.store import Bitmap

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "délta", "the", "of", "eta", "theta", "iota", "Kappa"]) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared lines and passages, nulls, empties, white space, one long text."""
    rng = random.Random(3)
    base = [words(rng, rng.randint(3, 120)) for _ in range(30)]
    long = words(rng, 400)
    shared = words(rng, 60)
    out = [*base, *base[:6], *base[:3], None, "", " \n\t", "one", "One  two", "one two"]
    for k in range(12):  # near copies of one text
        w = long.split()
        w[rng.randrange(len(w))] = f"edit{k}"
        out.append(" ".join(w))
    out += [f"{words(rng, 20)}\n{shared}\n{words(rng, 10)}" for _ in range(6)]
    out += [f"  {shared.upper()}\t\n\nshort\n", "x" * 900, "x" * 650, words(rng, 6000), "日本語 テキスト " * 40, "\n".join(["a line that repeats again"] * 3)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).withColumns({"h": F.lit(1), "n": F.lit("x"), "node": F.lit(2.0)})


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def test_words(texts):
    for table, pattern in ((tv.SPACED, brute.SPACED), (tv.ALNUM, brute.ALNUM)):
        data, off = tv.buffers(pa.array([t for _, t in texts]))
        w = tv.words(data, off, table)
        for r, (_, t) in enumerate(texts):
            found = [data[s:e].tobytes().decode() for s, e in zip(w.start[w.first[r] : w.first[r + 1]], w.end[w.first[r] : w.first[r + 1]])]
            want = pattern.findall(t or "") if table is tv.SPACED else [x for x in pattern.findall((t or "").translate(brute.LOWER))]
            assert [f.translate(brute.LOWER) for f in found] == [x.translate(brute.LOWER) for x in want]
    same = tv.words(*tv.buffers(pa.array(["Word word WORD"])))
    assert len(set(same.hash.tolist())) == 1


def test_words_cross_blocks(monkeypatch):
    monkeypatch.setattr(tv, "BLOCK", 7)
    data, off = tv.buffers(pa.array(["abc defghijklmnop q", "rs tu", "", "v"]))
    w = tv.words(data, off)
    assert [data[s:e].tobytes() for s, e in zip(w.start, w.end)] == [b"abc", b"defghijklmnop", b"q", b"rs", b"tu", b"v"] and list(w.first) == [0, 3, 5, 5, 6]


@pytest.mark.parametrize(
    "limits",
    [
        {},
        {"LIST_PAIRS": 2, "BLOCK_NODES": 3, "LEAST_FREQUENT": 3, "WINDOW_LEAST": 2},
        {"LOCAL_LIST": 1, "SIGN_WINDOW": 300, "STAR_NODES": 2, "BLOCK_SHINGLES": 200, "COUNT_WINDOW": 64},
        {"LOCAL_LIST": 2, "LIST_PAIRS": 1, "LIST_CHUNK": 2, "LEAST_FREQUENT": 2, "WINDOW_LEAST": 2, "HOLD_LIST": 3},
    ],
)
def test_jaccard(docs, texts, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard, k, v)
    got = rows(jaccard.classes(docs, 3, 90), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.components(texts), key=repr)


def test_jaccard_signatures_always_meet():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 16, 31, 33, 64, 127, 200):
        for _ in range(60):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = a.copy()
            for _ in range(rng.integers(0, 1 + n // 9)):
                k = rng.integers(0, len(b))
                b = np.delete(b, k) if rng.random() < 0.5 and len(b) > 1 else np.append(np.delete(b, k), rng.integers(0, 1 << 63, 1, dtype=np.uint64))
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                cls = lambda s: ((s >> np.uint64(3)) % np.uint64(3)).astype(np.uint8)
                assert len(np.intersect1d(jaccard.signatures(a, cls(a), 90), jaccard.signatures(b, cls(b), 90)))


def test_jaccard_keeps_one(docs, texts):
    kept = jaccard.keep_one(docs, 3, 90)
    assert kept.columns == docs.columns
    want = sorted(i for i, _, c in brute.components(texts) if i == c)
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_pipeline_drops_near_copies_of_five_words(spark):
    """The stage against brute force, with copies that 3 words / 0.9 leave in."""
    rng = random.Random(11)
    made = []
    for _ in range(6):
        w = words(rng, 100).split()
        edited = list(w)
        edited[30], edited[70] = "edit", "edit"
        made += [" ".join(w), " ".join(w + words(rng, 15).split()), " ".join(edited), " ".join(w + words(rng, 60).split())]
    made += [words(rng, 100) for _ in range(6)] + ["one two three four", "one two three five", "", None]
    made = list(enumerate(made))
    root = list(range(len(made)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [brute.shingles(t, 5) for _, t in made]
    for a in range(len(made)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in made], DOCS)
    want = [i for i, _ in made if find(i) == i]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want
    assert len(want) < len({c for *_, c in brute.components(made)})


def test_jaccard_signatures_meet_at_80_percent():
    rng = np.random.default_rng(2)
    cls = lambda s: ((s >> np.uint64(3)) % np.uint64(3)).astype(np.uint8)
    met = 0
    for n in (1, 2, 4, 5, 9, 15, 16, 31, 33, 64, 127, 200):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone, more = rng.integers(0, 1 + n // 5), rng.integers(0, 1 + n // 5)
            b = np.unique(np.append(rng.permutation(a)[gone:], rng.integers(0, 1 << 63, more, dtype=np.uint64)))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                met += 1
                assert len(np.intersect1d(jaccard.signatures(a, cls(a), 80), jaccard.signatures(b, cls(b), 80)))
    assert met > 300


def test_jaccard_prefixes_avoid_shingles_of_common_words():
    """Unlike texts share shingles of common words by chance, the more the larger the corpus; signatures are those of rare words."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    texts = []
    for _ in range(300):
        h = rng.choice(common, 150)
        h[::5] = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
        h[100:] = rng.choice(common, 50)
        texts.append(h)
    none = np.zeros(0, np.int64)
    counts = np.array([(np.concatenate(texts) == c).sum() for c in common])
    order = jaccard.Frequent(none.view(np.uint64), none, (common >> np.uint64(64 - jaccard.WORD_BITS)).astype(np.int64), counts)

    def signed(h):
        s, rank = order.ranked(h, 3)
        assert np.array_equal(s, jaccard.shingle_set(h, 3))
        return jaccard.signatures(s, order.of(s), 90, rank)

    _, times = np.unique(np.concatenate([signed(h) for h in texts]), return_counts=True)
    assert times.max() == 1
    for h in texts:  # near copies still meet
        near = np.append(h, rng.integers(0, 1 << 63, 6, dtype=np.uint64))
        assert len(np.intersect1d(signed(h), signed(near)))


def test_jaccard_moves_candidates_as_texts(spark, monkeypatch):
    """Sets of 64-bit hashes do not compress: none may be written or shuffled between the candidates and their links."""
    written = []
    monkeypatch.setattr(jaccard, "materialize", lambda df, name, f=jaccard.materialize: written.append((name, dict(df.dtypes))) or f(df, name))
    made = [(i, " ".join(f"w{(i // 4) * 1000 + k}" for k in range(100)) + f" x{i}" * (i % 4), "en", "s", 0) for i in range(40)]
    got = rows(jaccard.classes(spark.createDataFrame(made, DOCS), 3, 90), "doc_id", "component_id")
    assert got == sorted([(i, i // 4 * 4) for i in range(40)], key=repr)
    assert written and not any(kind == "binary" for name, kinds in written if name not in ("sets", "nodes") for kind in kinds.values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


def test_bitmap(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").alias("k"))
    all_ = spark.range(-5, 3000).select(F.col("id").alias("k"))
    has = Bitmap(keys, "k").has(F.col("k"))
    inside, outside = all_.where(has), all_.where(~has)
    assert spark.createDataFrame([(None,)], "k long").where(has).isEmpty()
    assert inside.count() + outside.count() == all_.count() and outside.join(keys, "k").isEmpty() and inside.count() < 1800


def test_encoder_matches_library():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    bits = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "é", "ß", "×", "a", "B", "12", "!", '"', " ", "中", "😀", "it's", "we'LL", "ɏ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    encoder = bpe.Encoder(packing.tokenizer_path())
    flat, ends = encoder.encode(*tv.buffers(pa.array(texts)))
    want = [x.ids for x in Tokenizer.from_file(packing.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    assert [flat[ends[k] : ends[k + 1]].tolist() for k in range(len(texts))] == want


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    found = packing.pack(docs, capacity=64).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == 64 for p in pieces[1:])
        for p in pieces:
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    assert len(by_sequence) <= 1.02 * sum(r.length for r in found) / 64 + 1


def test_plan_uses_two_for_one():
    fillings = packing.plan({6: 1, 3: 1, 2: 2}, 10)  # greedy: 6 + 3; the 3 makes way for 2 + 2
    assert fillings[0] == ([(6, 1), (2, 2)], 1)
    rng = random.Random(2)
    counts = {k: rng.randint(1, 500) for k in rng.sample(range(1, 129), 60)}
    places = packing.Places(packing.plan(counts, 128))
    length = np.repeat(list(counts), list(counts.values()))
    number = np.concatenate([np.arange(n) for n in counts.values()])
    s, o = places.place(length, number)
    order = np.lexsort((o, s))
    s, o, length = s[order], o[order], length[order]
    first = np.append(True, s[1:] != s[:-1])
    assert (o[first] == 0).all() and (o[1:] == np.where(first[1:], 0, o[:-1] + length[:-1])).all() and (o + length <= 128).all()


@pytest.mark.parametrize("block", [500_000, 20])
def test_decontamination(spark, docs, texts, block):
    rng = random.Random(9)
    long = next(t for _, t in texts if t and len(t) > 20_000).split()
    items = [(1, " ".join(long[100:140]).upper()), (10, "one two"), (2, texts[0][1]), (None, " ".join(long[300:313])), (5, ""), (6, None), (7, words(rng, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.report(docs, bench, block_windows=block), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.decontaminate(texts, items)
    assert got == sorted(want, key=repr)
    kept = decontaminate.remove(docs, bench, block_windows=block)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[5])
    cut = {r.doc_id: r.text for r in decontaminate.remove(docs, bench, "spans").collect()}
    assert len(cut) == len(texts) and all(brute.decontaminate([(i, cut[i])], [(1, items[0][1])])[0][2] == 0 for i, t in texts)


def test_line_dedup(docs, texts):
    want = brute.line_dedup(texts)
    assert rows(lines.report(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)
    out = lines.dedup(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, brute.sha(r.text or "")) for r in out.collect()) == sorted((w[0], w[3]) for w in want)


@pytest.mark.parametrize(
    "width,gram,limits",
    [
        (200, 40, {}),
        (48, 16, {}),
        (48, 16, {"MARK_WINDOW": 40, "HOT_LOCAL": 2, "SALTS": 3, "HOT_ANCHOR": 3, "PEEL": 4, "MERGE_BYTES": 200}),
        (48, 16, {"HOT_ANCHOR": 1, "RANGES": 3}),
        (47, 15, {"SEGMENT": 300, "HOT_ANCHOR": 2, "PEEL": 30, "RANGES": 2}),
    ],
)
def test_suffix_dedup(docs, texts, width, gram, limits, monkeypatch):
    for k, v in limits.items():
        monkeypatch.setattr(suffixes, k, v)
    want = brute.repeated_bytes(texts, width)
    assert rows(suffixes.report(docs, width, gram), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    """Texts of several segments: repeats that end, begin or lie at the cuts, and a text that begins at another's cut."""
    rng = random.Random(8)
    plain = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    for segment in (1000, 1500):
        monkeypatch.setattr(suffixes, "SEGMENT", segment)
        long = plain(5 * segment)
        made = [long, long[: segment + 3] + plain(3000), plain(700) + long[segment - 120 : segment + 260], long[segment:] + plain(50), long[2 * segment - 199 : 2 * segment + 1] + plain(400), plain(90) + long[3 * segment + 600 : 4 * segment + 650], long[-200:] + plain(30)]
        made = list(enumerate(made))
        got = rows(suffixes.report(spark.createDataFrame(made, "doc_id long, text string")), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == sorted(brute.repeated_bytes(made, 200), key=repr)


def test_suffix_dedup_of_a_common_passage(spark, monkeypatch):
    """One passage in a thousand texts, each with another text before and behind it; some share more than the passage."""
    rng = random.Random(12)
    plain = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, beside = plain(330), [plain(60) for _ in range(5)]
    made = [(i, plain(rng.randint(0, 90)) + (rng.choice(beside)[-rng.randint(0, 60) :] if i % 3 == 0 else "") + passage[rng.randint(0, 3) * 40 :] + (rng.choice(beside)[: rng.randint(1, 60)] if i % 5 == 0 else "") + plain(rng.randint(0, 250))) for i in range(1000)]
    monkeypatch.setattr(suffixes, "HOT_ANCHOR", 60)
    monkeypatch.setattr(suffixes, "MARK_WINDOW", 500)
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    got = rows(suffixes.report(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.repeated_bytes(made, 200), key=repr)


def test_transforms_are_in_suffix_order():
    rng = random.Random(6)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode() for _ in range(40)]
    raw, sizes = b"".join(strings), np.array([len(s) for s in strings])
    left = (np.repeat(np.cumsum(sizes), sizes) - np.arange(len(raw))).astype(np.int32)
    shard = np.repeat(np.arange(40) // 4, sizes)  # several strings a shard
    made = suffixes.Transforms(np.frombuffer(raw, np.uint8), left, shard)
    suffix = lambda p: raw[p : p + left[p]]
    assert [(shard[p], suffix(p)) for p in made.sa] == sorted((shard[p], suffix(p)) for p in range(len(raw)))
    step = suffixes.STEP
    for k, p in enumerate(made.sa):
        if p >= step and left[p - step] == left[p] + step:
            assert made.sa[made.lf[k]] == p - step and made.before[k] >= 0
        else:
            assert made.before[k] == -1
    characters = {}
    for k, p in enumerate(made.sa):
        if made.before[k] >= 0:
            assert characters.setdefault(made.before[k], raw[p - step : p]) == raw[p - step : p]
    assert len(set(characters.values())) == len(characters)


def test_repeated_suffixes():
    rng = random.Random(4)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 90))).encode() for _ in range(30)]
    text = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
    order, group = suffixes.repeated_suffixes(text, left, np.repeat(np.arange(30) % 3, sizes), 10)
    got = {}
    for p, g in zip(order.tolist(), group.tolist()):
        got.setdefault(g, set()).add(p)
    want = {}
    for p in range(len(text)):
        if left[p] >= 10:
            want.setdefault(text[p : p + 10].tobytes(), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_toxicity(spark):
    rng = random.Random(1)
    plain = ["stone", "river", "cloud", "paper", "window", "garden", "music", "bridge"]
    rude = ["grubbel", "snorf", "blatch"]
    made = []
    for i in range(600):
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(5)]
        bad = i % 3 == 0
        if bad:
            sentences[rng.randrange(5)] += " " + rng.choice(rude)
        made.append((i, ". ".join(sentences) + ".", int(bad)))
    labelled = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    labels = labelled.select("doc_id", F.lit(1).alias("quality"), "toxic")
    extra = spark.createDataFrame([(900, None), (901, ""), (902, "  \n"), (None, "stone river")], "doc_id long, text string")
    docs = labelled.select("doc_id", "text").unionByName(extra)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 604
    for i, _, y in made:
        assert got[i].predicted == y and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert got[900].score == got[901].score == got[902].score == 0 and got[None].held_out is False
    found = toxicity.offending(docs, model).collect()
    assert {r.doc_id for r in found} == {i for i, _, y in made if y} and all(any(w in r.span for w in rude) for r in found)
    assert sorted(r.doc_id for r in toxicity.reject(docs.where("doc_id < 600"), model).collect()) == [i for i, _, y in made if not y]
    one_class = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, one_class).agg(F.max("score")).first()[0] == 0


def test_quality(docs, texts):
    out = quality.judge(docs)
    assert rows(out, "doc_id", *quality.COUNTS) == sorted(((i, *brute.quality_counts(t)) for i, t in texts), key=repr)
    for r in out.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def _prose(rng, n, mark=0.0, length=4):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(length - 2, length + 2))) + ("#" if rng.random() < mark else "") for _ in range(n))


def test_quality_sketches_merge(spark):
    rng = random.Random(31)
    made = [(i, "en", "a" if i % 2 else "b", _prose(rng, rng.randint(60, 200), 0.02 * (i % 5))) for i in range(300)]
    stats = quality.counts(spark.createDataFrame(made, "doc_id long, lang string, source string, text string"))
    whole = rows(quality.sketches(stats), "lang", "source", "measure", "bucket", "n")
    parts = quality.sketches(stats.where("doc_id % 3 = 0")).unionByName(quality.sketches(stats.where("doc_id % 3 <> 0")))
    assert rows(parts.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n")), "lang", "source", "measure", "bucket", "n") == whole


def test_quality_buckets(spark):
    values = [0, 1, 127, 128, 129, 255, 256, 1000, 99_999, 123_456_789, 2**40 + 12_345]
    found = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", quality.bucket(F.col("v")))
    found = found.select("v", "b", quality.bucket_low(F.col("b")).alias("low"), quality.bucket_high(F.col("b")).alias("high")).collect()
    for r in found:
        assert r.low <= r.v <= r.high and r.high - r.low <= r.low / 64
    assert [r.b for r in found] == sorted(r.b for r in found)


def test_quality_thresholds_follow_the_source(spark):
    """Against brute force; sources with other tails, a null source, groups that fall back on their language or on all."""
    rng = random.Random(32)
    made = []
    for i in range(700):
        source = ("calm", "loud", None, "rare")[i % 4 if i % 40 else 3]
        lang = "de" if i % 6 == 0 else "en" if i % 6 < 5 else None
        mark = {"calm": 0.02, "loud": 0.5}.get(source, 0.05) * rng.random()
        text = _prose(rng, rng.randint(30, 160), mark, 7 if source == "loud" else 4)
        if i % 9 == 0:
            text = "\n".join([text[:200], text[:200], text[200:400], text[400:]])
        made.append((i, lang, source, text if i % 100 else None))
    same = " ".join("word" + str(k) + "#" * (k % 4 == 0) for k in range(100))
    made += [(900, "en", "calm", same), (901, "en", "loud", same), (902, "fr", "new", _prose(rng, 90))]
    docs = spark.createDataFrame(made, "doc_id long, lang string, source string, text string").withColumns({"measure": F.lit("x"), "n": F.lit(1), "_lang": F.lit("y")})
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert kept == brute.quality_verdicts(made)
    assert kept[900] is False and kept[901] is True  # one text, two sources
    assert 0.5 < sum(kept.values()) / len(kept) < 1


def test_licences(spark):
    """Unseen spellings; a hard-wrapped notice, notices within other text, ordinary sentences with licence words."""
    cases = {
        1: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), 2: ("text\nReleased under the MIT License.\nmore", "mit"), 3: ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        4: ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0. " + "word " * 3000, "apache-2.0"), 5: ("The driver must hold a valid license to operate this vehicle.", None), 6: (None, None), 7: ("", None), 8: ("no such words", None),
        9: ("The MIT License (MIT)\n\nCopyright (c) 2014 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction", "mit"),
        10: ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public", "lgpl"), 11: ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", "bsd"),
        12: ("the software license of the company was renewed", None), 13: ("European Union Public Licence 1.2", "eupl"), 14: ("This is free and unencumbered software released into the public domain.", "unlicense"), 15: ("All rights reserved.", "proprietary"),
        16: ("Mozilla Public License, v. 2.0\n\n  \n\nreleased under the ISC license", None), 17: ("Her brother asked for permission to sell copies of the map.", None),
    }
    plain = spark.createDataFrame([(100 + i, f"the river runs past stone {i} and the old bridge") for i in range(40)], "doc_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()] + [(1, cases[1][0])], "doc_id long, text string").unionByName(plain).withColumns({"families": F.lit(0), "p": F.lit("x"), "_g": F.lit(1)})
    model = licences.train(licences.sample(docs))
    assert model.error <= 0.02 and model.recall > 0.8 and 0.2 <= model.threshold < 1
    found = licences.score(docs, model).collect()
    assert len(found) == 58 and sum(r.doc_id == 1 for r in found) == 2
    for r in found:
        text, want = cases.get(r.doc_id, (f"the river runs past stone {r.doc_id - 100} and the old bridge", None))
        n, families, confirmed, licence, p = brute.licences(text, model)
        assert (r.n_paragraphs, r.families, r.n_confirmed, r.licence) == (n, families, confirmed, licence), text
        assert r.probability is None and p is None or r.probability == pytest.approx(p, abs=2e-6)
        if r.doc_id != 16:
            assert r.licence == want, text
        else:
            assert r.families == "isc,mpl-2.0" and r.n_confirmed == 2


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\b\\l\\h\\c", "a\nb: c", "", None, "</turn>\n### user: x", "#<\\", "日本語"]
    made = [(c, t, ["user", "assistant", "system", "a:b", None][(c + t) % 5], nasty[(c * 3 + t) % len(nasty)]) for c in range(6) for t in range(7)]
    turns = chat.canonical_turns(spark.createDataFrame(made, "conv_id long, turn long, role string, text string"))
    formatted = chat.format_turns(turns)
    for r in chat.read_back(formatted).collect():
        want = [(role or "", text or "") for c, t, role, text in made if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
    for r in chat.digest(formatted).collect():
        want = [(role or "", text or "") for c, t, role, text in made if c == r.conv_id]
        said = "".join(text for role, text in want if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(want), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_layouts(spark):
    want = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    for sql in (
        "select 1 conv_id, array(named_struct('role', 'user', 'content', 'q'), named_struct('role', 'assistant', 'content', 'a')) messages",
        "select 1 id, array(named_struct('from', 'human', 'value', 'q'), named_struct('from', 'gpt', 'value', 'a')) conversations",
        "select 1 id, 'q' prompt, 'a' completion",
        "select 1 id, 'q' instruction, 'a' output",
    ):
        assert rows(chat.canonical_turns(spark.sql(sql)), "conv_id", "turn", "role", "text") == want
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.sql("select 1 a, 2 b"))
    more = '{"id": 9, "messages": [{"role": "user", "content": "m", "time": 3}, {"role": "gpt", "content": "<b>\\\\"}], "conv_id": 4, "meta": {"a": 1}}'
    row = '{"conv_id": 5, "turn": 2, "role": "user", "text": null, "lang": "en"}'
    extended = spark.createDataFrame([(more, 1), (row, 2), (None, 3), ('{"conv_id": 6, "messages": []}', 4)], "record string, conv_id int")
    assert rows(chat.canonical_records(extended.where("conv_id < 4")), "conv_id", "turn", "role", "text") == [(4, 0, "user", "m"), (4, 1, "assistant", "<b>\\"), (5, 2, "user", None)]
    for bad in ('{"id": 1, "question": "q"}', "no json", '{"conv_id": 3, "messages": [{"role": "user"}]}', "{}"):
        with pytest.raises(Exception, match="no layout has the paths|no JSON object"):
            chat.canonical_records(spark.createDataFrame([(bad,), ('{"id": 1, "prompt": "q", "completion": "a"}',)], "record string")).collect()
    records = spark.createDataFrame([('{"id": 1, "prompt": "q", "completion": "a"}',), ('{"id": 2, "instruction": "i", "input": "n", "output": "o"}',), ('{"conv_id": 3, "messages": [{"role": "user", "content": "m"}]}',)], "record string")
    assert rows(chat.canonical_records(records), "conv_id", "turn", "role", "text") == [*want, (2, 0, "system", "i"), (2, 1, "user", "n"), (2, 2, "assistant", "o"), (3, 0, "user", "m")]


def test_urls(spark):
    pages = spark.createDataFrame([(1, "https://www.Sub.example.com:8080/ads/x", "2024-03-05"), (2, "http://example.com/ok", "2024-03-05"), (3, None, "2024-03-05"), (4, "not a url", "2024-03-05"), (5, "https://example.com/", None), (6, "http://example.com/ok", "2024-01-01")], "page_id long, url string, fetch_day string").withColumn("fetch_day", F.col("fetch_day").cast("date"))
    entries = spark.createDataFrame([("example.com", "block", "2024-02-01"), ("example.com", "remove", "2024-03-01"), ("sub.example.com/ads", "block", "2024-03-05"), ("example.com", "block", "2024-03-05"), ("example.com", "allow", "2024-03-05"), (None, "block", "2024-01-01")], "key string, action string, day string").withColumn("day", F.col("day").cast("date"))
    got = {r.page_id: (r.matched_key, r.action, r.kept) for r in urls.evaluate(pages, entries).collect()}
    assert got == {1: ("sub.example.com/ads", "block", False), 2: ("example.com", "block", False), 3: (None, None, True), 4: (None, None, True), 5: (None, None, True), 6: (None, None, True)}


def test_urls_of_repeated_captures(spark):
    """A verdict belongs to a URL and day, not to a page: repeated ids, null ids, repeated rows, clashing columns, a long URL."""
    long = "http://bad.com/" + "x" * 50_000
    made = [(1, "http://bad.com/a"), (1, "http://good.org/a"), (1, "http://bad.com/a"), (None, "http://bad.com/b"), (None, "http://good.org/b"), (2, long)]
    pages = spark.createDataFrame(made, "page_id long, url string").select("page_id", "url", F.lit("2024-05-01").cast("date").alias("fetch_day"), F.lit("k").alias("key"), F.lit("a").alias("action"), F.lit(1).alias("since"))
    entries = spark.createDataFrame([("bad.com", "block", "2024-02-01")], "key string, action string, day string").select("key", "action", F.col("day").cast("date").alias("day"), F.lit(1).alias("url"), F.lit(2).alias("until"))
    got = sorted(((r.page_id, r.host, r.kept) for r in urls.evaluate(pages, entries).collect()), key=repr)
    assert got == sorted([(1, "bad.com", False), (1, "good.org", True), (1, "bad.com", False), (None, "bad.com", False), (None, "good.org", True), (2, "bad.com", False)], key=repr)
    assert urls.evaluate(pages.limit(0), entries).isEmpty()
    assert urls.evaluate(pages, entries.limit(0)).where("kept").count() == 6


def test_chat_of_long_and_repeated_rows(spark):
    made = [(1, 0, "user", "#<\\ long " * 20_000), (1, 1, "assistant", "ok"), (1, 1, "assistant", "ok"), (None, 0, "assistant", "lost"), (2, None, "assistant", "first"), (2, 0, "user", "")]
    turns = chat.canonical_turns(spark.createDataFrame(made, "conv_id long, turn long, role string, text string").withColumns({"t": F.lit(1), "piece": F.lit("x"), "formatted": F.lit(2)}))
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.turns_sha256) for r in chat.digest(chat.format_turns(turns)).collect()}
    sha = lambda *turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert got == {1: (3, 4, sha(("user", made[0][3]), ("assistant", "ok"), ("assistant", "ok"))), None: (1, 4, sha(("assistant", "lost"))), 2: (2, 5, sha(("assistant", "first"), ("user", "")))}


def _word_hash(word):
    return int(tv.words(*tv.buffers(pa.array([word])), tv.ALNUM).hash[0])


def _prefix_hash(word, size):
    raw = word.encode()
    if len(raw) <= size:
        return size
    value = 0
    for b in raw[:size].decode("latin-1").translate(brute.LOWER).encode("latin-1"):
        value = (value * 257 + b) % 2**64
    return int(tv.mix(np.array([(value + (size << 56)) % 2**64], np.uint64))[0])


def _plain_score(model, text):
    return brute.toxicity(text, model.weights.astype(float), float(model.bias), toxicity.BITS, toxicity.PREFIXES, _word_hash, _prefix_hash)


def test_toxicity_against_plain_noisy_or(spark, texts):
    """Scores restated sentence by sentence; conflicting and repeated labels, repeated rows, a long text, clashing columns."""
    rng = random.Random(41)
    model = toxicity.NoisyOr(np.maximum(np.random.default_rng(4).normal(0, 0.4, 1 << toxicity.BITS), 0).astype(np.float32), -4.0)
    made = [*texts, (200, "Fine. " * 3000 + "Bad! word?\nÄrger über-all 12"), (200, "Fine."), (None, "one. two")]
    docs = spark.createDataFrame(made, "doc_id long, text string").withColumns({"score": F.lit("x"), "toxic": F.lit(3), "words": F.lit(1)})

    got = rows(toxicity.score(docs, model).withColumn("score", F.round("score", 6)), "doc_id", "score")
    want = [(i, round(_plain_score(model, t), 6)) for i, t in made]
    for (i, x), (j, y) in zip(got, sorted(want, key=repr)):
        assert i == j and x == pytest.approx(y, abs=2e-6)
    kept = toxicity.reject(docs, model, 0.5)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, x in want if x < 0.5), key=repr)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] * 2 + [(3, 1, 0), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    train = [(i, ("snorf " if i % 2 else "river ") + " ".join(rng.choice(["stone", "cloud"]) for _ in range(30))) for i in range(40)]
    train = spark.createDataFrame(train * 2, "doc_id long, text string")
    assert toxicity.train(train, labels, max_train=60).weights.max() > 0
    assert toxicity.train(train, labels, max_words=1).bias == -np.inf  # no document fits: nothing is learned


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard.classes(none).isEmpty() and suffixes.report(none).isEmpty() and lines.report(none).isEmpty() and packing.pack(none).isEmpty()
    assert quality.judge(none).isEmpty() and licences.scan(none).isEmpty() and decontaminate.report(none, bench).isEmpty()
    assert toxicity.score(none, toxicity.train(none, labels)).isEmpty()
    assert decontaminate.report(docs, bench.limit(0)).where("n_hit > 0").isEmpty()
    assert chat.digest(chat.format_turns(chat.canonical_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).isEmpty()


def test_null_and_repeated_ids(spark):
    text = "the same words stand here again and again in every row of this little table " * 4
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text), (3, text + "x")], "doc_id long, text string")
    assert rows(jaccard.classes(docs, 3, 90), "doc_id", "component_id") == [(1, 1), (1, 1), (2, 1), (3, 1), (None, None)]
    assert sorted(r.doc_id or 0 for r in jaccard.keep_one(docs).collect()) == [0, 1]
    assert {(r.doc_id, r.n_dropped) for r in lines.report(docs.withColumn("doc_id", F.col("doc_id"))).collect()} == {(None, 0), (1, 0), (2, 0), (3, 0)}
    assert {(r.doc_id, r.n_removed == 0) for r in suffixes.report(docs).collect()} == {(None, True), (1, False), (2, False), (3, False)}


def test_pipeline(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    held = spark.read.parquet(f"{folder}/documents.parquet")
    columns = held.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, folder)
        assert held.columns == columns, name
        held.write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
    left = [(r.doc_id, r.text) for r in held.select("doc_id", "text").collect()]
    assert len({c for *_, c in brute.components(left)}) == len(left)
    packed = corpus_pipeline.STAGES[-1][1](spark, held, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in left}


def test_pipeline_against_brute_force(spark, tmp_path, texts):
    """All stages, each against a plain restatement over its predecessor's rows: nulls, empties, repeated rows, clashing columns, then an empty table."""
    from tokenizers import Tokenizer

    rng = random.Random(77)
    rude = ["grubbel", "snorf"]
    made = [(i, t) for i, t in texts] + [(1, texts[1][1]), (None, "lost " + texts[2][1]), (None, None)]
    made += [(500 + i, words(rng, 30) + (". " + rng.choice(rude) + " " + words(rng, 5) if i % 3 == 0 else "")) for i in range(300)]
    item = words(rng, 40)
    made += [(900, words(rng, 60) + " " + item), (901, words(rng, 2000) + " " + item), (902, item.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in made], DOCS + ", node long, h string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(500 + i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now, order = made, lambda rows: sorted(rows, key=repr)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        got = order((r.doc_id, r.text) for r in held.collect())
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
            want = [(i, t) for i, t in now if _plain_score(model, t) < toxicity.THRESHOLD]
            assert not any(w in (t or "") for _, t in want for w in rude)
        elif name == "line_dedup":
            want = brute.lines_left(now)
        elif name == "ngram_jaccard":
            want = brute.near_copies_left(now)
        else:
            bad = [r[5] for r in brute.decontaminate(now, [(1, item)])]
            want = [x for x, b in zip(now, bad) if not b]
            assert sum(bad) == 2
        assert got == order(want), name
        assert len(got) < len(now) or name == "line_dedup"
        now = want
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    packed = corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path)).collect()
    assert sum(r.length for r in packed) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in now)
    filled = {}
    for r in packed:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_leaders_never_lose_a_pair():
    rng = np.random.default_rng(0)
    bound = lambda total: total - 2 * (-(-90 * total // 190))
    for turn in range(10):
        sets = []
        for _ in range(5):
            base = rng.integers(0, 1 << 63, rng.integers(40, 300), dtype=np.uint64)
            for _ in range(12):
                k = rng.integers(0, len(base) // 8)
                sets.append(np.unique(np.append(rng.permutation(base)[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64))))
        if turn % 2:
            sets.sort(key=len)  # bounds that rise from chunk to chunk
        n = np.array([len(s) for s in sets])
        shapes = jaccard.Shapes.of([jaccard.shape_of(s) for s in sets])
        root, held = list(range(60)), jaccard.Leaders(bound)

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        def link(a, b):
            for x, y in zip(a, b):
                root[find(x)] = find(y)

        for c in range(0, 60, 20):
            at = np.arange(60)[c : c + 20]
            if turn % 3 == 0:  # what another task has reduced: its leaders come with their radius
                other = jaccard.Leaders(bound)
                link(*other.absorb(at, n[at], shapes.take(at), np.zeros(20, int)))
                link(*held.absorb(other.nodes, n[other.nodes], shapes.take(other.nodes), other.info()))
            else:
                link(*held.absorb(at, n[at], shapes.take(at), np.zeros(20, int)))
        link(*held.close())
        for x in range(60):
            for y in range(x):
                both = len(np.intersect1d(sets[x], sets[y]))
                if 100 * both >= 90 * (n[x] + n[y] - both):
                    assert find(x) == find(y)


def test_shapes_fold_and_bound():
    """Histograms of sets of all sizes, alone, taken, joined: at any common width they bound the symmetric difference from below."""
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 60, 1024, 1025, 5000, 40_000, 90_000)]
    sets += [np.unique(np.append(s[len(s) // 9 :], rng.integers(0, 1 << 63, 3, dtype=np.uint64))) for s in sets]
    both = jaccard.Shapes.of([jaccard.shape_of(s) for s in sets[:5]]).joined(jaccard.Shapes.of(pa.array([jaccard.shape_of(s).tobytes() for s in [*sets[:2], *sets[5:]]], pa.binary())).take(np.arange(2, 11)))
    assert both.size.tolist() == [len(jaccard.shape_of(s)) for s in sets] and both.size.max() == 4096
    i, j = (x.ravel() for x in np.meshgrid(np.arange(14), np.arange(14)))
    apart = both.apart(i, j)
    for x, y, d in zip(i, j, apart):
        true = len(np.setxor1d(sets[x], sets[y]))
        assert d <= true and (x != y or d == 0)
        if true == len(sets[x]) + len(sets[y]) and 1000 < len(sets[x]) < 50_000 and len(sets[y]) * 5 > 4 * len(sets[x]) >= 4 * len(sets[y]) * 4 / 5:
            assert d > jaccard._bound(80)(len(sets[x]) + len(sets[y]))


def test_leaders_of_small_sets():
    """Sets of 9 to 18 shingles that differ by one: similar, though two of the largest may not differ at all."""
    bound = lambda total: total - 2 * (-(-90 * total // 190))
    rng = np.random.default_rng(5)
    for size in range(10, 19):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        n = np.array([size - 1, size])
        shapes = jaccard.Shapes.of([jaccard.shape_of(s) for s in (a[1:], a)])
        held = jaccard.Leaders(bound)
        edges = [held.absorb(np.arange(2), n, shapes, np.zeros(2, int)), held.close()]
        assert any({*x[x != y], *y[x != y]} == {0, 1} for x, y in edges), size


def test_jaccard_of_many_short_texts(spark, monkeypatch):
    rng = random.Random(7)
    made = []
    for k in range(12):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(12, 18))]
        made += [" ".join(w), " ".join(w[:-1]), " ".join(w[1:])]
    made = list(enumerate(made))
    monkeypatch.setattr(jaccard, "LIST_PAIRS", 1)
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(jaccard.classes(docs, 3, 90), "doc_id", "n_shingles", "component_id") == sorted(brute.components(made), key=repr)


def test_stages_with_ids_of_two_texts(spark):
    """An id that comes with unlike texts keeps each; with near copies of its own it keeps one; ties go to the least id, then the least set."""
    rng = random.Random(11)
    t, u, v = (words(rng, 40) for _ in range(3))
    near = t.rsplit(" ", 1)[0] + " other"
    docs = spark.createDataFrame([(1, t), (5, t), (5, u), (5, u), (6, u), (7, v), (7, f" {v}\n"), (8, near), (8, t), (9, None), (9, ""), (9, None), (None, t), (None, t)], "doc_id long, text string").withColumns({"_set": F.lit(1), "node": F.lit("x")})
    kept = rows(jaccard.keep_one(docs, 3, 80), "doc_id", "text")
    assert [r for r in kept if r[0] != 7] == sorted([(1, t), (5, u), (9, None), (9, ""), (None, t), (None, t)], key=repr)
    assert sum(r[0] == 7 for r in kept) == 1
    assert rows(jaccard.classes(docs, 3, 80), "doc_id", "component_id") == sorted([(1, 1), (5, 1), (5, 5), (5, 5), (6, 5), (7, 7), (7, 7), (8, 1), (8, 1), (9, 9), (9, 9), (9, 9), (None, None), (None, None)], key=repr)
    line = "a line that is long enough to count"
    twice = spark.createDataFrame([(1, line), (2, line), (3, f"x\n{line}"), (3, f"{line}\ny"), (3, "z")], "doc_id long, text string")
    assert rows(lines.dedup(twice), "doc_id", "text") == sorted([(1, ""), (2, ""), (3, f"x\n{line}"), (3, f"{line}\ny"), (3, "z")], key=repr)
    bench = spark.createDataFrame([("q1", u), ("q1", v)], "item_id string, text string")
    assert {(r.doc_id, r.n_hit > 0) for r in decontaminate.report(docs, bench).collect()} == {(1, False), (5, False), (5, True), (6, True), (7, True), (8, False), (9, False), (None, False)}
    pieces = packing.pack(docs).where("doc_id = 5").collect()
    assert len(pieces) == 3 and len({r.ids_crc32 for r in pieces}) == 2
