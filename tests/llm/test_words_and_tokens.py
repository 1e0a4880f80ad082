"""Periodic runs, language-model scores and tokenizer alignment against plain restatements."""

import os
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docprism.llm import align, arrays, bpe, kneser, periodic

CLASHING = {"n": 1, "start": "x", "pair": 2.0, "kind": 0, "shard": "s", "score": True, "rest": "r"}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASHING.items()})


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    vocab = "the The of a b c alpha béta gamma. x, y".split()
    out = [None, "", " \n\t ", "one", "a " * 23, "a " * 24, "a b " * 12 + "a", "a b c d e f g h " * 3, "a b c d e f g h " * 3 + "a"]
    for _ in range(60):
        w = [rng.choice(vocab[: rng.choice([1, 2, 3, 11])]) for _ in range(rng.randint(1, 160))]
        for _ in range(rng.randint(0, 2)):
            p = rng.randint(1, max(1, len(w) // 3))
            s = rng.randrange(len(w))
            for k in range(s, rng.randint(s, len(w))):
                w[k] = w[s + (k - s) % p] if s + (k - s) % p < len(w) else w[k]
        out.append((" " if rng.random() < 0.7 else "\n\t").join(w))
    out.append(" ".join(rng.choice(vocab) for _ in range(5000)))
    rows = list(enumerate(out))
    return [*rows, *((i + 500, t) for i, t in rows[:30]), (None, "null id " * 20), (None, None), rows[12], rows[12], (12, "another text of one id")]


RUNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


@pytest.mark.parametrize("limits", [{}, {"LIVE": 1, "PAIRS": 1}, {"LIVE": 300, "PAIRS": 50}])
def test_periodic_report(spark, texts, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(periodic, k, v)
    assert rows_of(periodic.report(table(spark, texts)), *RUNS) == sorted(brute.periodic(texts), key=repr)


def test_runs_of_small_alphabets():
    rng = random.Random(1)
    for _ in range(600):
        x = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 60))]
        first = np.array([0, len(x)])
        got = list(zip(*(v.tolist() for v in periodic.runs_in(np.array(x, np.int64), first, 6))))
        assert got == brute.periodic_runs(x, 6)


def test_covering_squares_reach_every_square():
    """Each square's leftmost place lies in the chain of a covering pair."""
    rng = random.Random(2)
    for _ in range(200):
        x = np.array([rng.randrange(2) for _ in range(rng.randint(2, 40))] + [9])
        tree = periodic.Tree(x)
        start, period = periodic.covering_squares(tree, periodic.lz_blocks(tree), len(x))
        place = {(s + k, p) for s, p in zip(start.tolist(), period.tolist()) for k in range(int(tree.ahead(np.array([s]), np.array([s + p]))[0]) - p + 1)}
        seen = set()
        for p in range(1, len(x) // 2 + 1):
            for i in range(len(x) - 2 * p + 1):
                square = tuple(x[i : i + 2 * p].tolist())
                if square[:p] == square[p:] and square not in seen:
                    seen.add(square)
                    assert (i, p) in place


def test_periodic_runs_and_collapse(spark):
    docs = table(spark, [(1, "x " + "a b c " * 9 + "y"), (2, "no runs\there"), (3, None)])
    assert rows_of(periodic.runs(docs), "doc_id", "start", "length", "period") == [(1, 1, 27, 3)]
    out = periodic.collapse(docs)
    assert out.columns == docs.columns
    assert rows_of(out, "doc_id", "text") == [(1, "x a b c y"), (2, "no runs\there"), (3, None)]


SCORES = "doc_id held_out n_tokens n_known base_score score train_tokens".split()


@pytest.mark.parametrize(("order", "limits"), [(3, {}), (3, {"SHARD": 64, "CHUNK": 100, "WORDS": 20}), (2, {"SHARD": 50, "CHUNK": 300}), (1, {"SHARD": 100}), (4, {"SHARD": 300})])
def test_language_model(spark, texts, monkeypatch, order, limits):
    for k, v in limits.items():
        monkeypatch.setattr(kneser, k, v)
    key = lambda r: (repr(r[:4]), round(r[4], 6))
    got = sorted(rows_of(kneser.report(table(spark, texts), order), *SCORES), key=key)
    want = sorted(brute.kneser_ney(texts, order)[0], key=key)
    assert [r[:4] + r[6:] for r in got] == [r[:4] + r[6:] for r in want]
    np.testing.assert_allclose([r[4:6] for r in got], [r[4:6] for r in want], atol=1e-8)


def test_probabilities_of_a_context_add_up(spark, texts):
    model = kneser.train(table(spark, texts))
    _, _, known = brute.kneser_ney(texts)
    assert model.words == len(known)
    words = np.append(np.arange(model.words), model.unknown).astype(model.kind)
    for context in ((model.start, model.start), (model.start, 0), (0, 1), (3, model.unknown), (2, 2)):
        seq = np.concatenate([[*context, w] for w in words]).astype(model.kind)
        p = kneser.probabilities(model, seq, np.arange(2, len(seq), 3))
        assert p.min() > 0 and abs(p.sum() - 1) < 1e-9


def test_language_model_prefers_what_it_has_read(spark):
    rng = random.Random(4)
    sentence = ["the cat sat on the mat", "a dog ran to the door", "birds fly over the sea"]
    docs = table(spark, [(i, ". ".join(rng.choice(sentence) for _ in range(6))) for i in range(400)] + [(i, " ".join(sorted(rng.choice(sentence).split()))) for i in range(1000, 1100)])
    model = kneser.train(docs.where("doc_id < 1000"))
    got = kneser.score(docs, model).where("held_out or doc_id >= 1000").groupBy(F.col("doc_id") < 1000).agg(F.avg("perplexity"), F.avg(F.col("score") - F.col("base_score"))).collect()
    of = {r[0]: r[1:] for r in got}
    assert of[True][0] * 3 < of[False][0] and of[True][1] > 0


def test_scores_meet_few_files_whatever_the_number_of_shards(spark, monkeypatch):
    """A batch of tokens meets every shard, so their number may not grow with the corpus."""
    monkeypatch.setattr(kneser, "SHARD", 8)
    monkeypatch.setattr(arrays, "FEW", 2)
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(60)))) for i in range(60)]
    model = kneser.train(table(spark, texts))
    assert model.bits > 6
    assert len([x for x in os.listdir(model.folder) if x.endswith(".index.npy") and not x.startswith("words")]) <= 5 * 4
    key = lambda r: r[0]
    got = sorted(rows_of(kneser.score(table(spark, texts), model), *SCORES), key=key)
    want = sorted(brute.kneser_ney(texts)[0], key=key)
    assert [r[:4] + r[6:] for r in got] == [r[:4] + r[6:] for r in want]
    np.testing.assert_allclose([r[4:6] for r in got], [r[4:6] for r in want], atol=1e-8)


def test_scores_ask_once_for_what_occurs_again(spark, monkeypatch):
    """Below the highest order a batch looks up each n-gram and each context once."""
    text = "a b c d " * 500
    model = kneser.train(table(spark, [(0, text)]))
    seq, places, *_ = kneser._sequences(model, *list(kneser._held(pa.array([text])))[0][2:])
    asked, look_up = {}, arrays.look_up
    monkeypatch.setattr(arrays, "look_up", lambda folder, name, bits, keys, *rest: asked.update({name: len(keys)}) or look_up(folder, name, bits, keys, *rest))
    p = kneser.probabilities(model, seq, places)
    assert len(p) == 2001 and len(np.unique(p[2:-1])) <= 4
    assert max(n for name, n in asked.items() if name != "grams3") < 10


def test_orders_and_tallies_of_rows():
    rng = np.random.default_rng(2)
    for n, top in ((0, 9), (1, 9), (1000, 3), (1000, 1 << 32), (70000, 1 << 18)):
        columns = [rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32) for _ in range(3)]
        whole = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(rng.integers(0, 40)) << np.uint64(1)
        assert (arrays.sorted_places(whole) == np.argsort(whole, kind="stable")).all()
        near = (np.uint64(1) << np.uint64(63)) + rng.integers(0, 500, n, dtype=np.uint64)  # they differ in bits that a place leaves out only
        assert (arrays.sorted_places(near) == np.argsort(near, kind="stable")).all()
        values, back = arrays.different(near)
        assert (values == np.unique(near)).all() and (values[back] == near).all()
        for k in (1, 2, 3):
            rows, count = np.unique(np.stack(columns[:k], axis=1), axis=0, return_counts=True) if n else (np.zeros((0, k)), [])
            for kind in (np.uint32, np.uint64):
                keys = [c.astype(kind) for c in columns[:k]]
                for got, counts in (kneser._tallied(keys), kneser._added(keys, np.ones(n, np.int64))):
                    assert (np.stack(got, axis=1) == rows).all() and (counts == count).all() and all(g.dtype == kind for g in got)
                different, back = kneser._different(keys)
                assert (np.stack(different, axis=1) == rows).all() and all((d[back] == c).all() for d, c in zip(different, keys))


def test_discounts():
    assert kneser.discounts(4, 0, 1, 1) == (0.0, 0.5, 1.0, 1.5)
    y = 10 / 18
    assert kneser.discounts(10, 4, 2, 1) == pytest.approx((0, 1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5))


def test_shards_and_packed_rows(tmp_path):
    rng = np.random.default_rng(1)
    for bits in (0, 3, 20):
        keys = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
        n = rng.integers(0, 600, len(keys))
        shard = (keys >> np.uint64(64 - bits)).astype(int) if bits else np.zeros(len(keys), int)
        for s in np.unique(shard)[:: max(1, bits // 2)]:
            arrays.write_shard(str(tmp_path), f"t{bits}", int(s), bits, keys[shard == s], {"n": n[shard == s]})
        there = np.isin(shard, np.unique(shard)[:: max(1, bits // 2)])
        asked = np.concatenate([keys[::-1], keys[:5], keys + np.uint64(1 << 20)])
        place, count = arrays.look_up(str(tmp_path), f"t{bits}", bits, asked, ("n",))
        assert (count == np.concatenate([(n * there)[::-1], (n * there)[:5], np.zeros(len(keys), int)])).all()
        assert ((place >= 0) == np.concatenate([there[::-1], there[:5], np.zeros(len(keys), bool)])).all()
    for a in ([], [5], [1, 1, 7, 1 << 40]):
        a, b = np.array(a, np.uint64), np.array([x % 97 for x in a], np.uint32)
        assert [x.tolist() for x in arrays.unpack(arrays.pack(a, b))] == [a.tolist(), b.tolist()]


@pytest.fixture(scope="module")
def tokenized():
    """Restated rows: whole texts by the libraries."""
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    alphabet = bpe._byte_alphabet()
    of_a = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab().items() if all(c in alphabet for c in t)}
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rng = random.Random(5)
    odd = [None, "", " ", "  ", "\n", "a", "  lead", "trail  ", "x▁y", "▁", "<|endoftext|> <s> </s> <unk> <0x0A>", "1234 5 6\t7\n\n 8", "日本語 テキスト é é ﬁ 🙂", "don't we'll  I'VE\r\nx", "\x00\x01 z", "a" * 3000, "the " * 500, "ж" * 50 + " １２", "　x y"]
    chars = "ab Z1 9\n\t .,'-é日🙂▁ <>/s|endoftxu"
    odd += ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    odd += [" ".join(rng.choice("alpha Beta, gamma 12 (delta) éta l'été the of".split()) for _ in range(300)) for _ in range(6)]
    rows = [*enumerate(odd), (None, "null id"), (3, "  "), (5, "a second text of one id"), (14, odd[14])]
    digest, held = brute.alignment(rows, lambda t: a.encode(t, add_special_tokens=False).ids, of_a.__getitem__, lambda t: b.encode(t), of_b)
    return rows, digest, held


ALIGNED = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.mark.parametrize("limits", [{}, {"FREQUENT": 200}, {"FREQUENT": 0, "HELD": 300, "BLOCK": 2000}])
def test_alignment(spark, tokenized, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(align, k, v)
    rows, digest, _ = tokenized
    assert rows_of(align.report(table(spark, rows)), *ALIGNED) == sorted(digest, key=repr)


def test_alignment_groups_and_counts(spark, tokenized):
    rows, _, held = tokenized
    docs = table(spark, rows)
    got = {}
    for r in align.groups(docs).where("doc_id > 20").orderBy("doc_id", "number").collect():
        of = got.setdefault(r.doc_id, [])
        assert r.number == len(of) and r.start == sum(g[0] for g in of)
        of.append((r.length, r.a, r.b))
    assert {i: [g[1:] for g in of] for i, of in got.items()} == {i: g for i, _, _, g, _ in held if i is not None and i > 20 and g}
    counted = {(r.a, r.b): r.documents for r in align.pair_counts(docs).collect()}
    assert counted == {k: sum(k in set(e) for *_, e in held) for k in {k for *_, e in held for k in e}}


def test_empty_tables(spark):
    none = table(spark, [])
    assert periodic.report(none).count() == kneser.report(none).count() == align.report(none).count() == 0
    assert periodic.collapse(none).count() == periodic.runs(none).count() == align.groups(none).count() == align.pair_counts(none).count() == 0
    held = table(spark, [(i, "only held out") for i in range(40)]).where(kneser.held_out(F.col("doc_id")))
    assert {tuple(r) for r in kneser.report(held).select("n_known", "base_score", "score", "train_tokens").collect()} == {(0, 0.0, 0.0, 0)}
