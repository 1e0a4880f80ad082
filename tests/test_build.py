"""The complete clean against a plain scan."""

import random
import re

from docprism.operators import prep


def test_build_corpus(spark):
    rng = random.Random(3)
    pool = [f"w{k}" for k in range(400)]
    base = [[rng.choice(pool) for _ in range(rng.randint(30, 90))] for _ in range(25)]
    texts = [" ".join(w) for w in base]
    for w in base[:12]:  # near copies, chains of them, exact copies with other spaces and case
        v = list(w)
        for _ in range(3):
            v = list(v)
            v[rng.randrange(len(v))] = rng.choice(pool)
            texts.append(" ".join(v))
        texts += ["  ".join(w).upper(), "<p>" + " ".join(w) + "</p><script>no text</script>", " ".join(rng.sample(w, len(w)))]
    texts += [None, "", "too short", "<b>" + "x " * 50 + "</b>", "y " * 301]
    rng.shuffle(texts)
    rows = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "k long, t string, cat string").repartition(3)
    built, steps = prep.build_corpus(rows, "k", "t", "cat", 40, 300, 0.8)
    got = built.orderBy("row_id").collect()

    left = [(k, t) for k, t in enumerate(texts) if t is not None]
    count = [len(texts), len(left)]
    plain = lambda t: " ".join(re.sub("<[^>]*>", " ", re.sub("(?s)<script.*?</script>", " ", t)).split())
    left = [(k, plain(t)) for k, t in left]
    left = [(k, t) for k, t in left if 40 <= len(t.split()) <= 300]
    count.append(len(left))
    seen: set = set()
    single = []
    for k, t in left:
        fp = re.sub(r"\s", "", t.lower())
        if fp not in seen:
            single.append((k, t))
        seen.add(fp)
    count.append(len(single))
    kept: list = []
    for k, t in single:
        w = set(t.lower().split())
        if not any(len(w & v) / len(w | v) > 0.8 for _, _, v in kept):
            kept.append((k, t, w))
    count.append(len(kept))
    assert [(r.row_id, r.k, r.clean_text, r.unique_word_count) for r in got] == [(f"DOC_{i:05d}", k, t, len(w)) for i, (k, t, w) in enumerate(kept)]
    assert [(r.step, r.dropped, r.left) for r in steps.orderBy("position").collect()] == [
        (name, (count[i - 1] if i else count[0]) - count[i], count[i]) for i, name in enumerate(("given", "null_text", "length", "exact_copies", "near_copies"))
    ]
    assert count[3] < count[2] and count[4] < count[3]
