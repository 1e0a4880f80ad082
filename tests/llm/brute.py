"""Plain restatements of the contracts, one document or one pair at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def line_dedup(docs, min_chars=20, min_docs=3):
    """docs: [(doc_id, text)]; rows of the digest."""
    held = defaultdict(set)
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    for i, text in docs:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    held[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def decontaminate(docs, items, width=13):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        k = min(width, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (t := tuple(w[a : a + k])) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[t]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def quality_counts(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = text.split("\n")
    seen, dup = set(), 0
    for x in lines:
        if SPACED.search(x):
            dup += x in seen
            seen.add(x)
    win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(win)
    covered = {j for i, t in enumerate(win) if count[t] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def quality_verdicts(docs, min_group=20):
    """docs: [(doc_id, lang, source, text)]; {doc_id: kept}: quantiles of values cut to seven significant bits, by source, language or all."""

    def low(x):
        return x if x < 128 else x >> (x.bit_length() - 7) << (x.bit_length() - 7)

    def high(x):
        return x if x < 128 else low(x) + (1 << (x.bit_length() - 7)) - 1

    def quantile(values, percent):
        values = sorted(values, key=low)
        return values[-(-len(values) * percent // 100) - 1]

    rows, groups = [], defaultdict(list)
    for i, lang, source, text in docs:
        n, chars, signs, dup, rep = quality_counts(text)
        failed = n < 50 or 100 * rep > 50 * n
        n_lines = sum(bool(SPACED.search(x)) for x in (text or "").split("\n"))
        values = {"length": chars * 100_000 // max(n, 1), "signs": signs * 100_000 // max(n, 1), "dup": dup * 100_000 // max(n_lines, 1), "rep": rep * 100_000 // max(n, 1)}
        rows.append((i, lang, source, failed, values))
        for m, x in values.items():
            if x and not failed:
                for key in ((lang, source), (lang,), ()):
                    groups[key, m].append(x)
    out = {}
    for i, lang, source, failed, values in rows:
        kept = not failed
        for m, x in values.items():
            held = next((groups[key, m] for key in ((lang, source), (lang,), ()) if len(groups[key, m]) >= min_group), None)
            if not x or held is None:
                continue
            a, b, top = low(quantile(held, 25)), high(quantile(held, 75)), high(quantile(held, 95))
            kept &= a - 6 * (b - a) <= x <= b + 6 * (b - a) if m == "length" else x <= max(top, b + 2 * (b - a))
        out[i] = kept
    return out


def toxicity(text, weights, bias, bits, prefixes, word_hash, prefix_hash):
    """Noisy-or of the sentences of one text; hashes are given."""
    sentences = defaultdict(list)
    for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
        sentences[sum(c in ".!?\n" for c in text[: m.start()])].append(m[0])
    quiet = 1.0
    for words in sentences.values():
        z = bias
        for w in words:
            z += weights[word_hash(w) >> (64 - bits)] + sum(weights[prefix_hash(w, k) >> (64 - bits)] for k in prefixes)
        quiet *= 1 - 1 / (1 + math.exp(-z))
    return 1 - quiet


def licences(text, model):
    """Digest row of one text: paragraphs, families, confirmed, licence, probability."""
    row = {g: k for k, g in enumerate(model.grams)}
    words, found, n = set(model.words), [], 0
    for block in re.split(r"\n[ \t\r\f\v]*\n", (text or "").lower()):
        lines = [x for x in block.split("\n") if words & {m[0] for m in re.finditer(r"(?<![a-z0-9.])[a-z0-9]+(?:[.][0-9]+)*(?![a-z0-9])", x)} or any(re.search(rf"(?<![a-z0-9.]){re.escape(w)}(?![a-z0-9])", x) for w in words)]
        if not lines:
            continue
        n += 1
        t = re.findall(r"[a-z0-9]+(?:[.][0-9]+)*", " ".join(lines))
        held = {row[g] for k in (1, 2, 3) for i in range(len(t) - k + 1) if (g := " ".join(t[i : i + k])) in row}
        z = [float(b) + sum(float(model.weights[r][c]) for r in held) / (1 + math.sqrt(len(held))) for c, b in enumerate(model.bias)]
        e = [math.exp(x - max(z)) for x in z]
        p = [x / sum(e) for x in e][:-1]
        k = max(range(len(p)), key=lambda c: (p[c], -c))
        if p[k] < model.threshold:
            continue
        sure = any(y == k and len(held & set(rows)) >= max(1, min(2, len(rows))) and len(held & set(rows)) >= 0.6 * min(len(held), len(rows)) for y, rows in model.templates if rows)
        found.append((p[k], model.families[k], sure))
    best = min(((-p, f) for p, f, sure in found if sure), default=(None, None))
    return n, ",".join(sorted({f for _, f, _ in found})), sum(sure for *_, sure in found), best[1], None if best[0] is None else round(-best[0], 6)


def lines_left(docs, min_chars=20, min_docs=3):
    """docs: [(doc_id, text)]; the texts after line dedup."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    held = defaultdict(set)
    for i, text in docs:
        if i is not None:
            for line in (text or "").split("\n"):
                held[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, text if len(kept) == len(lines) else "\n".join(kept)))
    return out


def near_copies_left(docs, k=5, percent=80):
    """docs: [(doc_id, text)]; one of each class of near copies, one of repeated rows, all rows without an id."""
    known = sorted({(i, t) for i, t in docs if i is not None}, key=repr)
    sets, root = [shingles(t, k) for _, t in known], list(range(len(known)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(known):
        least[find(a)] = min(least.get(find(a), i), i)
    return [known[a] for a in range(len(known)) if not sets[a] or least[find(a)] == known[a][0]] + [(i, t) for i, t in docs if i is None]


def shingles(text, k=3):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, num=90):
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(k)
    shared = Counter()
    for members in index.values():
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                shared[members[a], members[b]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= num * (len(sets[a][1]) + len(sets[b][1]) - n):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)]


def repeated_bytes(docs, width=200):
    """docs: [(doc_id, text)]; digest rows after removing bytes under a repeated width-byte string."""
    raw = [(t or "").encode() for _, t in docs]
    count = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for (i, _), r in zip(docs, raw):
        edge = [0] * (len(r) + 1)
        for a in range(len(r) - width + 1):
            if count[r[a : a + width]] > 1:
                edge[a] += 1
                edge[a + width] -= 1
        depth, cut = 0, []
        for a in range(len(r)):
            depth += edge[a]
            cut.append(depth > 0)
        spans = sum(c and (a == 0 or not cut[a - 1]) for a, c in enumerate(cut))
        out.append((i, len(r), sum(cut), spans, sha(bytes(b for b, c in zip(r, cut) if not c))))
    return out


def kneser_ney(docs, order=3, parts=7, part=2):
    """docs: [(doc_id, text)]; rows ``doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens`` by dictionaries, and the probability function."""
    def tokens(text):
        return [*SPACED.findall((text or "").translate(LOWER)), None]  # None: the end

    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % parts == part
    counts = {order: Counter()}
    known = Counter()
    for i, text in docs:
        if not out_of(i):
            t = ["<s>"] * (order - 1) + tokens(text)
            known.update(t[order - 1 :])
            counts[order].update(tuple(t[k - order + 1 : k + 1]) for k in range(order - 1, len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    follow = {k: defaultdict(Counter) for k in counts}
    lost = {}
    for k, c in counts.items():
        for g, n in c.items():
            follow[k][g[:-1]].update({"t": n, min(n, 3): 1})
        n = [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            lost[k] = [0, *(min(max(j - (j + 1) * y * n[j] / n[j - 1], 0), j) for j in (1, 2, 3))]
        else:
            lost[k] = [0, 0.5, 1, 1.5]

    def p(context, word):
        value = 1 / (len(known) + 1)
        for k in range(1, order + 1):
            ctx = context[len(context) - k + 1 :] if k > 1 else ()
            f = follow[k].get(ctx)
            if f:
                n = counts[k][(*ctx, word)]
                value = (max(n - lost[k][min(n, 3)], 0) + sum(lost[k][j] * f[j] for j in (1, 2, 3)) * value) / f["t"]
        return value

    total = sum(known.values())
    out = []
    for i, text in docs:
        t = tokens(text)
        s = ["<s>"] * (order - 1) + t
        score = sum(math.log10(p(tuple(s[k - order + 1 : k]), s[k])) for k in range(order - 1, len(s)))
        base = sum(math.log10((known[w] + 1) / (total + len(known) + 1)) for w in t)
        out.append((i, out_of(i), len(t), sum(w in known for w in t), base, score, total))
    return out, p, known


def periodic_runs(words, least=24):
    """Runs ``(start, length, period)`` of one list of words: every period, every stretch of equal words so far apart."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(r for r in found if not any(s[2] < r[2] and s[0] <= r[0] and s[0] + s[1] >= r[0] + r[1] for s in found))


def periodic(docs, least=24):
    out = []
    for i, text in docs:
        w = SPACED.findall(text or "")
        n = len(w)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = periodic_runs(w, least)
        best = (None,) * 4
        for s, length, q in runs:
            if best[0] is None or length * best[2] > best[1] * q:
                best = (s, length, q, 1000 * length // q)
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        kept = [x for k, x in enumerate(w) if k not in dropped]
        out.append((i, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept))))
    return out


def alignment(docs, encode_a, bytes_a, encode_b, bytes_b):
    """Digest rows, and the groups of each row: token by token, with given encoders and bytes of ids."""
    held, count = [], Counter()
    for i, text in docs:
        a = b = links = groups = ()
        if text:
            a, b = encode_a(" " + text), encode_b(text)
            of_a, of_b = [bytes_a(x) for x in a], [bytes_b(x) for x in b]
            if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
                a = b = ()
        if a:
            links, groups, left_a, left_b = [], [], [], []
            end_a = end_b = x = y = 0
            while x < len(a) or y < len(b):
                if end_a <= end_b:
                    left_a.append(a[x])
                    end_a += len(of_a[x])
                    x += 1
                    fresh = left_a
                else:
                    left_b.append(b[y])
                    end_b += len(of_b[y])
                    y += 1
                    fresh = left_b
                if fresh is left_a and end_b > end_a - len(of_a[x - 1]) or fresh is left_b and end_a > end_b - len(of_b[y - 1]):
                    links.append((left_a[-1], left_b[-1]))
                if end_a == end_b:
                    groups.append((left_a, left_b))
                    left_a, left_b = [], []
        held.append((i, a, b, groups, links))
        count.update(set(links))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    text = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return [(i, len(a), len(b), len(g), len(e), sum(count[k] == top[k[0]] for k in e), sum(count[k] for k in e), sha(text(g)) if a else "") for i, a, b, g, e in held], held
