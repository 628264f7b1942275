"""Plain single-machine versions of the operators, to hold their results against."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import regex
import tiktoken
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(doc_id):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text, k=4):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def near_duplicates(rows, k=4, t=4):
    """rows: (doc_id, text) -> list of (doc_id, fingerprint, component)"""
    prints = [fingerprint(text, k) for _, text in rows]
    values = np.array(sorted(set(prints)), dtype=np.uint64)
    group = {int(v): int(v) for v in values}

    def find(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i, v in enumerate(values):
        for w in values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ v) <= t]:
            group[find(int(v))] = find(int(w))
    least = {}
    for (doc_id, _), p in zip(rows, prints):
        root = find(p)
        known = [x for x in (least.get(root), doc_id) if x is not None]
        least[root] = min(known) if known else None
    return [(doc_id, f"{p:016x}", least[find(p)]) for (doc_id, _), p in zip(rows, prints)]


def similar_groups(rows, k=5, least=0.8):
    """rows: (doc_id, text) with a word each -> doc_id: least id of its group"""
    sets = []
    for doc_id, text in rows:
        words = WORD.findall(lower(text))
        sets.append((doc_id, {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}))
    group = {i: i for i, _ in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            shared = len(s & u)
            if shared >= least * (len(s) + len(u) - shared):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return {i: find(i) for i in group}


def bpe(rows, ranks, pattern):
    encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = []
    for doc_id, text in rows:
        ids = encoder.encode_ordinary(text or "")
        out.append((doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(encoder.decode_bytes(ids))))
    return out


def substrings(rows, window=13):
    """rows -> (doc_id, n_words, n_removed, kept_sha256)"""
    last = float("inf")
    words = [WORD.findall(text or "") for _, text in rows]
    first = {}
    for (doc_id, _), ws in zip(rows, words):
        key = last if doc_id is None else doc_id
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            first[w] = min(first.get(w, last), key)
    out = []
    for (doc_id, _), ws in zip(rows, words):
        key = last if doc_id is None else doc_id
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < key:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out.append((doc_id, len(ws), len(gone), sha(" ".join(kept).encode())))
    return out


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def lm(rows, held_out, weights=(8.0, 4.0)):
    """rows -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score without quantising)"""
    tokens = [WORD.findall(lower(text)) + [None] for _, text in rows]
    one, two, three, starts = Counter(), Counter(), Counter(), 0
    context = Counter()

    def grams(ts):
        padded = ["<start>", "<start>", *ts]
        return list(zip(padded, padded[1:], ts))

    for (doc_id, _), ts in zip(rows, tokens):
        if not held_out(doc_id):
            one.update(ts)
            starts += 1
            for u, v, w in grams(ts):
                two[v, w] += 1
                three[u, v, w] += 1
                context[u, v] += 1
    total, distinct = sum(one.values()), len(one)
    out = []
    for (doc_id, _), ts in zip(rows, tokens):
        base = score = 0.0
        for u, v, w in grams(ts):
            p = (one[w] + 0.5) / (total + 0.5 * (distinct + 1))
            base += math.log10(p)
            c = starts if v == "<start>" else one[v]
            p = two[v, w] / (c + weights[0]) + weights[0] / (c + weights[0]) * p
            score += math.log10(three[u, v, w] / (context[u, v] + weights[1]) + weights[1] / (context[u, v] + weights[1]) * p)
        out.append((doc_id, held_out(doc_id), len(ts), sum(one[w] > 0 for w in ts), total, base, score))
    return out


def nearest(rows, k=5, every=50):
    good = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good.setdefault(i, []).append(np.array(v, dtype=np.float64))
    out = []
    for q, vs in good.items():
        if q % every:
            continue
        own = vs[0]
        all_ = []
        for i, ws in good.items():
            for w in ws:
                if i != q and len(w) == len(own):
                    all_.append((-float(own @ w) / (np.sqrt(own @ own) * np.sqrt(w @ w)), i))
        for r, (s, i) in enumerate(sorted(all_)[:k], 1):
            out.append((q, r, i, -s))
    return out


def bucket(gram, buckets):
    """The hash bucket of an n-gram (a string), with 32-bit arithmetic written out."""
    h = 0x9E3779B1 * len(gram) % 2**32
    for c in gram:
        h = (h ^ ord(c)) * 0x85EBCA6B % 2**32
        h ^= h >> 15
    return h % buckets


def grams(text, orders=(1, 2, 3)):
    text = text.lower() + "\n"
    return [text[i : i + n] for n in orders for i in range(len(text) - n + 1)]


def bayes(train, asked, buckets, alpha=0.5):
    """train: (text, lang); asked: texts -> (lang, posterior) by multinomial naive Bayes."""
    counts, seen = {}, Counter()
    for text, lang in train:
        if text is not None and lang is not None:
            seen[lang] += 1
            counts.setdefault(lang, Counter()).update(bucket(g, buckets) for g in grams(text))
    out = []
    for text in asked:
        if not any(map(str.isalpha, text or "")):
            out.append(("und", 0.0))
            continue
        logs = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + alpha * buckets
            logs[lang] = math.log(seen[lang] / sum(seen.values())) + sum(math.log((counts[lang][bucket(g, buckets)] + alpha) / total) for g in grams(text))
        best = max(sorted(logs), key=logs.get)
        out.append((best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return out


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def machine_score(bias, linear, factors, features):
    """A factorisation machine pair by pair. features: place -> value"""
    y = bias + sum(linear[p] * x for p, x in features.items())
    items = list(features.items())
    for i, (p, x) in enumerate(items):
        for q, z in items[i + 1 :]:
            y += float(factors[p] @ factors[q]) * x * z
    return sigmoid(y)


def network_score(net, rows, widths, pad):
    """A convolutional classifier place by place. rows: the embedding of each word of the text."""
    rows = [*rows, *[np.zeros(rows[0].shape if rows else net.taps[0].shape[1])] * pad]
    top = []
    for width, tap in zip(widths, net.taps):
        for f in range(tap.shape[2]):
            top.append(max(sum(float(rows[i + j] @ tap[j, :, f]) for j in range(width) if i + j < len(rows)) for i in range(len(rows))))
    hidden = [max(t + s, 0.0) for t, s in zip(top, net.shift)]
    return sigmoid(sum(h * w for h, w in zip(hidden, net.output)) + net.bias)


def judged(texts, steps=20, prior=0.85, right_on_good=0.98, right_on_bad=0.4, least=0.001):
    """The verdict (posterior of being good at least a half) on each text: rules vote, expectation-maximisation weighs them."""

    def votes(text):
        text = text or ""
        n, chars, symbols, dup, repeats = statistics(text)
        if not n:
            return (0,) * 10
        words = WORD.findall(text)
        lines = len([x for x in text.split("\n") if WORD.search(x)])
        runs, capitals, exclamations = (len(re.findall(p, text)) for p in (r"[#*$%&|<>]+", "[A-Z]", "!"))

        def vote(v, good, bad):
            return 0 if v is None else 1 if good(v) else -1 if bad(v) else 0

        return (
            vote(n, lambda v: v >= 50, lambda v: v < 10),
            vote(chars / n, lambda v: 3 <= v <= 10, lambda v: v < 2 or v > 15),
            vote(symbols / n, lambda v: v <= 0.02, lambda v: v > 0.1),
            vote(symbols / chars, lambda v: v <= 0.005, lambda v: v > 0.04),
            vote(runs / n, lambda v: v <= 0.01, lambda v: v > 0.1),
            vote(dup / lines if lines >= 3 else None, lambda v: v == 0, lambda v: v > 0.3),
            vote(repeats / n, lambda v: v <= 0.05, lambda v: v > 0.2),
            vote(len(set(words)) / n if n >= 30 else None, lambda v: v >= 0.25, lambda v: v < 0.12),
            vote(capitals / chars, lambda v: v <= 0.15, lambda v: v > 0.4),
            vote(exclamations / n, lambda v: v <= 0.05, lambda v: v > 0.3),
        )

    all_ = [votes(t) for t in texts]
    a, b = [right_on_good] * 10, [right_on_bad] * 10

    def good(v):
        g, h = prior, 1 - prior
        for x, p, q in zip(v, a, b):
            if x:
                g, h = g * (p if x > 0 else 1 - p), h * (1 - q if x > 0 else q)
        return g / (g + h)

    inside = lambda x: min(max(x, least), 1 - least)
    for _ in range(steps):
        p = [good(v) for v in all_]
        if not p:
            break
        sums = [[sum(w for w, v in zip(ws, all_) if keep(v[r])) for ws, keep in ((p, lambda x: x > 0), (p, bool), ([1 - x for x in p], lambda x: x < 0), ([1 - x for x in p], bool))] for r in range(10)]
        prior = inside(sum(p) / len(p))
        a, b = [inside((s[0] + 2 * right_on_good) / (s[1] + 2)) for s in sums], [inside((s[2] + 2 * right_on_bad) / (s[3] + 2)) for s in sums]
    return [good(v) for v in all_]


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    s = np.asarray(score)[order]
    at = 0
    while at < len(s):
        stop = at
        while stop < len(s) and s[stop] == s[at]:
            stop += 1
        ranks[order[at:stop]] = (at + stop + 1) / 2
        at = stop
    label = np.asarray(label, bool)
    n, m = label.sum(), (~label).sum()
    return (ranks[label].sum() - n * (n + 1) / 2) / (n * m)


PATTERN_FIND = regex.compile
