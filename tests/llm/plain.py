"""The stages of the pipeline in plain Python, worked out anew."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import xxhash


def toxic_scores(texts: dict, marks: dict) -> dict:
    """doc_id -> (score, the neighbours' ids and cosines by brute force); texts and labels by doc_id."""
    words = lambda t: Counter(re.findall(r"\w+", (t or "").lower()))
    examples: dict = {}
    for i, t in sorted(marks.items()):
        if i in texts and zlib.crc32(str(i).encode()) % 5:
            examples.setdefault(texts[i] or "", [i, 0])[1] |= int(t > 0)
    counts = {i: (t, words(text)) for text, (i, t) in examples.items()}
    n, bads = len(counts), sum(t for t, _ in counts.values())
    df = Counter(w for _, c in counts.values() for w in c)
    bad = Counter(w for t, c in counts.values() if t for w in c)

    def weight(w):
        cells = [(bad[w], df[w], bads), (df[w] - bad[w], df[w], n - bads), (bads - bad[w], n - df[w], bads), (n - bads - df[w] + bad[w], n - df[w], n - bads)]
        e = sum(2 * k * math.log(k * n / (r * c)) for k, r, c in cells if k)
        return math.log((n + 1) / df[w]) * (0.03 + 0.97 * e * e / (e * e + 625))

    weights = {w: weight(w) for w in df}

    def unit(c):
        v = {w: (1 + math.log(k)) * weights[w] for w, k in c.items() if w in weights}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    units = {i: unit(c) for i, (_, c) in counts.items() if c}
    share = (bads + 1) / (n + 2)

    def votes(own, without=None):
        cosine = {i: sum(x * v[w] for w, x in own.items() if w in v) for i, v in units.items() if i != without}
        best = sorted((i for i in cosine if cosine[i] > 0), key=lambda i: (-round(cosine[i], 12), i))[:15]
        near = [1 / (0.05 + max(0.0, 1 - cosine[i])) for i in best]
        return (sum(x * counts[i][0] for x, i in zip(near, best, strict=True)) + share) / (sum(near) + 1), best, cosine

    tried = [(votes(v, i)[0], counts[i][0]) for i, v in units.items()]
    x, y = np.array([math.log(v / (1 - v)) for v, _ in tried]), np.array([t for _, t in tried], float)
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's method with a pull of one to (1, 0)
        p = 1 / (1 + np.exp(-(a * x + b)))
        g, w = np.array([((p - y) * x).sum() + a - 1, (p - y).sum() + b]), p * (1 - p)
        a, b = np.array([a, b]) - np.linalg.solve(np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]]), g)
    blank = [t for t, c in counts.values() if not c]
    out = {}
    for i, text in texts.items():
        own = unit(words(text))
        if own:
            v, best, cosine = votes(own)
            out[i] = (1 / (1 + math.exp(-(a * math.log(v / (1 - v)) + b))), best, cosine)
        else:
            out[i] = ((sum(blank) + 0.5) / (len(blank) + 5), [], {})
    return out


def least_of_near_copies(texts: dict, shingle: int = 5, similarity: float = 0.8) -> set:
    """The least doc_id of each group of texts whose shingle sets are similar, by comparing all pairs."""

    def shingles(t):
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        return frozenset(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)) or frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if a == b or (both and both >= similarity * (len(a) + len(b) - both) - 1e-9):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in ids}


def mixed(texts: dict, domains: dict, labelled: set, buckets: int = 1024) -> dict:
    """doc_id -> (posteriors in order of domain names, rate, copies)."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    bucket = lambda w: xxhash.xxh64_intdigest(w.lower().encode(), 42) % buckets
    known = {(domains[i], texts[i]) for i in labelled if i in texts and domains[i] is not None and texts[i] is not None}
    names = sorted({d for d, _ in known})
    share = np.array([sum(d == n for d, _ in known) for n in names], float)
    table = np.ones((len(names), buckets))
    for d, t in known:
        for w in words(t):
            table[names.index(d), bucket(w)] += 1
    logs = np.log(table / table.sum(axis=1, keepdims=True))
    tokens, post = {}, {}
    for i, t in texts.items():
        w = words(t)
        raw = np.log(share / share.sum()) + sum((logs[:, bucket(x)] for x in w), np.zeros(len(names)))
        e = np.exp(raw - raw.max())
        tokens[i], post[i] = len(w), e / e.sum()
    ids = list(texts)
    n, p = np.array([tokens[i] for i in ids], float), np.array([post[i] for i in ids])
    held = n @ p
    goal = (held / held.sum()) ** 0.7
    goal *= min(held / (goal / goal.sum())) / goal.sum()
    rate = np.ones(len(ids))
    for _ in range(60):
        rate = np.maximum(0, rate - p @ (((n * rate) @ p - goal) / held))
    rate = np.where(n == 0, 1.0, rate)
    out = {}
    for i, r in zip(ids, rate, strict=True):
        h = xxhash.xxh64_intdigest(b"mix", 42)
        key = xxhash.xxh64_intdigest((texts[i] or "").encode(), 42)
        for x in (i & (2**64 - 1), key):
            h = xxhash.xxh64_intdigest(struct.pack("<Q", x), h)
        unit = (h % (1 << 52) + 0.5) / float(1 << 52)
        out[i] = (post[i], float(r), int(r) + int(unit < r - int(r)))
    return out
