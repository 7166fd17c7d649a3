"""Plain versions of the operators, one document at a time, to hold the distributed ones against."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, n):
    w = WORD.findall(low(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, distance=2):
    """{key: smallest key reachable} for {key: fingerprint}."""
    keys = sorted(fps)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def hits(docs, items, window=10):
    """[(n_words, hit word places, items)] for each text."""
    known = {}
    for item, text in items:
        w = ITEM_WORD.findall(low(text))
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for text in docs:
        w, hit, named = ITEM_WORD.findall(low(text)), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if found := known.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    named |= found
        out.append((len(w), hit, named))
    return out


def repeated_lines(docs):
    """{row: line numbers} for [(id, text)]: lines that match an earlier line."""
    rows, index, gone = [], {}, {}
    for k, (owner, text) in enumerate(docs):
        for n, line in enumerate(text.split("\n") if text is not None else []):
            w = WORD.findall(low(line))
            rows.append((k, owner, n, frozenset(tuple(w[a : a + 5]) for a in range(len(w) - 4))))
    for j, row in enumerate(rows):
        for s in row[3]:
            index.setdefault(s, []).append(j)
    for k, owner, n, s in rows:
        for j in {j for x in s for j in index[x]}:
            k2, owner2, n2, s2 = rows[j]
            earlier = n2 < n if k2 == k else owner2 is not None and (owner is None or owner2 < owner)
            if earlier and 9 * len(s & s2) >= 4 * (len(s) + len(s2)):
                gone.setdefault(k, []).append(n)
                break
    return gone


def repeated_words(docs, window=13):
    """[(words, places removed)] for [(id, text)]."""
    first = {}
    cut = [(owner, WORD.findall(text or "")) for owner, text in docs]
    for owner, w in cut:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if owner is not None and (key not in first or owner < first[key]):
                first[key] = owner
    out = []
    for owner, w in cut:
        gone = set()
        for i in range(len(w) - window + 1):
            source = first.get(tuple(w[i : i + window]))
            if source is not None and (owner is None or source < owner):
                gone.update(range(i, i + window))
        out.append((w, gone))
    return out


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + d for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for d in range(5)}
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again), failed, len(lines)


def _vector(c):
    n, chars, symbols, dup, again, _, lines = c

    def share(a, b):
        return math.asin(math.sqrt(min(a / b, 1.0)))

    x = [min(max(math.log((chars + 250) / (n + 50)), 0), 4), share(symbols, symbols + n + 20),
         share(dup, lines + 5), share(again, n + 20)]
    return np.floor(np.array(x) * 4096)


def _distances(x, mean, cov):
    z = np.linalg.solve(np.linalg.cholesky(cov), (x / 4096 - mean).T)
    return (z * z).sum(axis=0)


def quality(rows, min_group=50):
    """[kept] for [(text, lang, source)]: minimum covariance determinant in every group."""
    floor = np.diag(np.array([0.08, 0.06, 0.15, 0.15]) ** 2)
    stats = [counts(text) for text, _, _ in rows]
    size = Counter((a, b) for (_, a, b), c in zip(rows, stats, strict=True) if not c[5])
    pool = Counter()
    for (a, _), n in size.items():
        pool[a] += n if n < min_group else 0
    group = [(a, b) if size[a, b] >= min_group else (a,) if pool[a] >= min_group else () for _, a, b in rows]
    kept = [False] * len(rows)
    for g in set(group):
        at = [k for k in range(len(rows)) if group[k] == g and not stats[k][5]]
        if not at:
            continue
        x = np.array([_vector(stats[k]) for k in at])

        def fit(some):
            y = some / 4096
            cov = (y.T @ y / len(y) - np.outer(y.mean(0), y.mean(0))) * 1.485
            np.fill_diagonal(cov, np.maximum(np.diag(cov), 0))
            return y.mean(0), cov + floor

        def mark(column, q):
            v = np.sort(np.floor(column / 8))
            return v[math.ceil(q * len(v)) - 1] * 8 / 4096

        spread = np.array([(mark(c, 0.75) - mark(c, 0.25)) / 1.349 for c in x.T])
        best = None
        for mean, cov in (fit(x), (np.array([mark(c, 0.5) for c in x.T]), np.diag(spread**2) + floor)):
            for _ in range(10):
                bins = np.minimum(np.floor(np.log2(_distances(x, mean, cov) * 64 + 1) * 16), 512)
                upto = np.array([(bins < b).sum() for b in bins])
                mean, cov = fit(x[upto < 0.75 * len(x)])
            volume = np.linalg.slogdet(cov)[1]
            if best is None or volume < best[0] - 1e-12:
                best = volume, mean, cov
        for k, d in zip(at, _distances(x, *best[1:]), strict=True):
            kept[k] = bool(d <= 28.47)
    return kept
