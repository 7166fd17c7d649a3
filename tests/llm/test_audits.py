"""The two audits against plain versions, on odd tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import test_documents
from brute import WORD, low

from moundlens.llm import divergence, interaction

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(4)
    rows = test_documents.odd_documents()
    parts = ["Alpha", "beta", "GAMMA delta", "é", "Ünïcode", "x1y", "#tag", "A B C", "zz zz", "$", "ÀB"]
    for k in range(150):
        text = " ".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 40, 250])))
        rows.append((500 + k, rng.choice([None, 1, 5, *range(100, 160)]), text, rng.choice(["en", "fr", "", None]), rng.choice(["s1", "s2", "s3", ""]), 0, 7, "f", 1, 2, 3, 4, 5, 6))
    rows += [rows[-1]] * 4 + [(900, 3, "...", "no terms", s, 0, 7, "f", 1, 2, 3, 4, 5, 6) for s in ("s1", "s2", None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.createDataFrame(odd, test_documents.SCHEMA).repartition(5)


def plain_divergence(rows):
    """Every term of every group scored by itself."""
    groups, holding = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall(low(text))
        groups[lang, source].update(found)
        holding[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in holding[lang].items() if n >= 3]
        mine = {s: c for (la, s), c in groups.items() if la == lang}

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in mine.items()}
        q = shares(sum(mine.values(), Counter()))
        for s in mine:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in mine if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:200])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(ranked)]
    return out


def test_divergence(spark, docs, odd, monkeypatch):
    want = sorted(plain_divergence([(r[2], r[3] or "", r[4] or "") for r in odd]))
    for held, cut in ((divergence.HELD, divergence.SLICE), (3, 7)):
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "SLICE", cut)
        assert sorted(map(tuple, divergence.audit(docs).collect())) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "no terms" and r[4] == 0 for r in want)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_cuts_ties_in_utf8_order(spark):
    """Far more terms of one value than ranks."""
    names = [f"{chr(0x61 + k % 20)}{chr(0xE0 + k // 20)}{chr(0x1F600 + k % 7)}" for k in range(400)]
    rows = [(" ".join(names), "x", "a")] * 3 + [("other words here", "x", "b")] * 50 + [("b" * 3, "x", "a")] * 9
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sorted(map(tuple, divergence.audit(docs).collect()))
    assert got == sorted(plain_divergence(rows))
    assert max(r[5] for r in got if r[1] == "a" and r[2] == "term") == 200


def plain_interaction(rows, labels):
    """Every order replayed document by document."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    fails = []
    for i, text, part in rows:
        t = text or ""
        w = WORD.findall(t)
        copy = t in first if i is None else first[t] < i
        flags = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 any(c in "#$%&*|" for c in t), copy)
        good = any(a == i and i is not None and b == 1 for a, b, _ in labels)
        bad = any(a == i and i is not None and c == 1 for a, _, c in labels)
        fails.append((part or "", {f for f, x in zip("ABCDE", flags, strict=True) if x}, good, bad))
    out, sums = [], Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            alive = mine
            for k, f in enumerate(order):
                gone = [x for x in alive if f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                sums[part, f] += len(gone)
                failing = sum(f in x[1] for x in mine)
                out.append((part, "".join(order), k + 1, len(alive), len(gone), failing - len(gone), sum(x[1] == {f} for x in mine),
                            sum(x[2] for x in gone), sum(x[3] for x in gone)))
    return [(*r, sums[r[0], r[1][r[2] - 1]]) for r in out]


def test_interaction(spark, docs, odd):
    rng = random.Random(6)
    labels = [(rng.choice([None, *range(90)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, interaction.audit(docs, told).collect()))
    assert got == sorted(plain_interaction([(r[1], r[2], r[3]) for r in odd], labels))
    assert interaction.audit(docs.limit(0), told).count() == 0
    assert interaction.audit(docs, told.limit(0)).count() == len(got)


def test_gray_walk_is_the_count_of_every_subset():
    rng = np.random.default_rng(1)
    mask, amount = rng.integers(0, 32, 40), rng.integers(0, 9, (40, 2))
    states = interaction.gray_walk(mask, amount, 5)
    for subset in range(32):
        assert np.array_equal(states[subset], amount[mask & subset == 0].sum(axis=0))
