"""Packing against the tokenizers library and a packer that takes one piece at a time."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import test_documents
import tokenizers

from moundlens.llm import packing
from moundlens.llm.packing import Limits
from moundlens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
CASES = [
    Limits(64),
    Limits(64, documents=5),
    Limits(64, attention=900),
    Limits(50, documents=7, attention=1200, weights=(1.0, 0.5, 2.0)),
    Limits(64, documents=1),
]


def one_by_one(lengths, limits, rule):
    """Contents of the bins, each a list of lengths in the order they came."""
    cap = limits.capacity
    weight = np.array(limits.weights) / cap.astype(float) ** 2
    left, held = [], []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        best = None
        for b, r in enumerate(left):
            if (r >= need).all():
                rest = (r - need).astype(float)
                score = ((rest * rest if rule == "norm" else need * r.astype(float)) * weight).sum()
                if best is None or (score, b) < best:
                    best = score, b
        if best is None:
            left.append(cap.copy())
            held.append([])
            best = 0.0, len(left) - 1
        left[best[1]] = left[best[1]] - need
        held[best[1]].append(n)
    return held


def spelled_out(slots, bins):
    held = [[] for _ in range(bins)]
    for length, _, count, first, per, offset in slots.tolist():
        for k in range(count):
            held[first + k // per].append((offset + k % per * length, length))
    return [sorted(x) for x in held]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", CASES)
def test_plan_is_that_of_single_pieces(limits, rule):
    for seed in range(12):
        rng = random.Random(seed)
        most = limits.longest
        lengths = [min(most, 1 + int(rng.expovariate(1 / rng.choice([3, 12, 30])))) for _ in range(rng.choice([0, 1, 40, 400]))]
        lengths += [most] * rng.choice([0, 3]) + [7] * rng.choice([0, 100])
        histogram = Counter(lengths)
        slots, bins = packing.plan(dict(histogram), limits, rule)
        held = spelled_out(slots, bins)
        assert Counter(n for b in held for _, n in b) == histogram
        for b in held:
            assert [at for at, _ in b] == np.r_[0, np.cumsum([n for _, n in b])[:-1]].tolist() if b else True
            assert sum(n for _, n in b) <= limits.tokens
            assert len(b) <= (limits.documents or len(b)) and sum(n * n for _, n in b) <= (limits.attention or 1 << 60)
        assert [[n for _, n in b] for b in held] == one_by_one(lengths, limits, rule)
        for length, n in histogram.items():  # every piece of a length has one place
            mine = slots[slots[:, 0] == length]
            assert np.array_equal(mine[:, 1], np.r_[0, np.cumsum(mine[:, 2])[:-1]]) and mine[:, 2].sum() == n


def test_plan_is_bounded_by_the_lengths():
    rng = random.Random(5)
    h = {n: 1 + int(rng.paretovariate(0.3)) for n in range(1, 513)}
    slots, _ = packing.plan(h, Limits(512))
    assert len(slots) < 16 * 512
    many, _ = packing.plan({n: 1000 * c for n, c in h.items()}, Limits(512))
    assert len(many) < 16 * 512


def test_capacity_of_attention_cuts_pieces():
    assert Limits(4096, attention=1 << 20).longest == 1024
    with pytest.raises(ValueError):
        packing.plan({40: 1}, Limits(64, attention=900))
    with pytest.raises(ValueError):
        packing.plan({1: 1}, Limits(64), "worst")


def test_words_are_encoded_like_whole_texts(monkeypatch):
    library = tokenizers.Tokenizer.from_file(packing.default_path())
    rng = random.Random(2)
    parts = ["a", "B", "'s", " ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", "　", " ", "é", "é", "́"]
    parts += ["İ", "Σ", "ß", "😀", "中文", "1", "23", "<|endoftext|>", "!", "'", "\x00", "ing", "THE", "‍", "한", "가", "x" * 70]
    monkeypatch.setattr(packing, "CACHED", 50)
    monkeypatch.setattr(packing, "STRETCH", 12)
    known = packing.WordEncoder(packing.default_path())
    known.check()
    letters = "abcdeghilnorstuäöüßéèñ" * 2 + "ABÉ.,-'0"
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [" ".join("".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(8)) for _ in range(3000)]
    for text, got in zip(texts, known.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(want)}I", *want), repr(text)


def test_words_in_use_are_not_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 40)
    known, learnt = packing.WordEncoder(packing.default_path()), []
    learn = known._learn
    monkeypatch.setattr(known, "_learn", lambda words: (learnt.extend(words), learn(words)))
    for k in range(20):  # ten new words each time, and ten that come every time
        words = [*(f"always{chr(97 + i)}" for i in range(10)), *(f"once{chr(97 + k)}{chr(97 + i)}" for i in range(10))]
        list(known.encode([" ".join(words)]))
    assert len(learnt) == len(set(learnt)) == 210
    assert len(known.cache) <= 40 and len(known.older) <= 40


def test_tokens_that_do_not_come_from_their_bytes_are_refused():
    known = packing.WordEncoder(packing.default_path())
    known.joint = [*known.joint, "qzx</w>"]
    with pytest.raises(ValueError):
        known.check()


def _check(rows, texts, tokens):
    library = tokenizers.Tokenizer.from_file(packing.default_path())
    mine, by = defaultdict(list), defaultdict(list)
    for key, piece, start, length, crc, sequence, offset in rows:
        mine[key].append((piece, start, length, crc))
        by[sequence].append((offset, length))
    total = 0
    for key, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        cut = [ids[k : k + tokens] for k in range(0, len(ids), tokens)]
        want = [(k, k * tokens, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for k, x in enumerate(cut)]
        assert sorted(mine[key]) == want
    assert set(mine) == set(texts)
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= tokens
    assert len(by) <= 1.01 * total / tokens + 1


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = QUERIES["op11_packing"](spark, SMALL)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert found.columns == columns
    _check([tuple(r) for r in found.collect()], texts, 4096)


def test_odd_and_empty_tables(spark):
    odd = test_documents.odd_documents()
    docs = spark.createDataFrame(odd, test_documents.SCHEMA).repartition(5)
    packed = packing.pack(docs, packing.default_path(), Limits(256))
    names = [c for c in docs.columns if c != "text"]
    assert packed.columns[: len(names)] == names
    assert packed.columns[len(names) :] == ["piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]
    rows = [tuple(r) for r in packed.collect()]
    _check([(r[0], *r[-7:-4], r[-3], *r[-2:]) for r in rows], {r[0]: r[2] for r in odd}, 256)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in rows:
        held = whole[r[-2]]
        assert held.ids[4 * r[-1] : 4 * (r[-1] + r[-5])] == r[-4] and r[-1] in held.starts
    assert packing.pack(docs.limit(0), packing.default_path(), Limits(256)).count() == 0


def test_the_plan_moves_no_ids_for_the_query(spark):
    plan = QUERIES["op11_packing"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ids:binary" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
