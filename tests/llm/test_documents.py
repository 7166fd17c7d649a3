"""Operators over documents against plain versions, on odd tables."""

from __future__ import annotations

import random
from types import SimpleNamespace

import brute
import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import DataFrame, functions as F

from moundlens.llm import bpe, decontaminate, licenses, lines, quality, sharding, simhash, substrings, tokencounts

SMALL = "/root/testdata/sf0.001"
SCHEMA = (
    "k int, doc_id long, text string, lang string, source string, n_chars long, "
    "n_words int, fp string, block long, spans int, c0 int, part int, kept_text int, _d int"
)


def words(rng, n, vocabulary=30):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_documents():
    """Nulls, empty and long texts, ties, repeated rows and ids, variants of common lines."""
    rng = random.Random(11)
    base = [words(rng, rng.randint(15, 40)) for _ in range(5)]

    def line():
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 3])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(30)}"
        return " ".join(w)

    texts = [None, "", "\n", " \t ", "one", "A b\x0bC d\x0ce", "é 😀 ß\n\n", "x" * 50_000, words(rng, 20_000, 5000)]
    texts += ["\n".join(line() for _ in range(rng.randint(1, 5))) for _ in range(120)]
    texts += ["\n".join([line(), "", "tail tail", line()]) + "\n" for _ in range(20)]
    rows = [(rng.choice([None, *range(90)]), t) for t in texts]
    rows += rows[:3] + rows[20:24]  # repeated rows
    langs = [None, "en", "fr"]
    return [(k, i, t, rng.choice(langs), rng.choice([None, "s1", "s2"]), len(t or ""), 7, "f", 1, 2, 3, 4, 5, 6) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents()


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.createDataFrame(odd, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_k(df, n):
    """{k: the last n columns}, read by position."""
    rows = df.collect()
    return {r[0]: tuple(r)[-n:] for r in rows}


def test_decontamination(spark, docs, odd, empty):
    rng = random.Random(3)
    items = [(str(k), words(random.Random(k), n)) for k, n in enumerate([0, 3, 9, 10, 11, 25])]
    items += [(None, odd[30][2].split("\n")[0]), ("7", odd[31][2].split("\n")[0]), ("7", None), ("8", "w1 w2")]
    rng.shuffle(items)
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute.hits([r[2] for r in odd], items)
    for size in (1 << 20, 0):  # broadcast, and joined by digest
        got = by_k(decontaminate.scan(docs, bench, index_bytes=size), 5)
        assert len(got) == len(odd)
        for k, (n, hit, named) in enumerate(want):
            assert got[k][:3] == (n, len(hit), sorted(named))
            text = odd[k][2]
            if text is None:
                assert got[k][4] is None
                continue
            left = text.encode()
            for start, end in reversed(got[k][3]):
                left = left[:start] + left[end:]
            assert left.decode() == got[k][4]
            w = brute.ITEM_WORD.findall(brute.low(text))
            inside = [x for s in got[k][3] for x in brute.ITEM_WORD.findall(brute.low(text.encode()[s[0] : s[1]].decode()))]
            assert inside == [w[p] for p in sorted(hit)]
    dropped = decontaminate.decontaminate(docs, bench, remove="documents")
    assert dropped.columns == docs.columns
    assert {r.k for r in dropped.collect()} == {k for k, (_, hit, _) in enumerate(want) if not hit}
    nothing = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.scan(docs, nothing).count() == len(odd)
    assert decontaminate.scan(empty, bench).count() == 0


def test_substrings(docs, odd, empty):
    got = by_k(substrings.parse(docs), 4)
    want = brute.repeated_words([(r[1], r[2]) for r in odd])
    for k, (w, gone) in enumerate(want):
        n, removed, factors, kept = got[k]
        assert (n, removed) == (len(w), len(gone))
        assert kept == " ".join(x for p, x in enumerate(w) if p not in gone)
        assert {p for f in factors for p in range(f.start, f.start + f.words)} == gone
        for f in factors:  # each factor lies in its source, word for word
            assert f.words >= 13
            sources = [" ".join(brute.WORD.findall(r[2] or "")) for r in odd if r[1] == f.source]
            part = w[f.start : f.start + 13]
            assert any(" ".join(part) in s for s in sources)
    assert substrings.parse(empty).count() == 0


@pytest.mark.parametrize("tight", [False, True])
def test_lines(monkeypatch, docs, odd, empty, tight):
    if tight:  # split lists, a second round and lists that are walked
        for name, value in {"FIRST": 1, "LIST": 10, "_SHORT": 2, "_STRIDE": 3}.items():
            monkeypatch.setattr(lines, name, value)
    want = brute.repeated_lines([(r[1], r[2]) for r in odd])
    got = by_k(lines.find(docs), 3)
    for k, r in enumerate(odd):
        gone = sorted(want.get(k, []))
        kept = None if r[2] is None else "\n".join(x for n, x in enumerate(r[2].split("\n")) if n not in gone)
        assert got[k] == (0 if r[2] is None else r[2].count("\n") + 1, gone, kept)
    kept = lines.dedup(docs)
    assert kept.columns == docs.columns
    assert {r.k for r in kept.collect()} == {k for k, r in enumerate(odd) if not (k in want and len(want[k]) == r[2].count("\n") + 1)}
    assert lines.find(empty).count() == 0


def shingles(text):
    w = brute.WORD.findall(brute.low(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def test_hot_tokens_are_split_on_both_sides(monkeypatch, spark):
    """Variants of one line under a list cut into many parts: nothing is missed."""
    rng = random.Random(8)
    base = words(rng, 40, 5000).split()
    texts = []
    for k in range(400):
        other = [*base, f"new{k}"]
        if k % 2:
            other[rng.randrange(len(base))] = other.pop()
        texts.append(" ".join(other))
    monkeypatch.setattr(lines, "LIST", 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute.repeated_lines(list(enumerate(texts)))
    got = {r.doc_id: len(r.removed) for r in lines.find(docs).collect()}
    assert got == {k: len(want.get(k, [])) for k in range(len(texts))} and sum(got.values()) > 150


def test_groups_of_a_split_token(monkeypatch):
    """Every ordered pair of entries meets in exactly one group, and no group holds more than two parts."""
    monkeypatch.setattr(lines, "LIST", 50)
    n, rng = 1000, np.random.default_rng(4)
    names = rng.integers(1, 1 << 62, n).astype(np.uint64)
    prefixes = SimpleNamespace(
        at=np.zeros(n, [(x, k) for x, k in lines._ENTRY if x not in ("token", "place", "asks", "salt")] + [("gone", np.int64)]),
        token=np.full(n, 9, np.uint64), which=np.arange(n), place=np.zeros(n, np.int64),
    )
    prefixes.at["name"] = names
    prefixes.at["gone"][: n // 4] = 1  # these only list
    monkeypatch.setattr(lines, "Prefixes", lambda data: prefixes)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    hot = (np.array([9], np.uint64), np.zeros(1, np.int64), np.array([n], np.int64))
    monkeypatch.setattr(lines.blocks, "answers", lambda told: hot if told.num_rows else none)
    told = pa.table({"kind": [1], "keys": [b""], "low": [b""], "often": [b""]})
    left = pa.table({"block": [3], "prefixes": [b""]})
    out = lines._entries(left, told, 7, False)
    column = {x: np.concatenate([np.frombuffer(b, k) for b in out.column(x).to_pylist()]) for x, k in lines._ENTRY}
    met: dict[tuple[int, int], int] = {}
    for salt in np.unique(column["salt"]):
        inside = column["salt"] == salt
        assert inside.sum() <= 2 * 1.8 * lines.LIST  # two parts of a hashed split
        asks, name = column["asks"][inside], column["name"][inside].tolist()
        listing = [x for x, a in zip(name, asks, strict=True) if a != 2]
        for i in (x for x, a in zip(name, asks, strict=True) if a > 0):
            for j in listing:
                met[i, j] = met.get((i, j), 0) + 1
    assert set(met.values()) == {1} and len(met) == (n - n // 4) * n


@pytest.mark.parametrize("tight", [False, True])
def test_whole_texts(monkeypatch, docs, odd, empty, tight):
    if tight:
        for name, value in {"FIRST": 1, "LIST": 10, "_SHORT": 2, "_STRIDE": 3}.items():
            monkeypatch.setattr(lines, name, value)
    found = lines.dedup_texts(docs)
    assert found.columns == docs.columns and lines.dedup_texts(empty).count() == 0
    rows = [tuple(r) for r in found.collect()]
    stay, sets = {r[0] for r in rows}, [shingles(r[2]) for r in odd]
    assert set(rows) <= set(odd) and len(stay) == len(rows)
    assert not any(alike(sets[a], sets[b]) for a in stay for b in stay if a < b)

    def place(k):
        return odd[k][1] is None, odd[k][1] or 0

    for k in set(range(len(odd))) - stay:
        assert any(j != k and place(j) <= place(k) and alike(sets[j], sets[k]) for j in range(len(odd)))


@pytest.mark.parametrize("tight", [False, True])
def test_near_copies_beyond_two_bits_go(monkeypatch, spark, tight):
    """Of the join of whole texts; the pipeline's stage links by fingerprints, see test_registered."""
    if tight:
        for name, value in {"FIRST": 1, "LIST": 10, "_SHORT": 2, "_STRIDE": 3}.items():
            monkeypatch.setattr(lines, name, value)
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = words(rng, rng.randint(40, 400), 5000).split()
        texts.append(" ".join(base))
        for _ in range(6):  # each changed word costs five shingles
            other = list(base)
            for at in rng.sample(range(len(base)), rng.randint(1, max(1, len(base) // 40))):
                other[at] = "new"
            texts.append(" ".join(other))
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    want = {k for k in range(len(texts)) if not any(alike(sets[j], sets[k]) for j in range(k))}
    prints = [brute.fingerprint(t, 5) for t in texts]
    far = [k for k in set(range(len(texts))) - want if all((prints[j] ^ prints[k]).bit_count() > 2 for j in range(len(texts)) if j != k)]
    assert far  # texts that no fingerprint within two bits would find
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in lines.dedup_texts(made).collect()} == want


@pytest.mark.parametrize("tight", [False, True])
def test_simhash(monkeypatch, docs, odd, empty, tight):
    if tight:
        monkeypatch.setattr(simhash, "LIST", 1)  # everything by neighbour values
    found = simhash.groups(docs, shingle=3).collect()
    fps = {k: brute.fingerprint(r[2], 3) for k, r in enumerate(odd)}
    group = brute.components(fps)
    least = {}
    for k, g in group.items():
        ids = [odd[j][1] for j, h in group.items() if h == g and odd[j][1] is not None]
        least[k] = min(ids, default=None)
    want = sorted(((odd[k][1], fps[k], least[k]) for k in fps), key=str)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in found), key=str) == want
    kept = simhash.dedup(docs, shingle=3)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(group[r.k] for r in rows) == sorted(set(group.values()))
    assert all(r.doc_id == least[r.k] for r in rows)
    assert simhash.groups(empty).count() == 0 and simhash.dedup(empty).count() == 0


def test_simhash_thresholds_cover_all_pairs(spark):
    """Dense clusters: components equal brute force for every number of partitions."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = set()
    while len(fps) < 400:
        v = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            v ^= 1 << b
        fps.add(v)
    signed = {v - (1 << 64) if v >> 63 else v: v for v in fps}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = brute.components(signed)
    for parts in ((2,), (3,), (4,)):
        plan = simhash.plan(df, 2, parts)
        assert len({b for bits, _ in plan for b in bits}) >= 64 - max(len(b) for b, _ in plan) * 2
        edges = [(r.a, r.b) for r in simhash.links(df).collect()]
        assert all((signed[a] ^ signed[b]).bit_count() <= 2 for a, b in edges)
        from moundlens.llm.components import components

        got = {r.node: r.root for r in components(simhash.links(df), "test").collect()}
        assert all(got.get(s, s) == want[s] for s in signed)


def test_allocation_is_the_cheapest():
    costs = [{-1: 0.0, 0: 5.0, 1: 50.0}, {-1: 0.0, 0: 1.0, 1: 9.0}, {-1: 0.0, 0: 3.0, 1: 4.0}]
    cost, chosen = simhash.allocate(costs, 0)
    every = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if a + b + c == 0]
    assert cost == min(sum(costs[i][t] for i, t in enumerate(x)) for x in every)
    assert sum(chosen) == 0


def test_quality(docs, odd, empty):
    got = by_k(quality.judge(docs), 8)
    for k, r in enumerate(odd):
        assert got[k][:6] == brute.counts(r[2])[:6]
    lean = {tuple(r)[0]: tuple(r)[2:] for r in quality.judge(docs, carry=["k", "n_words"]).collect()}
    assert lean == got
    want = brute.quality([(r[2], r[3], r[4]) for r in odd])
    assert [got[k][7] for k in range(len(odd))] == want
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.k for r in kept.collect()} == {k for k, keep in enumerate(want) if keep}
    assert quality.judge(empty).count() == 0


def test_quality_rejects_junk_and_keeps_the_rest(spark):
    """All small documents: verdicts as the plain version gives them; most labels agree."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = table.collect()
    got = {r.doc_id: r.kept for r in quality.judge(table).collect()}
    want = brute.quality([(r.text, r.lang, r.source) for r in rows])
    assert [got[r.doc_id] for r in rows] == want
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    judged = [(labels[i], k) for i, k in got.items() if i in labels]
    assert sum(bool(a) == b for a, b in judged) >= 0.95 * len(judged)


def test_sharding(docs, odd, empty, tmp_path, spark):
    rows = sharding.assign(docs, shards=7).select("k", "curve", "shard", "slot").collect()
    assert sorted(r.k for r in rows) == list(range(len(odd)))
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(7))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert sharding.assign(empty).count() == 0
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.assign(docs, shards=3).select("k", "shard", "slot"), path)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 3


@pytest.mark.parametrize("rows", ["null ids", "one id", "equal rows"])
def test_sharding_spreads_crowded_ids(spark, monkeypatch, rows):
    """A third of the rows without an id, with one id, or equal in all columns, over many buckets."""
    ids = {"null ids": "NULL", "one id": "7L", "equal rows": "7L"}[rows]
    text = "'same'" if rows == "equal rows" else "CAST(id AS STRING)"
    docs = spark.sql(
        f"""SELECT IF(id % 3 = 0, {ids}, id) AS doc_id, IF(id % 3 = 0, {text}, CAST(id AS STRING)) AS text,
        'en' AS lang, map('a', 1) AS _place FROM range(60000)"""
    )
    written: list[DataFrame] = []
    durable = sharding.durable
    monkeypatch.setattr(sharding, "durable", lambda df, name: written.append(durable(df, name)) or written[-1])
    found = sharding.assign(docs, dimensions=("lang",), shards=7, crowded=100)
    assert found.columns == [*docs.columns, "curve", "shard", "slot"] and len(written) == (rows == "equal rows")
    got = found.select("doc_id", "text", "shard", "slot").collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted(
        (r.doc_id or -1, r.text) for r in docs.select("doc_id", "text").collect()
    )
    slots: dict[int, list[int]] = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {len(v) for v in slots.values()} <= {60000 // 7, 60000 // 7 + 1}
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    if rows != "equal rows":  # where a row goes does not depend on the order of the rows
        other = sharding.assign(docs.orderBy(F.rand(3)), dimensions=("lang",), shards=7)
        assert sorted(map(str, other.select("doc_id", "text", "shard", "slot").collect())) == sorted(map(str, got))


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_steps_are_unit_steps(spark, n, bits):
    from itertools import product

    cells = list(product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, [f"q{k}" for k in range(n)])
    place = sharding.hilbert([F.col(f"q{k}") for k in range(n)], bits)
    rows = sorted(df.select("*", place.alias("h")).collect(), key=lambda r: r.h)
    assert [r.h for r in rows] == list(range(len(cells)))
    assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def odd_texts():
    rng = random.Random(2)
    alphabet = "aéèß 中文字\n\t  '’s'll're d1２½²٣#*$ ​\x85\x1c😀👍🏽̈ǅℵⅣ_-"
    pick = [*alphabet, "<|endoftext|>", "     ", "\n\n", "wordword", "'s", "<|endof"]
    texts = ["".join(rng.choice(pick) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    return [None, "", "x" * 3000, "x" * 3000 + " " + "y" * 2000, " " * 4000, "\n" * 999, "a b" * 999, "<|endoftext|>", *texts]


def test_bpe_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 200)
    path = bpe.default_path()
    library = tokenizers.Tokenizer.from_file(path)
    texts = odd_texts()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    df = spark.createDataFrame([(k, t, "n", 1) for k, t in enumerate(texts)], "k int, text string, n_tokens string, back int")
    rows = bpe.decode(bpe.encode(df, path), path).collect()
    for r in rows:
        ids = bpe.np.frombuffer(r.ids, "<u4").tolist()
        assert ids == want[r.k]
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")
    known = bpe.Vocabulary(path)
    direct = [bpe.np.frombuffer(x, "<u4").tolist() for x in known.encode(t or "" for t in texts)]
    assert direct == want
    pieces = list(known.cache)[:500]
    monkeypatch.setattr(bpe, "SHORT", 0)  # merging by heap
    assert all(known.exact(p.encode()) == bpe.np.frombuffer(known.cache[p], "<u4").tolist() for p in pieces)
    assert bpe.encode(df.limit(0), path).count() == 0


def test_token_counts_equal_the_library(spark):
    path = bpe.default_path()
    library = tokenizers.Tokenizer.from_file(path)
    texts = odd_texts()
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    df = spark.createDataFrame([(k, t, "n", 1) for k, t in enumerate(texts)], "k int, text string, n_tokens string, n_bytes int")
    for chunk, overlap in ((1 << 14, 256), (64, 1), (20, 20)):
        got = by_k(tokencounts.token_counts(df, path, chunk=chunk, overlap=overlap), 2)
        assert [got[k] for k in range(len(texts))] == [(len((t or "").encode()), n) for t, n in zip(texts, want, strict=True)]
    assert tokencounts.token_counts(df.limit(0), path).count() == 0


def test_licenses(spark, docs, odd, empty):
    rng = random.Random(4)
    parts = [p for _, t in licenses.TEMPLATES for p in t.split("\n\n")] + [t for _, t in licenses.TEMPLATES]
    pool = ["", "", "foo bar baz", "licensed under cc by 4.0!", "x", *parts]

    def mutated(line):
        w = line.split(" ")
        if rng.random() < 0.5 and len(w) > 3:
            w[rng.randrange(len(w))] = "zzz"
        return " ".join(w)

    texts = ["\n".join(mutated(rng.choice(pool)) for _ in range(rng.randint(0, 6))) for _ in range(200)]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate([None, *texts])], "k int, text string, matches int")

    def grams(text):
        w = brute.ITEM_WORD.findall(brute.low(text))
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)}

    known = [(n, grams(t)) for n, t in licenses.TEMPLATES]
    known += [(n, g) for n, t in licenses.TEMPLATES if "\n\n" in t for g in map(grams, t.split("\n\n")) if len(g) >= 5]

    def plain(text):
        cut = text.split("\n")
        starts = [i for i in range(len(cut)) if i == 0 or cut[i - 1] == ""]
        units = [("line", i, x) for i, x in enumerate(cut)]
        units += [("paragraph", a, "\n".join(cut[a:b])) for a, b in zip(starts, [*starts[1:], len(cut)], strict=True) if b - a > 1]
        units += [("text", 0, text)] if len(starts) > 1 else []
        out = []
        for kind, at, x in units:
            g = grams(x)
            scores = [(-len(g & t) / (len(g) + len(t)), k) for k, (_, t) in enumerate(known) if 20 * len(g & t) >= 9 * (len(g) + len(t)) and g]
            if scores:
                k = min(scores)[1]
                out.append((known[k][0], kind, at, len(g & known[k][1]), len(g) + len(known[k][1])))
        return sorted(out, key=lambda m: (m[2], m[1]))

    got = by_k(licenses.scan(df), 1)
    assert all([tuple(m) for m in got[k + 1][0]] == plain(t) for k, t in enumerate(texts))
    assert got[0][0] == [] and sum(len(v[0]) for v in got.values()) > 100
    assert licenses.scan(docs).count() == len(odd) and licenses.scan(empty).count() == 0


def test_sketches_never_rule_out_a_match():
    rng = np.random.default_rng(3)
    ruled_out = 0
    for _ in range(2000):
        n = int(rng.integers(1, 600))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n - int(rng.integers(0, n // 4 + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        may = lines._may_match(lines._sketch(a), lines._sketch(b), len(a) + len(b))
        assert may or not lines.matches(a, b)
        other = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        ruled_out += not lines._may_match(lines._sketch(a), lines._sketch(other), len(a) + n)
    assert ruled_out > 1900
