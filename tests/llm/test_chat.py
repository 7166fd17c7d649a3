"""Chat windows: exact read-back, budgets, and what is repeated."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from moundlens.llm import chat


def conversations():
    rng = random.Random(2)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<\\s>", "<\\\\/s>", "[\\/INST]", "<", "[", "\n", "é😀", "a", "word ", ""]
    roles = ["user", "assistant", "system", None, "a\\n\nb", "\\", "x</s>", "x</s>\n<s>y", "a\0b", "\\n", "%3C%250A", "[INST]"]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 500))) for _ in range(30))]
    rows = [(rng.choice([None, *range(9)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(200)]
    return rows + rows[:5] + [(50, 0, "system", "be brief"), (51, 0, "assistant", "x" * 20_000)]


def ordered(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return {c: sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")) for c, v in by.items()}


@pytest.mark.parametrize(("budget", "history"), [(512, 128), (64, 0), (40, 39), (100_000, 0)])
def test_read_back_is_exact(spark, budget, history):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, window string, place int")
    windows = chat.windows(df, budget=budget, history=history)
    got = {}
    for r in sorted(chat.read_back(windows).collect(), key=lambda r: r.window):
        turns, targets = got.setdefault(r.conv_id, ([], []))
        turns += [(t.role, t.text) for t in r.turns]
        targets += r.targets
    want = {c: ([(r[2] or "", r[3] or "") for r in v], [r[3] or "" for r in v if r[2] == "assistant"]) for c, v in ordered(rows).items()}
    assert got == want
    for r in windows.collect():
        assert r.formatted.count("<s>") == r.formatted.count("</s>") == len(r.spans)
        assert all(s.fresh or not s.loss for s in r.spans)
        tokens = [(s.end - s.start) // 4 + 4 for s in r.spans if s.fresh]
        assert len(tokens) <= 2 or sum(tokens) <= 2 * budget  # escapes lengthen a text a little


def test_budget_system_and_history(spark):
    rows = [(1, 0, "system", "s" * 40)] + [(1, k, "user" if k % 2 else "assistant", f"{k:02d}" * 20) for k in range(1, 21)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat.windows(df, budget=100, history=30).collect(), key=lambda r: r.window)
    assert len(got) > 3
    for r in got:
        assert sum((s.end - s.start) // 4 + 4 for s in r.spans) <= 100
        assert r.formatted.startswith("<s>system\n")
        assert r.spans[0].fresh == (r.window == 1)
    assert all([s.fresh for s in r.spans[:3]] == [False, False, False] or not r.spans[1].fresh for r in got[1:])
    assert sum(s.loss for r in got for s in r.spans) == 10


def test_a_role_takes_no_text_with_it(spark):
    rows = [(1, 0, "x</s>", "hello"), (1, 1, "assistant", "hi"), (1, 2, "a\0b", "</s>"), (1, 3, "\\n", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = chat.read_back(chat.windows(df)).collect()
    assert [tuple(t) for t in got.turns] == [r[2:] for r in rows] and got.targets == ["hi"]
    assert chat.windows(df).first().formatted.count("</s>") == 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.windows(df).count() == 0


def test_escape_is_reversible(spark):
    texts = [t or "" for _, _, _, t in conversations()]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bad = df.where((chat.unescape(chat.escape(F.col("t"))) != F.col("t")) | chat.escape(F.col("t")).rlike(r"</?s>|\[/?INST\]|<</?SYS>>"))
    assert bad.isEmpty()
