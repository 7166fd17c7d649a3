r"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation becomes one or more windows of at most `budget` tokens. Running totals of the turns'
tokens cut it into spans of equal length; a turn belongs to the span in which it ends, and a turn
that crosses into a span it would overfill makes a window of its own. Turns are never cut: one that
is longer than the budget is a window by itself. A leading system turn is repeated in every window,
and the last turns of the window before, up to `history` tokens, are repeated as context. Targets
(the assistant's texts) are under the loss mask in the window where they are new, and masked where
they are repeated, so each is learnt from once.

A turn is written `<s>role\ntext</s>\n`. Control strings inside a text get a backslash after their
first character, and texts that already have backslashes there get one more, so that unescaping
takes exactly one away. In roles, `%`, line breaks, `<` and `[` are written as `%25`, `%0A`, `%3C` and
`%5B`, so a role reads back whatever it holds.

Defined cases: a null text or role is an empty one; turns are ordered by number (nulls first), then
role and text, and repeated rows are turns of their own; rows without a conversation id form one
conversation; an empty table gives no windows; other columns of the turns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from moundlens.llm.common import pick, read_table

BUDGET = 512
HISTORY = 128
TARGET = "assistant"
SYSTEM = "system"
OPEN, CLOSE = "<s>", "</s>"
# Control strings of this template and of a widespread other one.
_CONTROL = r"([<\[])({0}\\*)(/?s>|</?SYS>>|/?INST\])"
_ESCAPE, _UNESCAPE = _CONTROL.replace("{0}", ""), _CONTROL.replace("({0}", r"\\(")
# What a role may not hold as it is: the marks, the line break after it, and the sign of a code.
_ROLE_CODES = {"%": "%25", "\n": "%0A", "<": "%3C", "[": "%5B"}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _escape_role(role: Column) -> Column:
    for char, code in _ROLE_CODES.items():
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def _unescape_role(role: Column) -> Column:
    # the percent sign last: until then each one is the start of a code
    for char, code in reversed(_ROLE_CODES.items()):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def estimated_tokens(text: Column) -> Column:
    """A token for four characters, and four for the marks of the turn."""
    return F.floor(F.length(text) / 4).cast("long") + 4


def windows(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    tokens=estimated_tokens,
) -> DataFrame:
    """(conv_id, window, formatted, spans): windows from 1; spans has one entry for each turn in the
    window, in order: start and end (code points) of its text in `formatted`, and whether it is
    `fresh` (not a repetition) and under the `loss` mask."""
    df = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    df = df.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    df = df.withColumn("tokens", tokens(F.col("text")))
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    df = df.withColumns({"place": F.row_number().over(order), "end": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    system = (F.col("place") == 1) & (F.col("role") == SYSTEM)
    df = df.withColumn("system", system)
    lead = F.coalesce(F.max(F.when(F.col("system"), F.col("tokens"))).over(conv), F.lit(0))
    df = df.withColumn("lead", lead.cast("long"))
    room = F.greatest(F.lit(budget - history) - F.col("lead"), F.lit(budget // 4)).cast("long")
    df = df.withColumns({"room": room, "stop": F.col("end") - F.col("lead"), "start": F.col("end") - F.col("lead") - F.col("tokens")})
    df = df.withColumn("span", F.when(F.col("system"), F.lit(0)).otherwise(F.expr("(stop - 1) div room")))
    body = F.sum(F.when(F.col("system"), F.lit(0)).otherwise(F.col("tokens"))).over(Window.partitionBy("conv_id", "span"))
    crossing = ~F.col("system") & (F.expr("start div room") < F.col("span"))
    df = df.withColumn("key", F.col("span") * 2 + F.when(crossing & (body > F.col("room")), F.lit(0)).otherwise(F.lit(1)))
    # a system turn by itself in span 0 belongs to the first window that there is
    least = F.min(F.when(~F.col("system"), F.col("key"))).over(conv)
    df = df.withColumn("key", F.when(F.col("system"), F.coalesce(least, F.lit(1))).otherwise(F.col("key")))
    df = df.withColumn("window", F.dense_rank().over(conv.orderBy("key")))
    df = df.withColumns({"last": F.max("window").over(conv), "edge": F.max("stop").over(Window.partitionBy("conv_id", "window"))})
    repeated = ~F.col("system") & (F.col("edge") - F.col("start") <= history) & (F.col("window") < F.col("last"))
    held = (
        F.when(F.col("system"), F.sequence(F.lit(1), F.col("last")))
        .when(repeated, F.array(F.col("window"), F.col("window") + 1))
        .otherwise(F.array("window"))
    )
    fresh = F.col("into") == F.col("window")
    parts = df.withColumn("into", F.explode(held)).select(
        "conv_id",
        F.col("into").alias("window"),
        F.struct(
            "place",
            F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n")).alias("head"),
            escape(F.col("text")).alias("body"),
            fresh.alias("fresh"),
            (fresh & (F.col("role") == TARGET)).alias("loss"),
        ).alias("part"),
    )
    whole = parts.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    tail = CLOSE + "\n"
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.struct(start.alias("start"), end.alias("end"), p["fresh"].alias("fresh"), p["loss"].alias("loss"))
        return F.struct((end + len(tail)).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    empty = F.array().cast("array<struct<start:int,end:int,fresh:boolean,loss:boolean>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    spans = F.aggregate("parts", zero, add, lambda acc: acc["spans"])
    return whole.select("conv_id", "window", formatted.alias("formatted"), spans.alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns read from windows: (conv_id, window, turns, targets, formatted): the fresh turns as
    (role, text) and the text under the loss mask, both unescaped, in order."""
    # no text holds the closing mark unescaped; the part after the last one is empty
    cut = F.split("formatted", F.lit(CLOSE + "\n"))
    df = formatted.withColumn("cut", F.slice(cut, F.lit(1), F.size(cut) - 1))

    def turn(part: Column) -> Column:
        plain = F.substr(part, F.lit(len(OPEN) + 1))
        place = F.instr(plain, "\n")
        return F.struct(
            _unescape_role(F.substr(plain, F.lit(1), place - 1)).alias("role"),
            unescape(F.substr(plain, place + 1)).alias("text"),
        )

    both = F.arrays_zip("cut", "spans")
    fresh = F.transform(F.filter(both, lambda x: x["spans"]["fresh"]), lambda x: turn(x["cut"]))
    inside = F.transform(
        F.filter("spans", lambda s: s["loss"]),
        lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])),
    )
    return df.select("conv_id", "window", fresh.alias("turns"), inside.alias("targets"), "formatted")


def op5_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(TARGET)).alias("role"),
        F.lit(said).alias("text"),
    )
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = read_back(windows(turns.unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    found = found.select(
        "conv_id",
        F.struct("window", lines.alias("lines"), F.array_join("targets", "").alias("targets")).alias("part"),
        F.size("turns").cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = found.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars")
    )
    said_ = F.array_join(F.transform("parts", lambda p: p["lines"]), "")
    learnt = F.array_join(F.transform("parts", lambda p: p["targets"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode(said_, "UTF-8"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(F.encode(learnt, "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
