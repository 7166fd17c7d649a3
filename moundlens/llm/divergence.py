"""Source divergence audit by count cells: how a source's words differ from its language's.

A language's terms are those in at least `LEAST_DOCS` of its documents. Every group (a language's
source) and the language itself give a term with `count` occurrences the smoothed share
p = 1 + floor(SCALE * (count + 1) / (N + V)), with V terms and N their occurrences there. The
divergence of p from q is f = floor((p - q)^2 / q). All numbers are integers, wider ones decimals.

f depends on two counts only, so terms are never scored one by one. They are grouped into cells:
(group count, language count) for the terms that stand out in a group, (count here, count there)
for two sources; f is evaluated once a cell and weighed with the cell's number of terms.

- `term`: cells of one group with the same value are merged; the first 200 values are found by a
  partial top-k, ranked by the running sum of their multiplicities, and only those cells are expanded
  into terms, in UTF-8 order.
- `pair`: the sum over all terms, absent ones included, is that of four parts: terms of both
  sources (cells of pairs), of the one, of the other (cells of one count each), and of none. Terms
  with the same counts in all sources are one row before their pairs are counted.

Tasks count the terms of their documents in a dictionary that is handed on when it is full, so the
exchange carries one row a task, source and term. No group's terms meet in one task.

Defined cases: null text, language and source are the empty string; documents without terms still
make their group; a language without terms has pairs of value 0 and no terms. Repeated rows count
each. A text of any length is walked in slices. An empty table has no rows. Only the named columns
are read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from moundlens.llm.common import durable, pick, read_table
from moundlens.operators.joins import join_group_table

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
HELD = 200_000  # terms a task holds before it hands them on
SLICE = 1 << 20  # bytes of a text cut into terms at a time
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _slices(data: bytes) -> Iterator[bytes]:
    """The text in pieces that end where a term does."""
    at = 0
    while len(data) - at > SLICE:
        end = at + SLICE
        last = _TERM.match(data, end)
        end = last.end() if last else end
        yield data[at:end]
        at = end
    yield data[at:]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of documents (lang, source, text), summed by task as far as
    memory goes: occurrences, and documents that hold the term. Terms are UTF-8 strings."""

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (often, holding) in held.items():
            terms = list(often)
            yield pa.record_batch(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(list(often.values()), pa.int64()),
                    pa.array(list(map(holding.__getitem__, terms)), pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                often, holding = held[lang, source]
                before, mine = len(often), set()
                for part in _slices(text.cast(pa.binary()).as_py().translate(_LOWER)):
                    found = _TERM.findall(part)
                    often.update(found)
                    mine.update(found)
                holding.update(mine)
                size += len(often) - before
                if size > HELD:
                    yield from rows(held)
                    held.clear()
                    size = 0
        yield from rows(held)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _wide(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)); the product may exceed 64 bits."""
    product = F.lit(SCALE).cast("decimal(10,0)") * _wide(count + 1)
    return F.call_function("div", product, _wide(F.greatest(n + v, F.lit(1)))) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), below 2^63 as shares are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, l) of the kept terms of each language where they occur: occurrences
    in the group, and in the language."""
    counts = term_counts(docs).repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("c"), F.sum("docs").alias("docs"))
    # one row a source: no larger than the number of sources, and on the partitioning that is there
    whole = counts.groupBy("lang", "term").agg(
        F.sum("c").alias("l"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "c")).alias("by")
    )
    whole = whole.where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "l", F.sort_array("by").alias("by"))
    return durable(whole, "divergence-terms")


def _sizes(groups: DataFrame, terms: DataFrame, ones: DataFrame) -> DataFrame:
    """(lang, source, n, l, v): occurrences in the group and in the language, terms of the language."""
    langs = terms.groupBy("lang").agg(F.sum("l").alias("nl"), F.count(F.lit(1)).alias("v"))
    own = ones.groupBy("lang", "source").agg(F.sum(F.col("x") * F.col("m")).alias("n"))
    sized = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    return durable(
        sized.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("n", "nl", "v"))), "divergence-sizes"
    )


def _standing_out(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """Part `term`: the first terms of every group by f against the language."""
    flat = terms.select("lang", "term", "l", F.explode("by").alias("s")).select("lang", "s.source", "term", F.col("s.c").alias("c"), "l")
    cell = flat.groupBy("lang", "source", "c", "l").agg(F.count(F.lit(1)).alias("m"))
    known = join_group_table(cell, sizes, ["lang", "source"], F.xxhash64("c", "l"))
    p, q = _share(F.col("c"), F.col("n"), F.col("v")), _share(F.col("l"), F.col("nl"), F.col("v"))
    valued = known.select("lang", "source", "c", "l", "m", p.alias("p"), q.alias("q")).where("p > q")
    valued = durable(valued.select("lang", "source", "c", "l", "m", _apart(F.col("p"), F.col("q")).alias("value")), "divergence-cells")
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    merged = merged.withColumn("place", F.row_number().over(best)).where(F.col("place") <= TOP)  # a partial top-k
    upto = F.sum("m").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = merged.withColumn("before", upto - F.col("m")).where(F.col("before") < TOP)
    chosen = valued.join(merged.select("lang", "source", "value"), ["lang", "source", "value"])
    terms_of = join_group_table(flat, chosen, ["lang", "source", "c", "l"], F.xxhash64("term"), weight="m")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    ranked = terms_of.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _between(terms: DataFrame, sizes: DataFrame, ones: DataFrame) -> DataFrame:
    """Part `pair`: every other source of the language, by the sum of f over all its terms."""
    left = sizes.select("lang", "source", F.col("n").alias("na"), "v")
    right = sizes.select("lang", F.col("source").alias("item"), F.col("n").alias("nb"))
    pairs = durable(left.join(right, "lang").where("source <> item"), "divergence-pairs")  # the rows to return
    alike = terms.groupBy("lang", "by").agg(F.count(F.lit(1)).alias("m"))
    both = alike.select("lang", "m", "by", F.explode("by").alias("a")).select("lang", "m", "a", F.explode("by").alias("b"))
    both = both.where("a.source <> b.source").groupBy(
        "lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.col("a.c").alias("x"), F.col("b.c").alias("y")
    ).agg(F.sum("m").alias("m"))

    def f(x: Column, y: Column) -> Column:
        return _wide(_apart(_share(x, F.col("na"), F.col("v")), _share(y, F.col("nb"), F.col("v"))))

    x, y, none = F.col("x"), F.col("y"), F.lit(0).cast("long")
    keys = ["lang", "source", "item"]
    one_a = pairs.join(ones, ["lang", "source"]).select(*keys, (F.col("m") * (f(x, none) - f(none, none))).alias("part_sum"))
    there = ones.select("lang", F.col("source").alias("item"), F.col("x").alias("y"), "m")
    one_b = pairs.join(there, ["lang", "item"]).select(*keys, (F.col("m") * (f(none, y) - f(none, none))).alias("part_sum"))
    two = pairs.join(both, keys).select(
        *keys, (F.col("m") * (f(x, y) - f(x, none) - f(none, y) + f(none, none))).alias("part_sum")
    )
    base = pairs.select(*keys, (F.col("v") * f(none, none)).alias("part_sum"))
    parts = [p.withColumn("part_sum", F.col("part_sum").cast("decimal(38,0)")) for p in (one_a, one_b, two, base)]
    total = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy(*keys).agg(F.sum("part_sum").cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return total.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): other sources and outstanding terms of each group."""
    mine = pick(docs, text=text_col, lang=lang_col, source=source_col).fillna("")
    terms = kept_terms(mine)
    ones = terms.select("lang", F.explode("by").alias("s")).groupBy("lang", F.col("s.source").alias("source"), F.col("s.c").alias("x"))
    ones = durable(ones.agg(F.count(F.lit(1)).alias("m")), "divergence-counts")
    sizes = _sizes(mine.select("lang", "source").distinct(), terms, ones)
    return _between(terms, sizes, ones).union(_standing_out(terms, sizes))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))
