"""Filter interaction audit: what each filter removes, for every order of applying the filters.

A row's failures are the bits of a mask, so a part needs only the counts of its mask cells (at most
32 for five filters), summed on the map side. A walk through all subsets of the filters in Gray-code
order toggles one filter at a time: every cell keeps how many of its failing filters are active, and
the running survivors change only where that counter leaves or reaches zero. The survivors of the 32
subsets are stored; a step of an order is the difference of two of them, so no order is replayed.

Whether a text equals that of a smaller id is decided without a group of copies ever meeting in a
task: the smallest id of every text is a map-side minimum over SHA-256 digests, and a row asks for
the pair (digest, own id), of which there are no more than rows of that id.

Defined cases: a null text is an empty one and equal to it; a null part is the empty string. Rows
of the smallest id are no copies, however many there are. A row without id comes after all others:
it is a copy if any row with an id holds its text. Labels of one id are joined by "any"; labels
without id count for nothing. Texts of any length are measured whole. An empty table has no parts.
Only the named columns are read, so no other column can clash.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from moundlens.llm.common import durable, pick, read_table

MEASURES = ("kept", "good", "toxic")
STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_rules(text: Column) -> dict[str, Column]:
    """The four filters on one text; TRUE where it fails."""
    # split() leaves an empty word before a leading blank and after a trailing one
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * distinct.cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): the failures of documents (doc_id, text, part), bit k for the k-th of
    ABCDE, and how many rows are alike."""
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_rules(F.col("_text")).values())]
    rows = docs.select("doc_id", F.coalesce("part", F.lit("")).alias("part"), text.alias("_text")).select(
        "doc_id", "part", F.unhex(F.sha2(F.col("_text"), 256)).alias("digest"), reduce(Column.__add__, bits).alias("mask")
    )
    # repeated rows are alike but for their number: counted first, so no id and no text is a hot key
    rows = durable(rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "interaction-rows")
    copy = 1 << len(bits)
    known, without = rows.where(F.col("doc_id").isNotNull()), rows.where(F.col("doc_id").isNull())
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    known = known.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    without = without.join(first.select("digest", F.lit(True).alias("met")), "digest", "left")
    is_first, met = F.coalesce("first", F.lit(False)), F.coalesce("met", F.lit(False))
    return known.select("doc_id", "part", F.when(is_first, F.col("mask")).otherwise(F.col("mask") + copy).alias("mask"), "n").union(
        without.select("doc_id", "part", F.when(met, F.col("mask") + copy).otherwise(F.col("mask")).alias("mask"), "n")
    )


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, kept, good, toxic): how many rows of a part fail just the filters of a mask."""
    told = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"),
    )
    # rows without id match no label; they skip the join, where they would be one key
    known, without = failed.where(F.col("doc_id").isNotNull()), failed.where(F.col("doc_id").isNull())
    zero = F.lit(0)
    rows = known.join(told, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", zero).alias("good"), F.coalesce("bad", zero).alias("bad"))
    rows = rows.union(without.select("part", "mask", "n", zero.alias("good"), zero.alias("bad")))
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("kept"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("toxic")
    )


def gray_walk(mask: np.ndarray, amount: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every subset of filters: amounts (cells x measures) of the cells none of whose
    failing filters is active."""
    states = np.zeros((1 << filters, amount.shape[1]), np.int64)
    active = np.zeros(len(mask), np.int64)
    running = amount.sum(axis=0)
    states[0] = running
    for step in range(1, 1 << filters):
        gray = step ^ (step >> 1)
        toggled = (step & -step).bit_length() - 1  # the one filter in which neighbours differ
        touched = (mask >> toggled & 1).astype(bool)
        if gray >> toggled & 1:
            active[touched] += 1
            running = running - amount[touched & (active == 1)].sum(axis=0)
        else:
            active[touched] -= 1
            running = running + amount[touched & (active == 0)].sum(axis=0)
        states[gray] = running
    return states


def interactions(cell_rows: DataFrame, names: str) -> DataFrame:
    """One row for each part, order of the filters and step, from `cells`."""
    orders = ["".join(x) for x in permutations(names)]
    bit = {f: 1 << k for k, f in enumerate(names)}
    before = np.array([[sum(bit[f] for f in o[:k]) for k in range(len(names))] for o in orders])
    which = np.array([[names.index(f) for f in o] for o in orders])
    after = before | 1 << which

    def steps(key: tuple[pa.Scalar], group: pa.Table) -> pa.Table:
        mask = group.column("mask").to_numpy().astype(np.int64)
        amount = np.stack([group.column(m).to_numpy() for m in MEASURES], axis=1)
        states = gray_walk(mask, amount, len(names))
        change = states[before] - states[after]  # orders x steps x measures
        removed = change[:, :, 0]
        failing = np.array([amount[mask >> k & 1 == 1, 0].sum() for k in range(len(names))])
        alone = np.array([amount[mask == 1 << k, 0].sum() for k in range(len(names))])
        total = np.array([removed[which == k].sum() for k in range(len(names))])
        flat = [states[after][:, :, 0], removed, failing[which] - removed, alone[which], change[:, :, 1], change[:, :, 2], total[which]]
        n = which.size
        head = [pa.array([key[0].as_py()] * n), pa.array(np.repeat(orders, len(names)).tolist())]
        step = pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders)))
        columns = STEPS.replace(",", "").split()[::2]
        return pa.table([*head, step, *(pa.array(x.ravel()) for x in flat)], names=columns)

    return cell_rows.groupBy("part").applyInArrow(steps, STEPS)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The five filters ABCDE over whole documents, for every part and order."""
    failed = failures(pick(docs, doc_id=id_col, text=text_col, part=part_col))
    return interactions(cells(failed, pick(labels, doc_id="doc_id", quality="quality", toxic="toxic")), "ABCDE")


def op13_filter_interaction(spark, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
