"""Joins of the pitch log with tables aggregated from it, safe against hot keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from moundlens.sources.scratch import materialize

BROADCAST_BYTES = 64 << 20
HOT_SHARE = 0.001  # a key with more than this share of all rows is split
HOT_SPLITS = 1_024
CELLS = 1 << 16  # parts of the hash range in which frequent keys are looked for
NO_DAY = -(1 << 31)  # stands for a missing date; no date has this number


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL matches NULL; keys appear once, from the left side."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    condition = reduce(
        lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_right_{key}" for key in keys])


def table_bytes(df: DataFrame) -> int:
    """Size of a table in memory, about: its text, and 8 bytes for any other value."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    fixed = 16 + 8 * len(df.columns)
    width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in texts], F.lit(fixed))
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]


def frequent_keys(
    fact: DataFrame, keys: list[str], least: Callable[[int], float]
) -> tuple[int, DataFrame | None]:
    """Number of rows, and the keys with more than `least(that number)` rows with their `_rows`;
    None if there is no such key.

    Rows are counted by hash cell first, on the map side. Only cells with that many rows can hold
    such a key, and only their rows are counted by key, so rare keys are never shuffled.
    """
    celled = fact.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(CELLS)).cast("int").alias("_cell"))
    cells = materialize(celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows")), "cells")
    total = cells.agg(F.sum("_rows")).first()[0] or 0
    full = cells.where(F.col("_rows") > F.lit(float(least(total)))).select("_cell")
    if full.isEmpty():
        return total, None
    near = celled.join(F.broadcast(full), "_cell", "left_semi")
    sizes = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    found = materialize(sizes.where(F.col("_rows") > F.lit(float(least(total)))), "frequent_keys")
    return total, None if found.isEmpty() else found


def _day(date: Column) -> Column:
    return F.coalesce(F.unix_date(date), F.lit(NO_DAY))


def _gathered(groups: DataFrame, keys: list[str], nested: str) -> DataFrame:
    """One row for all keys but the date `nested`: its days, and the groups' values in their order."""
    values = [name for name in groups.columns if name not in keys]
    entry = F.struct(_day(F.col(nested)).alias("_days"), *values)
    packed = groups.groupBy(*[k for k in keys if k != nested]).agg(F.collect_list(entry).alias("_all"))
    return packed.select(
        *[k for k in keys if k != nested], *[F.col("_all")[name].alias(f"_all_{name}") for name in ("_days", *values)]
    )


def _join_gathered(fact: DataFrame, packed: DataFrame, keys: list[str], nested: str, values: list[str]) -> DataFrame:
    place = F.array_position("_all__days", _day(F.col(nested))).cast("int")
    met = null_safe_join(fact, F.broadcast(packed), [k for k in keys if k != nested])
    met = met.withColumn("_place", place).where(F.col("_place") > 0)
    found = [F.get(f"_all_{name}", F.col("_place") - 1).alias(name) for name in values]
    return met.select(*fact.columns, *found)


def join_group_table(
    fact: DataFrame,
    groups: DataFrame,
    keys: list[str],
    row_hash: Column,
    weight: str = "group_rows",
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_share: float = HOT_SHARE,
    splits: int = HOT_SPLITS,
    nested: str | None = None,
) -> DataFrame:
    """Inner join of `fact` with a table holding one row per key; `weight` (row counts) is dropped.

    The group table is written out first, so its size is known. One of up to `broadcast_bytes` is
    broadcast and the fact table never moves. If `nested` names a date among the keys, and all other
    columns are numbers, a table of up to some four times that is broadcast too, its days gathered
    to one row for the other keys. Beyond that both sides are shuffled, and keys that hold more than
    `hot_share` of the fact's rows (at most 1 / hot_share of them, whether the group table has them or
    not) are spread over `splits` tasks: the fact side by `row_hash`, the group side by repeating the row.
    """
    groups = materialize(groups, "group_table")
    known = groups.drop(weight)
    if table_bytes(groups) <= broadcast_bytes:
        return null_safe_join(fact, F.broadcast(known), keys)
    if nested is not None:
        values = [name for name in known.columns if name not in keys]
        lists = known.count() * (4 + 8 * len(values))  # a day and a number a value
        if lists <= broadcast_bytes:
            packed = materialize(_gathered(known, keys, nested), "gathered_groups")
            heads = packed.count() * 24 * len(values)  # table_bytes has 8 of the 32 a list
            if lists + heads + table_bytes(packed) <= broadcast_bytes:
                return _join_gathered(fact, packed, keys, nested, values)

    _, hot_keys = frequent_keys(fact, keys, lambda rows: rows * hot_share)
    if hot_keys is None:
        return null_safe_join(fact, known, keys)
    hot_keys = hot_keys.select(*keys, F.lit(True).alias("_hot"))
    marked = null_safe_join(fact, F.broadcast(hot_keys), keys, "left").withColumn(
        "_split", F.when(F.col("_hot"), F.pmod(row_hash, F.lit(splits))).otherwise(F.lit(0))
    )
    known = null_safe_join(known, F.broadcast(hot_keys), keys, "left")
    repeats = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(splits - 1))).otherwise(
        F.array(F.lit(0))
    )
    spread = known.withColumn("_split", F.explode(repeats)).drop("_hot")
    return null_safe_join(marked, spread, [*keys, "_split"]).drop("_hot", "_split")
