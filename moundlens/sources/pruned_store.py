"""A store that skips files by pitcher, batter and date at once.

Rows are ordered along a curve that interleaves the bits of three cells: equal shares of the pitchers'
names, of the batters' names and of the dates. A run of that order is narrow in all three, so the
minimum and maximum of a row group in each column rule it out for most names and ranges. Beside them
each row group has Bloom filters of both names; where a name column is written with a dictionary
alone, the writer leaves the filter out, and readers ask the dictionary, which rules out as well.

A cell that holds a third of all rows is cut into as many files as its size asks for, since the range
cut goes on by batter, pitcher, date and key. Defined cases: NULL names and dates are in the first
cell; names that agree in their first seven bytes share a cell; a table without rows makes a store
without rows. Rows come back whatever the cells are; they decide only what is skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from moundlens.schema import STORE_SEASON
from moundlens.session import COMPILED, DROPPING, settings

NAMES = ("Pitcher", "Batter")
BITS = 5
ROWS_PER_FILE = 2_000_000
ROWS_PER_GROUP = 1_000_000  # distinct names that one Bloom filter is made for, at most
_PREFIX = 7  # bytes of a name; their number fits a long


def _number(name: str) -> Column:
    """A long in the order of the text's first bytes."""
    first = F.hex(F.substring(F.encode(F.col(name), "UTF-8"), 1, _PREFIX))
    return F.coalesce(F.conv(F.rpad(first, 2 * _PREFIX, "0"), 16, 10).cast("long"), F.lit(-1))


def _day() -> Column:
    return F.coalesce(F.unix_date("Date").cast("long"), F.lit(-(1 << 40)))


def _cell(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cut points lie below the value: a search by halves, in plain comparisons."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low).cast("long")
        middle = (low + high) // 2
        point = F.lit(int(cuts[middle])).cast("long")
        return F.when(value <= point, among(low, middle)).otherwise(among(middle + 1, high))

    return among(0, len(cuts))


def interleave(cells: list[Column], bits: int) -> Column:
    """One number from the bits of all cells, the highest bits of each first."""
    place = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for cell in cells:
            place = F.shiftleft(place, 1).bitwiseOR(F.getbit(cell, F.lit(level)).cast("long"))
    return place


def write_pruned_store(
    df: DataFrame, path: str, bits: int = BITS, files: int | None = None, mode: str = "error", **options: str
) -> None:
    """Parquet partitioned by season and laid out by pitcher, batter and date inside each.

    One pass finds the cut points of all three by fixed-size sketches, and the number of names.
    `options` go to the Parquet writer. `read_store` reads the result.
    """
    shares = F.lit([k / (1 << bits) for k in range(1, 1 << bits)])
    values = {**{name: _number(name) for name in NAMES}, "Date": _day()}
    found = df.select(*NAMES, *(v.alias(f"_{k}") for k, v in values.items())).agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.percentile_approx(f"_{k}", shares).alias(f"cuts_{k}") for k in values),
        *(F.approx_count_distinct(name).alias(f"distinct_{name}") for name in NAMES),
    )
    with settings(df.sparkSession, COMPILED):
        shape = found.first()  # a few numbers at any size of the log
    order = [STORE_SEASON, "_place", "Batter", "Pitcher", "Date", "PitchUID"]
    # each in a step of its own, so that a value is made once and not in every comparison
    placed = df.withColumns({STORE_SEASON: F.year("Date"), **{f"_{k}": v for k, v in values.items()}})
    placed = placed.withColumns({f"_{k}": _cell(F.col(f"_{k}"), shape[f"cuts_{k}"] or []) for k in values})
    placed = placed.withColumn("_place", interleave([F.col(f"_{k}") for k in values], bits))
    placed = placed.drop(*(f"_{k}" for k in values))
    files = files or max(1, -(-shape["rows"] // ROWS_PER_FILE))
    placed = placed.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("_place")
    writer = placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    for name in NAMES:
        distinct = max(1, min(int(shape[f"distinct_{name}"] * 1.2), ROWS_PER_GROUP))
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{name}", str(distinct))
    with settings(df.sparkSession, {**COMPILED, **DROPPING}):
        writer.options(**options).partitionBy(STORE_SEASON).parquet(path)
