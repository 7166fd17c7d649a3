"""Row filters. All of them drop rows whose condition is unknown."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from moundlens.functions.nulls import in_box, in_set
from moundlens.schema import EXCLUDED_DATE, HEART_ZONE, STORE_SEASON, STRIKE_ZONE


def by_level(df: DataFrame, level: str = "D1") -> DataFrame:
    return df.where(F.col("Level") == level)


def by_membership(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def is_tagged() -> Column:
    return ~F.col("TaggedPitchType").isin("Undefined", "Other")


def is_valid() -> Column:
    return is_tagged() & (F.col("PitchCall") != "Undefined")


def tagged_pitches(df: DataFrame) -> DataFrame:
    """Pitches with a usable type."""
    return df.where(is_tagged())


def valid_pitches(df: DataFrame) -> DataFrame:
    """Pitches with a usable type and call."""
    return df.where(is_valid())


def pitcher_dates(
    df: DataFrame,
    pitchers: Iterable[str] | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Chosen pitchers (all when not given) in a closed date range (open ends when not given).

    On the store the range also bounds the partition column, so folders outside it are not opened.
    That column has a reserved name; a season column of the user is never looked at.
    """
    stored = STORE_SEASON in df.columns
    if pitchers is not None:
        df = df.where(F.col("Pitcher").isin(*pitchers))
    if date_from is not None:
        first = F.lit(date_from).cast("date")
        df = df.where(F.col("Date") >= first)
        df = df.where(F.col(STORE_SEASON) >= F.year(first)) if stored else df
    if date_to is not None:
        last = F.lit(date_to).cast("date")
        df = df.where(F.col("Date") <= last)
        df = df.where(F.col(STORE_SEASON) <= F.year(last)) if stored else df
    return df


def exclude_date(df: DataFrame, date: str = EXCLUDED_DATE) -> DataFrame:
    return df.where(F.col("Date") != F.lit(date).cast("date"))


def not_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.dropna("any", subset=list(columns))


def no_nulls(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def in_year(df: DataFrame, year: int) -> DataFrame:
    """One calendar year, as a date range the scan can use."""
    return pitcher_dates(df, None, f"{year}-01-01", f"{year}-12-31")


def out_of_zone(df: DataFrame) -> DataFrame:
    return df.where(~in_box(STRIKE_ZONE))


def in_zone(df: DataFrame) -> DataFrame:
    return df.where(in_box(STRIKE_ZONE))


def in_heart(df: DataFrame) -> DataFrame:
    return df.where(in_box(HEART_ZONE))


def min_sample(df: DataFrame, column: str, least: int) -> DataFrame:
    return df.where(F.col(column) >= least)


def both_sides(df: DataFrame) -> DataFrame:
    """Left- and right-handed batters only."""
    return df.where(in_set(F.col("BatterSide"), ("Left", "Right")))
