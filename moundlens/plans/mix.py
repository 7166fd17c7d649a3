"""Pitch-mix shares, and the points and centroids behind the movement and release charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from moundlens.functions.numbers import exact_mean, ratio, round_half_up
from moundlens.functions.text import count_label
from moundlens.operators.filters import exclude_date, not_null, pitcher_dates, tagged_pitches
from moundlens.operators.flags import count_type_v2, pitch_class


def _add_shares(counted: DataFrame, within: Sequence[str]) -> DataFrame:
    """Percent of each row within its group; the group total is summed from the counts."""
    total = F.sum("pitches").over(Window.partitionBy(*within))
    return counted.withColumn("total_pitches", total).withColumn(
        "pcts", round_half_up(ratio(F.col("pitches"), F.col("total_pitches")) * F.lit(100.0), 1)
    )


def _class_counts(df: DataFrame, label: str, group: Column, dates) -> DataFrame:
    """Pitches per pitcher, label and class.

    Pitches are counted by their raw count and type; labels are put on the counted rows, a few
    hundred per pitcher, instead of on every pitch.
    """
    raw = (
        tagged_pitches(pitcher_dates(df, *dates))
        .groupBy("Pitcher", "Balls", "Strikes", "TaggedPitchType")
        .agg(F.count(F.lit(1)).alias("pitches"))
    )
    labelled = raw.withColumns({label: group, "PitchClass": pitch_class()})
    return labelled.groupBy("Pitcher", label, "PitchClass").agg(F.sum("pitches").alias("pitches"))


def _class_shares(df: DataFrame, label: str, group: Column, dates) -> DataFrame:
    counted = _class_counts(df, label, group, dates)
    return _add_shares(counted, ["Pitcher", label]).orderBy("Pitcher", label, "PitchClass")


def totals_with_detail(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    """Pitches per count, left-joined to the pitches per count and class.

    Both sides come from the same small table of counts, so only that table is shuffled.
    """
    detail = _class_counts(df, "Count", count_label(), (pitchers, date_from, date_to))
    totals = detail.groupBy("Pitcher", "Count").agg(F.sum("pitches").alias("total_pitches"))
    return totals.join(detail, ["Pitcher", "Count"], "left")


def by_count(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    return _class_shares(df, "Count", count_label(), (pitchers, date_from, date_to))


def by_count_type(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    return _class_shares(df, "CountType", count_type_v2(), (pitchers, date_from, date_to))


def by_side(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    """Type shares by batter side, with the mid-point of each slice stacked from the last type."""
    chosen = tagged_pitches(pitcher_dates(df, pitchers, date_from, date_to))
    keys = ["Pitcher", "BatterSide"]
    counted = chosen.groupBy(*keys, "TaggedPitchType").agg(F.count(F.lit(1)).alias("pitches"))
    shares = _add_shares(counted, keys)
    stacked = (
        Window.partitionBy(*keys)
        .orderBy(F.col("TaggedPitchType").desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    tenths = F.rint(F.col("pcts") * F.lit(10.0))
    return shares.withColumns(
        {
            "text_y": (F.sum(tenths).over(stacked) - tenths / F.lit(2.0)) / F.lit(10.0),
            "labels": F.concat(_plain_number(tenths), F.lit("%")),
        }
    ).orderBy(*keys, F.col("TaggedPitchType").desc_nulls_last())


def _plain_number(tenths: Column) -> Column:
    """Tenths as text without a trailing zero: 125 -> '12.5', 120 -> '12'."""
    whole, rest = F.floor(tenths / F.lit(10.0)), F.pmod(tenths.cast("long"), F.lit(10))
    return F.when(rest == 0, whole.cast("string")).otherwise(
        F.concat(whole.cast("string"), F.lit("."), rest.cast("string"))
    )


def _typed_points(df: DataFrame, dates) -> DataFrame:
    return tagged_pitches(exclude_date(pitcher_dates(df, *dates)))


def movement_points(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    """One row per pitch with all three movement measures."""
    points = _typed_points(df, (pitchers, date_from, date_to))
    measured = not_null(points, ["InducedVertBreak", "HorzBreak", "RelSpeed"])
    return measured.select(
        "PitchUID", "Pitcher", "TaggedPitchType", "HorzBreak", "InducedVertBreak", "RelSpeed"
    )


def movement_centroids(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    points = movement_points(df, pitchers, date_from, date_to)
    return points.groupBy("Pitcher", "TaggedPitchType").agg(
        F.count(F.lit(1)).alias("pitches"),
        round_half_up(exact_mean(F.col("InducedVertBreak")), 6).alias("ivb"),
        round_half_up(exact_mean(F.col("HorzBreak")), 6).alias("hb"),
    )


def release_points(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    """Release side and height of every typed pitch inside the chart limits."""
    points = _typed_points(df, (pitchers, date_from, date_to))
    return points.where(
        F.col("RelSide").between(F.lit(-4.0), F.lit(4.0))
        & F.col("RelHeight").between(F.lit(0.0), F.lit(7.0))
    ).select("PitchUID", "Pitcher", "TaggedPitchType", "RelSide", "RelHeight")


def spin_points(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    """Spin axis and rate of every typed pitch inside the chart limits."""
    points = _typed_points(df, (pitchers, date_from, date_to))
    return points.where(
        F.col("SpinAxis").between(F.lit(0.0), F.lit(360.0))
        & F.col("SpinRate").between(F.lit(1000.0), F.lit(3000.0))
    ).select("PitchUID", "Pitcher", "TaggedPitchType", "SpinAxis", "SpinRate")


def spin_centroids(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    """Plain means of axis and rate; the axis is not treated as an angle."""
    points = _typed_points(df, (pitchers, date_from, date_to))
    return points.groupBy("Pitcher", "TaggedPitchType").agg(
        F.count(F.lit(1)).alias("pitches"),
        round_half_up(exact_mean(F.col("SpinAxis")), 6).alias("spin_axis"),
        round_half_up(exact_mean(F.col("SpinRate")), 6).alias("spin_rate"),
    )
