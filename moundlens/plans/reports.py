"""Pitcher reports. Each computes every pitcher (or the chosen ones) in one job.

All of them take the pitch log, optional pitchers, and an optional closed date range. In place of
the log, the stored sums of `plans.daily` give the same rows without reading pitches.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from moundlens.functions.numbers import exact_mean, percent_text, ratio, round_half_up
from moundlens.functions.text import (
    count_label, keep_levels, level_rank, name_parts,
)
from moundlens.operators.filters import exclude_date, pitcher_dates, tagged_pitches, valid_pitches
from moundlens.operators.flags import (
    count_type_v2, movement_bands, pitch_class, pitch_flags, pitch_type,
)
from moundlens.plans.metrics import finish, merge_grains, summarize, summarize_sets
from moundlens.schema import (
    ATTACK_ZONE_ORDER, LEAGUE_AVERAGE_COLUMNS, LEAGUE_AVERAGES, LEAGUE_TYPE_ORDER,
    PITCH_CLASS_ORDER, PITCH_TYPE_ORDER,
)

_PLATE_DISCIPLINE = ["zone_pct", "swing_pct", "chase_pct"]
_PA_LEVEL = ["wobacon", "woba", "xwobacon", "xwoba"]
_OUTCOMES = ["rv_per_100", "bbe", *_PA_LEVEL]

OVERALL_METRICS = [
    "pitches", "strike_pct", "fps_pct", "csw_pct", "whiff_pct", "put_away_pct",
    *_PLATE_DISCIPLINE, "z_whiff_pct", *_OUTCOMES,
]
FULL_METRICS = [
    "pitches", "strike_pct", "fps_pct", "csw_pct", "whiff_pct", "put_away_pct",
    *_PLATE_DISCIPLINE, "z_swing_pct", "z_whiff_pct", *_OUTCOMES,
]
ZONE_METRICS = [
    "pitches", "bbe", "swing_pct", "csw_pct", "whiff_pct", "put_away_pct", "rv_per_100", "rv",
    "xwobacon", "xwoba",
]
COUNT_METRICS = [
    "pitches", "csw_pct", "whiff_pct", "strike_pct", *_PLATE_DISCIPLINE, "z_swing_pct",
    "z_whiff_pct", *_OUTCOMES,
]

REPORT_KEYS = [
    "Pitcher", "BatterSide", "pitch_type", "pitchzone", "Count", "CountType", "pitch_class",
]
# The smallest key sets from which every report can be merged.
REPORT_SETS = [
    ["Pitcher", "BatterSide", "pitch_type"],
    ["Pitcher", "Count", "CountType", "pitch_class"],
    ["Pitcher", "pitchzone"],
]
# Means of the movement report: column of the log and decimal places.
MOVEMENT_MEANS = {
    "velo": ("RelSpeed", 1),
    "ivb": ("InducedVertBreak", 1),
    "hb": ("HorzBreak", 1),
    "spin_rate": ("SpinRate", 0),
    "spin_axis": ("SpinAxis", 0),
    "rel_height": ("RelHeight", 1),
    "rel_side": ("RelSide", 1),
    "ext": ("Extension", 1),
    "wstuff_plus": ("wStuff_plus_2", 0),
    "stuff_plus": ("Stuff_plus", 0),
}
_MOVEMENT_COLUMNS = [
    "Pitcher", "pitch_type", "pitches", "velo", "max_velo", "ivb", "hb", "spin_rate", "spin_axis",
    "rel_height", "rel_side", "ext", "top_zone_vaa", "bot_zone_vaa", "wstuff_plus", "stuff_plus",
]


def labelled_pitches(
    df: DataFrame,
    pitchers: Iterable[str] | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Valid pitches with flags and every grouping label of the reports."""
    return report_labels(pitch_flags(valid_pitches(pitcher_dates(df, pitchers, date_from, date_to))))


def report_labels(flagged: DataFrame) -> DataFrame:
    return pitch_type(flagged).withColumns(
        {
            "pitchzone": keep_levels(F.col("pitchzone"), ATTACK_ZONE_ORDER),
            "Count": count_label(),
            "CountType": count_type_v2(),
            "pitch_class": keep_levels(pitch_class(), PITCH_CLASS_ORDER),
        }
    )


def add_mix(report: DataFrame, within: Sequence[str]) -> DataFrame:
    """Share of the pitches within the given keys, as text. Runs on the aggregated rows."""
    total = F.sum("pitches").over(Window.partitionBy(*within))
    return report.withColumn("mix", percent_text(ratio(F.col("pitches"), total)))


def _grain(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], dates) -> DataFrame:
    if not isinstance(df, DataFrame):  # stored daily sums
        return finish(df.sums(keys, *dates), keys, metrics)
    return finish(summarize(labelled_pitches(df, *dates), keys), keys, metrics)


def _most_used(label: str, order: Sequence[str]):
    rank = level_rank(F.col(label), tuple(order))
    return [F.col("pitches").desc_nulls_last(), rank.asc_nulls_last()]


def overall(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    dates = (pitchers, date_from, date_to)
    return _grain(df, ["Pitcher"], OVERALL_METRICS, dates).orderBy("Pitcher")


def _by_pitch_type(report: DataFrame) -> DataFrame:
    return add_mix(report, ["Pitcher"]).orderBy(
        "Pitcher", *_most_used("pitch_type", PITCH_TYPE_ORDER)
    )


def by_pitch_type(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    dates = (pitchers, date_from, date_to)
    return _by_pitch_type(_grain(df, ["Pitcher", "pitch_type"], FULL_METRICS, dates))


def by_attack_zone(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    report = _grain(df, ["Pitcher", "pitchzone"], ZONE_METRICS, (pitchers, date_from, date_to))
    return add_mix(report, ["Pitcher"]).orderBy(
        "Pitcher", *_most_used("pitchzone", ATTACK_ZONE_ORDER)
    )


def by_count(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    dates = (pitchers, date_from, date_to)
    return _grain(df, ["Pitcher", "Count"], COUNT_METRICS, dates).orderBy("Pitcher", "Count")


def by_count_type(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    keys = ["Pitcher", "CountType", "pitch_class"]
    report = _grain(df, keys, COUNT_METRICS, (pitchers, date_from, date_to))
    return report.orderBy("Pitcher", "CountType", *_most_used("pitch_class", PITCH_CLASS_ORDER))


def platoon(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    keys = ["Pitcher", "BatterSide"]
    return _grain(df, keys, FULL_METRICS, (pitchers, date_from, date_to)).orderBy(*keys)


def platoon_by_pitch_type(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    metrics = [name for name in FULL_METRICS if name != "z_swing_pct"]
    keys = ["Pitcher", "BatterSide", "pitch_type"]
    report = _grain(df, keys, metrics, (pitchers, date_from, date_to))
    return add_mix(report, ["Pitcher", "BatterSide"]).orderBy(
        "Pitcher", "BatterSide", *_most_used("pitch_type", PITCH_TYPE_ORDER)
    )


def all_grains(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    """The numbers of all seven reports from one pass over the pitches, in long form.

    Every task sums its pitches at three small grains (side and type, count and class, attack
    zone); the reports are merged from those sums. Columns outside a report's grain are NULL.
    """
    grains = {
        "overall": (0, ["Pitcher"]),
        "pitch_type": (0, ["Pitcher", "pitch_type"]),
        "platoon": (0, ["Pitcher", "BatterSide"]),
        "platoon_pitch_type": (0, ["Pitcher", "BatterSide", "pitch_type"]),
        "count": (1, ["Pitcher", "Count"]),
        "count_type": (1, ["Pitcher", "CountType", "pitch_class"]),
        "attack_zone": (2, ["Pitcher", "pitchzone"]),
    }
    if isinstance(df, DataFrame):
        summary = summarize_sets(labelled_pitches(df, pitchers, date_from, date_to), REPORT_SETS)
    else:
        summary = df.days(pitchers, date_from, date_to)
    merged = merge_grains(summary, REPORT_KEYS, grains)
    return finish(merged, ["report", *REPORT_KEYS], [*FULL_METRICS, "rv"])


def movement(
    df, pitchers=None, date_from=None, date_to=None, types=PITCH_TYPE_ORDER, hands: bool = False
) -> DataFrame:
    """Velocity, break, spin, release, approach angle and pitch models by pitch type.

    `hands` adds how many of the pitches are thrown with either hand.
    """
    sides = ("Right", "Left") if hands else ()
    if isinstance(df, DataFrame):
        report = _movement(df, (pitchers, date_from, date_to), types, sides)
    else:
        report = df.movement(types, sides, pitchers, date_from, date_to)
    handed = [f"{side.lower()}_handed" for side in sides]
    return add_mix(report.select(*_MOVEMENT_COLUMNS, *handed), ["Pitcher"]).orderBy(
        "Pitcher", *_most_used("pitch_type", types)
    )


def _movement(df: DataFrame, dates, types: tuple[str, ...], sides: Sequence[str]) -> DataFrame:
    chosen = exclude_date(pitcher_dates(df, *dates))
    typed = movement_bands(pitch_type(tagged_pitches(chosen), types))
    vaa = F.col("VertApprAngle")

    def band_mean(band: str):
        return round_half_up(exact_mean(F.when(F.col(band), vaa)), 2)

    return typed.groupBy("Pitcher", "pitch_type").agg(
        F.count(F.lit(1)).alias("pitches"),
        round_half_up(F.max("RelSpeed"), 1).alias("max_velo"),
        *(
            round_half_up(exact_mean(F.col(column)), digits).alias(name)
            for name, (column, digits) in MOVEMENT_MEANS.items()
        ),
        band_mean("TopZone").alias("top_zone_vaa"),
        band_mean("BotZone").alias("bot_zone_vaa"),
        *(F.count_if(F.col("PitcherThrows") == side).alias(f"{side.lower()}_handed") for side in sides),
    )


def pitcher_names(df, pitchers=None, date_from=None, date_to=None, dated=True) -> DataFrame:
    """Display name and pitch count, before any pitch is filtered out.

    Tables count inside the date range (`dated`), charts over all dates.
    """
    dates = (pitchers, *((date_from, date_to) if dated else ()))
    first, last = name_parts("Pitcher")
    if isinstance(df, DataFrame):
        counted = pitcher_dates(df, *dates).groupBy("Pitcher").agg(F.count(F.lit(1)).alias("pitches"))
    else:
        counted = df.names(*dates)
    return counted.withColumns({"first_name": first, "last_name": last}).orderBy("Pitcher")


def league_averages(spark: SparkSession) -> DataFrame:
    """Average pitch characteristics, seven types for each hand."""
    types = ["string"] * 2 + ["double"] * 3 + ["int"] * 2 + ["double"] * 5
    schema = ", ".join(f"{n} {t}" for n, t in zip(LEAGUE_AVERAGE_COLUMNS, types, strict=True))
    return spark.createDataFrame(LEAGUE_AVERAGES, schema)


def league_comparison(df, pitchers=None, date_from=None, date_to=None) -> DataFrame:
    """Movement report against the league, by hand and pitch type: own value minus league value.

    A pitcher's hand is the more frequent one of the chosen pitches, Right on a tie; it is counted
    in the same scan as the report. All seven league types are compared.
    """
    own = movement(df, pitchers, date_from, date_to, LEAGUE_TYPE_ORDER, hands=True)
    whole = Window.partitionBy("Pitcher")
    right, left = (F.sum(f"{side}_handed").over(whole) for side in ("right", "left"))
    own = own.withColumn(
        "p_throws", F.when(right + left > 0, F.when(right >= left, F.lit("Right")).otherwise(F.lit("Left")))
    )
    league = league_averages(df.sparkSession).withColumn(
        "pitch_type",
        F.when(F.col("pitch_type") == "Changeup", "ChangeUp").otherwise(F.col("pitch_type")),
    )
    pairs = {
        "velo": "velo", "ivb": "ivb", "hb": "hb", "spin_rate": "spinrate", "spin_axis": "spinaxis",
        "rel_height": "relht", "rel_side": "relsi", "ext": "ext", "top_zone_vaa": "topvaa",
        "bot_zone_vaa": "botvaa",
    }
    compared = own.alias("own").join(
        F.broadcast(league.alias("league")), ["p_throws", "pitch_type"]
    )
    return compared.select(
        "Pitcher",
        "p_throws",
        "pitch_type",
        "pitches",
        *[
            round_half_up(F.col(f"own.{mine}") - F.col(f"league.{theirs}"), 2).alias(
                f"{mine}_diff"
            )
            for mine, theirs in pairs.items()
        ],
    ).orderBy("Pitcher", level_rank(F.col("pitch_type"), LEAGUE_TYPE_ORDER))
