"""Per-pitch flags and classes: one definition for every report and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from moundlens.functions.nulls import flag, if_known, in_box, in_set, within
from moundlens.functions.text import count_label, group_label, keep_levels
from moundlens.schema import (
    BALLS, BOTTOM_BAND, CALLED_OR_SWINGING, COUNT_TYPES_V1, COUNT_TYPES_V2, FASTBALL_DIFF_TYPES,
    FOULS, FREE_PASS_WEIGHT, HITS, MODEL_CONTACT, MODEL_SWINGS, MOVEMENT_BOTTOM_BAND,
    MOVEMENT_TOP_BAND, PITCH_CLASSES, PITCH_TYPE_ORDER, REPORT_SWINGS, STRIKE_ZONE, STRIKES, TOP_BAND, WALK_BALLS,
)


def _report_conditions() -> dict[str, Column]:
    call, result = F.col("PitchCall"), F.col("PlayResult")
    in_play, hit_batter = call == "InPlay", call == "HitByPitch"
    angle = F.col("Angle")
    return {
        "TopZoneCheck": in_box(TOP_BAND),
        "BotZoneCheck": in_box(BOTTOM_BAND),
        "is_BBE": in_play,
        "is_BBE_EV": in_play & (F.col("TaggedHitType") != "Bunt"),
        "is_Swing": in_set(call, REPORT_SWINGS),
        "is_Whiff": call == "StrikeSwinging",
        "is_CSW": in_set(call, CALLED_OR_SWINGING),
        "is_Strike": in_set(call, STRIKES),
        "is_Zone": in_box(STRIKE_ZONE),
        "is_SweetSpot": in_play & within(angle, 8, 32),
        "is_HardHit": in_play & (F.col("ExitSpeed") >= 95),
        "is_CalledStrike": call == "StrikeCalled",
        "is_Ball": in_set(call, BALLS),
        "is_Foul": in_set(call, FOULS),
        "is_Hit": in_set(result, HITS),
        "is_GB": angle < 10,
        "is_FB": within(angle, 25, 50),
        "is_Single": result == "Single",
        "is_Double": result == "Double",
        "is_Triple": result == "Triple",
        "is_HR": result == "HomeRun",
        "is_Error": result == "Error",
        "is_Sac": result == "Sacrifice",
        "is_Dos": hit_batter,
        "is_Strikeout": (F.col("Strikes") == 2) & in_set(call, CALLED_OR_SWINGING),
        "is_Walk": (F.col("Balls") == 3) & in_set(call, WALK_BALLS),
    }


def pitch_flags(df: DataFrame) -> DataFrame:
    """Report profile. Flags nobody reads are pruned by the optimizer."""
    flagged = df.withColumns(_report_conditions())
    bbe, strikeout, walk, hit_batter, sac = (
        flag(F.col(name)) for name in ("is_BBE", "is_Strikeout", "is_Walk", "is_Dos", "is_Sac")
    )
    free = F.lit(FREE_PASS_WEIGHT)
    return flagged.withColumns(
        {
            "xwOBA_weights": F.col("xwOBACON_value") + walk * free + hit_batter * free,
            "is_AB": bbe + strikeout - sac,
            "is_PA": bbe + strikeout + walk + hit_batter,
        }
    )


def model_flags(df: DataFrame) -> DataFrame:
    """Pipeline profile: 1 / 0 / NULL integers, mirrored break and release side."""
    call, angle = F.col("PitchCall"), F.col("Angle")
    in_play = call == "InPlay"
    right_handed = F.col("PitcherThrows") == "Right"
    df = df.withColumns(
        {
            "is_Swing": flag(in_set(call, MODEL_SWINGS)),
            "is_Whiff": F.when(call == "StrikeSwinging", 1).when(call.isin(*MODEL_CONTACT), 0),
            "is_Foul": flag(in_set(call, FOULS)),
            "is_BBE": flag(in_play),
            "is_CalledStrike": flag(call == "StrikeCalled"),
            "is_Groundball": flag(in_play & (angle < 10)),
            "is_Linedrive": flag(in_play & within(angle, 10, 25)),
            "is_Flyball": flag(in_play & within(angle, 25, 50)),
            "is_Popup": flag(in_play & (angle > 50)),
            "is_HardHit": flag(in_play & (F.col("ExitSpeed") >= 95)),
            "is_SweetSpot": flag(in_play & within(angle, 8, 32)),
            "is_CSW": flag(in_set(call, CALLED_OR_SWINGING)),
            "BatterLoR": flag(F.col("BatterSide") == "Right"),
            "PitcherLoR": flag(right_handed),
            "HB_adjusted": if_known(right_handed, F.col("HorzBreak"), -F.col("HorzBreak")),
            "RelSide_adjusted": if_known(right_handed, F.col("RelSide"), -F.col("RelSide")),
        }
    )
    return df.withColumn("PlatoonAdv", flag(F.col("BatterLoR") == F.col("PitcherLoR")))


def fastball_diffs(df: DataFrame) -> DataFrame:
    """Distance from the pitcher's fastball of the day, for the types thrown off it."""
    off_fastball = F.col("TaggedPitchType").isin(*FASTBALL_DIFF_TYPES)
    pairs = {
        "FB_Velo_Diff": ("RelSpeed", "Fastball_Velo"),
        "FB_HB_Diff": ("HorzBreak", "Fastball_HB"),
        "FB_IVB_Diff": ("InducedVertBreak", "Fastball_IVB"),
    }
    return df.withColumns(
        {
            name: F.when(off_fastball, F.col(own) - F.col(base))
            for name, (own, base) in pairs.items()
        }
    )


def movement_bands(df: DataFrame) -> DataFrame:
    """Top and bottom band of the movement report; an unknown location counts as outside."""
    bands = {"TopZone": MOVEMENT_TOP_BAND, "BotZone": MOVEMENT_BOTTOM_BAND}
    return df.withColumns(
        {name: F.when(in_box(box), True).otherwise(False) for name, box in bands.items()}
    )


def recode_splitter(df: DataFrame) -> DataFrame:
    kind = F.col("TaggedPitchType")
    return df.withColumn("TaggedPitchType", if_known(kind == "Splitter", "ChangeUp", kind))


def pitch_type(df: DataFrame, types: tuple[str, ...] = PITCH_TYPE_ORDER) -> DataFrame:
    """The listed types; any other type becomes the NULL group."""
    return df.withColumn("pitch_type", keep_levels(F.col("TaggedPitchType"), types))


def pitch_class() -> Column:
    return group_label(F.col("TaggedPitchType"), PITCH_CLASSES, "Other")


def count_type_v1() -> Column:
    return group_label(count_label(), COUNT_TYPES_V1, "Neutral")


def count_type_v2() -> Column:
    return group_label(count_label(), COUNT_TYPES_V2, "3-0")


def platoon_side() -> Column:
    return if_known(F.col("PitcherThrows") == F.col("BatterSide"), "Same Side", "Oppo Side")
