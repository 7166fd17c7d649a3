"""Column contract of the pitch log and the fixed vocabularies the rules refer to."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _INT, _DOUBLE = T.StringType(), T.IntegerType(), T.DoubleType()


def _fields(names: str, dtype: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, dtype, True) for name in names.split()]


PITCH_SCHEMA = T.StructType(
    _fields("PitchUID", _STRING)
    + _fields("Date", T.DateType())
    + _fields("gameID", _STRING)
    + _fields("Inning Outs", _INT)
    + _fields(
        "Level Pitcher PitcherTeam PitcherThrows Batter BatterTeam BatterSide Catcher", _STRING
    )
    + _fields("Balls Strikes PitchofPA", _INT)
    + _fields("PitchCall TaggedPitchType TaggedHitType PlayResult", _STRING)
    + _fields(
        "RelSpeed HorzBreak InducedVertBreak SpinRate SpinAxis RelHeight RelSide Extension "
        "VertApprAngle PlateLocSide PlateLocHeight ExitSpeed Angle",
        _DOUBLE,
    )
    + _fields("pitchzone", _STRING)
    + _fields("Run_Value Stuff_plus wStuff_plus_2 xwOBACON_value woba_value", _DOUBLE)
    + _fields("woba_denom", _INT)
)
PITCH_COLUMNS = PITCH_SCHEMA.names

# Box limits in feet, both ends included, as (height low, high, side low, high).
STRIKE_ZONE = (1.6, 3.5, -0.85, 0.85)
HEART_ZONE = (1.83, 3.17, -0.56, 0.56)
TOP_BAND = (2.9, 3.75, -1.15, 1.15)
BOTTOM_BAND = (1.35, 2.2, -1.15, 1.15)
MOVEMENT_TOP_BAND = (2.90, 3.75, -1.15, 1.15)
MOVEMENT_BOTTOM_BAND = (1.4, 2.15, -1.15, 1.15)

# Pitch-call sets of the report profile.
REPORT_SWINGS = ("FoulBallNotFieldable", "FoulBall", "StrikeSwinging", "InPlay")
STRIKES = ("StrikeSwinging", "FoulBall", "FoulBallNotFieldable", "InPlay", "StrikeCalled")
CALLED_OR_SWINGING = ("StrikeSwinging", "StrikeCalled")
BALLS = ("BallCalled", "BallinDirt", "HitByPitch")
WALK_BALLS = ("BallCalled", "BallinDirt")
FOULS = ("FoulBallNotFieldable", "FoulBall", "FoulBallFieldable")
HITS = ("Single", "Double", "Triple", "HomeRun")
FREE_PASS_WEIGHT = 0.7

# Pitch-call sets of the model profile.
MODEL_SWINGS = ("InPlay", "FoulBall", "StrikeSwinging")
MODEL_CONTACT = ("InPlay", "FoulBall")

# Partition column of the store; no pitch log has a column of this name.
STORE_SEASON = "_store_season"
# Columns that season files lack and that later steps, or the reader, add.
LATER_COLUMNS = (
    "PitchUID", "woba_value", "woba_denom", "Run_Value", "pitchzone", "Stuff_plus",
    "wStuff_plus_2", "xwOBACON_value", "xwOBA_weights",
)

# Label orders. A label that is not listed counts as missing.
PITCH_TYPE_ORDER = ("Fastball", "Sinker", "Cutter", "Slider", "Curveball", "ChangeUp")
LEAGUE_TYPE_ORDER = (*PITCH_TYPE_ORDER, "Splitter")
ATTACK_ZONE_ORDER = ("Heart", "Shadow", "Chase", "Waste")
PITCH_CLASS_ORDER = ("Fastball", "Breaking Ball", "Off-speed")

# Pitch types behind each class of the reports.
PITCH_CLASSES = {
    "Fastball": ("Fastball", "Sinker"),
    "Breaking Ball": ("Slider", "Curveball", "Slurve", "Cutter"),
    "Off-speed": ("ChangeUp", "Splitter"),
}

# Counts behind each count type.
COUNT_TYPES_V1 = {
    "Behind": ("1-0", "2-0", "3-0", "2-1", "3-1", "3-2"),
    "Ahead": ("0-1", "0-2", "1-2", "2-2"),
}
COUNT_TYPES_V2 = {
    "'Fastball Count'": ("1-0", "2-0", "2-1", "3-1"),
    "Ahead": ("0-1", "0-2", "1-2", "2-2"),
    "Even": ("0-0", "1-1", "3-2"),
}

# Pitch types the swing pipeline reads, and keeps after recoding.
PIPELINE_TYPES = ("Fastball", "ChangeUp", "Curveball", "Slider", "Sinker", "Cutter", "Splitter")
MODEL_TYPES = ("Fastball", "Curveball", "ChangeUp", "Cutter", "Sinker", "Slider")
FASTBALL_TYPES = ("Fastball", "Sinker")
FASTBALL_DIFF_TYPES = ("Curveball", "ChangeUp", "Slider", "Cutter")

# Features per swing-model class.
FASTBALL_FEATURES = (
    "RelSpeed", "InducedVertBreak", "HB_adjusted", "SpinAxis", "SpinRate", "RelHeight",
    "RelSide_adjusted", "Extension", "PlateLocHeight", "PlateLocSide", "Balls", "Strikes",
    "PlatoonAdv",
)
DIFF_FEATURES = ("FB_Velo_Diff", "FB_IVB_Diff", "FB_HB_Diff")
SWING_CLASSES = {
    "Fastball": (("Fastball", "Sinker"), FASTBALL_FEATURES),
    "BreakingBall": (("Slider", "Curveball", "Cutter"), FASTBALL_FEATURES + DIFF_FEATURES),
    "Offspeed": (("ChangeUp",), FASTBALL_FEATURES + DIFF_FEATURES),
}
SWING_DEPTHS = {"Fastball": 3, "BreakingBall": 3, "Offspeed": 4}

# The date left out of movement and release views.
EXCLUDED_DATE = "2023-10-06"

# League averages per hand and pitch type.
LEAGUE_AVERAGE_COLUMNS = (
    "p_throws", "pitch_type", "velo", "ivb", "hb", "spinrate", "spinaxis", "relht", "relsi", "ext",
    "topvaa", "botvaa",
)
LEAGUE_AVERAGES = (
    ("Right", "Fastball", 94.1, 16.1, 7.2, 2282, 213, 5.8, 1.8, 6.4, -4.27, -5.80),
    ("Right", "Slider", 84.8, 1.9, -7.1, 2448, 106, 5.7, 1.9, 6.3, -6.28, -7.79),
    ("Right", "Sinker", 93.7, 8.6, 14.9, 2156, 223, 5.6, 1.9, 6.3, -4.84, -6.41),
    ("Right", "Curveball", 79.9, -9.6, -9.2, 2542, 44, 5.9, 1.7, 6.3, -8.38, -9.68),
    ("Right", "Changeup", 86.0, 5.9, 14.1, 1760, 238, 5.8, 1.9, 6.4, -5.94, -7.38),
    ("Right", "Cutter", 89.6, 8.1, -2.8, 2400, 179, 5.9, 1.8, 6.3, -5.36, -7.01),
    ("Right", "Splitter", 87.3, 3.9, 11.5, 1432, 232, 5.9, 1.8, 6.3, -6.17, -7.62),
    ("Left", "Fastball", 93.0, 16.0, -7.5, 2248, 146, 5.9, -1.8, 6.4, -4.44, -5.99),
    ("Left", "Slider", 84.0, 1.7, 6.6, 2377, 246, 5.8, -2.1, 6.2, -6.45, -8.00),
    ("Left", "Sinker", 92.6, 9.1, -15.0, 2102, 134, 5.7, -2.1, 6.3, -4.87, -6.59),
    ("Left", "Curveball", 78.5, -8.2, 8.6, 2452, 306, 6.0, 1.8, 6.2, -8.46, -9.65),
    ("Left", "Changeup", 84.1, 6.8, -14.3, 1718, 121, 5.8, 2.0, 6.3, -5.95, -7.49),
    ("Left", "Cutter", 87.2, 7.7, 1.7, 2289, 172, 5.8, 2.0, 6.2, -5.46, -7.10),
    ("Left", "Splitter", 84.2, 4.2, -8.6, 1041, 120, 5.8, 1.5, 6.6, -6.45, -7.62),
)

# Columns of the model table, and those of the scored table in its natural join.
MODEL_COLUMNS = [
    "PitchUID", "Date", "Pitcher", "PitcherTeam", "Inning", "Balls", "Strikes", "PitchCall",
    "Outs", "PitcherThrows", "Batter", "BatterSide", "BatterTeam", "TaggedPitchType", "RelSpeed",
    "PlateLocHeight", "PlateLocSide", "HB_adjusted", "InducedVertBreak", "SpinRate", "SpinAxis",
    "RelSide_adjusted", "RelHeight", "Extension", "FB_Velo_Diff", "FB_HB_Diff", "FB_IVB_Diff",
    "Type", "woba_denom", "woba_value", "Event", "Count", "new_Count", "Run_Value", "is_Swing",
    "is_Whiff", "is_Foul", "is_BBE", "is_CalledStrike", "is_Groundball", "is_Linedrive",
    "is_Flyball", "is_Popup", "is_HardHit", "is_SweetSpot", "BatterLoR", "PitcherLoR",
    "PlatoonAdv", "ExitSpeed", "Angle", "PlayResult", "gameID", "Catcher",
]
SCORED_COLUMNS = [
    "RelSpeed", "HB_adjusted", "InducedVertBreak", "SpinRate", "SpinAxis", "RelSide_adjusted",
    "RelHeight", "Extension", "PlateLocHeight", "PlateLocSide", "PlatoonAdv", "Balls", "Strikes",
    "is_Swing", "xSwing_Pred",
]
