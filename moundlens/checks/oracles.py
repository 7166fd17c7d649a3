"""SQL for the registered queries, written from the rules and run by another engine.

Each text starts with the CTEs that derive the pitch log, then states the result.
"""

from __future__ import annotations

from moundlens.checks.fixture import FIXTURE_CTES
from moundlens.schema import (
    FASTBALL_FEATURES, DIFF_FEATURES, LEAGUE_AVERAGE_COLUMNS, LEAGUE_AVERAGES, PITCH_COLUMNS, PITCH_SCHEMA,
    SCORED_COLUMNS,
)

_ORACLES: dict[str, str] = {}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)


def _sql(name: str, select: str, *ctes: str) -> None:
    _ORACLES[name] = ",\n".join([FIXTURE_CTES, *ctes]) + "\n" + select.strip()


def _r(expr: str, digits: int) -> str:
    return f"floor(({expr}) * 1e{digits} + 5e-1) / 1e{digits}"


def _avg(expr: str, where: str | None = None) -> str:
    keep = f" FILTER (WHERE {where})" if where else ""
    return f"(sum(floor(({expr}) * 1e9 + 5e-1)){keep} / nullif(count({expr}){keep}, 0) / 1e9)"


def _total(expr: str) -> str:
    return f"(sum(floor(({expr}) * 1e9 + 5e-1)) / 1e9)"


def _n(where: str) -> str:
    return f"count(*) FILTER (WHERE {where})"


def _share(part: str, whole: str) -> str:
    return _r(f"{_n(part)} / nullif({_n(whole)}, 0)", 5)


def _percent(expr: str) -> str:
    return f"printf('%.1f%%', floor(({expr}) * 1e3 + 5e-1) / 1e1)"


def _quoted(*labels: str) -> str:
    return ", ".join("'" + label.replace("'", "''") + "'" for label in labels)


TYPES = ("Fastball", "Sinker", "Cutter", "Slider", "Curveball", "ChangeUp")
ZONE = "(PlateLocHeight BETWEEN 16e-1 AND 35e-1 AND PlateLocSide BETWEEN -85e-2 AND 85e-2)"
HEART = "(PlateLocHeight BETWEEN 183e-2 AND 317e-2 AND PlateLocSide BETWEEN -56e-2 AND 56e-2)"
TYPED = "TaggedPitchType <> 'Undefined' AND TaggedPitchType <> 'Other'"
COUNT = (
    "concat(coalesce(CAST(Balls AS VARCHAR), 'NA'), '-', coalesce(CAST(Strikes AS VARCHAR), 'NA'))"
)
CLASS = """CASE WHEN TaggedPitchType IN ('Fastball', 'Sinker') THEN 'Fastball'
  WHEN TaggedPitchType IN ('Slider', 'Curveball', 'Slurve', 'Cutter') THEN 'Breaking Ball'
  WHEN TaggedPitchType IN ('ChangeUp', 'Splitter') THEN 'Off-speed' ELSE 'Other' END"""
COUNT_V1 = f"""CASE WHEN {COUNT} IN ('1-0', '2-0', '3-0', '2-1', '3-1', '3-2') THEN 'Behind'
  WHEN {COUNT} IN ('0-1', '0-2', '1-2', '2-2') THEN 'Ahead' ELSE 'Neutral' END"""
COUNT_V2 = f"""CASE WHEN {COUNT} IN ('1-0', '2-0', '2-1', '3-1') THEN '''Fastball Count'''
  WHEN {COUNT} IN ('0-1', '0-2', '1-2', '2-2') THEN 'Ahead'
  WHEN {COUNT} IN ('0-0', '1-1', '3-2') THEN 'Even' ELSE '3-0' END"""
LISTED_TYPE = f"CASE WHEN TaggedPitchType IN ({_quoted(*TYPES)}) THEN TaggedPitchType END"

# --- sources and sinks

_FX1 = ", ".join(PITCH_COLUMNS)


def _kind(field) -> str:
    """Narrowest type of a column's values as text."""
    kind = field.dataType.simpleString()
    if kind != "string":
        return f"'{kind}'"
    whole = f"bool_and(regexp_full_match({field.name}, '[+-]?[0-9]+'))"
    return f"CASE WHEN {whole} THEN 'int' ELSE 'string' END"


_sql("scan_csv", f"SELECT {_FX1} FROM pitches")
_sql(
    "inferred_types",
    "\nUNION ALL ".join(
        f"""SELECT '{f.name}' AS name, CASE WHEN count({f.name}) = 0 THEN 'string' ELSE {_kind(f)} END AS kind FROM pitches"""
        for f in PITCH_SCHEMA
    ),
)
_sql(
    "quarantined_records",
    """SELECT PitchUID, CASE md5(PitchUID)[1] WHEN '0' THEN 'Balls' WHEN '1' THEN 'Date,RelSpeed'
  WHEN '2' THEN 'RelSpeed' ELSE '' END AS problems FROM pitches""",
)
_sql("season_loads", f"SELECT {_FX1} FROM pitches")
_sql("align_schema", f"SELECT {_FX1} FROM pitches")
_sql(
    "sink_csv",
    f"SELECT {_FX1}, is_Swing, xSwing_Pred FROM pitches"
    if "is_Swing" not in PITCH_COLUMNS
    else f"SELECT {_FX1} FROM pitches",
)

# --- projections and filters

_sql("project_cols", "SELECT PitchUID, Batter, BatterTeam, woba_value, woba_denom FROM pitches")
_sql("drop_cols", "SELECT PitchUID, RelSpeed, SpinRate, PlateLocSide FROM pitches")

_REPORT_FLAGS = f"""
  coalesce(PitchCall IN ('FoulBallNotFieldable', 'FoulBall', 'StrikeSwinging', 'InPlay'), FALSE) AS f_swing,
  coalesce(PitchCall IN ('StrikeSwinging', 'StrikeCalled'), FALSE) AS f_csw,
  coalesce(PitchCall IN ('StrikeSwinging', 'FoulBall', 'FoulBallNotFieldable', 'InPlay', 'StrikeCalled'), FALSE) AS f_strike,
  PitchCall = 'StrikeSwinging' AS f_whiff,
  PitchCall = 'InPlay' AS f_bbe,
  PitchCall = 'HitByPitch' AS f_hbp,
  PlayResult = 'Sacrifice' AS f_sac,
  Strikes = 2 AND coalesce(PitchCall IN ('StrikeSwinging', 'StrikeCalled'), FALSE) AS f_k,
  Balls = 3 AND coalesce(PitchCall IN ('BallCalled', 'BallinDirt'), FALSE) AS f_bb,
  {ZONE} AS f_zone"""
_FLAGGED_ALL = f"marked AS (SELECT *, {_REPORT_FLAGS} FROM pitches)"
_FLAGGED = f"""valid AS (
  SELECT *, {_REPORT_FLAGS}, {LISTED_TYPE} AS pitch_type
  FROM pitches WHERE PitchCall <> 'Undefined' AND {TYPED}),
flagged AS (
  SELECT *, CAST(f_bbe AS INT) + CAST(f_k AS INT) + CAST(f_bb AS INT) + CAST(f_hbp AS INT) = 1 AS f_pa,
    xwOBACON_value + CASE WHEN f_bb THEN 7e-1 ELSE 0e0 END + CASE WHEN f_hbp THEN 7e-1 ELSE 0e0 END AS xw_all
  FROM valid)"""

_sql(
    "pitch_flags",
    """SELECT PitchUID,
  PlateLocSide BETWEEN -115e-2 AND 115e-2 AND PlateLocHeight BETWEEN 29e-1 AND 375e-2 AS TopZoneCheck,
  PlateLocSide BETWEEN -115e-2 AND 115e-2 AND PlateLocHeight BETWEEN 135e-2 AND 22e-1 AS BotZoneCheck,
  f_bbe AS is_BBE, f_bbe AND TaggedHitType <> 'Bunt' AS is_BBE_EV, f_swing AS is_Swing,
  f_whiff AS is_Whiff, f_csw AS is_CSW, f_strike AS is_Strike, f_zone AS is_Zone,
  f_bbe AND Angle BETWEEN 8e0 AND 32e0 AS is_SweetSpot, f_bbe AND ExitSpeed >= 95e0 AS is_HardHit,
  PitchCall = 'StrikeCalled' AS is_CalledStrike,
  PitchCall IS NOT NULL AND PitchCall IN ('BallCalled', 'BallinDirt', 'HitByPitch') AS is_Ball,
  PitchCall IS NOT NULL AND PitchCall IN ('FoulBallNotFieldable', 'FoulBall', 'FoulBallFieldable') AS is_Foul,
  PlayResult IS NOT NULL AND PlayResult IN ('Single', 'Double', 'Triple', 'HomeRun') AS is_Hit,
  Angle < 10e0 AS is_GB, Angle BETWEEN 25e0 AND 50e0 AS is_FB,
  PlayResult = 'Single' AS is_Single, PlayResult = 'Double' AS is_Double,
  PlayResult = 'Triple' AS is_Triple, PlayResult = 'HomeRun' AS is_HR,
  PlayResult = 'Error' AS is_Error, f_sac AS is_Sac, f_hbp AS is_Dos, f_k AS is_Strikeout,
  f_bb AS is_Walk,
  xwOBACON_value + CAST(f_bb AS INT) * 7e-1 + CAST(f_hbp AS INT) * 7e-1 AS xwOBA_weights,
  CAST(f_bbe AS INT) + CAST(f_k AS INT) - CAST(f_sac AS INT) AS is_AB,
  CAST(f_bbe AS INT) + CAST(f_k AS INT) + CAST(f_bb AS INT) + CAST(f_hbp AS INT) AS is_PA
FROM marked""",
    _FLAGGED_ALL,
)
_sql(
    "recode_pitch_type",
    """SELECT PitchUID, CASE TaggedPitchType WHEN 'Splitter' THEN 'ChangeUp' ELSE TaggedPitchType END
  AS TaggedPitchType FROM pitches""",
)
_sql("filter_level", "SELECT PitchUID, Level FROM pitches WHERE Level = 'D1'")
_sql(
    "filter_membership",
    """SELECT PitchUID, TaggedPitchType FROM pitches WHERE TaggedPitchType IN
  ('Fastball', 'ChangeUp', 'Curveball', 'Slider', 'Sinker', 'Cutter', 'Splitter')""",
)
_sql(
    "filter_valid_pitches",
    f"""SELECT PitchUID, PitchCall, TaggedPitchType FROM pitches
WHERE PitchCall <> 'Undefined' AND {TYPED}""",
)
_RANGE = "Date >= DATE '2022-03-03' AND Date <= DATE '2023-04-10'"
_sql("filter_pitcher_dates", f"SELECT PitchUID, Pitcher, Date FROM pitches WHERE {_RANGE}")
_sql("filter_excluded_date", "SELECT PitchUID, Date FROM pitches WHERE Date <> DATE '2023-10-06'")
_sql(
    "filter_not_null",
    """SELECT PitchUID, RelSpeed, InducedVertBreak, HorzBreak, SpinAxis FROM pitches
WHERE RelSpeed IS NOT NULL AND InducedVertBreak IS NOT NULL AND HorzBreak IS NOT NULL
  AND SpinAxis IS NOT NULL""",
)
_sql(
    "drop_any_null",
    """SELECT PitchUID, RelSpeed, SpinRate, PlateLocSide, PlateLocHeight, PitchCall FROM pitches
WHERE RelSpeed IS NOT NULL AND SpinRate IS NOT NULL AND PlateLocSide IS NOT NULL
  AND PlateLocHeight IS NOT NULL AND PitchCall IS NOT NULL""",
)
_sql("filter_year", "SELECT PitchUID, Date FROM pitches WHERE year(Date) = 2023")
_sql(
    "zone_filter",
    f"""SELECT PitchUID, CASE WHEN {ZONE} THEN 'in' ELSE 'out' END AS zone FROM pitches
WHERE {ZONE} IS NOT NULL""",
)
_sql("heart_filter", f"SELECT PitchUID, PlateLocSide, PlateLocHeight FROM pitches WHERE {HEART}")
_SIDE = "PlateLocSide BETWEEN -115e-2 AND 115e-2"
_sql(
    "zone_bands",
    f"""SELECT PitchUID,
  {_SIDE} AND PlateLocHeight BETWEEN 29e-1 AND 375e-2 AS TopZoneCheck,
  {_SIDE} AND PlateLocHeight BETWEEN 135e-2 AND 22e-1 AS BotZoneCheck,
  coalesce({_SIDE} AND PlateLocHeight BETWEEN 29e-1 AND 375e-2, FALSE) AS TopZone,
  coalesce({_SIDE} AND PlateLocHeight BETWEEN 14e-1 AND 215e-2, FALSE) AS BotZone
FROM pitches""",
)
_sql(
    "having_min_sample",
    """SELECT Pitcher, count(*) AS pitches FROM pitches
GROUP BY Pitcher HAVING count(*) >= 100""",
)

# --- joins

_PIPELINE = """pipeline AS (
  SELECT * FROM pitches WHERE Level = 'D1' AND TaggedPitchType IN
    ('Fastball', 'ChangeUp', 'Curveball', 'Slider', 'Sinker', 'Cutter', 'Splitter'))"""
_BASELINE = f"""baseline AS (
  SELECT Pitcher, PitcherThrows, PitcherTeam, Date, {_avg("RelSpeed")} AS Fastball_Velo,
    {_avg("HorzBreak")} AS Fastball_HB, {_avg("InducedVertBreak")} AS Fastball_IVB
  FROM pipeline WHERE TaggedPitchType IN ('Fastball', 'Sinker') GROUP BY ALL)"""
_BASED = """based AS (
  SELECT p.*, b.Fastball_Velo, b.Fastball_HB, b.Fastball_IVB FROM pipeline p JOIN baseline b
    ON p.Pitcher IS NOT DISTINCT FROM b.Pitcher
    AND p.PitcherThrows IS NOT DISTINCT FROM b.PitcherThrows
    AND p.PitcherTeam IS NOT DISTINCT FROM b.PitcherTeam AND p.Date IS NOT DISTINCT FROM b.Date)"""
_sql(
    "join_fastball_baseline",
    "SELECT PitchUID, Pitcher, Date, Fastball_Velo, Fastball_HB, Fastball_IVB FROM based",
    _PIPELINE, _BASELINE, _BASED,
)
_FINALS = """finals AS (
  SELECT PitchUID, Batter, BatterTeam,
    CASE WHEN PitcherThrows = BatterSide THEN 'Same Side' ELSE 'Oppo Side' END AS Platoon_Advantage,
    woba_value, woba_denom
  FROM pitches WHERE Level = 'D1' AND PitcherThrows IN ('Left', 'Right')
    AND BatterSide IN ('Left', 'Right') AND woba_denom = 1)"""
_COUNTS = """counts AS (
  SELECT Batter, BatterTeam, count(*) AS PA,
    CAST(coalesce(sum(CASE WHEN Platoon_Advantage = 'Same Side' THEN woba_denom END), 0) AS BIGINT) AS Same_Side_PA,
    CAST(coalesce(sum(CASE WHEN Platoon_Advantage = 'Oppo Side' THEN woba_denom END), 0) AS BIGINT) AS Oppo_Side_PA
  FROM finals GROUP BY Batter, BatterTeam)"""
_sql("join_pa_counts", "SELECT * FROM finals JOIN counts USING (Batter, BatterTeam)", _FINALS, _COUNTS)


def _splits(source: str) -> str:
    return f"""splits AS (
  SELECT Batter, BatterTeam, Platoon_Advantage, count(*) AS PA, {_avg("woba_value")} AS wOBA
  FROM {source} GROUP BY Batter, BatterTeam, Platoon_Advantage)"""


_PAIRED = """paired AS (
  SELECT o.Batter, o.BatterTeam, o.PA AS oppo_pa, o.wOBA AS oppo_woba, s.PA AS same_pa,
    s.wOBA AS same_woba
  FROM (SELECT * FROM splits WHERE Platoon_Advantage = 'Oppo Side') o
  JOIN (SELECT * FROM splits WHERE Platoon_Advantage = 'Same Side') s
    ON o.Batter = s.Batter AND o.BatterTeam = s.BatterTeam)"""
_sql("paired_split_join", "SELECT * FROM paired", _FINALS, _splits("finals"), _PAIRED)
_sql(
    "left_join_totals",
    """SELECT t.Pitcher, t.Count, t.total_pitches, d.PitchClass, d.pitches
FROM (SELECT Pitcher, Count, count(*) AS total_pitches FROM counted GROUP BY ALL) t
LEFT JOIN (SELECT Pitcher, Count, PitchClass, count(*) AS pitches FROM counted GROUP BY ALL) d
  ON t.Pitcher = d.Pitcher AND t.Count = d.Count""",
    f"counted AS (SELECT Pitcher, {COUNT} AS Count, {CLASS} AS PitchClass FROM pitches WHERE {TYPED})",
)

_IN_PLAY = "PitchCall = 'InPlay'"
_MODEL_FLAGS = f"""
  CASE WHEN PitchCall IN ('InPlay', 'FoulBall', 'StrikeSwinging') THEN 1 ELSE 0 END AS m_swing,
  CASE WHEN PitchCall = 'StrikeSwinging' THEN 1 WHEN PitchCall IN ('InPlay', 'FoulBall') THEN 0 END AS is_Whiff,
  CASE WHEN PitchCall IN ('FoulBall', 'FoulBallFieldable', 'FoulBallNotFieldable') THEN 1 ELSE 0 END AS is_Foul,
  CAST({_IN_PLAY} AS INT) AS is_BBE, CAST(PitchCall = 'StrikeCalled' AS INT) AS is_CalledStrike,
  CAST({_IN_PLAY} AND Angle < 10e0 AS INT) AS is_Groundball,
  CAST({_IN_PLAY} AND Angle BETWEEN 10e0 AND 25e0 AS INT) AS is_Linedrive,
  CAST({_IN_PLAY} AND Angle BETWEEN 25e0 AND 50e0 AS INT) AS is_Flyball,
  CAST({_IN_PLAY} AND Angle > 50e0 AS INT) AS is_Popup,
  CAST({_IN_PLAY} AND ExitSpeed >= 95e0 AS INT) AS is_HardHit,
  CAST({_IN_PLAY} AND Angle BETWEEN 8e0 AND 32e0 AS INT) AS is_SweetSpot,
  CASE WHEN PitchCall IN ('StrikeSwinging', 'StrikeCalled') THEN 1 ELSE 0 END AS is_CSW,
  CAST(BatterSide = 'Right' AS INT) AS BatterLoR, CAST(PitcherThrows = 'Right' AS INT) AS PitcherLoR,
  CAST((BatterSide = 'Right') = (PitcherThrows = 'Right') AS INT) AS PlatoonAdv,
  CASE WHEN PitcherThrows = 'Right' THEN HorzBreak WHEN PitcherThrows <> 'Right' THEN -HorzBreak END AS HB_adjusted,
  CASE WHEN PitcherThrows = 'Right' THEN RelSide WHEN PitcherThrows <> 'Right' THEN -RelSide END AS RelSide_adjusted"""
_EVENT = """CASE WHEN Strikes = 2 AND PitchCall IN ('StrikeSwinging', 'StrikeCalled') THEN 'strikeout'
    WHEN Balls = 3 AND PitchCall IN ('BallCalled', 'BallinDirt') THEN 'walk'
    WHEN PitchCall = 'HitByPitch' THEN 'hit_by_pitch' WHEN PitchCall = 'InPlay' THEN PlayResult END"""
_TYPE = """CASE WHEN PitchCall = 'InPlay' THEN 'X'
    WHEN PitchCall IN ('BallCalled', 'BallinDirt', 'HitByPitch') THEN 'B'
    WHEN PitchCall IS NOT NULL THEN 'S' END"""
_NEW_COUNT = f"""CASE WHEN ({_EVENT}) IS NOT NULL THEN NULL
    WHEN PitchCall IN ('BallCalled', 'BallinDirt') THEN concat(Balls + 1, '-', Strikes)
    WHEN PitchCall IN ('StrikeSwinging', 'StrikeCalled') THEN concat(Balls, '-', Strikes + 1)
    WHEN PitchCall IN ('FoulBallNotFieldable', 'FoulBall', 'FoulBallFieldable')
      THEN concat(Balls, '-', least(Strikes + 1, 2)) END"""
_PLAYS = f"""plays AS (
  SELECT *, {_EVENT} AS Event, {_TYPE} AS Type, {COUNT} AS Count, {_NEW_COUNT} AS new_Count
  FROM pitches)"""
_WEIGHTS = f"""event_w AS (
  SELECT Event AS w_event, {_r(_avg("woba_value"), 4)} AS w_woba FROM plays
  WHERE Event IS NOT NULL GROUP BY Event),
run_w AS (
  SELECT Balls AS w_balls, Strikes AS w_strikes, coalesce(Event, Type) AS w_what,
    {_r(_avg("Run_Value"), 4)} AS w_run
  FROM plays WHERE coalesce(Event, Type) IS NOT NULL GROUP BY ALL)"""
_sql(
    "event_weights_join",
    """SELECT PitchUID, Event, Type, Count, new_Count, w_woba AS woba_value,
  CASE WHEN w_event IS NULL THEN 0 ELSE 1 END AS woba_denom, w_run AS Run_Value
FROM plays LEFT JOIN event_w ON Event = w_event
LEFT JOIN run_w ON Balls = w_balls AND Strikes = w_strikes AND coalesce(Event, Type) = w_what""",
    _PLAYS, _WEIGHTS,
)

_OFF_FASTBALL = "TaggedPitchType IN ('Curveball', 'ChangeUp', 'Slider', 'Cutter')"
_READY = f"""recoded AS (
  SELECT * REPLACE (CASE WHEN TaggedPitchType = 'Splitter' THEN 'ChangeUp' ELSE TaggedPitchType END
    AS TaggedPitchType) FROM based),
ready AS (
  SELECT *, {_MODEL_FLAGS},
    CASE WHEN {_OFF_FASTBALL} THEN RelSpeed - Fastball_Velo END AS FB_Velo_Diff,
    CASE WHEN {_OFF_FASTBALL} THEN HorzBreak - Fastball_HB END AS FB_HB_Diff,
    CASE WHEN {_OFF_FASTBALL} THEN InducedVertBreak - Fastball_IVB END AS FB_IVB_Diff
  FROM recoded
  WHERE RelSpeed IS NOT NULL AND InducedVertBreak IS NOT NULL AND HorzBreak IS NOT NULL
    AND RelHeight IS NOT NULL AND RelSide IS NOT NULL AND Extension IS NOT NULL
    AND SpinAxis IS NOT NULL AND PitcherThrows IS NOT NULL)"""
_READY_CTES = (_PIPELINE, _BASELINE, _BASED, _READY)
_KEYS14 = tuple(
    "m_swing" if c == "is_Swing" else c for c in SCORED_COLUMNS if c != "xSwing_Pred"
)
_sql(
    "natural_join_nullsafe",
    f"""SELECT b.PitchUID, b.Pitcher, b.Batter, b.SpinRate, b.m_swing AS is_Swing, a.xSwing_Pred,
  count(*) AS copies
FROM ready a JOIN ready b ON {" AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in _KEYS14)}
GROUP BY ALL""",
    *_READY_CTES,
)
_sql(
    "model_roundtrip",
    "SELECT count(*) AS scored, 0e0 AS max_change FROM ready WHERE TaggedPitchType = 'ChangeUp'",
    *_READY_CTES,
)

# --- aggregations

_sql("agg_count", "SELECT Balls, Strikes, count(*) AS pitches FROM pitches GROUP BY Balls, Strikes")
_sql(
    "agg_mean",
    f"""SELECT Pitcher, {_r(_avg("RelSpeed"), 6)} AS velo, {_r(_avg("HorzBreak"), 6)} AS hb,
  {_r(_avg("SpinRate"), 6)} AS spin FROM pitches GROUP BY Pitcher""",
)
_sql(
    "agg_mean_filtered",
    """SELECT Pitcher, avg(CAST(f_csw AS INT)) FILTER (WHERE Strikes = 2) AS put_away,
  avg(CAST(f_whiff AS INT)) FILTER (WHERE f_swing) AS whiff,
  avg(CAST(f_swing AS INT)) FILTER (WHERE NOT f_zone) AS chase
FROM flagged GROUP BY Pitcher""",
    _FLAGGED,
)
_sql(
    "agg_mean_strict",
    f"""SELECT Pitcher, pitch_type,
  CASE WHEN {_n("PitchofPA IS NULL")} = 0 THEN avg(CAST(f_strike AS INT)) FILTER (WHERE PitchofPA = 1) END AS fps,
  CASE WHEN {_n("(f_zone AND f_swing) IS NULL")} = 0
    THEN avg(CAST(f_whiff AS INT)) FILTER (WHERE f_zone AND f_swing) END AS z_whiff
FROM flagged GROUP BY Pitcher, pitch_type""",
    _FLAGGED,
)
_sql(
    "agg_sum_flag",
    "SELECT Pitcher, CAST(sum(CAST(f_bbe AS INT)) AS BIGINT) AS bbe FROM flagged GROUP BY Pitcher",
    _FLAGGED,
)
_sql(
    "agg_sum_filtered",
    "SELECT Batter, BatterTeam, Same_Side_PA, Oppo_Side_PA FROM counts",
    _FINALS, _COUNTS,
)
_sql(
    "agg_sum_measure",
    f"SELECT pitchzone, {_r(_total('Run_Value'), 2)} AS run_value FROM pitches GROUP BY pitchzone",
)
_sql("agg_max", "SELECT Pitcher, max(RelSpeed) AS max_velo FROM pitches GROUP BY Pitcher")
_sql(
    "agg_rv_per_100",
    f"""SELECT Pitcher, {_r(_avg("Run_Value") + " * 1e2", 2)} AS rv_per_100
FROM pitches GROUP BY Pitcher""",
)
_sql(
    "agg_ratio",
    f"""SELECT Pitcher, CAST(sum(is_Swing) AS BIGINT) / count(*) AS swing,
  {_total("xSwing_Pred")} / count(*) AS xswing FROM pitches GROUP BY Pitcher""",
)
_VELO = f"count(*) AS pitches, {_r(_avg('RelSpeed'), 6)} AS velo"
_sql(
    "agg_group_widths",
    f"""SELECT NULL AS Pitcher, NULL AS PitcherThrows, NULL AS PitcherTeam, CAST(NULL AS DATE) AS Date,
  0 AS width, {_VELO} FROM pitches
UNION ALL SELECT Pitcher, NULL, NULL, NULL, 1, {_VELO} FROM pitches GROUP BY Pitcher
UNION ALL SELECT Pitcher, PitcherThrows, NULL, NULL, 2, {_VELO} FROM pitches
  GROUP BY Pitcher, PitcherThrows
UNION ALL SELECT Pitcher, PitcherThrows, PitcherTeam, Date, 4, {_VELO} FROM pitches
  GROUP BY Pitcher, PitcherThrows, PitcherTeam, Date""",
)
_sql(
    "distinct_values",
    """SELECT DISTINCT 'PitchCall' AS name, PitchCall AS value FROM pitches
UNION SELECT 'TaggedPitchType', TaggedPitchType FROM pitches
UNION SELECT 'BatterSide', BatterSide FROM pitches
UNION SELECT 'PitcherThrows', PitcherThrows FROM pitches""",
)
_CHART = f"{TYPED} AND Date <> DATE '2023-10-06'"
_MEASURED = "InducedVertBreak IS NOT NULL AND HorzBreak IS NOT NULL AND RelSpeed IS NOT NULL"
for _name in ("agg_centroids", "movement_centroids"):
    _sql(
        _name,
        f"""SELECT Pitcher, TaggedPitchType, count(*) AS pitches,
  {_r(_avg("InducedVertBreak"), 6)} AS ivb, {_r(_avg("HorzBreak"), 6)} AS hb
FROM pitches WHERE {_CHART} AND {_MEASURED} GROUP BY Pitcher, TaggedPitchType""",
    )

_SAMPLE = """enough AS (
  SELECT * FROM counts WHERE PA >= 150 AND Same_Side_PA >= 35 AND Oppo_Side_PA >= 35),
sample AS (SELECT * FROM finals JOIN enough USING (Batter, BatterTeam))"""
_SAMPLE_CTES = (_FINALS, _COUNTS, _SAMPLE)
_PAIR_CTES = (*_SAMPLE_CTES, _splits("sample"), _PAIRED)
_sql(
    "agg_global_mean",
    f"SELECT {_r(_avg('oppo_woba - same_woba'), 6)} AS mean_diff FROM paired",
    *_PAIR_CTES,
)

# --- windows

_sql(
    "share_of_total",
    f"""SELECT Pitcher, pitch_type, pitches,
  {_percent("pitches / sum(pitches) OVER (PARTITION BY Pitcher)")} AS mix
FROM (SELECT Pitcher, pitch_type, count(*) AS pitches FROM flagged GROUP BY ALL)""",
    _FLAGGED,
)
_sql(
    "share_within_side",
    f"""SELECT Pitcher, BatterSide, pitch_type, pitches,
  {_percent("pitches / sum(pitches) OVER (PARTITION BY Pitcher, BatterSide)")} AS mix
FROM (SELECT Pitcher, BatterSide, pitch_type, count(*) AS pitches FROM flagged GROUP BY ALL)""",
    _FLAGGED,
)
_SIDE_MIX = f"""side_mix AS (
  SELECT *, CAST(floor(pcts * 1e1 + 5e-1) AS BIGINT) AS tenths
  FROM (SELECT *, {_r("pitches / total_pitches * 1e2", 1)} AS pcts FROM (SELECT Pitcher, BatterSide, TaggedPitchType, count(*) AS pitches,
      CAST(sum(count(*)) OVER (PARTITION BY Pitcher, BatterSide) AS BIGINT) AS total_pitches
    FROM pitches WHERE {TYPED} GROUP BY Pitcher, BatterSide, TaggedPitchType))),
side_stack AS (
  SELECT *, (sum(tenths) OVER (PARTITION BY Pitcher, BatterSide ORDER BY TaggedPitchType DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tenths / 2e0) / 1e1 AS text_y
  FROM side_mix)"""
_sql(
    "running_midpoint",
    "SELECT Pitcher, BatterSide, TaggedPitchType, pcts, text_y FROM side_stack",
    _SIDE_MIX,
)
_sql(
    "mix_by_side",
    """SELECT Pitcher, BatterSide, TaggedPitchType, pitches, total_pitches, pcts, text_y,
  concat(tenths // 10, CASE WHEN tenths % 10 = 0 THEN '' ELSE concat('.', tenths % 10) END, '%') AS labels
FROM side_stack""",
    _SIDE_MIX,
)


def _chase(min_n: int) -> str:
    return f"""chase AS (
  SELECT *, chase_pct - xchase_pct AS chase_diff FROM (
    SELECT Batter, BatterTeam, count(*) AS ooz_pitches,
      CAST(sum(is_Swing) AS BIGINT) / count(*) AS chase_pct,
      {_total("xSwing_Pred")} / count(*) AS xchase_pct
    FROM pitches WHERE year(Date) = 2023 AND NOT {ZONE} GROUP BY Batter, BatterTeam)
  WHERE ooz_pitches >= {min_n})"""


def _bin(value: str, breaks: str) -> str:
    """Last cut point not above the value, counting equal cut points once; the top one closes."""
    return f"""CAST(least(len(list_filter(list_distinct({breaks}), lambda b: b <= {value})),
    greatest(len(list_distinct({breaks})) - 1, 1)) AS INT)"""


def _breaks(value: str) -> str:
    return f"quantile_cont({value}, [{', '.join(f'CAST({i / 14!r} AS DOUBLE)' for i in range(15))}])"


_sql(
    "quantile_bins",
    f"""SELECT Batter, BatterTeam, {_bin("chase_pct", "cuts_a")} AS chase_bin,
  {_bin("chase_diff", "cuts_b")} AS diff_bin
FROM chase, (SELECT {_breaks("chase_pct")} AS cuts_a, {_breaks("chase_diff")} AS cuts_b FROM chase)""",
    _chase(100),
)

# --- sorts and limits

_TYPE_COUNTS = "SELECT Pitcher, pitch_type, count(*) AS pitches FROM flagged GROUP BY ALL"
_sql("sort_desc", f"{_TYPE_COUNTS} ORDER BY pitches DESC", _FLAGGED)
_sql(
    "sort_asc",
    "SELECT Pitcher, max(RelSpeed) AS max_velo FROM pitches GROUP BY Pitcher ORDER BY max_velo",
)
_sql(
    "sort_mixed",
    """SELECT Pitcher, BatterSide, pitch_type, count(*) AS pitches FROM flagged GROUP BY ALL
ORDER BY BatterSide, pitches DESC""",
    _FLAGGED,
)
_sql(
    "top_k",
    """SELECT PitchUID, Batter, is_Swing - xSwing_Pred AS xswing_diff FROM pitches
ORDER BY xswing_diff DESC, PitchUID LIMIT 15""",
)
_sql(
    "sort_by_level",
    f"""SELECT TaggedPitchType, count(*) AS pitches,
  CAST(list_position([{_quoted(*TYPES)}], TaggedPitchType) - 1 AS INT) AS level_rank
FROM pitches GROUP BY TaggedPitchType ORDER BY level_rank""",
)

# --- set operations and reshape

_sql("union_seasons", f"SELECT {_FX1} FROM pitches WHERE year(Date) IN (2022, 2023)")
_sql(
    "union_scored",
    f"""SELECT {", ".join(k for k in _KEYS14 if k != "m_swing")}, m_swing AS is_Swing, xSwing_Pred
FROM ready WHERE TaggedPitchType IN ('Fastball', 'Sinker', 'Slider', 'Curveball', 'Cutter', 'ChangeUp')""",
    *_READY_CTES,
)
_sql(
    "unpivot_splits",
    """SELECT Batter, 'Same Side' AS Platoon_Advantage, same_woba AS wOBA FROM paired
UNION ALL SELECT Batter, 'Oppo Side', oppo_woba FROM paired""",
    *_PAIR_CTES,
)

# --- scalar functions

_sql(
    "scalar_conditionals",
    f"""SELECT PitchUID, PitchCall = 'StrikeSwinging' AS is_whiff,
  CASE WHEN PitchCall = 'StrikeSwinging' THEN 1 WHEN PitchCall IN ('InPlay', 'FoulBall') THEN 0 END AS whiff,
  {COUNT_V1} AS count_type, coalesce(Angle < 10e0, FALSE) AS low_angle FROM pitches""",
)
_sql(
    "scalar_predicates",
    """SELECT PitchUID,
  coalesce(PitchCall IN ('FoulBallNotFieldable', 'FoulBall', 'StrikeSwinging', 'InPlay'), FALSE) AS in_swings,
  Angle >= 8e0 AND Angle <= 32e0 AS sweet_angle,
  PitchCall = 'InPlay' AND ExitSpeed >= 95e0 AS hard_hit, SpinRate IS NULL AS no_spin FROM pitches""",
)
_sql(
    "scalar_round",
    f"""SELECT PitchUID, {_r("RelSpeed", 0)} AS r0, {_r("HorzBreak / 4e0", 1)} AS r1,
  {_r("VertApprAngle / 8e0", 2)} AS r2, {_r("SpinRate / 7e0", 3)} AS r3,
  {_r("Run_Value / 3e0", 5)} AS r5 FROM pitches""",
)
_sql(
    "scalar_percent",
    f"""SELECT Pitcher, BatterSide, {_percent("CAST(sum(is_Swing) AS BIGINT) / count(*)")} AS swing_text
FROM pitches GROUP BY Pitcher, BatterSide""",
)
_sql("scalar_count_label", f"SELECT PitchUID, {COUNT} AS Count FROM pitches")
_sql(
    "scalar_name_split",
    """SELECT DISTINCT Pitcher, trim(substr(Pitcher, strpos(Pitcher, ',') + 1)) AS first_name,
  substr(Pitcher, 1, strpos(Pitcher, ',') - 1) AS last_name FROM pitches""",
)
_sql(
    "scalar_mirror_diff",
    """SELECT PitchUID, CASE PitcherThrows WHEN 'Right' THEN HorzBreak ELSE -HorzBreak END AS HB_adjusted,
  CASE PitcherThrows WHEN 'Right' THEN RelSide ELSE -RelSide END AS RelSide_adjusted,
  HorzBreak - InducedVertBreak AS break_gap, (HorzBreak + InducedVertBreak) / 2e0 AS break_mid
FROM pitches""",
)
_sql(
    "scalar_casts",
    """SELECT PitchUID, CAST(Balls AS VARCHAR) AS balls_text, CAST(Strikes AS DOUBLE) AS strikes_number,
  Date AS day, CAST(year(Date) AS VARCHAR) AS year_text, is_Swing = 1 AS swung FROM pitches""",
)

# --- flags and classes

_sql("pitch_class", f"SELECT PitchUID, {CLASS} AS PitchClass FROM pitches")
_sql("count_type_v1", f"SELECT PitchUID, {COUNT_V1} AS CountType FROM pitches")
_sql("count_type_v2", f"SELECT PitchUID, {COUNT_V2} AS CountType FROM pitches")
_sql(
    "platoon_side",
    """SELECT PitchUID, CASE WHEN PitcherThrows = BatterSide THEN 'Same Side'
  WHEN PitcherThrows <> BatterSide THEN 'Oppo Side' END AS Platoon_Advantage FROM pitches""",
)
_sql(
    "model_flags",
    f"SELECT m_swing AS is_Swing, * EXCLUDE (m_swing) FROM (SELECT PitchUID, {_MODEL_FLAGS} FROM pitches)",
)

# --- reports

_METRICS = {
    "pitches": "count(*)",
    "strike_pct": _share("f_strike", "TRUE"),
    "fps_pct": f"""CASE WHEN {_n("PitchofPA IS NULL")} = 0
    THEN {_share("PitchofPA = 1 AND f_strike", "PitchofPA = 1")} END""",
    "csw_pct": _share("f_csw", "TRUE"),
    "whiff_pct": _share("f_swing AND f_whiff", "f_swing"),
    "put_away_pct": _share("Strikes = 2 AND f_csw", "Strikes = 2"),
    "zone_pct": _share("f_zone", "f_zone IS NOT NULL"),
    "swing_pct": _share("f_swing", "TRUE"),
    "chase_pct": _share("NOT f_zone AND f_swing", "NOT f_zone"),
    "z_swing_pct": _share("f_zone AND f_swing", "f_zone"),
    "z_whiff_pct": f"""CASE WHEN {_n("(f_zone AND f_swing) IS NULL")} = 0
    THEN {_share("f_zone AND f_swing AND f_whiff", "f_zone AND f_swing")} END""",
    "rv_per_100": _r(_avg("Run_Value") + " * 1e2", 2),
    "rv": _r(f"coalesce({_total('Run_Value')}, 0e0)", 2),
    "bbe": _n("f_bbe"),
    "wobacon": _r(_avg("woba_value", "f_bbe"), 3),
    "woba": _r(_avg("woba_value", "f_pa"), 3),
    "xwobacon": _r(_avg("xwOBACON_value", "f_bbe"), 3),
    "xwoba": _r(_avg("xw_all", "f_pa"), 3),
}
_FULL = [name for name in _METRICS if name != "rv"]
_BY_COUNT = [name for name in _FULL if name not in ("fps_pct", "put_away_pct")]
_GRAINS = {
    "pitch_type": "pitch_type",
    "pitchzone": "CASE WHEN pitchzone IN ('Heart', 'Shadow', 'Chase', 'Waste') THEN pitchzone END",
    "Count": COUNT,
    "CountType": COUNT_V2,
    "pitch_class": f"nullif({CLASS}, 'Other')",
    "BatterSide": "BatterSide",
}


def _report(keys: list[str], metrics: list[str]) -> str:
    columns = ["Pitcher", *[f"{_GRAINS[key]} AS {key}" for key in keys]]
    columns += [f"{_METRICS[name]} AS {name}" for name in metrics]
    groups = ", ".join(["Pitcher", *[_GRAINS[key] for key in keys]])
    return f"SELECT {', '.join(columns)} FROM flagged GROUP BY {groups}"


def _with_mix(report: str, within: str) -> str:
    share = _percent(f"pitches / sum(pitches) OVER (PARTITION BY {within})")
    return f"SELECT *, {share} AS mix FROM ({report})"


_OVERALL = [name for name in _FULL if name != "z_swing_pct"]
_ZONE_METRICS = [
    "pitches", "bbe", "swing_pct", "csw_pct", "whiff_pct", "put_away_pct", "rv_per_100", "rv",
    "xwobacon", "xwoba",
]
_sql("report_overall", _report([], _OVERALL), _FLAGGED)
_sql("report_pitch_type", _with_mix(_report(["pitch_type"], _FULL), "Pitcher"), _FLAGGED)
_sql("report_attack_zone", _with_mix(_report(["pitchzone"], _ZONE_METRICS), "Pitcher"), _FLAGGED)
_sql("report_count", _report(["Count"], _BY_COUNT), _FLAGGED)
_sql("report_count_type", _report(["CountType", "pitch_class"], _BY_COUNT), _FLAGGED)
_sql("report_platoon", _report(["BatterSide"], _FULL), _FLAGGED)
_sql(
    "report_platoon_pitch_type",
    _with_mix(_report(["BatterSide", "pitch_type"], _OVERALL), "Pitcher, BatterSide"),
    _FLAGGED,
)
_ALL_GRAINS = {
    "overall": [],
    "pitch_type": ["pitch_type"],
    "attack_zone": ["pitchzone"],
    "count": ["Count"],
    "count_type": ["CountType", "pitch_class"],
    "platoon": ["BatterSide"],
    "platoon_pitch_type": ["BatterSide", "pitch_type"],
}
_sql(
    "report_all_grains",
    "\nUNION ALL BY NAME ".join(
        f"SELECT '{name}' AS report, * FROM ({_report(keys, list(_METRICS))})"
        for name, keys in _ALL_GRAINS.items()
    ),
    _FLAGGED,
)

_MOVE_MEANS = {
    "velo": ("RelSpeed", 1), "ivb": ("InducedVertBreak", 1), "hb": ("HorzBreak", 1),
    "spin_rate": ("SpinRate", 0), "spin_axis": ("SpinAxis", 0), "rel_height": ("RelHeight", 1),
    "rel_side": ("RelSide", 1), "ext": ("Extension", 1), "wstuff_plus": ("wStuff_plus_2", 0),
    "stuff_plus": ("Stuff_plus", 0),
}
_MOVEMENT = f"""move AS (
  SELECT Pitcher, {LISTED_TYPE} AS pitch_type, count(*) AS pitches,
    {", ".join(f"{_r(_avg(c), d)} AS {n}" for n, (c, d) in _MOVE_MEANS.items())},
    {_r("max(RelSpeed)", 1)} AS max_velo,
    {_r(_avg("VertApprAngle", f"{_SIDE} AND PlateLocHeight BETWEEN 29e-1 AND 375e-2"), 2)} AS top_zone_vaa,
    {_r(_avg("VertApprAngle", f"{_SIDE} AND PlateLocHeight BETWEEN 14e-1 AND 215e-2"), 2)} AS bot_zone_vaa
  FROM pitches WHERE {_CHART} GROUP BY Pitcher, {LISTED_TYPE})"""
_sql("report_movement", _with_mix("SELECT * FROM move", "Pitcher"), _MOVEMENT)
_sql(
    "report_from_daily_sums",
    "\nUNION ALL BY NAME ".join(
        f"SELECT '{name}' AS report, * FROM ({_report(keys, list(_METRICS))})"
        for name, keys in _ALL_GRAINS.items()
    ),
    _FLAGGED.replace("WHERE", f"WHERE {_RANGE} AND", 1),
)
_sql(
    "movement_from_daily_sums",
    _with_mix("SELECT * FROM move", "Pitcher"),
    _MOVEMENT.replace(f"WHERE {_CHART}", f"WHERE {_RANGE} AND {_CHART}"),
)
_LEAGUE_ROWS = ", ".join(
    "(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in row) + ")"
    for row in LEAGUE_AVERAGES
)
_LEAGUE_PAIRS = {
    "velo": "velo", "ivb": "ivb", "hb": "hb", "spin_rate": "spinrate", "spin_axis": "spinaxis",
    "rel_height": "relht", "rel_side": "relsi", "ext": "ext", "top_zone_vaa": "topvaa",
    "bot_zone_vaa": "botvaa",
}
_sql(
    "league_avg_compare",
    f"""SELECT m.Pitcher, h.p_throws, m.pitch_type, m.pitches,
  {", ".join(f"{_r(f'm.{a} - l.{b}', 2)} AS {a}_diff" for a, b in _LEAGUE_PAIRS.items())}
FROM move m JOIN hands h ON m.Pitcher = h.Pitcher JOIN league l
  ON h.p_throws = l.p_throws AND m.pitch_type = replace(l.pitch_type, 'Changeup', 'ChangeUp')""",
    _MOVEMENT.replace(LISTED_TYPE, LISTED_TYPE.replace("'ChangeUp'", "'ChangeUp', 'Splitter'")),
    f"""hands AS (
  SELECT Pitcher, PitcherThrows AS p_throws FROM pitches
  WHERE PitcherThrows IN ('Left', 'Right') AND {_CHART}
  GROUP BY Pitcher, PitcherThrows
  QUALIFY row_number() OVER (PARTITION BY Pitcher ORDER BY count(*) DESC, PitcherThrows DESC) = 1)""",
    f"league({', '.join(LEAGUE_AVERAGE_COLUMNS)}) AS (VALUES {_LEAGUE_ROWS})",
)


def _class_mix(label: str, expr: str) -> str:
    return f"""SELECT *, {_r("pitches / total_pitches * 1e2", 1)} AS pcts FROM (
  SELECT Pitcher, {expr} AS {label}, {CLASS} AS PitchClass, count(*) AS pitches,
    CAST(sum(count(*)) OVER (PARTITION BY Pitcher, {expr}) AS BIGINT) AS total_pitches
  FROM pitches WHERE {TYPED} GROUP BY Pitcher, {expr}, {CLASS})"""


_sql("mix_by_count", _class_mix("Count", COUNT))
_sql("mix_by_count_type", _class_mix("CountType", COUNT_V2))
_sql(
    "pitcher_names",
    f"""SELECT Pitcher, {_n(_RANGE)} AS pitches, count(*) AS all_pitches,
  trim(split_part(Pitcher, ',', 2)) AS first_name, split_part(Pitcher, ',', 1) AS last_name
FROM pitches GROUP BY Pitcher HAVING {_n(_RANGE)} > 0""",
)

# --- data behind the charts

_sql(
    "movement_points",
    f"""SELECT PitchUID, Pitcher, TaggedPitchType, HorzBreak, InducedVertBreak, RelSpeed
FROM pitches WHERE {_CHART} AND {_MEASURED}""",
)
_sql(
    "release_points",
    f"""SELECT PitchUID, Pitcher, TaggedPitchType, RelSide, RelHeight FROM pitches
WHERE {_CHART} AND RelSide BETWEEN -4e0 AND 4e0 AND RelHeight BETWEEN 0e0 AND 7e0""",
)
_sql(
    "spin_points",
    f"""SELECT PitchUID, Pitcher, TaggedPitchType, SpinAxis, SpinRate FROM pitches
WHERE {_CHART} AND SpinAxis BETWEEN 0e0 AND 360e0 AND SpinRate BETWEEN 1e3 AND 3e3""",
)
_sql(
    "spin_centroids",
    f"""SELECT Pitcher, TaggedPitchType, count(*) AS pitches, {_r(_avg("SpinAxis"), 6)} AS spin_axis,
  {_r(_avg("SpinRate"), 6)} AS spin_rate FROM pitches WHERE {_CHART}
GROUP BY Pitcher, TaggedPitchType""",
)


def _density(keys: str, where: str) -> tuple[str, ...]:
    """Normal kernel density of every point on a 20 x 20 grid, bandwidth by the reference rule."""
    return (
        f"""points AS (
  SELECT {keys}, PlateLocSide AS x, PlateLocHeight AS y FROM pitches
  WHERE {where} AND PlateLocSide BETWEEN -17e-1 AND 17e-1 AND PlateLocHeight BETWEEN 0e0 AND 45e-1)""",
        f"""widths AS (
  SELECT {keys}, count(*) AS n,
    106e-2 * least(stddev_samp(x), (quantile_cont(x, 75e-2) - quantile_cont(x, 25e-2)) / 134e-2)
      * pow(count(*), -2e-1) AS hx,
    106e-2 * least(stddev_samp(y), (quantile_cont(y, 75e-2) - quantile_cont(y, 25e-2)) / 134e-2)
      * pow(count(*), -2e-1) AS hy
  FROM points GROUP BY {keys})""",
        f"""steps AS (SELECT CAST(unnest(range(20)) AS INT) AS i)""",
        f"""cells AS (
  SELECT {keys}, sx.i AS ix, sy.i AS iy,
    sum(exp(-5e-1 * pow((-17e-1 + sx.i * 34e-1 / 19 - x) / hx, 2)
          - 5e-1 * pow((sy.i * 45e-1 / 19 - y) / hy, 2)) / (n * hx * hy)) AS z
  FROM points JOIN widths USING ({keys}), steps sx, steps sy WHERE hx > 0 AND hy > 0
  GROUP BY {keys}, sx.i, sy.i)""",
    )


_sql(
    "location_density",
    f"""SELECT Pitcher, TaggedPitchType, ix, iy, {_r("-17e-1 + ix * 34e-1 / 19", 6)} AS side,
  {_r("iy * 45e-1 / 19", 6)} AS height,
  {_r("z / max(z) OVER (PARTITION BY Pitcher, TaggedPitchType)", 6)} AS ndensity FROM cells""",
    *_density("Pitcher, TaggedPitchType", TYPED),
)
_HDR_KEYS = "Pitcher, BatterSide, TaggedPitchType"
_sql(
    "location_hdr",
    f"""SELECT {_HDR_KEYS}, ix, iy, CASE WHEN z >= c50 THEN 5e-1 WHEN z >= c80 THEN 8e-1
  WHEN z >= c95 THEN 95e-2 ELSE 99e-2 END AS region
FROM cells JOIN cutoffs USING ({_HDR_KEYS}) WHERE z >= c99""",
    *_density(_HDR_KEYS, f"{TYPED} AND BatterSide IN ('Left', 'Right')"),
    f"""ordered AS (
  SELECT *, sum(z) OVER (PARTITION BY {_HDR_KEYS} ORDER BY z DESC)
    / sum(z) OVER (PARTITION BY {_HDR_KEYS}) AS held FROM cells)""",
    f"""cutoffs AS (
  SELECT {_HDR_KEYS}, max(z) FILTER (WHERE held >= 5e-1) AS c50,
    max(z) FILTER (WHERE held >= 8e-1) AS c80, max(z) FILTER (WHERE held >= 95e-2) AS c95,
    max(z) FILTER (WHERE held >= 99e-2) AS c99 FROM ordered GROUP BY {_HDR_KEYS})""",
)
_sql(
    "split_difference",
    """SELECT Batter, BatterTeam, (oppo_woba + same_woba) / 2e0 AS split_mean,
  oppo_woba - same_woba AS split_diff FROM paired""",
    *_PAIR_CTES,
)

# --- platoon study

_sql("platoon_sample", "SELECT * FROM sample", *_SAMPLE_CTES)
_sql("platoon_split_woba", "SELECT * FROM splits", *_PAIR_CTES)
_sql(
    "platoon_pairs",
    """SELECT *, oppo_woba - same_woba AS diff, same_woba > oppo_woba AS same_higher,
  oppo_woba > same_woba AS oppo_higher, CASE WHEN same_woba > oppo_woba THEN 'Same Higher'
    WHEN oppo_woba > same_woba THEN 'Oppo Higher' END AS which_side FROM paired""",
    *_PAIR_CTES,
)
_sql(
    "platoon_side_counts",
    """SELECT CASE WHEN same_woba > oppo_woba THEN 'Same Higher'
  WHEN oppo_woba > same_woba THEN 'Oppo Higher' END AS which_side, count(*) AS batters
FROM paired GROUP BY 1""",
    *_PAIR_CTES,
)
_FIT = """obs AS (
  SELECT woba_value AS y, CASE WHEN Platoon_Advantage = 'Oppo Side' THEN 1e0 ELSE 0e0 END AS x,
    Batter FROM sample),
moments AS (
  SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy,
    regr_syy(y, x) AS syy FROM obs),
fit AS (
  SELECT *, sxy / sxx AS b1, my - sxy / sxx * mx AS b0, syy - sxy * sxy / sxx AS rss,
    CAST(n - 2 AS DOUBLE) AS df FROM moments)"""
# the two-sided p-value by the trapezoid rule on the density of t with df degrees of freedom
_P = """least(1e0, greatest(0e0, 1e0 - 2e0 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())
  * (least(abs(t_value), 4e1) / 20000) * (
    list_sum(list_transform(range(1, 20000), lambda k: pow(1 + pow(k * least(abs(t_value), 4e1) / 20000, 2) / df, -(df + 1) / 2)))
    + 5e-1 + 5e-1 * pow(1 + pow(least(abs(t_value), 4e1), 2) / df, -(df + 1) / 2))))"""
_sql(
    "ols_platoon",
    f"""SELECT term, {_r("estimate", 6)} AS estimate, {_r("std_error", 6)} AS std_error,
  {_r("t_value", 6)} AS t_value, CASE WHEN t_value IS NOT NULL THEN {_r(_P, 6)} END AS p_value, {_r("sqrt(rss / df)", 6)} AS sigma,
  {_r("1e0 - rss / syy", 6)} AS r_squared, df, n
FROM (SELECT *, estimate / std_error AS t_value FROM (
  SELECT '(Intercept)' AS term, b0 AS estimate,
    sqrt(rss / df * (1e0 / n + mx * mx / sxx)) AS std_error, * FROM fit
  UNION ALL SELECT 'platoon_effect', b1, sqrt(rss / df / sxx), * FROM fit))""",
    *_SAMPLE_CTES, _FIT,
)
_sql(
    "ols_predictions",
    f"""SELECT Platoon_Advantage, {_r("b0 + b1 * shift", 6)} AS pred, 'Linear' AS "Group", coding FROM fit,
  (VALUES ('Same Side', -5e-1, 'half'), ('Oppo Side', 5e-1, 'half'), ('Same Side', 0e0, 'indicator'),
    ('Oppo Side', 1e0, 'indicator')) AS c(Platoon_Advantage, shift, coding)""",
    *_SAMPLE_CTES, _FIT,
)

_QUARTS = (("min", 0), ("q1", "25e-2"), ("median", "5e-1"), ("q3", "75e-2"), ("max", 1))
_sql(
    "ols_summary",
    f"""SELECT {", ".join(f"(SELECT {_r(f'quantile_cont(y - b0 - b1 * x, {q})', 6)} FROM obs, fit) AS residual_{name}" for name, q in _QUARTS)},
  {_r("sqrt(rss / df)", 6)} AS sigma, {_r("1e0 - rss / syy", 6)} AS r_squared,
  {_r("1e0 - rss / syy * (n - 1) / df", 6)} AS adj_r_squared, {_r("t_value * t_value", 6)} AS f_value,
  1e0 AS df1, df AS df2,
  CASE WHEN t_value IS NOT NULL THEN {_r(_P, 6)} END AS p_value
FROM (SELECT *, b1 / sqrt(rss / df / sxx) AS t_value FROM fit)""",
    *_SAMPLE_CTES, _FIT,
)

# --- swing pipeline

_sql("fastball_baseline", "SELECT * FROM baseline", _PIPELINE, _BASELINE)
_sql(
    "model_ready",
    f"""SELECT PitchUID, Date, Pitcher, PitcherTeam, Inning, Balls, Strikes, PitchCall, Outs, PitcherThrows,
  Batter, BatterSide, BatterTeam, TaggedPitchType, RelSpeed, PlateLocHeight, PlateLocSide, HB_adjusted,
  InducedVertBreak, SpinRate, SpinAxis, RelSide_adjusted, RelHeight, Extension, FB_Velo_Diff,
  FB_HB_Diff, FB_IVB_Diff, {_TYPE} AS Type, CASE WHEN w_event IS NULL THEN 0 ELSE 1 END AS woba_denom,
  w_woba AS woba_value, {_EVENT} AS Event, {COUNT} AS Count, {_NEW_COUNT} AS new_Count,
  w_run AS Run_Value, m_swing AS is_Swing, is_Whiff, is_Foul, is_BBE, is_CalledStrike, is_Groundball,
  is_Linedrive, is_Flyball, is_Popup, is_HardHit, is_SweetSpot, BatterLoR, PitcherLoR, PlatoonAdv,
  ExitSpeed, Angle, PlayResult, gameID, Catcher
FROM ready LEFT JOIN event_w ON ({_EVENT}) = w_event LEFT JOIN run_w
  ON Balls = w_balls AND Strikes = w_strikes AND coalesce({_EVENT}, {_TYPE}) = w_what""",
    *_READY_CTES, _PLAYS, _WEIGHTS,
)
_ALL_FEATURES = ", ".join((*FASTBALL_FEATURES, *DIFF_FEATURES))
_sql(
    "feature_sets",
    f"""SELECT PitchUID, {_ALL_FEATURES}, m_swing AS is_Swing,
  CASE WHEN TaggedPitchType IN ('Fastball', 'Sinker') THEN 'Fastball'
    WHEN TaggedPitchType = 'ChangeUp' THEN 'Offspeed' ELSE 'BreakingBall' END AS swing_class
FROM ready WHERE TaggedPitchType IN ({_quoted(*TYPES)})""",
    *_READY_CTES,
)
for _side, _team in (("batter", "BatterTeam"), ("pitcher", "PitcherTeam")):
    _sql(
        f"top_swing_diff_{_side}",
        f"""SELECT PitchUID, Date, Pitcher, PitcherTeam, Batter, BatterTeam, Inning, {COUNT} AS Count,
  PitchCall, is_Swing, {_r("xSwing_Pred * 1e2", 2)} AS xswing_pct, is_Swing - xSwing_Pred AS xswing_diff
FROM pitches
QUALIFY row_number() OVER (PARTITION BY {_team} ORDER BY is_Swing - xSwing_Pred DESC, PitchUID) <= 10""",
    )
_sql(
    "pitcher_swing_diff",
    f"""SELECT *, {_r("swing_pct - xswing_pct", 2)} AS swing_diff FROM (
  SELECT PitcherTeam, Pitcher, count(*) AS pitches,
    {_r("CAST(sum(is_Swing) AS BIGINT) / count(*) * 1e2", 2)} AS swing_pct,
    {_r(_total("xSwing_Pred") + " / count(*) * 1e2", 2)} AS xswing_pct
  FROM pitches WHERE year(Date) = 2023 GROUP BY PitcherTeam, Pitcher HAVING count(*) >= 100)""",
)
_sql(
    "team_chase_diff",
    f"""SELECT Batter, BatterTeam, ooz_pitches, chase_pct, xchase_pct, chase_diff,
  {_bin("chase_pct", "cuts_a")} AS chase_bin, {_bin("chase_diff", "cuts_b")} AS diff_bin
FROM chase JOIN (SELECT BatterTeam, {_breaks("chase_pct")} AS cuts_a, {_breaks("chase_diff")} AS cuts_b
  FROM chase GROUP BY BatterTeam) USING (BatterTeam)""",
    _chase(15),
)
_sql(
    "overall_chase_diff",
    "SELECT * FROM chase ORDER BY chase_diff, Batter, BatterTeam LIMIT 15",
    _chase(200),
)
_HEART_BOARD = f"""SELECT *, heart_swing_pct - heart_xswing_pct AS swing_diff FROM (
  SELECT Batter, BatterTeam, count(*) AS heart_pitches, avg(is_Swing) AS heart_swing_pct,
    {_avg("xSwing_Pred")} AS heart_xswing_pct
  FROM pitches WHERE year(Date) = 2023 AND {HEART} GROUP BY Batter, BatterTeam)"""
_sql("heart_swing_board", _HEART_BOARD)
_sql(
    "heart_swing_diff",
    f"{_HEART_BOARD} WHERE heart_pitches >= 150 ORDER BY swing_diff DESC, Batter, BatterTeam LIMIT 15",
)

# --- models

_sql(
    "sample_n",
    """SELECT PitchUID, Pitcher, TaggedPitchType FROM pitches
ORDER BY md5(PitchUID || ':2004'), PitchUID LIMIT 30000""",
)
_sql(
    "stratified_split",
    """SELECT PitchUID, is_Swing,
  row_number() OVER (PARTITION BY is_Swing ORDER BY md5(PitchUID || ':2004'))
    <= ceil(75e-2 * count(*) OVER (PARTITION BY is_Swing)) AS is_train FROM pitches""",
)
_SCORES = """scores AS (
  SELECT xSwing_Pred AS s, count(*) FILTER (WHERE is_Swing = 1) AS pos,
    count(*) FILTER (WHERE is_Swing = 0) AS neg FROM pitches GROUP BY xSwing_Pred),
ranked AS (
  SELECT *, coalesce(sum(pos) OVER below, 0) AS pos_below, coalesce(sum(neg) OVER below, 0) AS neg_below,
    sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
  FROM scores WINDOW below AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_sql(
    "roc_curve",
    """SELECT s AS threshold, CAST(all_pos - pos_below AS BIGINT) / CAST(all_pos AS BIGINT) AS sensitivity,
  CAST(neg_below AS BIGINT) / CAST(all_neg AS BIGINT) AS specificity FROM ranked""",
    _SCORES,
)
_sql(
    "auc_exact",
    f"""SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
  {_r("sum(pos * (neg_below + neg / 2e0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))", 9)} AS auc
FROM ranked""",
    _SCORES,
)


def _reml_rounds(rounds: int = 6, points: int = 25) -> tuple[str, ...]:
    """Random-intercept fit: REML criterion on grids of psi, each closing in on the last minimum."""
    last = points - 1
    ctes = [
        """sums AS (
  SELECT Batter, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS t, sum(x * x) AS sxx,
    sum(x * y) AS sxy, sum(y * y) AS syy FROM obs GROUP BY Batter)""",
        "bounds0 AS (SELECT ln(1e-8) AS low, ln(1e4) AS high)",
    ]
    for k in range(rounds):
        zero = " UNION ALL SELECT -1, 0e0" if k == 0 else ""
        ctes.append(
            f"""grid{k} AS (SELECT r.i, exp(low + (high - low) * r.i / {last}) AS psi
  FROM bounds{k}, range({points}) r(i){zero})"""
        )
        ctes.append(
            f"""normal{k} AS (
  SELECT i, psi, sum(n) AS total, sum(n - c * n * n) AS a00, sum(sx - c * n * sx) AS a01,
    sum(sxx - c * sx * sx) AS a11, sum(t - c * n * t) AS v0, sum(sxy - c * sx * t) AS v1,
    sum(syy - c * t * t) AS q, sum(ln(1 + n * psi)) AS ld
  FROM (SELECT *, psi / (1 + n * psi) AS c FROM sums, grid{k}) GROUP BY i, psi)"""
        )
        ctes.append(
            f"""fit{k} AS (
  SELECT *, (total - 2) * (1 + ln(2 * pi() * (q - beta0 * v0 - beta1 * v1) / (total - 2))) + ld + ln(det) AS crit
  FROM (SELECT *, (a11 * v0 - a01 * v1) / det AS beta0, (a00 * v1 - a01 * v0) / det AS beta1
    FROM (SELECT *, a00 * a11 - a01 * a01 AS det FROM normal{k})))"""
        )
        ctes.append(
            f"""bounds{k + 1} AS (
  SELECT ln((SELECT psi FROM grid{k} WHERE i = greatest(b.i - 1, 0))) AS low,
    ln((SELECT psi FROM grid{k} WHERE i = least(b.i + 1, {last}))) AS high
  FROM (SELECT i FROM fit{k} WHERE i >= 0 ORDER BY crit LIMIT 1) b)"""
        )
    every = " UNION ALL ".join(f"SELECT psi, beta0, beta1, crit FROM fit{k}" for k in range(rounds))
    ctes.append(f"best AS (SELECT * FROM ({every}) ORDER BY crit, psi LIMIT 1)")
    ctes.append(
        """effects AS (
  SELECT Batter, beta0 + psi / (1 + n * psi) * (t - beta0 * n - beta1 * sx) AS own0, beta1 AS own1
  FROM sums, best)"""
    )
    return tuple(ctes)


_sql(
    "mixed_model_coef",
    f"SELECT Batter, {_r('own0', 4)} AS beta0, {_r('own1', 4)} AS beta1 FROM effects",
    *_SAMPLE_CTES, _FIT, *_reml_rounds(),
)
_sql(
    "mixed_model_splits",
    f"""SELECT Batter, 'Same Side' AS Platoon_Advantage, {_r("own0 - own1 / 2", 4)} AS "wOBA" FROM effects
UNION ALL SELECT Batter, 'Oppo Side', {_r("own0 + own1 / 2", 4)} FROM effects""",
    *_SAMPLE_CTES, _FIT, *_reml_rounds(),
)
_INFO = """info AS (
  SELECT *, a00 * a11 - a01 * a01 AS det, (q - beta0 * v0 - beta1 * v1) / (total - 2) AS s2 FROM (
    SELECT psi, beta0, beta1, crit, sum(n) AS total, CAST(count(*) AS DOUBLE) AS groups,
      sum(n - c * n * n) AS a00, sum(sx - c * n * sx) AS a01, sum(sxx - c * sx * sx) AS a11,
      sum(t - c * n * t) AS v0, sum(sxy - c * sx * t) AS v1, sum(syy - c * t * t) AS q
    FROM (SELECT *, psi / (1 + n * psi) AS c FROM sums, best) GROUP BY psi, beta0, beta1, crit)),
scaled AS (
  SELECT (y - own0 - own1 * x) / sqrt(s2) AS r FROM obs JOIN effects USING (Batter), info)"""
_SUMMARY = (
    ("fixed", "(Intercept) estimate", "beta0"),
    ("fixed", "(Intercept) std_error", "sqrt(s2 * a11 / det)"),
    ("fixed", "(Intercept) t_value", "beta0 / sqrt(s2 * a11 / det)"),
    ("fixed", "platoon_effect estimate", "beta1"),
    ("fixed", "platoon_effect std_error", "sqrt(s2 * a00 / det)"),
    ("fixed", "platoon_effect t_value", "beta1 / sqrt(s2 * a00 / det)"),
    ("fixed", "correlation", "-a01 / sqrt(a00 * a11)"),
    ("random", "Batter variance", "psi * s2"),
    ("random", "Batter std_dev", "sqrt(psi * s2)"),
    ("random", "residual variance", "s2"),
    ("random", "residual std_dev", "sqrt(s2)"),
    ("fit", "reml_criterion", "crit"),
    ("fit", "observations", "total"),
    ("fit", "groups", "groups"),
)
_sql(
    "mixed_model_summary",
    " UNION ALL ".join(
        [f"SELECT '{part}' AS part, '{name}' AS name, {_r(value, 4)} AS value FROM info" for part, name, value in _SUMMARY]
        + [f"SELECT 'scaled_residual', '{name}', {_r(f'quantile_cont(r, {q})', 4)} FROM scaled HAVING count(*) > 0" for name, q in _QUARTS]
    ),
    *_SAMPLE_CTES, _FIT, *_reml_rounds(), _INFO,
)

# --- the same rows out of other layouts

for _name, _same in (
    ("join_stored_baseline", "join_fastball_baseline"),
    ("join_stored_counts", "join_pa_counts"),
    ("model_ready_stored", "model_ready"),
    ("team_chase_diff_pruned", "team_chase_diff"),
):
    _ORACLES[_name] = _ORACLES[_same]
