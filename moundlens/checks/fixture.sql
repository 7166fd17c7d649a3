WITH seed AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, l_extendedprice,
    (CAST(round(l_extendedprice * 1e2) AS BIGINT) * 7919 + l_orderkey * 104729
      + l_partkey * 1299709 + l_linenumber * 15485863) % 2147483647 AS g0
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
mix AS (
  SELECT *,
    (g0 * 16807) % 2147483647 AS g1, (g0 * 39373) % 2147483647 AS g2,
    (g0 * 48271) % 2147483647 AS g3, (g0 * 69621) % 2147483647 AS g4,
    (g0 * 630360016) % 2147483647 AS g5, (g0 * 742938285) % 2147483647 AS g6,
    (g0 * 950706376) % 2147483647 AS g7, (g0 * 1226874159) % 2147483647 AS g8,
    (g0 * 62089911) % 2147483647 AS g9, (g0 * 1343714438) % 2147483647 AS g10,
    (g0 * 1203248318) % 2147483647 AS g11, (g0 * 397204094) % 2147483647 AS g12
  FROM seed),
base AS (
  SELECT
    CONCAT_WS('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)),
      CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)),
      CAST(CAST(round(l_extendedprice * 1e2) AS BIGINT) AS VARCHAR(20))) AS PitchUID,
    CAST(CASE WHEN g1 % 100 = 0 THEN '2023-10-06'
      ELSE CONCAT(CASE WHEN g1 % 10 < 5 THEN '2022' ELSE '2023' END, '-0', CAST(2 + g2 % 4 AS VARCHAR(2)),
        CASE WHEN g3 % 3 = 0 THEN '-03' WHEN g3 % 3 = 1 THEN '-10' ELSE '-17' END) END AS DATE) AS Date,
    CONCAT('G', CAST(g2 % 60 AS VARCHAR(4))) AS gameID,
    CAST(1 + g4 % 9 AS INT) AS Inning, CAST(g5 % 3 AS INT) AS Outs,
    CASE WHEN g4 % 20 = 0 THEN 'D2' ELSE 'D1' END AS Level,
    CONCAT('Last', CAST(l_suppkey AS VARCHAR(20)), ', First', CAST(l_suppkey AS VARCHAR(20))) AS Pitcher,
    CONCAT('TM_', CAST(l_suppkey % 8 AS VARCHAR(4))) AS PitcherTeam,
    CASE WHEN l_suppkey % 25 = 24 THEN 'Undefined' WHEN l_suppkey % 3 = 0 THEN 'Left' ELSE 'Right' END AS PitcherThrows,
    CONCAT('Bat', CAST(o_custkey % 40 AS VARCHAR(4)), ', B') AS Batter,
    CONCAT('TM_', CAST(o_custkey % 8 AS VARCHAR(4))) AS BatterTeam,
    CASE WHEN g5 % 200 = 0 THEN 'Undefined' WHEN g5 % 100 < 35 THEN 'Left' ELSE 'Right' END AS BatterSide,
    CONCAT('C', CAST(l_suppkey % 8 AS VARCHAR(4))) AS Catcher,
    CAST(g6 % 4 AS INT) AS Balls, CAST(g7 % 3 AS INT) AS Strikes,
    CAST(1 + g6 % 4 + g7 % 3 AS INT) AS PitchofPA,
    CASE WHEN g8 % 100 < 33 THEN 'BallCalled' WHEN g8 % 100 < 35 THEN 'BallinDirt'
      WHEN g8 % 100 < 51 THEN 'StrikeCalled' WHEN g8 % 100 < 63 THEN 'StrikeSwinging'
      WHEN g8 % 100 < 76 THEN 'FoulBall' WHEN g8 % 100 < 79 THEN 'FoulBallNotFieldable'
      WHEN g8 % 100 < 80 THEN 'FoulBallFieldable' WHEN g8 % 100 < 97 THEN 'InPlay'
      WHEN g8 % 100 < 98 THEN 'HitByPitch' WHEN g8 % 100 < 99 THEN 'Undefined' END AS PitchCall,
    CASE WHEN g9 % 100 < 38 THEN 'Fastball' WHEN g9 % 100 < 49 THEN 'Sinker'
      WHEN g9 % 100 < 55 THEN 'Cutter' WHEN g9 % 100 < 73 THEN 'Slider'
      WHEN g9 % 100 < 83 THEN 'Curveball' WHEN g9 % 100 < 93 THEN 'ChangeUp'
      WHEN g9 % 100 < 96 THEN 'Splitter' WHEN g9 % 100 < 97 THEN 'Slurve'
      WHEN g9 % 100 < 98 THEN 'Other' WHEN g9 % 100 < 99 THEN 'Undefined' END AS TaggedPitchType,
    CASE WHEN g10 % 40 = 0 THEN NULL ELSE CAST(700 + g10 % 290 AS DOUBLE) / 1e1 END AS RelSpeed,
    CASE WHEN g11 % 40 = 0 THEN NULL ELSE CAST(g11 % 481 - 240 AS DOUBLE) / 1e1 END AS HorzBreak,
    CASE WHEN g12 % 40 = 0 THEN NULL ELSE CAST(g12 % 401 - 180 AS DOUBLE) / 1e1 END AS InducedVertBreak,
    CASE WHEN g1 % 30 = 7 THEN NULL ELSE CAST(1200 + g1 % 1700 AS DOUBLE) END AS SpinRate,
    CASE WHEN g2 % 50 = 3 THEN NULL ELSE CAST(g2 % 360 AS DOUBLE) END AS SpinAxis,
    CASE WHEN g3 % 50 = 3 THEN NULL ELSE CAST(450 + g3 % 220 AS DOUBLE) / 1e2 END AS RelHeight,
    CASE WHEN g4 % 50 = 3 THEN NULL ELSE CAST(g4 % 701 - 350 AS DOUBLE) / 1e2 END AS RelSide,
    CASE WHEN g5 % 50 = 3 THEN NULL ELSE CAST(520 + g5 % 180 AS DOUBLE) / 1e2 END AS Extension,
    CASE WHEN g6 % 50 = 3 THEN NULL ELSE CAST(0 - 250 - g6 % 800 AS DOUBLE) / 1e2 END AS VertApprAngle,
    CASE WHEN g7 % 50 = 3 THEN NULL ELSE CAST(g7 % 401 - 200 AS DOUBLE) / 1e2 END AS PlateLocSide,
    CASE WHEN g7 % 50 = 3 THEN NULL ELSE CAST(g11 % 451 AS DOUBLE) / 1e2 END AS PlateLocHeight,
    CASE WHEN g8 % 100 BETWEEN 80 AND 96 AND g12 % 30 <> 0 THEN CAST(500 + g12 % 650 AS DOUBLE) / 1e1 END AS ExitSpeed,
    CASE WHEN g8 % 100 BETWEEN 80 AND 96 AND g12 % 30 <> 0 THEN CAST(g10 % 1301 - 500 AS DOUBLE) / 1e1 END AS Angle,
    CASE WHEN g8 % 100 BETWEEN 80 AND 96 THEN CASE WHEN g11 % 25 = 0 THEN 'Bunt' ELSE 'Other' END END AS TaggedHitType,
    CASE WHEN g8 % 100 BETWEEN 80 AND 96 THEN
      CASE WHEN g9 % 50 < 11 THEN 'Single' WHEN g9 % 50 < 14 THEN 'Double' WHEN g9 % 50 < 15 THEN 'Triple'
        WHEN g9 % 50 < 17 THEN 'HomeRun' WHEN g9 % 50 < 18 THEN 'Error' WHEN g9 % 50 < 20 THEN 'Sacrifice'
        ELSE 'Out' END ELSE 'Undefined' END AS PlayResult,
    CASE WHEN g12 % 100 < 25 THEN 'Heart' WHEN g12 % 100 < 65 THEN 'Shadow' WHEN g12 % 100 < 88 THEN 'Chase'
      WHEN g12 % 100 < 98 THEN 'Waste' END AS pitchzone,
    CAST(g10 % 1001 - 500 AS DOUBLE) / 1e3 AS Run_Value,
    CAST(g11 % 1200 AS DOUBLE) / 1e3 AS xw,
    CAST(60 + g12 % 81 AS DOUBLE) AS Stuff_plus, CAST(g9 % 201 AS DOUBLE) AS wStuff_plus_2,
    CAST(g3 % 1001 AS DOUBLE) / 1e3 AS xSwing_Pred
  FROM mix),
pitches AS (
  SELECT PitchUID, Date, gameID, Inning, Outs, Level, Pitcher, PitcherTeam, PitcherThrows, Batter, BatterTeam,
    BatterSide, Catcher, Balls, Strikes, PitchofPA, PitchCall, TaggedPitchType, TaggedHitType, PlayResult,
    RelSpeed, HorzBreak, InducedVertBreak, SpinRate, SpinAxis, RelHeight, RelSide, Extension, VertApprAngle,
    PlateLocSide, PlateLocHeight, ExitSpeed, Angle, pitchzone, Run_Value, Stuff_plus, wStuff_plus_2,
    CASE WHEN PitchCall = 'InPlay' THEN xw WHEN PitchCall IS NOT NULL THEN 0e0 END AS xwOBACON_value,
    CASE WHEN PlayResult = 'Single' THEN 9e-1 WHEN PlayResult = 'Double' THEN 125e-2
      WHEN PlayResult = 'Triple' THEN 16e-1 WHEN PlayResult = 'HomeRun' THEN 2e0
      WHEN PitchCall = 'HitByPitch' OR (Balls = 3 AND PitchCall IN ('BallCalled', 'BallinDirt')) THEN 7e-1
      ELSE 0e0 END AS woba_value,
    CASE WHEN PitchCall IN ('InPlay', 'HitByPitch') OR (Balls = 3 AND PitchCall IN ('BallCalled', 'BallinDirt'))
      OR (Strikes = 2 AND PitchCall IN ('StrikeSwinging', 'StrikeCalled')) THEN 1 ELSE 0 END AS woba_denom,
    CASE WHEN PitchCall IN ('InPlay', 'FoulBall', 'StrikeSwinging') THEN 1 ELSE 0 END AS is_Swing,
    xSwing_Pred
  FROM base)
SELECT * FROM pitches
