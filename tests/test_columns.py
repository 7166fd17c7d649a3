"""Missing values, rounding, text and flags on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from conftest import column
from moundlens.functions.numbers import exact_mean, percent_text, round_half_up, strict_mean
from moundlens.functions.student_t import two_sided_p
from moundlens.functions.text import count_label, name_parts
from moundlens.operators import filters, flags
from moundlens.plans import platoon


def test_unknown_call_stays_unknown_or_false_by_rule(make):
    flagged = flags.pitch_flags(make({"PitchCall": None}, {"PitchCall": "StrikeSwinging"}))
    assert column(flagged, "is_Whiff") == [None, True]
    assert column(flagged, "is_Swing") == [False, True]
    assert column(flagged, "is_PA") == [None, 0]


def test_zone_edges_and_missing_location(make):
    df = make(
        {"PlateLocHeight": 1.6, "PlateLocSide": 0.85},
        {"PlateLocHeight": 3.51},
        {"PlateLocHeight": None},
        {"PlateLocHeight": None, "PlateLocSide": 2.0},
    )
    assert column(flags.pitch_flags(df), "is_Zone") == [True, False, None, False]
    assert filters.in_zone(df).count() == 1
    assert filters.out_of_zone(df).count() == 2
    bands = flags.movement_bands(df)
    assert column(bands, "TopZone") == [False, True, False, False]


def test_angle_limits_differ_between_profiles(make):
    df = make(*[{"PitchCall": "InPlay", "Angle": a} for a in (9.9, 10.0, 25.0, 50.0, None)])
    model = flags.model_flags(df)
    assert column(model, "is_Groundball") == [1, 0, 0, 0, None]
    assert column(model, "is_Linedrive") == [0, 1, 1, 0, None]
    assert column(model, "is_Flyball") == [0, 0, 1, 1, None]
    taken = make({"PitchCall": "BallCalled", "Angle": 5.0})
    assert column(flags.pitch_flags(taken), "is_GB") == [True]
    assert column(flags.model_flags(taken), "is_Groundball") == [0]


def test_swing_profiles_differ_on_unplayable_fouls(make):
    df = make({"PitchCall": "FoulBallNotFieldable"}, {"PitchCall": "FoulBallFieldable"})
    assert column(flags.pitch_flags(df), "is_Swing") == [True, False]
    assert column(flags.model_flags(df), "is_Swing") == [0, 0]
    assert column(flags.model_flags(df), "is_Foul") == [1, 1]


def test_same_hand_is_the_platoon_indicator_and_break_is_mirrored(make):
    df = make(
        {"PitcherThrows": "Left", "BatterSide": "Left", "HorzBreak": 4.0, "RelSide": -2.0},
        {"PitcherThrows": "Right", "BatterSide": "Left", "HorzBreak": 4.0},
    )
    model = flags.model_flags(df)
    assert column(model, "PlatoonAdv") == [1, 0]
    assert column(model, "HB_adjusted") == [-4.0, 4.0]
    assert column(model, "RelSide_adjusted") == [2.0, 1.5]


def test_plate_appearance_arithmetic(make):
    df = make(
        {"PitchCall": "InPlay", "PlayResult": "Sacrifice", "xwOBACON_value": 0.3},
        {"PitchCall": "StrikeCalled", "Strikes": 2},
        {"PitchCall": "BallinDirt", "Balls": 3},
        {"PitchCall": "HitByPitch"},
    )
    flagged = flags.pitch_flags(df)
    assert column(flagged, "is_AB") == [0, 1, 0, 0]
    assert column(flagged, "is_PA") == [1, 1, 1, 1]
    assert column(flagged, "xwOBA_weights") == [0.3, 0.0, 0.7, 0.7]


def test_labels_outside_the_list(make):
    df = make(
        {"TaggedPitchType": "Slurve"}, {"TaggedPitchType": None}, {"TaggedPitchType": "Cutter"}
    )
    assert column(flags.pitch_type(df), "pitch_type") == [None, None, "Cutter"]
    classes = df.select("PitchUID", flags.pitch_class().alias("c"))
    assert column(classes, "c") == ["Breaking Ball", "Other", "Breaking Ball"]


def test_counts(make):
    df = make({"Balls": 3, "Strikes": 0}, {"Balls": 1, "Strikes": 1}, {"Balls": None, "Strikes": 2})
    labelled = df.select(
        "PitchUID", count_label().alias("l"), flags.count_type_v1().alias("a"),
        flags.count_type_v2().alias("b"),
    )
    assert column(labelled, "l") == ["3-0", "1-1", "NA-2"]
    assert column(labelled, "a") == ["Behind", "Neutral", "Neutral"]
    assert column(labelled, "b") == ["3-0", "Even", "3-0"]


def test_names_split_at_the_first_comma(spark):
    df = spark.createDataFrame([("Smith, J, Jr",), ("Solo",), (None,)], "Pitcher string")
    first, last = name_parts()
    rows = df.select(first.alias("f"), last.alias("l")).collect()
    assert [(r.f, r.l) for r in rows] == [("J, Jr", "Smith"), ("", "Solo"), (None, None)]


def test_filters_drop_unknown(make):
    df = make({"PitchCall": None}, {"TaggedPitchType": None}, {"PitchCall": "Undefined"}, {})
    assert column(filters.valid_pitches(df), "PitchUID") == ["u3"]
    dated = make({"Date": None}, {})
    assert filters.exclude_date(dated).count() == 1
    chosen = filters.pitcher_dates(make({}, {"Pitcher": "X, Y"}), ["X, Y"], "2023-04-01", "2023-04-01")
    assert column(chosen, "PitchUID") == ["u1"]


def test_rounding_takes_binary_halves_up(spark):
    # 23 / 40 lies just under its decimal tie in binary, so it goes down
    df = spark.createDataFrame([(0.125,), (-0.125,), (2.5,), (23 / 40,), (None,)], "x double")
    two = [r[0] for r in df.select(round_half_up(F.col("x"), 2)).collect()]
    assert two == [0.13, -0.12, 2.5, 0.57, None]
    none = [r[0] for r in df.select(round_half_up(F.col("x"), 0)).collect()]
    assert none == [0.0, 0.0, 3.0, 1.0, None]


def test_percent_text(spark):
    df = spark.createDataFrame([(0.0025,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(percent_text(F.col("x"))).collect()] == ["0.3%", "100.0%", None]


def test_strict_mean_is_unknown_when_a_choice_is(spark):
    schema = "g int, x int, c boolean"
    rows = [(1, 1, True), (1, 0, True), (1, 1, False), (2, 1, True), (2, 1, None), (3, 1, False),
            (4, None, True)]
    means = spark.createDataFrame(rows, schema).groupBy("g").agg(
        strict_mean(F.col("x"), F.col("c")).alias("m")
    )
    assert column(means, "m", "g") == [0.5, None, None, None]


def test_exact_mean_ignores_order_and_empty_groups(spark):
    rows = [(1, 0.1)] * 7 + [(1, 0.2)] * 5 + [(2, None)]
    means = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g int, x double").repartition(parts)
        means.append(column(df.groupBy("g").agg(exact_mean(F.col("x")).alias("m")), "m", "g"))
    assert means[0] == means[1] == [1.7 / 12, None]


@pytest.mark.parametrize("rows", [12, 400])
def test_p_value_equals_the_library(spark, rows):
    data = [(float(i % 2), (i * 37 % 101) / 50 + (i % 2) * 0.05) for i in range(rows)]
    df = spark.createDataFrame(data, "x double, y double")
    mine = {r["term"]: r for r in platoon.ols(df, "y", "x").collect()}
    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    library = LinearRegression(solver="normal", labelCol="y").fit(vectors).summary
    for term, place in (("x", 0), ("(Intercept)", 1)):  # the library lists the intercept last
        assert mine[term]["std_error"] == pytest.approx(
            library.coefficientStandardErrors[place], rel=1e-9
        )
        assert mine[term]["t_value"] == pytest.approx(library.tValues[place], rel=1e-9)
        assert mine[term]["p_value"] == pytest.approx(library.pValues[place], abs=1e-9)
    assert mine["x"]["r_squared"] == pytest.approx(library.r2, abs=1e-12)


def test_p_value_far_out(spark):
    df = spark.createDataFrame([(0.0, 5.0), (60.0, 1000.0), (2.0, 1.0)], "t double, df double")
    found = [r[0] for r in df.select(two_sided_p(F.col("t"), F.col("df"))).collect()]
    assert found[0] == pytest.approx(1.0) and found[1] == pytest.approx(0.0, abs=1e-12)
    assert found[2] == pytest.approx(0.2951672, abs=1e-6)  # Cauchy: 1 - 2 atan(2) / pi
