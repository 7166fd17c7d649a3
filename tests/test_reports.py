from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import as_set
from moundlens.operators.filters import valid_pitches
from moundlens.plans import mix, reports

REPORTS = {
    "overall": reports.overall, "pitch_type": reports.by_pitch_type,
    "attack_zone": reports.by_attack_zone, "count": reports.by_count,
    "count_type": reports.by_count_type, "platoon": reports.platoon,
    "platoon_pitch_type": reports.platoon_by_pitch_type, "movement": reports.movement,
    "mix_by_count": mix.by_count, "mix_by_count_type": mix.by_count_type,
    "mix_by_side": mix.by_side, "names": reports.pitcher_names,
    "league": reports.league_comparison,
}
DATES = ("2022-03-03", "2023-04-10")


@pytest.mark.parametrize("name", REPORTS)
def test_all_pitchers_equal_one_pitcher(log, name):
    one = "Last3, First3"
    together = REPORTS[name](log, None, *DATES).where(F.col("Pitcher") == one)
    alone = REPORTS[name](log, [one], *DATES)
    assert as_set(together) == as_set(alone) != set()


@pytest.mark.parametrize(
    "name", "overall pitch_type attack_zone count count_type platoon platoon_pitch_type".split()
)
def test_one_pass_equals_the_single_reports(log, name):
    single = REPORTS[name](log, None, *DATES).drop("mix")
    suite = reports.all_grains(log, None, *DATES).where(F.col("report") == name)
    assert as_set(suite.select(*single.columns)) == as_set(single)


def test_missing_label_is_a_group_and_counts_in_the_mix(make):
    df = make(
        {"TaggedPitchType": "Splitter"}, {"TaggedPitchType": "Slurve"}, {}, {"PitchCall": None}
    )
    rows = reports.by_pitch_type(df).collect()
    assert [(r["pitch_type"], r["pitches"], r["mix"]) for r in rows] == [
        (None, 2, "66.7%"), ("Fastball", 1, "33.3%"),
    ]


def test_equal_counts_follow_the_label_order(make):
    df = make(*[{"TaggedPitchType": t} for t in ("ChangeUp", "Slurve", "Cutter", "Fastball")])
    order = [r["pitch_type"] for r in reports.by_pitch_type(df).collect()]
    assert order == ["Fastball", "Cutter", "ChangeUp", None]


def test_strict_rates_vanish_with_an_unlocated_swing(make):
    swing = {"PitchCall": "StrikeSwinging"}
    located = reports.overall(make(swing, {})).first()
    assert located["z_whiff_pct"] == 1.0
    unknown = reports.overall(make(swing, {**swing, "PlateLocSide": None}, {})).first()
    assert unknown["z_whiff_pct"] is None and unknown["whiff_pct"] == 1.0
    # an unlocated take decides nothing
    take = reports.overall(make(swing, {"PlateLocSide": None})).first()
    assert take["z_whiff_pct"] == 1.0
    assert reports.overall(make({"PitchofPA": None}, {})).first()["fps_pct"] is None


def test_nothing_to_average_is_null(make):
    row = reports.overall(make({"Run_Value": None})).first()
    assert row["whiff_pct"] is None and row["wobacon"] is None and row["rv_per_100"] is None
    zone = reports.by_attack_zone(make({"Run_Value": None, "pitchzone": "Odd"})).first()
    assert zone["pitchzone"] is None and zone["rv"] == 0.0


def test_swing_rate_splits_by_zone(log):
    located = log.where(F.col("PlateLocSide").isNotNull())
    for row in reports.by_pitch_type(located).collect():
        inside = (row["z_swing_pct"] or 0) * row["zone_pct"]
        outside = (row["chase_pct"] or 0) * (1 - row["zone_pct"])
        assert row["swing_pct"] == pytest.approx(inside + outside, abs=3e-5)


def test_mix_totals_meet_report_counts_after_the_call_filter(log):
    totals = mix.by_count(valid_pitches(log)).select("Pitcher", "Count", "total_pitches").distinct()
    counts = reports.by_count(log).select("Pitcher", "Count", F.col("pitches").alias("total_pitches"))
    assert as_set(totals) == as_set(counts)


def test_slices_add_up(log):
    rows = mix.by_side(log).collect()
    sides: dict = {}
    for r in rows:
        sides.setdefault((r["Pitcher"], r["BatterSide"]), []).append(r)
    for slices in sides.values():
        assert sum(r["pcts"] for r in slices) == pytest.approx(100, abs=0.5)
        below = 0.0
        for r in slices:  # already from the last type to the first
            assert r["text_y"] == pytest.approx(below + r["pcts"] / 2)
            below += r["pcts"]
            assert r["labels"] == f"{r['pcts']:g}%"


def test_movement_excludes_the_date_and_keeps_unknown_calls(make):
    import datetime as dt

    df = make({"PitchCall": None, "PlateLocHeight": 3.0}, {"Date": dt.date(2023, 10, 6)})
    row = reports.movement(df).first()
    assert row["pitches"] == 1 and row["top_zone_vaa"] == -5.0 and row["bot_zone_vaa"] is None


def test_league_table(spark, make):
    assert reports.league_averages(spark).count() == 14
    row = reports.league_comparison(make({"TaggedPitchType": "ChangeUp", "RelSpeed": 88.0})).first()
    assert row["velo_diff"] == 2.0 and row["p_throws"] == "Right"


def test_names_count_inside_or_outside_the_range(make):
    import datetime as dt

    df = make({}, {"Date": dt.date(2022, 1, 1)}, {"PitchCall": "Undefined"})
    inside = reports.pitcher_names(df, None, "2023-01-01", "2023-12-31").first()
    always = reports.pitcher_names(df, None, "2023-01-01", "2023-12-31", dated=False).first()
    assert (inside["pitches"], always["pitches"]) == (2, 3)
    assert (inside["first_name"], inside["last_name"]) == ("Jo", "Doe")


def test_report_reads_only_its_columns_and_sends_sums(log):
    plan = reports.by_pitch_type(log)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("ReadSchema") :]
    assert "SpinRate" not in scan and "Catcher" not in scan
    assert "PushedFilters: [IsNotNull(PitchCall)" in plan
    assert "partial_count" in plan and "BatchEvalPython" not in plan
