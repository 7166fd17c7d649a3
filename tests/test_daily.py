"""Reports from daily sums against reports from the log."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import as_set
from moundlens.plans import daily, reports
from moundlens.plans.daily import TABLES, DailySums, _day_sums, _pitch_rows, _placed
from moundlens.schema import STORE_SEASON
from moundlens.sources.pitch_log import read_store, write_store

REPORTS = [
    reports.overall, reports.by_pitch_type, reports.by_attack_zone, reports.by_count,
    reports.by_count_type, reports.platoon, reports.platoon_by_pitch_type, reports.all_grains,
    reports.movement, reports.league_comparison, reports.pitcher_names,
]
RANGE = ("2022-03-03", "2023-04-10")


@pytest.fixture(scope="module")
def some(log, tmp_path_factory):
    """A few pitchers, so that eleven reports stay quick."""
    chosen = log.where("Pitcher < 'Last2'").drop(STORE_SEASON)
    path = str(tmp_path_factory.mktemp("daily") / "log")
    write_store(chosen, path)
    store = read_store(log.sparkSession, path)
    return store, DailySums.build(store, path + "-sums")


@pytest.mark.parametrize("report", REPORTS, ids=lambda f: f.__name__)
def test_reports_equal_the_direct_ones_without_the_pitches(some, report):
    log, sums = some
    direct, stored = report(log, None, *RANGE), report(sums, None, *RANGE)
    assert stored.dtypes == direct.dtypes
    assert as_set(stored) == as_set(direct) != set()
    assert all(sums.path in file for file in stored.inputFiles())
    who = [log.select("Pitcher").first()[0]]
    assert as_set(report(sums, who)) == as_set(report(log, who))


def test_a_range_opens_only_its_days(some):
    _, sums = some
    plan = reports.overall(sums, None, *RANGE)._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "2022-03-03" in filters and "2023-04-10" in filters


def test_days_are_added_corrected_and_deleted(spark, make, tmp_path):
    def log(*days):
        rows = [{"Date": d, "Pitcher": p, "RelSpeed": v} for d, p, v in days]
        return make(*[{"PitchUID": f"u{k}", **row} for k, row in enumerate(rows)])

    a, b, c = (dt.date(2023, 4, k) for k in (1, 2, 3))
    sums = DailySums.build(log((a, "A, A", 90.0), (b, "A, A", 91.0), (b, None, 80.0), (None, "A, A", 70.0)), str(tmp_path / "s"))
    now = log((a, "A, A", 90.0), (c, "B, B", 95.0), (c, "B, B", float("nan")), (None, "C, C", None))
    for _ in range(2):  # the second time changes nothing
        sums.update(now, [b, "2023-04-03", None])
        for report in (reports.overall, reports.movement, reports.pitcher_names):
            for dates in ((), (None, "2023-04-02", "2023-04-03"), (["A, A"],)):
                assert as_set(report(sums, *dates)) == as_set(report(now, *dates))
    sums.update(now, [])
    kept = {r["Date"] for r in sums.table("names").select("Date").collect()}
    assert kept == {a, c, None}


def test_without_pitches(spark, make, tmp_path):
    sums = DailySums.build(make({}).where("false"), str(tmp_path / "s"))
    assert reports.all_grains(sums).isEmpty() and reports.movement(sums).isEmpty()
    sums.update(make({}), ["2023-04-01"])
    assert as_set(reports.overall(sums)) == as_set(reports.overall(make({})))
    assert all(sums.table(name).count() for name in TABLES)


def test_rows_do_not_grow_with_pitches(spark, make, tmp_path):
    one = make({})
    many = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("copy")
    small, large = DailySums.build(one, str(tmp_path / "a")), DailySums.build(many, str(tmp_path / "b"))
    for name in TABLES:
        assert small.table(name).count() == large.table(name).count()


def test_reports_move_nothing_where_days_are_bucketed(some, tmp_path):
    log, _ = some
    late = log.where("Date > '2023-04-01'")
    DailySums.build(log.where("Inning > 2"), str(tmp_path / "s"), buckets=8).update(
        log, [r[0] for r in log.select("Date").distinct().collect()]
    )
    sums = DailySums(log.sparkSession.newSession(), str(tmp_path / "s"))  # found by folder
    for report in (reports.all_grains, reports.by_count_type, reports.movement):
        assert as_set(report(sums, None, *RANGE)) == as_set(report(log, None, *RANGE)) != set()
    plan = reports.all_grains(sums, None, *RANGE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    mine = sums.table("reports").where("Date > '2023-04-01'")
    per_day = mine.select("Date", F.input_file_name().alias("f")).distinct().groupBy("Date").count()
    assert {r["count"] for r in per_day.collect()} <= set(range(1, 9)) and not late.isEmpty()


def test_each_pitch_moves_once(some, tmp_path):
    log, _ = some
    plan = _day_sums(_placed(_pitch_rows(log), 1))._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert plan.count("Exchange") == 1 and "Expand" not in plan


def test_a_pitcher_with_very_many_pitches_a_day_has_several_tasks(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(daily, "ROWS_PER_TASK", 20)
    kinds = ("Fastball", "Other", None, "Slider")
    rows = [{"Pitcher": None, "Date": None, "RelSpeed": 80.0 + k % 7, "TaggedPitchType": kinds[k % 4]} for k in range(300)]
    log = make(*rows, {"Pitcher": "A, A", "PitchCall": "InPlay"}, {"Pitcher": "A, A", "PitchCall": None})
    placed = _placed(_pitch_rows(log), 1)
    assert 2 < placed.where("Pitcher IS NULL").select("_part").distinct().count() <= 300 / 20
    sums = DailySums.build(log, str(tmp_path / "s"))
    for report in (reports.all_grains, reports.movement, reports.pitcher_names):
        assert as_set(report(sums)) == as_set(report(log)) != set()
