"""The store bucketed by keys and the store laid out by three columns."""

from __future__ import annotations

import bisect
import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import as_set
from moundlens.checks import queries
from moundlens.checks.fixture import event_weights
from moundlens.plans import platoon, swing
from moundlens.schema import PITCH_COLUMNS, SCORED_COLUMNS, STORE_SEASON
from moundlens.sources.keyed_store import GROUP, PART, PARTS, KeyedStore, _name_of
from moundlens.sources.pitch_log import read_store, write_store
from moundlens.sources.pruned_store import _cell, interleave, write_pruned_store


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(log):
    """A log in which one pitcher and day, one batter, and NULL keys have a third of the rows each."""
    third = F.pmod(F.xxhash64("PitchUID"), F.lit(3))
    for name in (*swing.BASELINE_KEYS, *platoon.BATTER):
        hot = F.lit(dt.date(2023, 4, 1)) if name == "Date" else F.lit("Right" if name == "PitcherThrows" else "Hot")
        null = F.col(name) if name == "PitcherThrows" else F.lit(None)
        log = log.withColumn(name, F.when(third == 0, hot).when(third == 1, null).otherwise(F.col(name)))
    return log.drop(STORE_SEASON)


@pytest.mark.parametrize("buckets", [8, 23])
def test_keyed_store_equals_the_shuffled_join(spark, skewed, tmp_path, buckets):
    store = KeyedStore.write(skewed, str(tmp_path / "s"), swing.BASELINE_KEYS, buckets)
    assert as_set(store.rows.select(*PITCH_COLUMNS)) == as_set(skewed.select(*PITCH_COLUMNS))
    baseline = swing.stored_baseline(store)
    assert as_set(baseline.drop(GROUP, PARTS)) == as_set(swing.fastball_baseline(skewed))
    joined = swing.join_stored_baseline(store)
    want = swing.join_fastball_baseline(swing.pipeline_pitches(skewed))
    assert joined.count() == want.count()
    assert as_set(joined) == as_set(want.select(*joined.columns))
    plan = plan_of(joined)
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    ready = swing.model_ready(store)
    assert "Exchange" not in plan_of(ready)
    assert as_set(ready) == as_set(swing.model_ready(skewed).select(*ready.columns))


def test_keyed_store_by_batter(spark, skewed, tmp_path):
    KeyedStore.write(skewed, str(tmp_path / "s"), platoon.BATTER)
    store = KeyedStore.open(spark.newSession(), str(tmp_path / "s"))  # another session finds it by folder
    joined = platoon.join_stored_counts(store)
    assert "Exchange" not in plan_of(joined)
    want = platoon.join_pa_counts(platoon.final_pitches(skewed))
    assert as_set(joined) == as_set(want.select(*joined.columns))
    sample = platoon.platoon_sample(store, min_pa=5, min_side=1)
    direct = platoon.platoon_sample(skewed, min_pa=5, min_side=1)
    assert as_set(sample) == as_set(direct.select(*sample.columns)) and not sample.isEmpty()


def test_hot_keys_are_cut_into_parts(skewed, tmp_path):
    buckets, rows = 16, skewed.count()
    store = KeyedStore.write(skewed, str(tmp_path / "s"), swing.BASELINE_KEYS, buckets)
    sizes = store.rows.groupBy(GROUP, PART).count()
    assert sizes.agg(F.max("count")).first()[0] <= 0.75 * rows / buckets
    parts = store.rows.select(GROUP, PARTS).distinct()
    assert parts.where(F.col(PARTS) > 1).count() >= 2
    whole, one_file = store.rows.count(), store.rows.groupBy(F.input_file_name()).count()
    assert whole == rows and one_file.count() <= buckets
    cold = store.rows.where(F.col(PARTS) == 1).groupBy(GROUP, PART).count()
    assert "Exchange" not in plan_of(cold)


def test_keyed_store_without_rows_and_with_other_keys(log, tmp_path):
    store = KeyedStore.write(log.limit(0), str(tmp_path / "s"), swing.BASELINE_KEYS)
    assert swing.join_stored_baseline(store).count() == 0
    with pytest.raises(ValueError, match="keyed by"):
        platoon.join_stored_counts(store)


def rows_read(df) -> int:
    """Rows that the scan handed on: those of the row groups that it did not skip."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def groups_that_may_hold(path: str, batter: str) -> tuple[int, int]:
    kept = total = 0
    for file in glob.glob(f"{path}/*/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index("Batter")
        for k in range(meta.num_row_groups):
            stats = meta.row_group(k).column(at).statistics
            total += 1
            kept += stats is not None and stats.has_min_max and stats.min <= batter <= stats.max
    return kept, total


@pytest.fixture(scope="module")
def players(log):
    """Pitches of 997 batters and 499 pitchers, a third of them of one pitcher and one day."""
    hot = F.pmod(F.xxhash64("PitchUID", F.lit(1)), F.lit(3)) == 0
    of = lambda n, seed: F.format_string("P%03d", F.pmod(F.xxhash64("PitchUID", F.lit(seed)), F.lit(n)))
    return log.drop(STORE_SEASON).withColumns({
        "Batter": of(997, 2),
        "Pitcher": F.when(hot, "P007").otherwise(of(499, 3)),
        "Date": F.when(hot, F.lit(dt.date(2023, 4, 1))).otherwise(F.col("Date")),
    })


def test_pruned_store_reads_few_row_groups_for_one_batter(spark, players, tmp_path):
    path = str(tmp_path / "s")
    write_pruned_store(players, path, files=60)
    store = read_store(spark, path)
    assert as_set(store.select(*PITCH_COLUMNS)) == as_set(players.select(*PITCH_COLUMNS))
    kept, total = groups_that_may_hold(path, "P500")
    assert total >= 60 and kept <= total / 3  # three columns share the cut: 60 ** (2 / 3) is 15
    rows = players.count()
    for name, value in (("Batter", "P500"), ("Pitcher", "P123")):
        chosen = store.where(F.col(name) == value).select("PitchUID", name)
        assert rows_read(chosen) <= rows / 4
        assert as_set(chosen) == as_set(players.where(F.col(name) == value).select("PitchUID", name))
    sizes = [row["count"] for row in store.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 6 * rows / 60  # the hot pitcher and day are spread


def test_bloom_filters_skip_names_between_the_ends(spark, players, tmp_path):
    """Without dictionaries only the filters can tell that a name is not there."""
    path = str(tmp_path / "s")
    write_pruned_store(players, path, files=4, **{"parquet.enable.dictionary": "false"})
    store = read_store(spark, path)
    absent = store.where(F.col("Batter") == "P5005").select("PitchUID", "Batter")
    assert groups_that_may_hold(path, "P5005")[0] >= 1
    assert rows_read(absent) == 0
    assert rows_read(store.where(F.col("Batter") > "P5005").select("PitchUID", "Batter")) > 0


def test_pruned_store_of_nulls_and_of_nothing(spark, make, tmp_path):
    rows = make(
        {"Pitcher": None}, {"Batter": None}, {"Date": None}, {"Batter": ""}, {"Pitcher": "Ærø, Ö"}, {"Batter": "x" * 300}
    )
    write_pruned_store(rows, str(tmp_path / "a"))
    assert as_set(read_store(spark, str(tmp_path / "a")).select(*PITCH_COLUMNS)) == as_set(rows)
    write_pruned_store(rows, str(tmp_path / "a"), mode="overwrite")
    assert read_store(spark, str(tmp_path / "a")).count() == 6
    write_pruned_store(rows.limit(0), str(tmp_path / "b"), files=2)
    assert not glob.glob(str(tmp_path / "b" / "*" / "*.parquet"))


def test_interleaved_bits(spark):
    cells = spark.sql("SELECT CAST(5 AS LONG) a, CAST(3 AS LONG) b, CAST(6 AS LONG) c")
    place = cells.select(interleave([F.col("a"), F.col("b"), F.col("c")], 3)).first()[0]
    assert place == 0b101_011_110


def test_cells_are_found_by_plain_comparisons(spark):
    """Functions over arrays are interpreted, value by value and cut by cut."""
    cuts = [-5, 0, 0, 7, 1 << 40]
    values = [-6, -5, -4, 0, 1, 7, 8, 1 << 40, (1 << 40) + 1]
    found = spark.createDataFrame([(v,) for v in values], "v long").select("v", _cell(F.col("v"), cuts).alias("cell"))
    assert "lambda" not in found._jdf.queryExecution().toString()
    assert {r["v"]: r["cell"] for r in found.collect()} == {v: bisect.bisect_left(cuts, v) for v in values}
    assert spark.range(1).select(_cell(F.lit(3), [])).first()[0] == 0


def test_names_of_keys_differ_as_the_keys_do(spark):
    keys = [(None, "a"), ("a", None), ("-", "a"), ("1:a", None), ("", "a"), ("a", ""), ("a1:a", ""), ("a", "1:a"), (None, None)]
    found = spark.createDataFrame(keys, "a string, b string").select(_name_of(["a", "b"]).alias("name")).collect()
    assert len({r["name"] for r in found}) == len(keys) and all(r["name"] for r in found)


def test_only_fastballs_travel_to_the_baseline(log):
    assert "IN (Fastball,Sinker)" in plan_of(swing.fastball_baseline(log))


def test_written_pitches_have_the_columns_that_are_read(log, monkeypatch):
    written, plain = {}, queries.materialize
    monkeypatch.setattr(queries, "materialize", lambda df, name: (written.update({name: df.columns}), plain(df, name))[1])
    queries.union_scored(log)
    assert set(written["model_ready"]) == {"TaggedPitchType", *SCORED_COLUMNS}
    result = queries.feature_sets(log)
    assert set(written["model_ready"]) == {"TaggedPitchType", *result.columns} - {"swing_class"}


def test_model_inputs_are_all_that_weighted_pitches_need(log):
    weights = event_weights(log)
    ready = swing.model_ready(log.select(*swing.MODEL_INPUTS), weights)
    assert as_set(ready) == as_set(swing.model_ready(log, weights).select(*ready.columns))


def test_store_files_are_written_with_zstd(log, tmp_path):
    write_store(log.drop(STORE_SEASON).limit(9), str(tmp_path / "s"), clustered=False)
    files = glob.glob(str(tmp_path / "s" / "*" / "*.parquet"))
    assert files and all(name.endswith(".zstd.parquet") for name in files)
