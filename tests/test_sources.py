from __future__ import annotations

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, as_set
from moundlens.checks import fixture
from moundlens.operators.filters import in_year, pitcher_dates
from moundlens.schema import LATER_COLUMNS, PITCH_COLUMNS, PITCH_SCHEMA, STORE_SEASON
from moundlens.sources import pitch_log, typed_scan
from moundlens.sources.keyed_store import KeyedStore
from moundlens.sources.pitch_log import (
    align_schema, read_raw_season, read_season_csv, read_store, union_seasons, write_csv, write_store,
)
from moundlens.sources.pruned_store import write_pruned_store
from moundlens.sources.scratch import discard, fresh_path, materialize, scratch_root
from moundlens.sources.season_load import load_games
from moundlens.sources.typed_scan import infer_types


def test_season_files_line_up_by_name(spark, make, tmp_path):
    first = make({"RelSpeed": 91.25}, {"SpinRate": None, "TaggedHitType": ""})
    second = make({"PitchUID": "z", "PlayResult": "NA"})
    wider = second.select(*reversed(PITCH_COLUMNS), F.lit(7).alias("Rel Ht."), F.lit("q").alias("wStuff+"))
    write_csv(first, str(tmp_path / "a"))
    write_csv(wider, str(tmp_path / "b"))
    both = union_seasons(
        read_season_csv(spark, str(tmp_path / "a")), read_season_csv(spark, str(tmp_path / "b"))
    )
    assert both.schema == PITCH_SCHEMA
    rows = {r["PitchUID"]: r for r in both.collect()}
    assert rows["u0"]["RelSpeed"] == 91.25
    assert rows["u1"]["SpinRate"] is None
    assert rows["z"]["PlayResult"] is None and rows["z"]["RelSpeed"] == 90.0


def test_empty_and_na_fields_are_null(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Balls,PitchUID,Rel Ht.\nNA,a,1\n,b,2\n2,c,x\nbad,d,3\n")
    schema = "PitchUID string, Balls int, `Rel Ht.` double"
    typed = spark.createDataFrame([], schema).schema
    df = read_season_csv(spark, str(tmp_path / "f.csv"), typed)
    assert [tuple(r) for r in df.orderBy("PitchUID").collect()] == [
        ("a", None, 1.0), ("b", None, 2.0), ("c", 2, None), ("d", None, 3.0),
    ]


def test_missing_column_is_an_error(spark, make):
    with pytest.raises(Exception, match="Balls"):
        align_schema(make({}).drop("Balls")).count()


def test_store_prunes_seasons_and_keeps_every_row(spark, log, tmp_path):
    write_store(log.drop(STORE_SEASON), str(tmp_path / "s"))
    store = read_store(spark, str(tmp_path / "s"))
    assert as_set(store.select(*PITCH_COLUMNS)) == as_set(log.select(*PITCH_COLUMNS))
    for kept in (in_year(store, 2023), pitcher_dates(store, None, "2023-02-01", "2023-11-01")):
        plan = kept._jdf.queryExecution().executedPlan().toString()
        pruned = plan[plan.index("PartitionFilters: [") :].split("]")[0]
        assert STORE_SEASON in pruned and "2023" in pruned
        assert kept.count() == log.where(F.year("Date") == 2023).count()


def test_store_lays_pitchers_out_in_ranges(spark, log, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "64k")  # else this little data would be one partition
    try:
        write_store(log.drop(STORE_SEASON), str(tmp_path / "s"))
    finally:
        spark.conf.unset(size)
    store = read_store(spark, str(tmp_path / "s"))
    places = store.select("Pitcher", STORE_SEASON, F.input_file_name().alias("file")).distinct()
    files = places.select("file").distinct().count()
    per_pitcher = places.groupBy("Pitcher", STORE_SEASON).count().agg(F.max("count")).first()[0]
    assert per_pitcher <= 4 < files


def test_scratch_lies_in_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert not named or fresh_path(spark, "x").startswith(named.rstrip("/"))
    assert fresh_path(spark, "x").startswith(scratch_root(spark))
    df = spark.range(5)
    assert as_set(materialize(df, "t")) == as_set(df)


def test_files_of_one_call_with_other_headers_are_refused(spark, make, tmp_path):
    log = make({"RelSpeed": 91.25, "SpinRate": 2300.0})
    swapped = ["SpinRate", "RelSpeed", *[c for c in PITCH_COLUMNS if c not in ("SpinRate", "RelSpeed")]]
    write_csv(log, str(tmp_path / "a"))
    write_csv(log.select(*swapped), str(tmp_path / "b"))
    with pytest.raises(Exception, match="(?i)header"):
        read_season_csv(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()


def test_raw_season_gets_keys_and_empty_later_columns(spark, make, tmp_path):
    rows = [{"RelSpeed": 91.25}, {"RelSpeed": 91.25}, {"RelSpeed": 80.0}, {"Pitcher": None}]
    raw = make(*rows).drop(*LATER_COLUMNS)
    write_csv(raw, str(tmp_path / "a"))
    write_csv(raw.orderBy(F.col("RelSpeed").desc()), str(tmp_path / "b"))
    one, two = (read_raw_season(spark, str(tmp_path / x)) for x in "ab")
    assert one.columns == PITCH_COLUMNS and one.select("PitchUID").distinct().count() == 4
    assert as_set(one) == as_set(two)
    assert one.where("woba_value IS NOT NULL OR Stuff_plus IS NOT NULL").isEmpty()


def test_a_users_season_column_filters_nothing(spark, make):
    log = make(*[{"Date": dt.date(2022, 5, k)} for k in (1, 2, 3)])
    for seasons in ("2023", "CAST(NULL AS INT)", "'twenty-two'"):
        labelled = log.withColumn("Season", F.expr(seasons))
        assert pitcher_dates(labelled, None, "2022-01-01", "2022-12-31").count() == 3
        assert in_year(labelled, 2022).count() == 3


def test_an_unclustered_store_is_written_without_sorting(spark, make, tmp_path, monkeypatch):
    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    writer = type(make({}).write)
    plain = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path: (seen.append(spark.conf.get(name)), plain(self, path)))
    before = spark.conf.get(name)
    days = [dt.date(2022, 4, 1), None, dt.date(2023, 4, 1), dt.date(2022, 5, 1)]
    rows = make(*({"Date": day} for day in days)).coalesce(1)
    write_store(rows, str(tmp_path / "s"), clustered=False)
    assert int(seen[0]) > 0 and spark.conf.get(name) == before
    found = read_store(spark, str(tmp_path / "s"))
    assert as_set(found.drop(STORE_SEASON)) == as_set(rows)
    assert {r[0] for r in found.select(STORE_SEASON).distinct().collect()} == {2022, 2023, None}


def test_a_tasks_share_of_the_logs_join_does_not_grow(spark, tmp_path, monkeypatch):
    line = "id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber, DOUBLE(id) AS l_extendedprice"
    spark.range(20).selectExpr(*line.split(", ")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(20).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    names, seen = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"), []
    before = [spark.conf.get(n) for n in names]
    plain = fixture.write_store
    monkeypatch.setattr(fixture, "write_store", lambda *a, **k: (seen.append([spark.conf.get(n) for n in names]), plain(*a, **k)))
    monkeypatch.setattr(fixture, "ROWS_PER_TASK", 1)
    assert fixture.pitches(spark, str(tmp_path)).count() == 20
    assert int(seen[0][0]) >= 20 and seen[0][1] == "25"
    assert [spark.conf.get(n) for n in names] == before


def shuffled(spark) -> dict[str, int]:
    """Bytes of every shuffle file that is there."""
    held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    files = [held.apply(k) for k in range(held.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


def test_writes_leave_no_shuffle_behind(log, spark, tmp_path):
    plain = log.drop(STORE_SEASON)
    before = shuffled(spark)
    materialize(plain.repartition(3, "Batter"), "moved")
    write_store(plain, str(tmp_path / "clustered"))
    assert shuffled(spark).keys() <= before.keys()
    write_pruned_store(plain, str(tmp_path / "pruned"), files=3)
    KeyedStore.write(plain, str(tmp_path / "keyed"), ["Batter"], buckets=3)
    # what is left are the counts and cut points that were collected, no pitches
    assert sum(size for name, size in shuffled(spark).items() if name not in before) < 100_000


def test_discarded_tables_are_gone(spark):
    table = materialize(spark.range(9), "short-lived")
    folder = table.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    discard(table)
    assert not os.path.exists(folder)


def test_compressed_csv_gives_the_same_rows(log, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pitch_log, "CSV_ROWS", 700)
    rows = log.select(*PITCH_SCHEMA.names)
    write_csv(rows, str(tmp_path / "plain"))
    write_csv(rows, str(tmp_path / "packed"), "gzip")
    parts = [p for p in os.listdir(tmp_path / "packed") if p.startswith("part-")]
    assert len(parts) >= rows.count() / 700 and all(p.endswith(".csv.gz") for p in parts)
    plain, packed = (read_season_csv(spark, str(tmp_path / k)) for k in ("plain", "packed"))
    assert plain.exceptAll(packed).isEmpty() and packed.count() == plain.count()
    assert infer_types(spark, str(tmp_path / "packed")) == infer_types(spark, str(tmp_path / "plain"))


def test_types_are_inferred_without_a_table_of_fields(spark, tmp_path, monkeypatch):
    (tmp_path / "f.csv").write_text("a,b\n1,x\n2,2023-01-01\n")
    written = []
    plain = typed_scan.materialize
    monkeypatch.setattr(typed_scan, "materialize", lambda df, name: (written.append(name), plain(df, name))[1])
    assert [f.dataType.simpleString() for f in infer_types(spark, str(tmp_path))] == ["int", "string"]
    assert written == ["lines"]


def test_stores_of_queries_hold_the_columns_that_are_read(spark, monkeypatch):
    from moundlens.checks import queries

    held = []
    pruned, keyed = queries.write_pruned_store, queries._keyed
    monkeypatch.setattr(queries, "write_pruned_store", lambda df, path: (held.append(df.columns), pruned(df, path))[1])
    monkeypatch.setattr(queries, "_keyed", lambda df, keys: (held.append(df.columns), keyed(df, keys))[1])
    for name, plain in (("team_chase_diff_pruned", "team_chase_diff"), ("join_stored_counts", "join_pa_counts")):
        found, want = (queries.all_queries()[n](spark, SMALL) for n in (name, plain))
        assert found.columns == want.columns and found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    assert [len(columns) for columns in held] == [9, 8]


def test_a_load_leaves_no_copy_of_the_seasons(log, spark, tmp_path):
    plain, path = log.drop(STORE_SEASON), str(tmp_path / "s")
    load_games(plain.where("Inning > 2"), path)
    before = set(glob.glob(f"{scratch_root(spark)}/moundlens-*/new-seasons"))
    load_games(plain, path)
    assert read_store(spark, path).count() == plain.count()
    assert set(glob.glob(f"{scratch_root(spark)}/moundlens-*/new-seasons")) == before
