"""Inferred types against a plain pass over the rows, and what happens to records that do not fit."""

from __future__ import annotations

import csv
import datetime as dt
import random
import re

import pytest
from pyspark.sql import Row, functions as F, types as T

from moundlens.sources import typed_scan
from moundlens.sources.typed_scan import infer_types, numbered_lines, scan_season

VALUES = {
    "int": ["1", "-7", "+3", "007", "2147483647"],
    "bigint": ["2147483648", "-99999999999"],
    "double": ["1.5", "-.25", "3.", "1e5", "99999999999999999999"],
    "date": ["2023-04-01", "2024-02-29"],
    "string": ["x", "2023-02-30", "1,5", "1d", "NaN", "a\"b", " 1x", "2023-4-1"],
}


def plain_type(values):
    """The narrowest type by Python's own parsing."""
    values = [v for v in values if v not in ("", "NA")]

    def is_date(v):
        try:
            return bool(re.fullmatch(r"\d{4}-\d\d-\d\d", v)) and bool(dt.date.fromisoformat(v))
        except ValueError:
            return False

    if values and all(re.fullmatch(r"[+-]?\d+", v) for v in values):
        numbers = [int(v) for v in values]
        for kind, bits in (("int", 31), ("bigint", 63)):
            if all(-(2**bits) <= n < 2**bits for n in numbers):
                return kind
    if values and all(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v) for v in values):
        return "double"
    return "date" if values and all(map(is_date, values)) else "string"


def test_types_equal_a_plain_pass(spark, tmp_path):
    rng = random.Random(4)
    columns = []
    for _ in range(40):
        kinds = rng.sample(list(VALUES), rng.choice([1, 1, 2]))
        pool = [v for kind in kinds for v in VALUES[kind]] + ["NA", ""]
        columns.append([rng.choice(pool) for _ in range(60)])
    columns += [["NA", ""] * 30, ["1"] * 59 + ["x"]]  # no value; one odd value at the end
    rows = list(zip(*columns, strict=True))
    for part in range(3):
        with open(tmp_path / f"{part}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n", escapechar="\\", doublequote=False)
            writer.writerows([[f"col {k}" for k in range(len(columns))], *rows[part * 20 : part * 20 + 20]])
    schema = infer_types(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in schema] == [plain_type(c) for c in columns]
    scan = scan_season(spark, str(tmp_path))
    assert scan.schema == schema and scan.rows.count() == 60 and scan.quarantine.count() == 0


def test_no_record_vanishes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,n,day\n1,5,2023-04-01\n\n2,five,2023-04-01\n3,6\n4,7,2023-04-01,9\nx,,yesterday\n5,NA,\n')
    (tmp_path / "b.csv").write_text("id,n,day\r\n6,8,2023-04-02\r\n7,1.5,2023-04-02")
    schema = spark.createDataFrame([], "n int, day date, id string").schema
    scan = scan_season(spark, str(tmp_path), schema)
    day = dt.date(2023, 4, 1)
    assert sorted(map(str, scan.rows.collect())) == sorted(
        str(Row(n=n, day=d, id=i)) for n, d, i in [(5, day, "1"), (None, None, "5"), (8, dt.date(2023, 4, 2), "6")]
    )
    bad = {(r["file"][-5:], r["line"]): (r["text"], r["problems"]) for r in scan.quarantine.collect()}
    assert bad == {
        ("a.csv", 4): ("2,five,2023-04-01", ["n"]),
        ("a.csv", 5): ("3,6", ["fields"]),
        ("a.csv", 6): ("4,7,2023-04-01,9", ["fields"]),
        ("a.csv", 7): ("x,,yesterday", ["day"]),
        ("b.csv", 3): ("7,1.5,2023-04-02", ["n"]),
    }


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = ["h", *(f"{k}," + "x" * (k % 50) for k in range(2, 3_000))]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    (tmp_path / "b.csv").write_text("h\n2,y\n")
    size = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(size, "5000")
    try:
        got = numbered_lines(spark, str(tmp_path)).collect()
        splits = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.unset(size)
    assert splits > 10
    assert sorted((r["line"], r["text"]) for r in got if r["file"].endswith("a.csv")) == list(enumerate(lines, 1))
    assert sorted((r["line"], r["text"]) for r in got if r["file"].endswith("b.csv")) == [(1, "h"), (2, "2,y")]


def test_headers_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\n")
    (tmp_path / "b.csv").write_text("")
    scan = scan_season(spark, str(tmp_path))
    assert scan.rows.dtypes == [("id", "string"), ("n", "string")] and scan.rows.isEmpty() and scan.quarantine.isEmpty()
    with pytest.raises(ValueError, match="not in the files"):
        scan_season(spark, str(tmp_path), T.StructType().add("other", T.IntegerType()))
    (tmp_path / "c.csv").write_text("n,id\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        scan_season(spark, str(tmp_path))
    (tmp_path / "twice").mkdir()
    (tmp_path / "twice" / "d.csv").write_text("n,n\n1,2\n")
    with pytest.raises(ValueError, match="repeats"):
        scan_season(spark, str(tmp_path / "twice"))


def test_the_fold_is_one_small_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\n" + "\n".join(f"{k},{k}.5" for k in range(500)))
    records, names = typed_scan._records(spark, str(tmp_path))
    folded = records.agg(F.bool_and(typed_scan._fits(F.col("c0"), "int")))
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "partial_bool_and" in plan or "partial_min" in plan
    assert [f.dataType.simpleString() for f in typed_scan._inferred(records, names)] == ["int", "double"]


def test_a_value_is_placed_once_among_the_types(spark):
    values = ["1", "-2147483649", "9" * 30, "1.5", "1e999", ".", "2023-02-28", "2023-02-30", "x", "1 ", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(typed_scan._kind(df.v)).collect()] == [0, 1, 2, 2, 2, 4, 3, 4, 4, 4, None]
