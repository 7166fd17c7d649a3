"""Season files with inferred types, and a side table of the records that do not fit.

Types are inferred from every row, not from a sample: each column keeps which of the types integer,
double and date all its values fit (the least and the greatest place among the types, folded on the map side), and gets the narrowest.
A record with another number of fields than the header, or with a value outside its column's type,
does not vanish or lose the value: it goes to `quarantine` with its file, line and reasons.

Lines are numbered across the splits of a file: a task numbers the lines it reads, the lines of each
split are counted, and running totals of these (one row a split) give the first line of each.

Defined cases: empty fields and `NA` are NULL and fit every type; a column without values is text;
blank lines are skipped, but numbered; a file without lines adds nothing; names that a header
repeats, and headers that differ between files of one scan, are an error. A record is one line:
line breaks inside quotes are not supported, and their halves end in quarantine.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from moundlens.operators.joins import join_group_table
from moundlens.session import WRITING, settings
from moundlens.sources.scratch import materialize

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
# Narrowest first; text fits everything.
LATTICE: dict[str, T.DataType] = {
    "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "date": T.DateType(),
}


@dataclass(frozen=True)
class Scan:
    rows: DataFrame  # records that fit
    quarantine: DataFrame  # file, line, text, problems: `fields` or the names of columns
    schema: T.StructType


def _kind(value: Column) -> Column:
    """Place of the narrowest type in LATTICE that a value fits, past its end for text. Whole numbers
    fit the later number types too; a missing value says nothing."""
    fits = [value.try_cast(t).isNotNull() for t in LATTICE.values()]
    number = F.when(value.rlike(INTEGER) & (fits[0] | fits[1]), F.when(fits[0], 0).otherwise(1))
    number = F.when(value.rlike(NUMBER), F.coalesce(number, F.when(fits[2], 2), F.lit(len(LATTICE))))
    return F.when(
        value.isNotNull(),
        F.coalesce(number, F.when(value.rlike(DATE) & fits[3], 3), F.lit(len(LATTICE))),
    )


def _fits(value: Column, kind: str) -> Column:
    """Whether a value fits a type of LATTICE."""
    place = list(LATTICE).index(kind)
    return _kind(value) == place if kind == "date" else _kind(value) <= place


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, text) of every line, numbered from 1 in its file."""
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),  # rises along the lines of a split
        F.col("value").alias("text"),
    )
    lines = materialize(read, "lines")
    splits = lines.groupBy("file", "split").agg(
        F.count(F.lit(1)).alias("group_rows"), F.min("place").alias("first")
    )
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("group_rows").over(earlier), F.lit(0)))
    joined = join_group_table(lines, splits, ["file", "split"], F.xxhash64("place"))
    number = F.col("before") + F.col("place") - F.col("first") + 1
    return joined.select("file", number.alias("line"), "text")


def _header(lines: DataFrame) -> list[str]:
    heads = lines.where(F.col("line") == 1).agg(F.min("text").alias("one"), F.max("text").alias("other")).first()
    if heads["one"] is None:
        raise ValueError("there is no file with a header")
    if heads["one"] != heads["other"]:
        raise ValueError(f"files with different headers: {heads['one']!r} and {heads['other']!r}")
    names = next(csv.reader([heads["one"].removeprefix("﻿")]))
    if len(set(names)) < len(names):
        raise ValueError("the header repeats a name")
    return names


def _records(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """(file, line, text, malformed, c0, c1, ...): fields as text; and their names."""
    lines = numbered_lines(spark, path)
    names = _header(lines)
    fields = ", ".join([*(f"c{k} string" for k in range(len(names))), "bad string"])
    options = {"nullValue": "NA", "columnNameOfCorruptRecord": "bad"}
    body = lines.where((F.col("line") > 1) & (F.trim("text") != ""))
    parsed = body.withColumn("r", F.from_csv("text", fields, options))
    records = parsed.select(
        "file", "line", "text", F.col("r.bad").isNotNull().alias("malformed"),
        *[F.when(F.col(f"r.c{k}") != "", F.col(f"r.c{k}")).alias(f"c{k}") for k in range(len(names))],
    )
    return records, names


def _inferred(records: DataFrame, names: list[str]) -> T.StructType:
    whole = records.where(~F.col("malformed")).select(
        *[_kind(F.col(f"c{k}")).alias(f"c{k}") for k in range(len(names))]
    )
    ends = [f(f"c{k}").alias(f"{end}{k}") for k in range(len(names)) for end, f in (("low", F.min), ("high", F.max))]
    with settings(records.sparkSession, WRITING):  # so many folds in one method would be interpreted
        found = whole.agg(*ends).first()

    def widest(low: int | None, high: int | None) -> T.DataType:
        types = list(LATTICE.values())
        numbers = high is not None and high < 3
        return types[high] if numbers or low == high == 3 else T.StringType()

    return T.StructType(
        [T.StructField(name, widest(found[f"low{k}"], found[f"high{k}"])) for k, name in enumerate(names)]
    )


def infer_types(spark: SparkSession, path: str | list[str]) -> T.StructType:
    """The narrowest type of every column that all its values fit; records with another number of
    fields than the header are not asked."""
    return _inferred(*_records(spark, path))


def scan_season(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> Scan:
    """The files' records by the types of `schema`, or by inferred ones.

    Columns are found by name, and columns outside the schema are left out. Every record is either in
    `rows` or in `quarantine`.
    """
    records, names = _records(spark, path)
    records = materialize(records, "records")  # read for the types, the rows and the quarantine
    schema = _inferred(records, names) if schema is None else schema
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"columns not in the files: {missing}")
    at = {name: F.col(f"c{k}") for k, name in enumerate(names)}
    typed = {f.name: at[f.name].try_cast(f.dataType) for f in schema}
    wrong = [
        F.when(at[f.name].isNotNull() & typed[f.name].isNull(), F.lit(f.name))
        for f in schema
        if not isinstance(f.dataType, T.StringType)
    ]
    nothing = F.array().cast("array<string>")
    values = F.array_compact(F.array(*wrong)) if wrong else nothing
    problems = F.when(F.col("malformed"), F.array(F.lit("fields"))).otherwise(values)
    good = records.where(F.size(problems) == 0).select(*[c.alias(name) for name, c in typed.items()])
    bad = records.select("file", "line", "text", problems.alias("problems")).where(F.size("problems") > 0)
    return Scan(good, bad, schema)
