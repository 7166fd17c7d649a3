"""Season files and the columnar store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from moundlens.schema import LATER_COLUMNS, PITCH_SCHEMA, STORE_SEASON
from moundlens.session import DROPPING, WRITING, settings

CSV_ROWS = 500_000  # rows of a compressed season file


def read_season_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType = PITCH_SCHEMA
) -> DataFrame:
    """CSV with a header. Columns are found by name, `NA` and empty fields are NULL.

    Columns outside the schema are ignored, so a season with extra columns lines up with the
    others; a value that does not fit its type becomes NULL. The files of one call share a
    layout, and a file with another header is refused: read such seasons one by one and stack them.
    """
    # Without a schema and without inference only the first header is read ahead. With it as the
    # schema, not enforced, Spark compares it to the header of every other file.
    options = {"header": True, "nullValue": "NA", "enforceSchema": False}
    names = spark.read.options(**options).csv(path).columns
    layout = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return align_schema(spark.read.options(**options).schema(layout).csv(path), schema)


def align_schema(
    df: DataFrame, schema: T.StructType = PITCH_SCHEMA, optional: tuple[str, ...] = ()
) -> DataFrame:
    """Keep the agreed columns, by name, in the agreed order and type; `optional` ones may be
    missing and are NULL then."""
    have = set(df.columns)

    def column(field: T.StructField):
        if field.name in optional and field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        return F.col(f"`{field.name}`").try_cast(field.dataType).alias(field.name)

    return df.select(*[column(field) for field in schema])


def add_pitch_uid(df: DataFrame, name: str = "PitchUID") -> DataFrame:
    """A key made from all values of a row; equal rows are told apart by a number.

    The same rows get the same keys in whatever order they come, since only equal rows share one
    window, however many there are of the others.
    """
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns if c != name]
    keyed = df.drop(name).withColumn("_digest", F.md5(F.concat_ws("\x1f", *values)))
    same = Window.partitionBy("_digest").orderBy("_digest")
    number = F.row_number().over(same).cast("string")
    return keyed.withColumn(name, F.concat_ws("-", "_digest", number)).drop("_digest")


def read_raw_season(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A season file as tracking systems write it: without the columns that later steps derive,
    and without a key. The former are NULL, the latter is made from the row."""
    names = spark.read.option("header", True).csv(path).columns
    missing = tuple(c for c in LATER_COLUMNS if c not in names)
    schema = T.StructType([f for f in PITCH_SCHEMA if f.name not in missing])
    log = read_season_csv(spark, path, schema)
    if "PitchUID" in missing:
        log = add_pitch_uid(log)
    return align_schema(log, PITCH_SCHEMA, LATER_COLUMNS)


def union_seasons(*seasons: DataFrame) -> DataFrame:
    """Stack seasons by column name, duplicates kept."""
    stacked, *rest = seasons
    for season in rest:
        stacked = stacked.unionByName(season)
    return stacked


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV with a header. Compressed files, which are read by one task each, have up to `CSV_ROWS` rows."""
    writer = df.write.option("header", True).option("nullValue", "NA").option("compression", compression)
    if compression != "none":
        writer = writer.option("maxRecordsPerFile", CSV_ROWS).option("zlib.compress.level", "BEST_SPEED")
    writer.csv(path)


def write_store(df: DataFrame, path: str, clustered: bool = True, mode: str = "error") -> None:
    """Parquet partitioned by season, so that a date filter skips whole folders.

    `clustered` also lays each season out by pitcher, so that the report of one pitcher skips most
    row groups. Partitions follow the size of the data: small pitchers share one, and one with
    very many pitches is cut into several files. Otherwise rows stay where they are, and no task sorts
    them: it holds a file of each season open. The partition column has a reserved name. With the
    mode `overwrite`, the seasons of `df` are replaced and others stay.
    """
    seasoned = df.withColumn(STORE_SEASON, F.year("Date"))
    if clustered:
        order = [STORE_SEASON, "Pitcher", "Date", "PitchUID"]
        seasoned = seasoned.hint("rebalance", *order[:2]).sortWithinPartitions(*order)
    writer = seasoned.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    # clustered rows come by season already
    with settings(df.sparkSession, DROPPING if clustered else {**WRITING, **DROPPING}):
        writer.partitionBy(STORE_SEASON).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
