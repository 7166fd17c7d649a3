"""Daily partial sums beside the log: reports of any pitcher and date range without its pitches.

Three tables, one folder a day each: sums of the report metrics at the three finest grains, sums of
the movement measures by tagged type, and pitch counts. All sums are whole numbers (measures in
units of 1e-9, as decimals), so merging days gives exactly the numbers of the direct reports. A day
has a few rows for each of its pitchers, however many pitches they threw.

The functions of `reports` take a `DailySums` in place of the log. When a day is added, corrected or
deleted, `update` sums the given days again and replaces their folders alone. Updating twice changes
nothing, so one that was interrupted is simply run again.

A pitch moves once, as a row, to the task that sums its pitcher and day for all three tables, since a
day has nearly as many sums as pitches. Where days are large enough, their files are bucketed by
pitcher, the same way in all days, and a report by pitcher moves nothing. A pitcher with very many
pitches on one day is summed by several tasks; readers add up what they find.

Defined cases: pitches without a date have a folder of their own and count only in reports without a
range; a day without pitches left keeps a marker row, which no reader sees, and so does the folder of
pitches without a date; NULL keys are groups. Sums that were stored before they were bucketed are built again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from moundlens.functions.numbers import not_nan, ratio, round_half_up, scaled_sum, unscaled
from moundlens.functions.text import keep_levels
from moundlens.operators.filters import exclude_date, is_tagged, is_valid, pitcher_dates
from moundlens.operators.flags import movement_bands, pitch_flags
from moundlens.operators.joins import BROADCAST_BYTES, frequent_keys, null_safe_join, table_bytes
from moundlens.plans.metrics import SUM_COLUMNS, report_sums
from moundlens.plans.reports import MOVEMENT_MEANS, REPORT_KEYS, REPORT_SETS, report_labels
from moundlens.schema import PITCH_SCHEMA, STORE_SEASON
from moundlens.session import COMPILED, settings

TABLES = ("reports", "movement", "names")
HANDS = ("Right", "Left")
ROWS_PER_TASK = 75_000
# Pitches of a bucket in all days, and at least those of one on an average day.
BUCKET_ROWS, FILE_ROWS = 300_000, 10_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 128
_LAYOUT = "buckets int"


def _measures() -> dict[str, Column]:
    vaa = F.col("VertApprAngle")
    bands = {"top_zone_vaa": F.when(F.col("TopZone"), vaa), "bot_zone_vaa": F.when(F.col("BotZone"), vaa)}
    return {**{name: F.col(column) for name, (column, _) in MOVEMENT_MEANS.items()}, **bands}


def _conditions() -> dict[str, Column]:
    """Truth values of a pitch that its sums are made from."""
    flags = {name: F.col(name) for name in ("is_Zone", "is_Swing", "is_Whiff", "is_Strike", "is_CSW", "is_BBE")}
    return {
        **flags,
        "is_PA": F.col("is_PA") == 1,
        "PitchofPA": F.col("PitchofPA") == 1,
        "TopZone": F.col("TopZone"),
        "BotZone": F.col("BotZone"),
        "tagged": is_tagged(),
        "valid": is_valid(),
        **{side: F.col("PitcherThrows") == side for side in HANDS},
    }


def _pitch_rows(log: DataFrame) -> DataFrame:
    """What the sums need of a pitch; its truth values as one number, two bits each (2: NULL)."""
    code = F.lit(0)
    for place, cond in enumerate(_conditions().values()):
        code = code.bitwiseOR(F.shiftleft(F.coalesce(cond.cast("int"), F.lit(2)), 2 * place))
    measures = [column for column, _ in MOVEMENT_MEANS.values()]
    return movement_bands(pitch_flags(log)).select(
        "Date", "Pitcher", "BatterSide", "TaggedPitchType", "pitchzone", "Balls", "Strikes", code.alias("_code"),
        "woba_value", "xwOBACON_value", "xwOBA_weights", "Run_Value", "VertApprAngle", *measures,
    )


def _labelled(rows: DataFrame) -> DataFrame:
    """Rows of `_pitch_rows` with their truth values and labels again."""
    digits = {
        name: F.shiftright("_code", 2 * place).bitwiseAND(F.lit(3)) for place, name in enumerate(_conditions())
    }
    whole = {name: F.when(digit < 2, digit) for name, digit in digits.items()}
    known = {n: value if n in ("is_PA", "PitchofPA") else value == 1 for n, value in whole.items()}
    return report_labels(rows.withColumns(known))


def _placed(rows: DataFrame, buckets: int) -> DataFrame:
    """Each pitch in the task that sums its pitcher and day; `_place` and `_part` belong to the key.

    A task has some ROWS_PER_TASK pitches, and those of a day and bucket come from one task, unless
    they are more. Tasks are cut by range, so that they are even however few places there are.
    """
    total, hot = frequent_keys(rows, ["Date", "Pitcher"], lambda _: 4 * ROWS_PER_TASK)
    largest = rows.groupBy("Date").count().agg(F.max("count")).first()[0] or 0
    cells, parts = max(1, -(-largest // (buckets * ROWS_PER_TASK))), F.lit(1)
    if hot is not None:
        hot = hot.select("Date", "Pitcher", F.ceil(F.col("_rows") / ROWS_PER_TASK).cast("int").alias("_parts"))
        hot = F.broadcast(hot) if table_bytes(hot) <= BROADCAST_BYTES else hot
        rows, parts = null_safe_join(rows, hot, ["Date", "Pitcher"], "left"), F.coalesce("_parts", F.lit(1))
    spread = F.xxhash64(*[name for name in rows.columns if name != "_parts"])
    bucket, cell = F.pmod(F.hash("Pitcher"), F.lit(buckets)), F.pmod(F.xxhash64("Pitcher"), F.lit(cells))
    rows = rows.withColumns(
        {"_place": (bucket + cell * buckets).cast("int"), "_part": F.pmod(spread, parts).cast("int")}
    ).drop("_parts")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-total // ROWS_PER_TASK), min(cores, -(-total // FILE_ROWS)), 1)
    return rows.repartitionByRange(tasks, "Date", "_place", "_part")


def _day_sums(placed: DataFrame) -> DataFrame:
    """The rows of the three tables, named in `kind`; every one stands for a pitch or more."""
    movement, names = len(REPORT_SETS), len(REPORT_SETS) + 1
    sets = [F.when(F.col("valid"), F.lit(k)) for k in range(movement)]
    sets += [F.when(F.col("tagged"), F.lit(movement)), F.lit(names)]
    each = _labelled(placed).withColumn("_set", F.explode(F.filter(F.array(*sets), lambda k: k.isNotNull())))
    number = F.col("_set")
    held = {key: k for k, kept in enumerate(REPORT_SETS) for key in kept if key != "Pitcher"}
    held["TaggedPitchType"] = movement
    each = each.withColumns({key: F.when(number == k, F.col(key)) for key, k in held.items()})
    own = {"max_speed": F.max("RelSpeed")}
    for name, value in _measures().items():
        own |= {f"{name}_sum": scaled_sum(value), f"{name}_rows": F.count(not_nan(value))}
    own |= {f"{side.lower()}_handed": F.count_if(F.col(side)) for side in HANDS}
    sums = {**report_sums(), **own}
    summed = each.groupBy("Date", "_place", "_part", "Pitcher", "_set", *held).agg(
        *[value.alias(name) for name, value in sums.items()]
    )

    def kept(name: str) -> Column:
        mine = number == movement if name in own else number < movement
        return (F.col(name) if name == "pitches" else F.when(mine, F.col(name))).alias(name)

    kind = F.when(number < movement, TABLES[0]).when(number == movement, TABLES[1]).otherwise(TABLES[2])
    return summed.select(
        "Pitcher", *held, F.when(number < movement, number).alias("_set"), *map(kept, sums), kind.alias("kind"), "Date"
    )


def _columns(name: str) -> list[str]:
    """Columns of one of TABLES."""
    if name == "reports":
        return ["Date", *REPORT_KEYS, *SUM_COLUMNS, "_set"]
    if name == "names":
        return ["Date", "Pitcher", "pitches"]
    sums = [f"{measure}_{part}" for measure in _measures() for part in ("sum", "rows")]
    hands = [f"{side.lower()}_handed" for side in HANDS]
    return ["Date", "Pitcher", "TaggedPitchType", "pitches", "max_speed", *sums, *hands]


def _buckets(log: DataFrame) -> int:
    """Buckets of a day's files; 1 where days or the whole are too small for LEAST_BUCKETS."""
    days = log.groupBy("Date").count()
    rows, number = days.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = min(rows // BUCKET_ROWS, rows // max(number, 1) // FILE_ROWS, MOST_BUCKETS)
    return buckets if buckets >= LEAST_BUCKETS else 1


@dataclass(frozen=True)
class DailySums:
    """The stored sums under `path`; give it to the functions of `reports` instead of a log."""

    sparkSession: SparkSession
    path: str

    @staticmethod
    def build(log: DataFrame, path: str, buckets: int | None = None) -> DailySums:
        """Sums of every day of the log, in a new folder. The number of buckets follows from the log."""
        spark, buckets = log.sparkSession, buckets or _buckets(log)
        spark.createDataFrame([(buckets,)], _LAYOUT).coalesce(1).write.parquet(f"{path}/layout")
        sums = DailySums(spark, path)
        sums._write(log, [None], buckets)  # its markers make the folders of tables without a row
        return sums

    def update(self, log: DataFrame, days: Iterable[dt.date | str | None]) -> None:
        """Make the folders of `days` (None: pitches without a date) agree with the log.

        Only these days of the log are read. Their folders are replaced one after the other, so
        nothing should read them meanwhile.
        """
        days = {dt.date.fromisoformat(d) if isinstance(d, str) else d for d in days}
        if not days:
            return
        dated = sorted(d for d in days if d is not None)
        chosen, seasons = F.col("Date").isin(dated), F.col(STORE_SEASON).isin(sorted({d.year for d in dated}))
        if None in days:
            chosen, seasons = chosen | F.col("Date").isNull(), seasons | F.col(STORE_SEASON).isNull()
        part = log.where(chosen)
        if STORE_SEASON in log.columns:
            part = part.where(seasons)
        self._write(part, days, self._layout())

    def _layout(self) -> int:
        return self.sparkSession.read.schema(_LAYOUT).parquet(f"{self.path}/layout").first()[0]

    def _folder(self, name: str | None = None) -> str:
        return f"{self.path}/sums" + (f"/kind={name}" if name else "")

    def _schema(self, name: str | None = None) -> T.StructType:
        # the schema follows from the code, and without days there is no file to read it from
        empty = self.sparkSession.createDataFrame([], PITCH_SCHEMA)
        places = {"_place": F.lit(0), "_part": F.lit(0)}
        fields = _day_sums(_pitch_rows(empty).withColumns(places)).schema.fields
        kept = _columns(name) if name else [f.name for f in fields]
        return T.StructType([T.StructField(f.name, f.dataType) for f in fields if f.name in kept])

    def _registered(self, buckets: int, name: str | None = None) -> str:
        """Name under which this session finds all tables, or one, as bucketed by pitcher, its days as they are now."""
        table, folder = f"moundlens_{uuid.uuid4().hex}", self._folder(name).replace("'", "\\'")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._schema(name))
        with settings(self.sparkSession, {"spark.sql.hive.manageFilesourcePartitions": "false"}):
            self.sparkSession.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet OPTIONS (compression 'zstd') "
                f"PARTITIONED BY ({'Date' if name else 'kind, Date'}) "
                f"CLUSTERED BY (Pitcher) SORTED BY (Pitcher) INTO {buckets} BUCKETS LOCATION '{folder}'"
            )
        return table

    def _write(self, log: DataFrame, days: Iterable[dt.date | None], buckets: int) -> None:
        """Replace the folders of the days of `log` and of `days`."""
        marks = self.sparkSession.createDataFrame([(d, name) for d in days for name in TABLES], "Date date, kind string")
        marks = marks.withColumn("pitches", F.lit(0).cast("long"))
        sums = _day_sums(_placed(_pitch_rows(log), buckets)).unionByName(marks, allowMissingColumns=True)
        dynamic = {**COMPILED, "spark.sql.sources.partitionOverwriteMode": "dynamic"}
        with settings(self.sparkSession, dynamic):
            if buckets > 1:
                sums.write.insertInto(self._registered(buckets), overwrite=True)
                return
            ordered = sums.sortWithinPartitions("kind", "Date", "Pitcher")
            writer = ordered.write.mode("overwrite").option("compression", "zstd")
            writer.partitionBy("kind", "Date").parquet(self._folder())

    def table(self, name: str) -> DataFrame:
        """One of TABLES, without markers."""
        spark, buckets = self.sparkSession, self._layout()
        if buckets > 1:
            read = spark.table(self._registered(buckets, name))
        else:
            read = spark.read.schema(self._schema(name)).parquet(self._folder(name))
        return read.where(F.col("pitches") > 0).select(*_columns(name))

    def days(self, pitchers=None, date_from=None, date_to=None) -> DataFrame:
        """Sums at the finest report grains, as `summarize_sets` gives them, day by day."""
        return pitcher_dates(self.table("reports"), pitchers, date_from, date_to)

    def sums(self, keys: Sequence[str], *dates) -> DataFrame:
        """One row of sums per key of a report."""
        number = next(k for k, kept in enumerate(REPORT_SETS) if set(keys) <= set(kept))
        chosen = self.days(*dates).where(F.col("_set") == number)
        return chosen.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in SUM_COLUMNS])

    def movement(self, types: tuple[str, ...], sides: Sequence[str], *dates) -> DataFrame:
        """The movement report before its mix."""
        chosen = exclude_date(pitcher_dates(self.table("movement"), *dates))
        typed = chosen.withColumn("pitch_type", keep_levels(F.col("TaggedPitchType"), types))
        digits = {**{name: d for name, (_, d) in MOVEMENT_MEANS.items()}, "top_zone_vaa": 2, "bot_zone_vaa": 2}

        def mean(name: str) -> Column:
            total, rows = F.sum(f"{name}_sum"), F.sum(f"{name}_rows")
            return round_half_up(unscaled(ratio(total.cast("double"), rows)), digits[name]).alias(name)

        return typed.groupBy("Pitcher", "pitch_type").agg(
            F.sum("pitches").alias("pitches"),
            round_half_up(F.max("max_speed"), 1).alias("max_velo"),
            *[mean(name) for name in digits],
            *[F.sum(f"{side.lower()}_handed").alias(f"{side.lower()}_handed") for side in sides],
        )

    def names(self, *dates) -> DataFrame:
        """Pitches of each pitcher before any filter."""
        chosen = pitcher_dates(self.table("names"), *dates)
        return chosen.groupBy("Pitcher").agg(F.sum("pitches").alias("pitches"))
