"""A copy of the log bucketed by the keys of a group table, so that both meet without a shuffle.

The pitches of one key lie in one bucket of the store, and every group table made from it is bucketed
alike. Aggregating the pitches by the keys and joining the result back to them then moves no pitch.

A key that holds more than half an average bucket is cut into parts by row hash, each of at most
about a quarter of an average bucket; its group row is repeated once a part. There are at most twice
as many such keys as buckets, and at most four times as many parts beyond their number, whatever
share one key has.

Defined cases: NULL is a key like any other; keys are texts, whole numbers, dates or truth values;
rows equal in all columns stay in one part; a table without rows makes a store without rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from moundlens.operators.joins import BROADCAST_BYTES, frequent_keys, null_safe_join, table_bytes
from moundlens.session import DROPPING, settings
from moundlens.sources.scratch import fresh_path

GROUP, PART, PARTS = "_group", "_part", "_parts"
ROWS_PER_BUCKET = 1_000_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 65_536
_LAYOUT = "keys array<string>, columns string, buckets int"


def _name_of(keys: Sequence[str]) -> Column:
    """All key values as one text, different for different keys, never NULL."""
    texts = [F.col(key).cast("string") for key in keys]
    sized = [F.concat(F.length(text).cast("string"), F.lit(":"), text) for text in texts]
    return F.concat(*[F.coalesce(text, F.lit("-")) for text in sized])


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _bucketed(df: DataFrame, path: str, buckets: int, placed: bool = False) -> DataFrame:
    """The table written with one file a bucket, and read as a bucketed table. If its rows are `placed`,
    each task has those of one bucket."""
    name = f"moundlens_{uuid.uuid4().hex}"
    rows = (df if placed else df.repartition(buckets, GROUP, PART)).sortWithinPartitions(GROUP, PART)
    writer = rows.write.format("parquet").option("compression", "zstd").option("path", path)
    with settings(df.sparkSession, DROPPING):
        writer.bucketBy(buckets, GROUP, PART).sortBy(GROUP, PART).saveAsTable(name)
    return df.sparkSession.table(name)


def _registered(spark: SparkSession, path: str, columns: str, buckets: int) -> DataFrame:
    """The bucketed table of an existing folder, for a session that did not write it."""
    name = f"moundlens_{uuid.uuid4().hex}"
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({GROUP}, {PART}) "
        f"SORTED BY ({GROUP}, {PART}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)


@dataclass(frozen=True)
class KeyedStore:
    """`rows` are the log's rows and the store's own three columns; filter them freely, but keep
    the three until the rows have been joined."""

    rows: DataFrame
    keys: tuple[str, ...]
    buckets: int

    @staticmethod
    def write(log: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None) -> KeyedStore:
        """Writes the store. Without a number of buckets, one for every million rows."""
        order, given = [*log.columns, GROUP, PARTS, PART], buckets

        def count(rows: int) -> int:
            return given or min(max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET)), MOST_BUCKETS)

        def quarter(rows: int) -> float:
            return max(rows / count(rows) / 4.0, 1.0)

        total, hot = frequent_keys(log, list(keys), lambda rows: 2 * quarter(rows))
        buckets, parts, placed = count(total), F.lit(1), log
        if hot is not None:
            hot = hot.select(*keys, F.ceil(F.col("_rows") / F.lit(quarter(total))).cast("int").alias(PARTS))
            if table_bytes(hot) <= BROADCAST_BYTES:
                hot = F.broadcast(hot)
            placed = null_safe_join(log, hot, list(keys), "left")
            parts = F.coalesce(PARTS, F.lit(1))
        spread = F.pmod(F.xxhash64(*log.columns), F.col(PARTS)).cast("int")
        placed = placed.withColumn(PARTS, parts).withColumn(PART, spread)
        # the name of a key is made again where the rows arrive, so it does not travel
        placed = placed.repartition(buckets, _name_of(keys), PART).withColumn(GROUP, _name_of(keys))
        placed = placed.select(*order)
        _bucketed(placed, f"{path}/rows", buckets, placed=True)
        spark = log.sparkSession
        layout = spark.createDataFrame([(list(keys), _columns(placed), buckets)], _LAYOUT)
        layout.coalesce(1).write.parquet(f"{path}/layout")
        return KeyedStore.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> KeyedStore:
        keys, columns, buckets = spark.read.schema(_LAYOUT).parquet(f"{path}/layout").first()
        return KeyedStore(_registered(spark, f"{path}/rows", columns, buckets), tuple(keys), buckets)

    def summarize(self, rows: DataFrame, *measures: Column, having: Column | None = None) -> DataFrame:
        """One row a key: the keys, then the measures, made without moving the rows.

        Keys in one part are complete in their bucket. Those cut into parts are summed part by part
        first, so one partial row a part travels.
        """
        whole = rows.where(F.col(PARTS) == 1).groupBy(GROUP, PART, PARTS, *self.keys).agg(*measures)
        cut = rows.where(F.col(PARTS) > 1).groupBy(GROUP, PARTS, *self.keys).agg(*measures)
        both = whole.drop(PART).unionByName(cut)
        return both if having is None else both.where(having)

    def repeated(self, groups: DataFrame) -> DataFrame:
        """A result of `summarize`, written bucketed like the rows, a row for every part of its key."""
        every = groups.withColumn(PART, F.explode(F.sequence(F.lit(0), F.col(PARTS) - 1)))
        path = fresh_path(groups.sparkSession, "groups")
        return _bucketed(every.drop(PARTS, *self.keys), path, self.buckets)

    def join(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """Rows with the row of their key out of `repeated`; keys without one drop out.

        Both sides are read bucket by bucket, and the groups of a bucket are hashed in memory.
        """
        joined = rows.join(groups.hint("shuffle_hash"), [GROUP, PART])
        return joined.drop(GROUP, PART, PARTS)
