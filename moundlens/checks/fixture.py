"""Pitch log derived from the driver tables lineitem and orders."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from moundlens.functions.numbers import exact_mean, round_half_up
from moundlens.plans.swing import play_labels
from moundlens.session import settings
from moundlens.sources.pitch_log import read_store, write_store
from moundlens.sources.scratch import fresh_path, materialize

_SQL = Path(__file__).with_name("fixture.sql").read_text()
FIXTURE_CTES = _SQL[: _SQL.rindex("SELECT * FROM pitches")].rstrip()

ROWS_PER_TASK = 1_000_000  # lines that one task sorts to meet their orders, some 25 bytes each
_stores: dict[tuple[str, str], str] = {}


def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "orders")
    }
    # one small file would keep the derivation on one core
    cores = spark.sparkContext.defaultParallelism
    if tables["lineitem"].rdd.getNumPartitions() < cores:
        tables["lineitem"] = tables["lineitem"].repartition(cores)
    text = _SQL.replace("FROM lineitem JOIN orders", "FROM {lineitem} JOIN {orders}")
    return spark.sql(text, **tables)


def _sharing(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Settings by which a task's share of the join does not grow with the tables."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(25 * ROWS_PER_TASK),
    }


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log, written once per session and folder and read back as a columnar store."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        path = fresh_path(spark, "pitches")
        with settings(spark, _sharing(spark, sf_dir)):
            write_store(derive(spark, sf_dir), path, clustered=False)  # queries read all of it
        _stores[key] = path
    return read_store(spark, _stores[key])


def event_weights(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weight tables estimated from the log itself: mean wOBA per event, mean run value per
    count and outcome."""
    labelled = play_labels(log)
    events = (
        labelled.where(F.col("Event").isNotNull())
        .groupBy(F.col("Event").alias("event"))
        .agg(
            round_half_up(exact_mean(F.col("woba_value")), 4).alias("woba_weight"),
            F.lit(1).alias("is_pa"),
        )
    )
    outcome = F.coalesce(F.col("Event"), F.col("Type"))
    runs = (
        labelled.where(outcome.isNotNull())
        .groupBy(
            F.col("Balls").alias("balls"), F.col("Strikes").alias("strikes"), outcome.alias("event")
        )
        .agg(round_half_up(exact_mean(F.col("Run_Value")), 4).alias("run_value"))
    )
    return materialize(events, "events"), materialize(runs, "run_values")
