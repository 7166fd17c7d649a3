"""Session settings: the ones worth having anywhere, and a local session for tests and benchmark."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Worth setting on a cluster too. Partition sizes follow the data, hot partitions are split, and
# wide projections (flags, model columns) stay in methods small enough to be compiled by the JVM:
# beyond 8,000 bytes of byte code a generated method is only interpreted.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


# Compiled methods, and a file of each partition value held open so that wide rows need no sort
# before a partitioned write. Beyond that many values Spark sorts the rest of a task's rows.
OPEN_FILES = 16
COMPILED = {"spark.sql.codegen.hugeMethodLimit": RECOMMENDED["spark.sql.codegen.hugeMethodLimit"]}
WRITING = {**COMPILED, "spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}

# What a write has shuffled is not needed after it: its files go at once, and not when the driver happens
# to collect its garbage.
DROPPING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings while a job runs; the former ones afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def local_session(cores: int | None = None, **extra: str) -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("moundlens")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.ansi.enabled", "true")
        # call sites for error messages cost more than planning does on small data
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
