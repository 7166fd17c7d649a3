"""What the operators share: columns by position, durable tables, Arrow results."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from moundlens.sources.scratch import materialize

__all__ = ["durable", "hand_back", "numbered", "pick", "read_table", "returned", "tidy"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, under the operator's own names, so nothing else can clash."""
    return df.select(*(F.col(old).alias(new) for new, old in columns.items()))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: survives the loss of any executor.

    What the write shuffled is not needed after it, so its files go at once instead of when the
    driver happens to collect its garbage.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return materialize(df, name)
    finally:
        conf.set(_CLEANUP, before)


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ...: no name of the user's can clash with an operator's."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def hand_back() -> None:
    """Gives the system the memory that a Python worker no longer uses but holds for later.

    Workers outlive their tasks; what one stage's arrays took would otherwise stay in every
    executor while later stages need it for the JVM.
    """
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def returned(table: pa.Table) -> pa.Table:
    """The table of one group; the memory that making it took is handed back."""
    hand_back()
    return table


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function of batches; memory is handed back when a task has read them all."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return tidied
