"""Durable intermediate tables in the shared folder the session names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from moundlens.session import DROPPING, WRITING, settings

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; a temporary folder only for a local master without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    app = context.applicationId
    if app not in _local_roots:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        _local_roots[app] = tempfile.mkdtemp(prefix="moundlens-")
    return _local_roots[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/moundlens-{uuid.uuid4().hex}/{name}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative trainers a checkpoint folder when the session has none yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{scratch_root(spark)}/checkpoints")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read many: cuts the lineage and leaves a table that outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with settings(spark, {**WRITING, **DROPPING}):
        df.write.option("compression", "zstd").parquet(path)  # disk is what many tables run out of
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a table of `materialize` that nothing reads any more."""
    spark = table.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
