"""What all operators share: tables, the shared folder, and Arrow kernels that any executor can import."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return at_least(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def at_least(df: DataFrame) -> DataFrame:
    """df in no fewer partitions than there are cores, as a few megabytes of text are seconds of work. Nothing moves where a scan has as many,
    and what comes out of a shuffle (whose partitions adaptive execution decides on) or a stream stays as it is."""
    if df.isStreaming or "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bind(module: str, name: str, *args) -> Callable:
    """The function ``module.name`` with ``args`` after its first argument, for mapInArrow.

    The closure travels by value and imports the module on the executor, so that what the module
    caches outlives a task. The package is found where the driver has it, or on the workers' own path.
    """
    root = ROOT

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        yield from getattr(importlib.import_module(module), name)(batches, *args)

    return run


def values(column, n: int = 64) -> Iterator:
    """An Arrow column's values, of which n are held at once."""
    for at in range(0, len(column), n):
        yield from column.slice(at, n).to_pylist()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where none is set, a local session gets one of its own, which the
    one machine shares; any other raises, as a folder of one machine would lose what executors write."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{os.path.abspath('spark-warehouse')}/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, with its file system's name. It goes when the session's JVM ends, or before that by drop()."""
    fs, path = _file_system(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def drop(spark: SparkSession, folder: str) -> None:
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder: later plans read it, whatever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name that is not taken (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
