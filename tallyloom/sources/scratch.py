"""Checkpoints in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where none is set and all run on this machine."""
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallyloom-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = file_system(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, system = file_system(spark, path)
    system.delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; what is there is deleted when Python ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_scratch() -> None:
    while _written:
        try:
            remove(*_written.pop())
        except Exception:  # the session may be gone already
            return


_written: list[tuple[SparkSession, str]] = []
atexit.register(drop_scratch)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once: later reads find them in the same partitions and order, whatever is lost meanwhile."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
