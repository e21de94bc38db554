"""Folders and scratch tables of a session."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="satchel-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the session ends."""
    path = f"{shared_dir(spark)}/satchel-{name}-{uuid.uuid4().hex}"
    _LEFT.append((spark, path))
    return path


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, by the session's Hadoop configuration."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def uri(spark: SparkSession, path: str) -> str:
    """A path with its file system's scheme, as others than Spark need it."""
    p, fs = hadoop_path(spark, path)
    return fs.makeQualified(p).toString().replace("file:/", "file:///", 1) if fs.getScheme() == "file" else fs.makeQualified(p).toString()


_LEFT: list[tuple[SparkSession, str]] = []


@atexit.register
def _drop_rest() -> None:
    """Delete what this session has written to the shared folder."""
    for spark, path in _LEFT:
        try:
            p, fs = hadoop_path(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001 - the session has gone
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there, and lost executors lose nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
