"""Folders that the driver and all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only on a local master where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
        spark.sparkContext.setCheckpointDir(base)
    elif "://" not in base and not base.startswith("file:") and spark.sparkContext.master.startswith("local"):
        base = f"file://{os.path.abspath(base)}"
    return base.rstrip("/")


def _path(spark: SparkSession, at: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def fresh(spark: SparkSession, label: str) -> str:
    """A new folder among this application's, which go when it ends."""
    own = f"{shared(spark)}/tables-{spark.sparkContext.applicationId}"
    fs, path = _path(spark, own)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, at: str) -> None:
    fs, path = _path(spark, at)
    fs.delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate, from file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
