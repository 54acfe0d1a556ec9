"""Scans of the Parquet tables, and the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of Parquet tables; any store that Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names; one of this machine only where the executors are this very process."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "lectern-checkpoints")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed Parquet table in the shared folder, of which only the columns asked for are read again; goes when the program ends. A checkpoint holds whole rows as they are in memory."""
    spark = df.sparkSession
    shared(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    if not _FOLDERS:
        atexit.register(swept)
    _FOLDERS.append((spark, folder))
    return spark.read.schema(df.schema).parquet(folder)


def swept() -> None:
    """Removes the tables that ``kept`` has made, as far as their sessions still run."""
    while _FOLDERS:
        spark, folder = _FOLDERS.pop()
        with contextlib.suppress(Exception):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
