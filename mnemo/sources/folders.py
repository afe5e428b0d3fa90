"""Folders that driver and executors share, reached through Hadoop's file system."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local master may fall back on a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mnemo-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def path_of(spark: SparkSession, path: str):
    """Hadoop's file system and path of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fresh(spark: SparkSession, name: str) -> str:
    """A new shared folder that goes when the application ends."""
    root = f"{shared(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    fs, p = path_of(spark, root)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return root


def staged(rows: DataFrame, name: str) -> DataFrame:
    """rows, written down in a fresh shared folder."""
    path = f"{fresh(rows.sparkSession, name)}/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def stamp(spark: SparkSession, path: str) -> tuple:
    """What changes when a table's files do: their names, lengths and times."""
    fs, p = path_of(spark, path)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))
