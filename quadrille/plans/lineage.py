"""Cutting the lineage of iterated plans: tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one becomes it, on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one, which is deleted when the application ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    files, at = file_system(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written and read again; a lost executor costs a read, and no lineage stays."""
    spark = df.sparkSession
    path = new_folder(spark, "rows")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete checkpointed tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {os.path.dirname(file) for file in table.inputFiles()}:
            files, at = file_system(spark, folder)
            files.delete(at, True)
