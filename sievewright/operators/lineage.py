"""Cutting lineage in storage that every executor sees."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder, from spark.checkpoint.dir; in local mode, where that is unset, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that every executor sees")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written as a table to the checkpoint folder; it goes by release(), or when Python ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the tables that cut() gave, once nothing that still runs reads them; others are left alone."""
    for df in tables:
        if path := getattr(df, "_cut_at", None):
            _drop(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Has the JVM look for what nothing refers to any more, so that shuffle files of finished jobs leave the disks now."""
    spark.sparkContext._jvm.System.gc()


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have gone before; the folder is the cluster's to clear then
        pass
