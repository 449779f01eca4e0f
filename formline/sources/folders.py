"""Shared working folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """A fresh folder below the cluster's checkpoint folder, visible to every executor.

    Only a local session, where driver and executors are one machine, may fall back
    to a temporary folder.
    """
    base = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="formline-")
    return f"{base.rstrip('/')}/formline-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows written to a shared folder and read back.

    Cuts the lineage, so that a plan that uses the rows several times does not repeat the
    work, and a lost executor costs one re-read.
    """
    path = shared_folder(df.sparkSession, folder)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder of working tables that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
