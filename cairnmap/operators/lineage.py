"""Cutting lineage in iterative operators, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where that is unset, one under the warehouse (a local session's temporary folder).

    On a cluster a warehouse on the driver's own disk is refused: executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if path or held.isDefined():
        return path or held.get()
    local = spark.sparkContext.master.startswith("local")
    base = tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
    if not local and (base.startswith("file:") or ":" not in base):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{base}/checkpoints/{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under a path; none where it isn't there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()] if fs.exists(place) else []


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
