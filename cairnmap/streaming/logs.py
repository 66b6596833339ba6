"""Recorded inputs as bounded streams, and sinks that log streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def replayed(spark: SparkSession, path: str, schema: StructType | str, files: int = 1, kind: str = "parquet") -> DataFrame:
    """A recorded folder as a stream, oldest files first and at most ``files`` a trigger: the bounded queue; nothing is dropped, late files wait."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files).load(path)


def posed(messages: DataFrame, poses: DataFrame, key: str, ahead: str = "2 seconds", delay: str = "10 minutes") -> DataFrame:
    """Streamed messages (key, ts, ...) with every pose (key, ts, ...) from ``ahead`` before to ``ahead`` after them: the read-ahead of a
    replay. Pose columns get the prefix pose_; both sides' state ends ``delay`` behind the newest row."""
    p = poses.select(*(F.col(c).alias("pose_" + c) for c in poses.columns)).withWatermark("pose_ts", delay)
    m = messages.withWatermark("ts", delay)
    span = F.expr(f"interval {ahead}")
    return m.join(p, (F.col(key) == F.col("pose_" + key)) & (F.col("pose_ts") >= F.col("ts") - span) & (F.col("pose_ts") <= F.col("ts") + span))


def logged(rows: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ()) -> StreamingQuery:
    """A stream of scans or poses written to Parquet, exactly once, until the input is used up."""
    out = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True)
    return (out.partitionBy(*by) if by else out).start()
