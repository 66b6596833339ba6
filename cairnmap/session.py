"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "cairnmap", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution (coalescing and skew joins) and Arrow; a setting given by the cluster stays."""
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
