"""Shapes that tests share."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnmap.functions import geometry as G
from cairnmap.operators import sdf as S


def ball(spark, n: int = 24):
    """A ball's distance volume."""
    i = F.col("id")
    v = spark.range(n**3).select(*((F.floor(i / n**p) % n - n // 2).cast("int").alias(a) for p, a in ((2, "i"), (1, "j"), (0, "k"))))
    d = G.norm(*(F.col(a) * 0.1 for a in S.VOXEL)) - 0.75
    return v.withColumn("d", F.greatest(F.lit(-0.35), F.least(F.lit(0.35), d))).withColumn("w", F.lit(1.0))
