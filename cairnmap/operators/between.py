"""Poses between stamps: the two poses around each message, interpolated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def slerp(a: list, b: list, f) -> list:
    """A unit quaternion the share f of the way from a to b, the shorter way round; straight where the two are all but equal."""
    dot = sum((x * y for x, y in zip(a, b)), F.lit(0.0))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    near = angle < 1e-6
    u = F.when(near, 1 - f).otherwise(F.sin((1 - f) * angle) / F.sin(angle))
    v = F.when(near, f).otherwise(F.sin(f * angle) / F.sin(angle)) * sign
    made = [u * x + v * y for x, y in zip(a, b)]
    size = F.sqrt(sum((m * m for m in made), F.lit(0.0)))
    return [m / size for m in made]


def interpolated_pose(messages: DataFrame, poses: DataFrame, on: str, by: str, reach: float) -> DataFrame:
    """Messages (by, on, ...) that lie between two poses (by, on, tx .. qw) at most ``reach`` away each, with the pose in between.

    Time is cut into stretches of ``reach``: a pose goes to its own stretch and the two beside it, a message to its own, and every
    (key, stretch) is sorted once, so a key of any length is spread over its stretches. A message on a pose's stamp takes that pose; of poses
    on one stamp the smallest values count. Messages with a null key or stamp, or outside of any such pair of poses, have no row; poses with nulls don't count.
    """
    stretch = F.floor(F.col(on) / reach).cast("long")
    good = poses.select(by, on, *POSE).dropna()
    p = good.groupBy(by, on).agg(F.min(F.struct(*POSE)).alias("_p")).withColumn("_b", F.explode(F.sequence(stretch - 1, stretch + 1)))
    p = p.select(by, "_b", on, F.lit(0).alias("_side"), F.struct(F.col(on).alias("at"), "_p").alias("_pose"))
    own = [c for c in messages.columns if c not in (by, on)]
    m = messages.filter(F.col(by).isNotNull() & F.col(on).isNotNull()).select(by, stretch.alias("_b"), on, F.lit(1).alias("_side"), F.struct(F.lit(0).alias("_none"), *own).alias("_own"))
    both = m.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(by, "_b")
    back = F.last("_pose", ignorenulls=True).over(w.orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("_pose", ignorenulls=True).over(w.orderBy(F.col(on).desc(), "_side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumns({"_back": back, "_ahead": ahead}).filter("_side = 1")
    found = found.filter((F.col(on) - F.col("_back.at") <= reach) & (F.col("_ahead.at") - F.col(on) <= reach))
    share = (F.col(on) - F.col("_back.at")) / F.nullif(F.col("_ahead.at") - F.col("_back.at"), F.lit(0.0))
    found = found.withColumn("_f", F.coalesce(share, F.lit(0.0)))
    a, b, f = [F.col(f"_back._p.{c}") for c in POSE], [F.col(f"_ahead._p.{c}") for c in POSE], F.col("_f")
    moved = [x + f * (y - x) for x, y in zip(a[:3], b[:3])]
    return found.select(F.col(by), F.col(on), *(F.col("_own")[c].alias(c) for c in own), *(v.alias(c) for v, c in zip([*moved, *slerp(a[3:], b[3:], f)], POSE)))
