"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def synchronised(left: DataFrame, right: DataFrame, key: str, tolerance: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Pairs of messages of one key whose stamps differ by at most a tolerance; watermarks on both sides bound the state.

    left: key, ts_a, id_a; right: key, ts_b, id_b. Works on batch frames as well, where watermarks have no effect.
    """
    l, r = left.withWatermark("ts_a", delay), right.withWatermark("ts_b", delay).withColumnRenamed(key, "_key")
    near = F.expr(f"ts_b between ts_a - interval {tolerance} and ts_a + interval {tolerance}")
    return l.join(r, (F.col(key) == F.col("_key")) & near).drop("_key")


def _gate(metres: float, radians: float) -> Callable:
    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        kept = []
        for r in rows.itertuples():
            turn = 0.0 if last is None else (r.yaw - last[2] + 3.141592653589793) % (2 * 3.141592653589793) - 3.141592653589793
            if last is None or ((r.x - last[0]) ** 2 + (r.y - last[1]) ** 2) ** 0.5 > metres or abs(turn) > radians:
                kept.append((key[0], r.seq, r.x, r.y, r.yaw))
                last = (r.x, r.y, r.yaw)
        if last is not None:
            state.update(tuple(float(v) for v in last))
        yield pd.DataFrame(kept, columns=["robot_id", "seq", "x", "y", "yaw"])

    return run


def fuse_gate(poses: DataFrame, metres: float = 0.05, radians: float = 0.01) -> DataFrame:
    """Streamed poses (robot_id, seq, x, y, yaw) that moved far enough against the last fused one, which is the state."""
    schema = "robot_id long, seq long, x double, y double, yaw double"
    return poses.groupBy("robot_id").applyInPandasWithState(_gate(metres, radians), schema, "x double, y double, yaw double", "append", "NoTimeout")


def latest(contacts: DataFrame, key: str, ts: str, values: tuple[str, ...]) -> DataFrame:
    """The last values of each key: a streaming aggregation in update mode, or a batch one."""
    return contacts.groupBy(key).agg(F.max(ts).alias(ts), F.max_by(F.struct(*values), F.struct(ts, *values)).alias("v")).select(key, ts, *(F.col("v")[v].alias(v) for v in values))


def fuse_cells(path: str, size: float) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that adds each batch's moments to a Parquet map, one folder a batch, so that a repeated batch changes
    nothing and no other batch is read or rewritten. Cells of any number of points are kept; ``fused`` merges and filters them."""
    from ..operators import cells

    def run(batch: DataFrame, number: int) -> None:
        own = cells.fit(batch, size, least=1)
        whole = own.fillna(0.0, list(cells.COV))  # one point has no covariance: its scatter is 0
        whole.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def fused(spark, path: str, least: int = 3) -> DataFrame:
    """The map that ``fuse_cells`` has written: the batches' cells merged, those of fewer than ``least`` points left out."""
    from ..operators import cells

    return cells.merge(spark.read.parquet(path).drop("batch")).filter(F.col("n") >= least)
