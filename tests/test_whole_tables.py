"""Plans without DuckDB text run over whole tables."""

from __future__ import annotations

import numpy as np

from cairnmap.plans import motion, spatial, updates
from cairnmap.plans.registry import cloud


def made(spark, folder):
    draw = np.random.default_rng(4)
    vectors = [(k, draw.normal(0, 0.1, 64).tolist(), k % 5) for k in range(100)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    events = [(k, 1_700_000_000 + 60 * k, k % 30, "click", float(k % 7)) for k in range(600)]
    spark.createDataFrame(events, "event_id long, s long, user_id long, event_type string, value double").selectExpr("event_id", "timestamp_seconds(s) as ts", "user_id", "event_type", "value").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_no_scan_or_robot_is_left_out(spark, tmp_path):
    sf = made(spark, tmp_path)
    assert motion.aligned_errors(spark, sf).collect()[0]["n"] == 600
    points = {r["scan_id"] for r in cloud(spark, sf).select("scan_id").distinct().collect()}
    seen = spatial.O.ray_evidence(spatial.rays(spark, sf, "true"), spatial.cells(spark, sf), spatial.SIZE, ("pid",)).count()
    assert points == set(range(5)) and updates.ray_evidence(spark, sf).count() == seen > spatial.O.ray_evidence(spatial.rays(spark, sf, "scan_id = 3"), spatial.cells(spark, sf), spatial.SIZE, ("pid",)).count()
