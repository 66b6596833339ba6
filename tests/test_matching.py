"""Line search, point and cell matching, updates, streams and readers against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnmap import streaming
from cairnmap.operators import cells as C
from cairnmap.operators import joins as J
from cairnmap.operators import linesearch as L
from cairnmap.operators import registration as R
from cairnmap.operators import updates as U
from cairnmap.sources import readers

POINT = "pid long, x double, y double, z double"


def room(draw, n=900):
    """Points on three walls, with some relief."""
    u, v = draw.uniform(-2, 2, (2, n))
    bump = 0.05 * np.sin(3 * u) * np.cos(2 * v)
    return np.concatenate([np.column_stack(p) for p in ((u, v, bump), (u, bump + 2, v), (bump - 2, u, v))])


def frame(spark, x):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], POINT)


@pytest.mark.parametrize("f", [lambda a: ((a - 1.7) ** 2, 2 * (a - 1.7)), lambda a: (-a / (a * a + 2), (a * a - 2) / (a * a + 2) ** 2), lambda a: ((a + 0.004) ** 5 - 2 * (a + 0.004) ** 4, 5 * (a + 0.004) ** 4 - 8 * (a + 0.004) ** 3)])
def test_line_search(f):
    value, slope = f(0.0)
    a = L.more_thuente(f, value, slope)
    new, new_slope = f(a)
    assert new <= value + L.DECREASE * a * slope and (abs(new_slope) <= L.CURVATURE * abs(slope) or a in (L.LEAST, L.MOST))
    assert L.more_thuente(lambda a: (a, 1.0), 0.0, 1.0) == L.FALLBACK


def test_matching_finds_the_pose(spark):
    draw = np.random.default_rng(1)
    x = room(draw)
    true = R.twist(np.array([0.06, -0.05, 0.04, 0.01, -0.02, 0.03]))
    moved = (x - true[:3, 3]) @ true[:3, :3]
    pose, _ = R.match_points(frame(spark, moved), frame(spark, x), sizes=(1.0, 0.5), rounds=8)
    assert np.abs(pose - true).max() < 0.03
    own = [C.fit(frame(spark, p), 0.5, least=6).withColumn("scan", F.lit(k)) for k, p in enumerate((x, moved))]
    row = R.consecutive(own[0].union(own[1]), "scan", 0.5).collect()
    assert len(row) == 1 and np.abs(np.array([row[0][c] for c in ("tx", "ty", "tz")]) - true[:3, 3]).max() < 0.03


def test_pair_terms_are_derivatives():
    draw = np.random.default_rng(2)
    m, t, a, b = draw.normal(0, 0.3, (5, 3)), draw.normal(0, 0.3, (5, 3)), draw.normal(0, 0.4, (5, 3, 3)), draw.normal(0, 0.4, (5, 3, 3))
    cs, ct = a @ a.transpose(0, 2, 1), b @ b.transpose(0, 2, 1)

    def score(p):
        r = R.twist(p)
        return R._pair_terms(m @ r[:3, :3].T + r[:3, 3], r[:3, :3] @ cs @ r[:3, :3].T, t, ct)[0]

    _, g, _ = R._pair_terms(m, cs, t, ct)
    for i in range(6):
        e = np.eye(6)[i] * 1e-5
        assert abs((score(e) - score(-e)) / 2e-5 - g[i]) < 1e-6


def test_merge_far_from_the_origin(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(0, 0.01, (4000, 3)) + [6e6, 6e6, 0]
    rows = frame(spark, x).withColumn("half", F.col("pid") % 2)
    parts = rows.groupBy("half").agg(F.count("*").alias("n"), *(F.avg(a).alias("m" + a) for a in "xyz"), *(F.covar_samp(p[0], p[1]).alias("c" + p) for p in ("xx", "xy", "xz", "yy", "yz", "zz")))
    got = C.merge(parts.withColumns({k: F.lit(0) for k in C.KEY})).first()
    np.testing.assert_allclose([got["cxx"], got["cyy"]], np.var(x[:, :2], axis=0, ddof=1), rtol=1e-3)


def test_closest_keeps_every_row(spark):
    left = spark.createDataFrame([(1, 5, None), (1, 5, None), (1, 9, "a"), (2, 1, "b")], "k int, t long, name string")
    right = spark.createDataFrame([(1, 4, 40), (1, 6, 60), (1, 9, 90)], "k int, t long, rid long")
    got = sorted((r["k"], r["t"], r["rid"], r["gap"]) for r in J.closest(left, right, "t", ("k",), "rid").collect() if r["k"] == 1)
    assert got == [(1, 5, 40, 1), (1, 5, 40, 1), (1, 9, 90, 0)]
    assert J.closest(left, right, "t", ("k",), "rid").count() == 4


def test_refinement_folds_in_order(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(0, 0.1, (40, 3))
    cell = C.fit(frame(spark, x[:20]), 4.0).withColumn("occ", F.lit(3.0))
    got = U.refined(cell, frame(spark, x[20:]), 4.0, "pid").first()
    mean, cov, e = x[:20].mean(0), np.cov(x[:20].T), (5e-4 - 5e-2) / 20 * 13 + 5e-2
    for p in x[20:]:
        mean = mean + e * (p - mean)
        cov = cov + e * (np.outer(p - mean, p - mean) - cov)
    np.testing.assert_allclose([got["mx"], got["cxx"], got["cyz"], got["n"]], [mean[0], cov[0, 0], cov[1, 2], 40], rtol=1e-9)


def test_streams(spark, tmp_path):
    draw = np.random.default_rng(5)
    x = draw.normal(0, 0.3, (300, 3))
    for k in range(3):
        frame(spark, x[100 * k : 100 * (k + 1)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(POINT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(streaming.fuse_cells(f"{tmp_path}/map", 0.5)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r[:3]: r for r in map(tuple, C.fit(frame(spark, x), 0.5).collect())}
    got = {r[:3]: r for r in map(tuple, streaming.fused(spark, f"{tmp_path}/map").collect())}
    assert got.keys() == want.keys()
    for k, r in got.items():
        np.testing.assert_allclose(r[3:], want[k][3:], atol=1e-9)


def test_gate_stream(spark, tmp_path):
    rows = [(1, k, 0.04 * k, 0.0, 0.0) for k in range(6)]
    spark.createDataFrame(rows, "robot_id long, seq long, x double, y double, yaw double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("robot_id long, seq long, x double, y double, yaw double").parquet(f"{tmp_path}/in")
    q = streaming.fuse_gate(stream).writeStream.format("memory").queryName("gate").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["seq"] for r in spark.table("gate").orderBy("seq").collect()] == [0, 2, 4]


def test_missing_numbers_keep_their_line(spark, tmp_path):
    (tmp_path / "a.wrl").write_text("point [\n1 2 3,\nnan nan 7,\n4 5 6,\n]")
    assert [tuple(r)[2:] for r in readers.vrml_points(spark, str(tmp_path)).orderBy("pt_idx").collect()] == [(1.0, 2.0, 3.0), (None, None, 7.0), (4.0, 5.0, 6.0)]


def test_long_lines_are_whole(spark, tmp_path):
    (tmp_path / "l.txt").write_text("1 " + " ".join(map(str, range(150))))
    assert len(readers.stamped_list(spark, str(tmp_path)).first()["values"]) == 150


def test_tracking_a_surface(spark):
    from cairnmap.operators import sdf as S
    from .shapes import ball

    draw = np.random.default_rng(6)
    v = draw.normal(0, 1, (400, 3))
    x = 0.75 * v / np.linalg.norm(v, axis=1)[:, None] + [0.05, -0.04, 0.03]
    pose = S.track(frame(spark, x), ball(spark).persist(), 0.1, 0.35, "pid", rounds=6)
    moved = x @ pose[:3, :3].T + pose[:3, 3]
    assert abs(np.linalg.norm(moved, axis=1) - 0.75).max() < 0.02


def test_classes_agree_with_the_decomposition(spark):
    draw = np.random.default_rng(7)
    scale = draw.uniform(0.02, 0.3, (600, 3))
    x = draw.normal(0, 1, (600, 3)) * scale + draw.integers(-2, 3, (600, 3))
    cells = C.fit(frame(spark, x), 1.0, least=6)
    want = {tuple(r[k] for k in C.KEY): r["class"] for r in C.clamped(cells).collect()}
    got = {tuple(r[k] for k in C.KEY): r["class"] for r in C.with_kind(cells).collect()}
    assert got == want and len(got) > 10


def test_sums_in_blocks_are_the_tree_s():
    """Against frames put together from a tree's nodes, with places that begin anywhere and batches that end anywhere; nulls don't count."""
    from cairnmap.operators.trajectory import block_state, block_sums

    def tree(values, first, end, level=0):
        """The sum of places first to end, from the left: leaves to a block's edge, whole blocks, and the leaves after."""
        if first // 16 == end // 16:
            return [(level, k) for k in range(first, end)]
        left = [(level, k) for k in range(first, -(-first // 16) * 16)]
        return left + tree(values, -(-first // 16), end // 16, level + 1) + [(level, k) for k in range(end // 16 * 16, end)]

    draw = np.random.default_rng(2)
    for first in (0, 5, 16, 250, 256, 4090):
        values = draw.normal(size=first + 5000).tolist()
        levels = [values]
        while len(levels[-1]) >= 16:
            a = levels[-1]
            levels.append([float(np.add.accumulate([0.0, *a[k : k + 16]])[-1]) for k in range(0, len(a) // 16 * 16, 16)])
        state, got = block_state(first), []
        for a, b in ((0, 3), (3, 700), (700, 5000)):
            got += block_sums(values[first + a : first + b], state)
        for n in (0, 1, 2, 10, 11, 15, 16, 250, 255, 256, 300, 4095, 4096, 4200, 4999):
            want = 0.0
            for level, k in tree(values, first, first + n + 1):
                want += levels[level][k]
            assert got[n] == want
    assert block_sums([None, 1.0, None, 2.0], block_state(14)) == [None, 1.0, 1.0, 3.0]


def test_poses_are_the_sql_s_to_the_last_bit(spark, tmp_path):
    import duckdb
    import pandas as pd

    from cairnmap.plans import registry

    events = pd.read_parquet("/root/testdata/sf0.01/events.parquet")
    longer = pd.concat([events.assign(event_id=events["event_id"] + k * len(events), ts=events["ts"] + pd.Timedelta(days=k)) for k in range(5)])
    longer.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = base.execute(f"WITH {registry.POSES} SELECT robot_id, seq, yaw, x, y FROM poses ORDER BY robot_id, seq").df()
    got = registry.sql_poses(spark, str(tmp_path)).select("robot_id", "seq", "yaw", "x", "y").toPandas().sort_values(["robot_id", "seq"])
    assert len(want) == 50_000 and np.array_equal(got.to_numpy(), want.to_numpy())
