"""Cells, joins and trajectories against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from cairnmap.operators import cells as C
from cairnmap.operators import joins as J
from cairnmap.operators import planning as P
from cairnmap.operators import registration as R


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(3)
    return spark.createDataFrame([(k, *map(float, draw.normal(0, 0.4, 3))) for k in range(400)], "pid long, x double, y double, z double")


def test_fit_and_merge_agree(points):
    whole = {r[:3]: r for r in map(tuple, C.fit(points, 0.5, least=2).collect())}
    halves = points.withColumn("half", points["pid"] % 2)
    parts = C.fit(halves, 0.5, ("half",), least=2)
    for r in map(tuple, C.merge(parts).collect()):
        if r[:3] in whole and whole[r[:3]][3] == r[3]:
            np.testing.assert_allclose(r[4:], whole[r[:3]][4:], atol=1e-9)


def test_missing_points_are_dropped(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0), (float("nan"), 0.0, 0.0), (None, 1.0, 1.0), (9.0, 0.0, 0.0)], "x double, y double, z double")
    assert C.valid_points(rows, 5.0).count() == 1


def test_radius_pairs(points):
    rows = points.collect()
    x = np.array([[r["x"], r["y"], r["z"]] for r in rows])
    near = (np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.2).sum()
    assert J.radius_pairs(points, points, 0.2, "pid", "pid").count() == near


def test_octree_covers_all_points(points):
    leaves = C.octree_leaves(points, 2.0, 10, 4).collect()
    assert sum(r["n"] for r in leaves) == 400
    assert all(r["n"] <= 10 or r["level"] == 4 for r in leaves)


def test_greedy_association(spark):
    left = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 1.1)], "a long, t double")
    right = spark.createDataFrame([(10, 0.95), (11, 1.3), (12, 9.0)], "b long, t double")
    found = {(r["l_id"], r["r_id"]) for r in J.associate(left, right, "t", 0.5, "a", "b").collect()}
    assert found == {(1, 10), (2, 11)}


def test_wavefront_and_path(spark):
    edges = spark.createDataFrame([(str(k), str(k + 1), 1.0) for k in range(6)] + [(str(k + 1), str(k), 1.0) for k in range(6)], "src string, dst string, cost double")
    costs = P.wavefront(edges, "0")
    assert {r["node"]: r["cost"] for r in costs.collect()} == {str(k): float(k) for k in range(7)}
    assert [r["node"] for r in P.path(costs, "6").orderBy("step").collect()] == [str(k) for k in range(6, -1, -1)]


def test_pose_from_matches(spark):
    draw = np.random.default_rng(0)
    s = draw.normal(0, 1, (60, 3))
    t = s @ R.twist(np.array([0, 0, 0, 0.1, 0.2, 0.3]))[:3, :3].T + [1.0, 2.0, 3.0]
    t[:20] += draw.normal(0, 3, (20, 3))
    rows = spark.createDataFrame([tuple(map(float, [*a, *b])) for a, b in zip(s, t)], "sx double, sy double, sz double, tx double, ty double, tz double")
    pose, found = R.ransac(rows, 100)
    assert found >= 40
    np.testing.assert_allclose(pose[:3, 3], [1, 2, 3], atol=0.05)
