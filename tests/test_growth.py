"""Steps whose rows or memory grew faster than their input: what a plan moves, beside the results."""

from __future__ import annotations

import numpy as np

from cairnmap.functions import geometry as G
from cairnmap.operators import cells as C
from cairnmap.operators import occupancy as O
from cairnmap.operators import sdf as S
from cairnmap.operators.nearest import nearest_any

from .shapes import ball


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored(df, path):
    """The rows from files, whose size the planner knows."""
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def cloud(spark, n: int = 400, seed: int = 3):
    draw = np.random.default_rng(seed).normal(0, 0.15, (n, 3)).tolist()
    return spark.createDataFrame([(k, *p) for k, p in enumerate(draw)], "pid long, x double, y double, z double")


def test_smoothed_depth_sums_neighbours_where_rays_are(spark, tmp_path):
    points = stored(cloud(spark), tmp_path / "points")
    rays = points.select("pid", *((points[a] * 0).alias("o" + a) for a in G.AXES), *((points[a] * 4).alias(a) for a in G.AXES))
    out = O.ray_depth(rays, stored(C.fit(points, 0.1, least=4), tmp_path / "cells"), 0.1, "pid", threshold=0.2, smooth=5.0)
    assert "hashpartitioning(pid#" in plan_of(out) and ", step#" not in "".join(line for line in plan_of(out).splitlines() if "Exchange" in line)
    assert out.count() == 400


def test_normal_equations_move_a_point_once(spark, tmp_path):
    points = stored(cloud(spark), tmp_path / "points")
    volume = ball(spark)
    out = S.normal_equations(points.withColumn("x", points["x"] + 0.7), volume, 0.1, 0.35, "pid", 0.05)
    assert "explode(sequence(0, 7" not in plan_of(out) and "pid#" not in "".join(line for line in plan_of(out).splitlines() if "hashpartitioning" in line)
    held = {(r["i"], r["j"], r["k"]): r["d"] for r in volume.collect()}

    def value(p):
        low = np.floor(p / 0.1).astype(int)
        f = p / 0.1 - low
        return sum(np.where(c, f, 1 - f).prod() * held.get(tuple((low + c).tolist()), 0.35) for c in np.ndindex(2, 2, 2))

    n, want, right = 0, np.zeros((6, 6)), np.zeros(6)
    for p in np.array([tuple(r) for r in points.selectExpr("x + 0.7", "y", "z").collect()]):
        d = value(p)
        if abs(d) < 0.35 * (1 - 1e-9):
            g = np.array([(value(p + s) - value(p - s)) / 0.1 for s in np.eye(3) * 0.05])
            j, w = np.concatenate((np.cross(p, g), g)), min(1.0, 0.05 / abs(d))
            n, want, right = n + 1, want + w * np.outer(j, j), right + w * d * j
    row = out.first()
    assert row["n"] == n > 300
    assert np.allclose([row[f"g{i}"] for i in range(6)], right) and np.allclose([row[f"a{i}{k}"] for i in range(6) for k in range(i, 6)], want[np.triu_indices(6)])


def test_nearest_any_keeps_a_point_in_one_row(spark, tmp_path):
    points = stored(cloud(spark), tmp_path / "points")
    cells = stored(C.fit(points, 0.1), tmp_path / "cells")
    out = nearest_any(points, cells, 0.1, ("pid",))
    assert "SortAggregate" not in plan_of(out) and ", pid#" not in "".join(line for line in plan_of(out).splitlines() if "hashpartitioning(pid" in line)
    means = np.array([tuple(r) for r in cells.select("mx", "my", "mz").collect()])
    x = {r["pid"]: np.array([r["x"], r["y"], r["z"]]) for r in points.collect()}
    found = out.collect()
    assert len(found) == 400 and all(abs(r["dist"] - np.linalg.norm(means - x[r["pid"]], axis=1).min()) < 1e-12 for r in found)


def test_neighbours_are_counted_without_pairs(spark, monkeypatch):
    """A crowd of n points in one ball moves some n rows, not 27 n or n squared; split tiles, ties at the radius, copies and bad rows count as by brute force."""
    import numpy as np

    from cairnmap.operators import within as W

    rng = np.random.default_rng(7)
    p = np.round(rng.normal(0, 0.08, (600, 3)) / 0.0125) * 0.0125  # many pairs at the radius exactly
    rows = [(i // 400, i if i % 50 else 7, *map(float, q)) for i, q in enumerate(p)] + [(0, 700, None, 0.0, 0.0), (0, 701, float("nan"), 0.0, 0.0), (None, 702, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "scan_id int, pid long, x double, y double, z double")
    whole = {}
    for s, i, *a in rows[:600]:
        for t, _, *b in rows[:600]:
            if s == t and sum((u - v) * (u - v) for u, v in zip(a, b)) ** 0.5 <= 0.05:
                whole[i] = whole.get(i, 0) + 1
    for crowd in (W.CROWD, 50):
        monkeypatch.setattr(W, "CROWD", crowd)
        assert {r["pid"]: r["near"] for r in W.neighbour_counts(points, "pid", 0.05, ("scan_id",)).collect()} == whole
    dense = rng.normal(0, 0.1, (20000, 3))
    seen = []
    met = W._met
    monkeypatch.setattr(W, "_met", lambda a, b, first, last, r: seen.append(np.maximum(last - first, 0).sum()) or met(a, b, first, last, r))
    got = W.counts_within(dense, dense, 0.05)
    assert sum(seen) < 1.5 * got.sum()  # a grid of the radius measures 6 times as many
    assert all(got[k] == (np.sqrt(((dense[k] - dense) ** 2).sum(1)) <= 0.05).sum() for k in range(0, 20000, 400))


def test_dense_points_are_counted_without_pairs(spark):
    """Points with three others of other ids within the radius, as by brute force, without a join of pairs."""
    import numpy as np

    from cairnmap.operators import joins as J

    p = np.round(np.random.default_rng(8).normal(0, 0.1, (300, 3)) / 0.0125) * 0.0125
    rows = [(i // 200, i if i % 20 else 7, *map(float, q)) for i, q in enumerate(p)]
    points = spark.createDataFrame(rows, "scan_id int, pid long, x double, y double, z double")
    others = {}
    for s, i, *a in rows:
        for t, k, *b in rows:
            near = s == t and i != k and sum((u - v) * (u - v) for u, v in zip(a, b)) ** 0.5 <= 0.05
            others[i] = others.get(i, 0) + near
    dense = J.nth_neighbour_within(points, "pid", 0.05, 3, ("scan_id",))
    assert {r["pid"] for r in dense.collect()} == {i for i, n in others.items() if n >= 3} != set(others)
    assert "r_id" not in dense._jdf.queryExecution().optimizedPlan().toString()


def test_weighing_is_spread_over_tasks(spark):
    """Weights as from a loop over the pairs; few bytes of particles still go to many tasks, and only particles are shuffled."""
    import math

    import numpy as np

    from cairnmap.operators import particles as PF

    rng = np.random.default_rng(9)
    cell = "ix int, iy int, iz int, mx double, my double, mz double, cxx double, cxy double, cxz double, cyy double, cyz double, czz double"

    def cells(n):
        m = rng.uniform(-0.3, 0.3, (n, 3))
        c = [q @ q.T + 0.001 * np.eye(3) for q in rng.normal(0, 0.05, (n, 3, 3))]
        return {tuple(np.floor(v / 0.1 + 0.5).astype(int).tolist()): (v, k) for v, k in zip(m, c)}

    frame = lambda d: spark.createDataFrame([(*k, *map(float, v), *(float(c[i, j]) for i in range(3) for j in range(i, 3))) for k, (v, c) in d.items()], cell)
    scan, tgt = cells(15), cells(150)
    own = [(n, *map(float, rng.uniform(-0.1, 0.1, 3))) for n in range(40)]
    got = PF.weigh(spark.createDataFrame(own, "pid long, x double, y double, a double"), frame(scan), frame(tgt), 0.1)
    for r in got.collect():
        c, s = math.cos(r["a"]), math.sin(r["a"])
        turn, lik = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]), 1.0
        for v, k in scan.values():
            at = turn @ v + [r["x"], r["y"], 0]
            met = tgt.get(tuple(np.floor(at / 0.1 + 0.5).astype(int).tolist()))
            if met:
                lik += 0.1 + 0.9 * math.exp(-0.05 * (at - met[0]) @ np.linalg.inv(turn @ k @ turn.T + met[1]) @ (at - met[0]) / 2)
        assert abs(lik - r["lik"]) < 1e-9
    assert got.count() == 40 and any(r["lik"] > 1 for r in got.collect())
    assert got.rdd.getNumPartitions() >= 200


def test_growth_takes_several_hops_a_round(spark, monkeypatch):
    """Hops as from a queue, over a branching lattice, a directed tail and two seeds, in far fewer rounds than hops; a front too large for a broadcast takes one hop a round."""
    from collections import deque
    from glob import glob

    from cairnmap.operators import planning as P

    pairs = {(a, b) for a in range(120) for b in (a - 5, a - 1, a + 1, a + 5) if 0 <= b < 120 and a % 7 and b % 7} | {(118, 500), (500, 501), (600, 601)}
    edges, seeds = spark.createDataFrame(sorted(pairs), "src long, dst long"), spark.createDataFrame([(1,), (118,)], "center long")
    want = {}
    for c in (1, 118):
        held, queue = {c: 0}, deque([c])
        while queue:
            at = queue.popleft()
            for a, b in pairs:
                if a == at and b not in held:
                    held[b] = held[at] + 1
                    queue.append(b)
        want |= {(c, n): h for n, h in held.items()}
    for ball, most in ((P.BALL, 0.5), (1, 1.2)):
        monkeypatch.setattr(P, "BALL", ball)
        before = set(glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/reachable-*/*"))
        got = [((r["center"], r["node"]), r["hops"]) for r in P.reachable(edges, seeds).collect()]
        assert dict(got) == want and len(got) == len(want)
        rounds = set(glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/reachable-*/*")) - before
        assert len(rounds) <= most * max(want.values()) + 2
