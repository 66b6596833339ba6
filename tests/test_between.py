"""Interpolated poses, nearest cells, six-degree noise, curvature and scores against plain computations."""

from __future__ import annotations

import numpy as np
import pytest

from cairnmap.operators import between as B
from cairnmap.operators import cells as C
from cairnmap.operators import joins as J
from cairnmap.operators import nearest as N
from cairnmap.operators import particles as PF
from cairnmap.operators import registration as R


def rotation(q):
    x, y, z, w = np.array(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def log_turn(r):
    angle = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    return axis * (0.5 if angle < 1e-9 else angle / (2 * np.sin(angle)))


def test_poses_between_stamps(spark):
    """The turn between two poses is the share of their whole turn, about the same axis; far, outer, null and repeated stamps."""
    r = np.random.default_rng(1)
    poses = []
    for robot in range(3):
        for t in np.cumsum(r.uniform(0.2, 4, 30)):
            q = r.normal(0, 1, 4)
            poses.append((robot, float(t), *map(float, r.normal(0, 1, 3)), *map(float, q / np.linalg.norm(q))))
    twice = (*poses[5][:2], 99.0, *poses[5][3:])
    messages = [(robot, float(t), i) for i, (robot, t) in enumerate((k, t) for k in range(4) for t in r.uniform(-2, 70, 40))] + [(poses[5][0], poses[5][1], 900), (None, 1.0, 901), (1, None, 902)]
    messages += [messages[0]]
    names = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
    p = spark.createDataFrame([*poses, twice, (0, 3.0, None, *poses[0][3:]), (None, *poses[0][1:])], "robot long, t double, " + ", ".join(f"{n} double" for n in names))
    m = spark.createDataFrame(messages, "robot long, t double, id long").selectExpr("*", "id as tx", "1 as _p")
    m = m.drop("tx")
    reach, want = 3.0, []
    for robot, t, i in messages:
        own = sorted(x for x in poses if x[0] == robot) if t is not None else []
        before, after = [x for x in own if x[1] <= t], [x for x in own if x[1] >= t]
        if before and after and t - before[-1][1] <= reach and after[0][1] - t <= reach:
            a, b = before[-1], after[0]
            f = (t - a[1]) / (b[1] - a[1]) if b[1] > a[1] else 0.0
            ra, rb = rotation(a[5:]), rotation(b[5:])
            w = log_turn(ra.T @ rb) * f
            angle = np.linalg.norm(w)
            k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]) / max(angle, 1e-12)
            turn = np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k
            want.append((i, np.array(a[2:5]) + f * (np.array(b[2:5]) - np.array(a[2:5])), ra @ turn))
    got = B.interpolated_pose(m, p, "t", "robot", reach).collect()
    assert sorted(g.id for g in got) == sorted(w[0] for w in want) and len(want) > 40
    by = {w[0]: w for w in want}
    for g in got:
        _, at, turn = by[g.id]
        assert np.allclose([g.tx, g.ty, g.tz], at) and np.allclose(rotation([g.qx, g.qy, g.qz, g.qw]), turn, atol=1e-6)
    assert B.interpolated_pose(m, p.limit(0), "t", "robot", reach).count() == 0


def test_nearest_cell_at_any_distance(spark):
    """Clusters far apart, many levels, ties, a crowd of points in one place, points with nulls."""
    r = np.random.default_rng(2)
    means = np.concatenate([c + r.integers(-8, 9, (120, 3)) * 0.5 for c in r.uniform(-900, 900, (5, 3)).round()])
    means = np.unique(means, axis=0)
    cells = [(*np.floor(m / 0.5 + 0.5).astype(int).tolist(), *map(float, m)) for m in means]
    points = np.concatenate((r.uniform(-1500, 1500, (80, 3)), means[:40] + 0.25, np.tile(means[3] + 0.1, (200, 1)), means[50:60]))
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    c = spark.createDataFrame(cells + [(0, 0, 0, None, 1.0, 1.0)], "ix int, iy int, iz int, mx double, my double, mz double").selectExpr("*", "1 as x", "2 as lx")
    p = spark.createDataFrame(rows + [(-1, None, 0.0, 0.0), (-2, float("nan"), 0.0, 0.0)], "pid long, x double, y double, z double").selectExpr("*", "3 as mx")
    want = {i: min((float(np.sqrt(((np.array(q) - m[3:]) ** 2).sum())), *m[:3]) for m in cells) for i, *q in rows}
    got = {g.pid: (g.dist, g.ix, g.iy, g.iz) for g in N.nearest_any(p, c, 0.5, ("pid",)).collect()}
    assert set(got) == set(want)
    assert all(abs(got[i][0] - w[0]) < 1e-9 for i, w in want.items()) and sum(got[i][1:] == w[1:] for i, w in want.items()) >= len(want) - 2
    assert N.nearest_any(p, c.limit(0), 0.5, ("pid",)).count() == 0 and N.nearest_any(p.limit(0), c, 0.5, ("pid",)).count() == 0


def test_six_degree_noise_has_its_covariance(spark):
    root = np.tril(np.random.default_rng(3).normal(0, 0.02, (6, 6)))
    cov = root @ root.T
    cov[4, :] = cov[:, 4] = 0  # a still direction
    n = 20_000
    own = spark.range(n).selectExpr("id as pid", "1.0 as x", "-2.0 as y", "0.5 as z", "0.0 as qx", "0.0 as qy", "0.6 as qz", "0.8 as qw")
    motion = (0.5, 0.1, -0.2, 0.1, 0.0, 0.0, 0.99)
    moved = PF.predict6(own, motion, cov.tolist(), step=3).orderBy("pid").toPandas()
    assert moved.equals(PF.predict6(own.repartition(7), motion, cov.tolist(), step=3).orderBy("pid").toPandas())
    base = rotation([0, 0, 0.6, 0.8])
    middle, turned = np.array([1.0, -2.0, 0.5]) + base @ motion[:3], base @ rotation(motion[3:])
    noise = []
    for x in moved.to_numpy()[:, 1:]:
        d = turned.T @ rotation(x[3:])
        noise.append([*(turned.T @ (x[:3] - middle)), np.arctan2(d[2, 1], d[2, 2]), -np.arcsin(np.clip(d[2, 0], -1, 1)), np.arctan2(d[1, 0], d[0, 0])])
    noise = np.array(noise)
    spread = np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    assert np.all(np.abs(noise.mean(0)) < 4 * np.sqrt(np.diag(cov) / n) + 1e-9)
    assert np.all(np.abs(np.cov(noise.T) - cov) < 4 * np.sqrt((spread**2 + cov**2) / n) + 1e-9)
    with pytest.raises(ValueError):
        PF.predict6(own, motion, (-np.eye(6)).tolist())


def blobs(spark, seed=4, n=900):
    r = np.random.default_rng(seed)
    points = np.concatenate((np.column_stack((r.uniform(0, 6, n), r.uniform(0, 4, n), r.normal(0, 0.05, n))), np.column_stack((r.normal(3, 0.05, n), r.uniform(0, 4, n), r.uniform(0, 3, n))), np.column_stack((r.uniform(0, 6, n), r.normal(2, 0.05, n), r.uniform(0, 3, n)))))
    return spark.createDataFrame(points.tolist(), "x double, y double, z double")


def test_second_derivatives_equal_differences_of_the_score(spark):
    target = C.fit(blobs(spark), 1.0, least=6).cache()
    source = C.transform(target, R.turned_pose(np.array([0.05, -0.04, 0.03, 0.02, -0.01, 0.03])).reshape(-1).tolist()).cache()
    points = C.transform_points(blobs(spark, 5, 150), R.turned_pose(np.array([0.02, 0.03, 0.0, 0.01, 0.0, -0.02])).reshape(-1).tolist())
    points = points.filter(" and ".join(f"pmod({a} + 0.5, 1) between 0.05 and 0.95" for a in "xyz")).cache()  # so that no point changes its cell
    pair, point = R.hessian(source, target, 1.0, 3).first(), R.point_hessian(points, target, 1.0).first()

    def score(p, which):
        t = R.turned_pose(np.array(p)).reshape(-1).tolist()
        return R.pair_score(C.transform(source, t), target, 1.0, 3).first()["score"] if which else R.point_score(C.transform_points(points, t), target, 1.0).first()["score"]

    e = 1e-3
    for which, row, checked in ((True, pair, ((3, 4), (4, 4), (0, 5), (1, 3))), (False, point, ((3, 5),))):
        for i, j in checked:
            at = lambda a, b: [a * e * (k == i) + b * e * (k == j) for k in range(6)]  # noqa: B023, E731
            rough = (score(at(1, 1), which) - score(at(1, -1), which) - score(at(-1, 1), which) + score(at(-1, -1), which)) / (4 * e * e)
            assert abs(rough - row[f"h{min(i, j)}{max(i, j)}"]) < 2e-2 * max(1.0, abs(rough)), (which, i, j, rough)


def test_full_curvature_finds_the_motion(spark):
    target = C.fit(blobs(spark), 1.0, least=6)
    motion = R.turned_pose(np.array([0.08, -0.05, 0.04, 0.01, -0.02, 0.03]))
    pose, score = R.match_cells(C.transform(target, motion.reshape(-1).tolist()), target, 1.0, full=True)
    assert np.allclose(pose @ motion, np.eye(4), atol=5e-3) and score < 0


def test_order_statistics(spark):
    r = np.random.default_rng(6)
    values = np.concatenate((r.normal(0, 1, 4000), np.full(900, 0.25), [1e9, -1e9]))
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    whole = np.sort(values)
    for index in (0, 17, 2450, 3000, len(values) - 1):
        assert R.order_statistic(rows, "v", index, gather=50, buckets=16) == whole[index]
    assert R.order_statistic(rows, "v", len(values)) is None and R.order_statistic(rows.limit(0), "v", 0) is None


def test_wavefront_in_buckets(spark):
    """Against Dijkstra on a lattice with odd costs: short and long edges, a hot node, an unreachable part, tiles, a directed graph."""
    import heapq

    from cairnmap.operators import planning as PL

    r = np.random.default_rng(8)
    nodes = [(i, j) for i in range(6) for j in range(6)]
    name = lambda n: f"{n[0]}:{n[1]}"
    both = {}
    for i, j in nodes:
        for k in ((i + 1, j), (i, j + 1), (4, 4)):
            if k in nodes and k != (i, j) and r.random() < 0.8:
                both[name((i, j)), name(k)] = both[name(k), name((i, j))] = float(r.choice([0.05, 0.3, 1.0, 2.5]) + (3.0 if k == (4, 4) else 0.0))
    both["far", "away"] = both["away", "far"] = 1.0
    one = {k: v for n, (k, v) in enumerate(both.items()) if n % 5}

    def dijkstra(edges):
        costs, heap = {"0:0": 0.0}, [(0.0, "0:0")]
        while heap:
            c, n = heapq.heappop(heap)
            for (a, b), w in edges.items():
                if b == n and c + w < costs.get(a, 1e18) - 1e-12:
                    costs[a] = c + w
                    heapq.heappush(heap, (c + w, a))
        return costs

    from pyspark.sql import functions as F

    for edges, options in ((both, {"tile": lambda n: F.floor(F.split(n, ":")[0].try_cast("int") / 4)}), (one, {"symmetric": False, "delta": 1.5})):
        frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()] + [("x", None, 1.0)], "src string, dst string, cost double")
        got = PL.wavefront(frame, "0:0", **options).collect()
        want = dijkstra(edges)
        assert len(got) == len(want) and all(abs(g.cost - want[g.node]) < 1e-9 for g in got)
        assert all(g.node == "0:0" or abs(want[g.next] + edges[g.node, g.next] - g.cost) < 1e-9 for g in got)
    frame = spark.createDataFrame([("a", "0:0", 1.0)], "src string, dst string, cost double")
    assert PL.wavefront(frame.limit(0), "0:0").count() == 1 and PL.wavefront(frame, "0:0", most=0.5).count() == 1


def test_nearest_vertex_looks_at_few_of_the_vertices_within_reach(spark):
    """Thousands of vertices within reach of each point, some repeated; a few points with none, or with one far off only."""
    draw = np.random.default_rng(3)
    v = draw.normal(0, 1, (6000, 3))
    v = 0.5 * v / np.linalg.norm(v, axis=1)[:, None]
    v = np.vstack((v, v[:500], [[3.0, 3.0, 3.0]]))
    p = np.vstack((0.52 * v[:1500] / np.linalg.norm(v[:1500], axis=1)[:, None], v[100:200], v[100:110], [[3.0, 3.0, 3.25], [9.0, 9.0, 9.0], [0.0, 0.0, 0.0]]))
    frame = lambda x, name: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], f"{name} long, x double, y double, z double")
    points, vertices = frame(p, "contact"), frame(v, "id")
    got = {r["contact"]: (r["id"], r["dist"]) for r in J.nearest_vertex(points, vertices, 0.3, "contact", "id").collect()}
    far = np.round(np.linalg.norm(p[:, None] - v[None], axis=2), 9)
    want = {i: (int(row.argmin()), float(row.min())) for i, row in enumerate(far) if row.min() <= 0.3}
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()} and all(abs(got[i][1] - w[1]) < 2e-9 for i, w in want.items())
    places = vertices.selectExpr("id", "x mx", "y my", "z mz")
    assert J.block_pairs(points, places, J.fine_size(places, 0.3)).count() < 200 * len(p) < (far <= 0.3).sum()


def test_nearest_cells_move_each_point_once(spark):
    """Blocks are unfolded from the cells, not from the points; ties, points without cells, nulls, two means in one place."""
    from cairnmap.operators import extents as X

    r = np.random.default_rng(12)
    cells = [(*map(int, k), *map(float, k + r.integers(-2, 3, 3) * 0.25)) for k in np.unique(r.integers(-4, 5, (150, 3)), axis=0)]
    rows = [(i, *map(float, p)) for i, p in enumerate(r.integers(-24, 25, (300, 3)) * 0.25)]
    c = spark.createDataFrame(cells, "ix int, iy int, iz int, mx double, my double, mz double")
    p = spark.createDataFrame([*rows, (900, None, 0.0, 0.0)], "pid long, x double, y double, z double")
    want = {}
    for i, *q in rows:
        own = np.floor(np.array(q) + 0.5)
        near = sorted((float(np.sqrt(((np.array(q) - m[3:]) ** 2).sum())), *m[:3]) for m in cells if np.abs(np.array(m[:3]) - own).max() <= 1)
        if near:
            want[i] = near[:4]
    got = {}
    for g in X.four_nearest(p, c, 1.0, "pid").orderBy("pid", "rank").collect():
        got.setdefault(g.pid, []).append((g.dist, g.ix, g.iy, g.iz))
    first = J.nearest_cell(p, c, 1.0, ("pid",))
    assert got == want and {g.pid: [(g.dist, g.ix, g.iy, g.iz)] for g in first.collect()} == {i: w[:1] for i, w in want.items()}
    unfolded = [line for line in first._jdf.queryExecution().optimizedPlan().toString().splitlines() if "explode(" in line]
    assert len(unfolded) == 3 and not any("pid" in line for line in unfolded)
