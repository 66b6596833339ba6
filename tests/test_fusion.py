"""Fusion of scans, features, rotations, rendering, polygons and zones against known answers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnmap.operators import features as FE
from cairnmap.operators import fusion as FU
from cairnmap.operators import grasp as GR
from cairnmap.operators import planning as PL
from cairnmap.operators import registration as R
from cairnmap.operators import cells as C
from cairnmap.operators import sdf as S
from cairnmap.operators.tiles import TileMap

from .test_matching import room


def scans(spark, poses, x):
    rows = [(k, *map(float, p)) for k, t in enumerate(poses) for p in (x - t[:3, 3]) @ t[:3, :3]]
    return spark.createDataFrame(rows, "scan int, x double, y double, z double")


@pytest.mark.parametrize("more", [{}, {"evidence": True, "span": 8, "coarse": True}])
def test_fused_scans(spark, more):
    x = room(np.random.default_rng(3))
    true = [np.eye(4), R.twist(np.array([0.05, -0.04, 0.03, 0.01, -0.01, 0.02])), R.twist(np.array([0.1, -0.06, 0.05, 0.01, -0.02, 0.04]))]
    cells, path = FU.fuse_scans(scans(spark, true, x), "scan", 0.5, **more)
    for t, p in zip(true, path):
        assert p["accepted"] and p["fused"] and np.abs(p["pose"] - t).max() < 0.03
    assert cells.agg(F.sum("n")).first()[0] > 2.5 * len(x) and FU.path_frame(spark, path).count() == 3
    if more:
        assert cells.filter("occ > 0").count() > 0


def test_refused_and_empty_scans(spark):
    x = room(np.random.default_rng(3))
    _, path = FU.fuse_scans(scans(spark, [np.eye(4), R.twist(np.array([0.05, -0.04, 0.03, 0, 0, 0.02]))], x), "scan", 0.5, metres=1e-3)
    assert not path[1]["accepted"] and not path[1]["fused"] and np.allclose(path[1]["pose"], np.eye(4))
    assert FU.fuse_scans(scans(spark, [], x), "scan", 0.5) == (None, [])


def test_tracked_frames(spark):
    draw = np.random.default_rng(6)
    v = draw.normal(0, 1, (3000, 3))
    x = 0.75 * v / np.linalg.norm(v, axis=1)[:, None] + [0, 0, 2.0]
    shift = np.array([0.03, -0.02, 0.02])
    rows = [(0, k, *map(float, p)) for k, p in enumerate(x)] + [(1, k, *map(float, p - shift)) for k, p in enumerate(x[:300])]
    frames = spark.createDataFrame(rows, "frame int, pid long, x double, y double, z double")
    volume, path = FU.track_frames(frames, "frame", 0.1, 0.35, rounds=5)
    moved = (x[:300] - shift) @ path[1]["pose"][:3, :3].T + path[1]["pose"][:3, 3]
    assert np.abs(np.linalg.norm(moved - [0, 0, 2.0], axis=1) - 0.75).mean() < 0.02 and volume.count() > 100


def test_features_give_the_pose(spark):
    draw = np.random.default_rng(9)
    x, vec = draw.uniform(-2, 2, (40, 3)), draw.normal(0, 1, (40, 8))
    true = R.twist(np.array([0.4, -0.3, 0.2, 0.1, -0.2, 0.3]))
    moved = (x - true[:3, 3]) @ true[:3, :3]
    moved[:6] += 1.5
    rows = [(f, 100 * f + k, *map(float, p), [float(q) for q in vec[k]]) for f, own in ((0, x), (1, moved)) for k, p in enumerate(own)]
    features = spark.createDataFrame(rows, "frame int, id long, mx double, my double, mz double, v array<double>")
    features = features.withColumns({"cxx": F.lit(0.01), "cxy": F.lit(0.0), "cxz": F.lit(0.0), "cyy": F.lit(0.01), "cyz": F.lit(0.0), "czz": F.lit(0.01)})
    found = FE.frame_matches(features, "frame", "id", "v")
    assert sorted((r["l_id"], r["r_id"]) for r in found.collect()) == [(100 + k, k) for k in range(40)]
    plain = features.drop("frame", "v")
    matched = found.join(plain.withColumnRenamed("id", "l_id"), "l_id").join(plain.select(F.col("id").alias("r_id"), *(F.col(c).alias("t_" + c) for c in plain.columns if c != "id")), "r_id")
    row = FE.match_features(matched, "pair").collect()
    assert len(row) == 1 and row[0]["inliers"] == 34 and np.abs(np.array(row[0]["pose"]).reshape(4, 4) - true).max() < 1e-3


def test_rotation_fits(spark):
    place = np.array(R.directions(40))
    counts = np.zeros((2, 40), int)
    counts[0, [3, 20, 33]] = (30, 20, 10)
    turn = R.twist(np.array([0, 0, 0, 0.0, 0.0, 0.9]))[:3, :3]
    onto = (place @ turn.T @ place.T).argmax(1)
    for k in (3, 20, 33):
        counts[1, onto[k]] += counts[0, k]
    rows = [(m, b, int(n)) for m in (0, 1) for b, n in enumerate(counts[m]) if n]
    fits = FE.rotation_fits(spark.createDataFrame(rows, "m int, bin int, n long"), spark.createDataFrame([(0, 1)], "a int, b int"), "m").orderBy("rank").collect()
    assert len(fits) == 3 and np.arccos((np.trace(np.array(fits[0]["turn"]).reshape(3, 3).T @ turn) - 1) / 2) < 0.35 and fits[0]["gap"] <= fits[1]["gap"]


def test_rendered_ball(spark):
    from .shapes import ball

    rows = [(k, 0.1 * (k % 5) - 0.2, 0.1 * (k // 5) - 0.2, -1.0, 0.0, 0.0, 1.0, 0.1) for k in range(25)] + [(99, 5.0, 5.0, -1.0, 0.0, 0.0, 1.0, 0.1)]
    rays = spark.createDataFrame(rows, "id int, ox double, oy double, oz double, dx double, dy double, dz double, start double")
    got = {r["id"]: r for r in S.render(rays, ball(spark).persist(), 0.1, 0.35, "id").collect()}
    assert not got[99]["hit"] and got[99]["t"] is None
    for k, x, y, *_ in rows[:25]:
        assert got[k]["hit"] and abs(got[k]["t"] - (1 - np.sqrt(0.75**2 - x * x - y * y))) < 0.02


def test_grown_polygons(spark):
    path = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 60, 0), (1, 0, 500, 500)], "p int, seq long, i int, j int")
    walls = spark.createDataFrame([(20, j) for j in range(-40, 41)] + [(505, 500)], "i int, j int")
    got = PL.grow_polygons(path, walls, "p").toPandas()
    assert set(zip(got["p"], got["seq"])) == {(0, 0), (0, 1)}  # the third seed's square meets a wall
    first = got[got["seq"] == 0]
    assert len(first) == 4 and first["i"].max() < 20 and first["i"].max() > 5 and got[got["seq"] == 1]["i"].min() > 20


def test_grown_polygons_equal_single_steps(spark):
    """Thousands of seeds on a busy raster against growth pixel by pixel; repeated walls, places below zero, ends of paths, a path of one point."""
    draw = np.random.default_rng(4)
    steps = draw.integers(-9, 10, (6, 80, 2)).cumsum(1)
    path = [(p, k, *map(int, ij)) for p, own in enumerate(steps) for k, ij in enumerate(own)] + [(9, 0, -700, 3)]
    walls = {(int(i), int(j)) for i, j in draw.integers(-160, 160, (700, 2))}

    def free(c):
        for (i, j), (k, l) in zip(c, [*c[1:], c[0]]):
            for n in range(max(abs(k - i), abs(l - j)) + 1):
                if (i + np.sign(k - i) * min(n, abs(k - i)), j + np.sign(l - j) * min(n, abs(l - j))) in walls:
                    return False
        return True

    want = {}
    for p, k, i, j in path:
        best = [(i - 5, j - 5), (i - 5, j + 5), (i + 5, j + 5), (i + 5, j - 5)]
        goals = [r[2:] for q in (k - 1, k + 1) for r in path if r[:2] == (p, q)]
        if not free(best):
            continue
        for _ in range(50 if goals else 0):
            now = [list(c) for c in best]
            for g in goals:
                gap = [np.hypot(c[0] - g[0], c[1] - g[1]) for c in now]
                one = gap.index(min(gap))
                two = (one - 1) % 4 if gap[(one - 1) % 4] < gap[(one + 1) % 4] else (one + 1) % 4
                for c in (one, two):
                    now[c] = [v - 1 if v > t else v + 1 for v, t in zip(now[c], g)]
                for a in (0, 1):
                    off = now[one][a] - now[two][a]
                    push = (2 if off > 0 else -2) if abs(off) < 10 else 0
                    now[one][a] += push
                    now[two][a] -= push
            if not free(now):
                break
            best = now
        want[p, k] = [tuple(c) for c in best]
    frame = spark.createDataFrame(path, "p int, seq long, i int, j int")
    blocked = spark.createDataFrame([*walls, *list(walls)[:50]], "i int, j int")
    for most in (20_000, 50):
        got = PL.grow_polygons(frame, blocked, "p", most=most)
        found = {}
        for r in got.orderBy("p", "seq", "edge").collect():
            found.setdefault((r["p"], r["seq"]), []).append((r["i"], r["j"]))
        assert found == want and 100 < len(want) < len(path)


def test_zones_and_contents(spark):
    cube = np.array([[x, y, z] for x in (-1.0, 1) for y in (-1.0, 1) for z in (-1.0, 1)])
    assert np.allclose(GR.measured_hull(cube), (8, 24)) and np.allclose(GR.measured_hull(cube[[0, 1, 2, 4]]), (8 / 6, 6 + 2 * np.sqrt(3)))
    star = np.concatenate((np.eye(6), -np.eye(6)))
    rows = [(0, k % 3, *map(float, p)) for k, p in enumerate(star)] + [(1, 0, *map(float, p)) for p in np.eye(6)]
    wrenches = spark.createDataFrame(rows, "grasp int, finger int, " + ", ".join(f"{w} double" for w in GR.WRENCH))
    quality = {r["grasp"]: r for r in GR.grasp_quality(wrenches, "grasp").collect()}
    assert quality[0]["facets"] == 64 and abs(quality[0]["volume"] - 64 / 720) < 1e-9 and not quality[1]["force_closure"]
    zones = GR.shifted_zones(wrenches, "grasp", "finger", 0.5).toPandas()
    assert set(zones["grasp"]) == {0} and zones.groupby("zone").size().tolist() == [32] * 12 and np.allclose(zones["off"], 0.5 / np.sqrt(6))
    held = wrenches.filter("grasp = 0").withColumns({"id": F.col("finger").cast("long"), "k": F.lit(0)})
    small = spark.createDataFrame(zones)
    whole = spark.createDataFrame([(7, 0), (7, 1), (7, 2), (8, 0)], "patch int, id long")
    many = held.withColumn("k", F.monotonically_increasing_id())
    assert [r["patch"] for r in GR.zone_inclusion(many, small, whole).collect()] == [7]  # all fingers' wrenches reach all zones, one finger's don't


def test_steps_touch_the_tiles_in_reach_only(spark, tmp_path):
    """Rooms far apart, scanned in turn at known poses: what a step reads and writes is its own room's tiles; the map goes on after being opened again."""
    x = room(np.random.default_rng(3))
    places = [0.0, 200.0, 400.0, 0.3]
    known = {k: R.turned_pose(np.array([p, -p, 0.0, 0.0, 0.0, 0.1 * k])) for k, p in enumerate(places)}
    frame = scans(spark, [np.eye(4)] * 4, x)
    held, path = FU.fuse_tiles(frame.filter("scan < 3"), "scan", 0.5, path=str(tmp_path / "map"), span=8, known=known)
    whole = len(held.tiles)
    assert all(not p["read"] for p in path) and sum(len(p["written"]) for p in path) == whole
    again = TileMap(spark, str(tmp_path / "map"), 8)
    assert again.tiles == held.tiles and again.version == 3
    spark.range(3).write.parquet(str(tmp_path / "map/cells/00000004"))  # a step that died before its manifest
    held, path = FU.fuse_tiles(frame.filter("scan = 3"), "scan", 0.5, path=str(tmp_path / "map"), span=8, known=known)
    assert 0 < len(path[0]["read"]) < whole and len(path[0]["written"]) < whole and all(t[0] < 10 for t in path[0]["read"] + path[0]["written"])
    held.prune()
    assert sorted(held._versions("cells")) == sorted(set(held.tiles.values())) and held._versions("manifest") == [4]
    per = None
    for k in range(4):
        own = C.fit(C.transform_points(frame.filter(F.col("scan") == k), known[k].reshape(-1).tolist()), 0.5, least=6)
        per = own if per is None else per.union(own)
    tidy = lambda d: sorted(tuple(round(float(v), 6) for v in r) for r in d.select(*C.KEY, "n", *C.MEAN, *C.COV).collect())
    assert tidy(TileMap(spark, str(tmp_path / "map"), 8).read()) == tidy(C.merge(per))


def test_tile_maps_of_nothing(spark, tmp_path):
    held, path = FU.fuse_tiles(scans(spark, [], room(np.random.default_rng(3))), "scan", 0.5, path=str(tmp_path / "none"))
    assert held.read() is None and path == [] and held.tiles == {}
    two = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (None, 1.0, 1.0, 1.0)], "scan int, x double, y double, z double")
    held, path = FU.fuse_tiles(two, "scan", 0.5, path=str(tmp_path / "few"))
    assert [p["order"] for p in path] == [1] and held.read() is None


def test_pyramid_reaches_what_one_level_misses(spark):
    """Two rounds at full resolution end far off; twelve, eight and two from coarse to fine arrive."""
    truth = R.turned_pose(np.array([0.16, -0.14, 0.2, 0.05, -0.06, 0.08]))
    u, v = (a.ravel() for a in np.meshgrid(np.arange(48), np.arange(48)))
    x = np.column_stack(((u - 24) / 24, (v - 24) / 24, 1.6 + 0.2 * np.sin(u / 6) + 0.15 * np.cos(v / 5)))
    wall = spark.createDataFrame([(k, int(a), int(b), *map(float, p)) for k, (a, b, p) in enumerate(zip(u, v, x))], "id long, u int, v int, x double, y double, z double")
    rays = wall.select("id", *(F.lit(0.0).alias("o" + a) for a in "xyz"), "x", "y", "z")
    voxels = S.fuse_points(rays, 0.1, 0.4, "id").persist()
    seen = C.transform_points(wall, np.linalg.inv(truth).reshape(-1).tolist()).persist()
    off = lambda pose: np.abs((np.column_stack((x, np.ones(len(x)))) @ (pose @ np.linalg.inv(truth)).T)[:, :3] - x).mean()
    pyramid, single = S.track_pyramid(seen, voxels, 0.1, 0.4, "id"), S.track(seen, voxels, 0.1, 0.4, "id", rounds=2)
    assert off(pyramid) < 0.5 * off(single) and off(pyramid) < 0.03, (off(pyramid), off(single))


def test_grasps_small_in_bytes_run_in_tasks_of_their_own(spark):
    """Twelve grasps of a few hundred bytes each are not put into one task; a hull's step doesn't look at the facets far from it; zones come in parts."""
    from time import process_time

    from cairnmap.operators.hull import convex_hull

    draw = np.random.default_rng(5)
    rows = [(g, k % 3, *map(float, p)) for g in range(12) for k, p in enumerate(draw.normal(size=(30, 6)))]
    wrenches = spark.createDataFrame(rows, "grasp int, finger int, " + ", ".join(f"{w} double" for w in GR.WRENCH))
    for found in (GR.grasp_quality(wrenches, "grasp"), GR.shifted_zones(wrenches, "grasp", "finger", 0.5)):
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 6
    order = ["grasp", "zone", "facet"]
    whole, parts = (GR.shifted_zones(wrenches, "grasp", "finger", 0.5, held=h).toPandas().sort_values(order).reset_index(drop=True) for h in (1 << 22, 1000))
    assert len(whole) and whole[order].equals(parts[order]) and np.allclose(whole, parts)

    def seconds(n):
        points = draw.normal(size=(n, 3))
        began = process_time()
        hull = convex_hull(points / np.linalg.norm(points, axis=1)[:, None])
        assert len(hull.vertices) == 2 * n - 4
        return process_time() - began

    seconds(500)
    assert seconds(8000) < 12 * seconds(2000)


def test_hulls_take_the_places_of_their_dead_facets(spark):
    """A hull holds little more than its facets; zones' sizes are those of their rows, also with wrenches in the facets, equal ones and flat faces."""
    import tracemalloc

    from cairnmap.operators.hull import convex_hull

    draw = np.random.default_rng(8)
    points = draw.normal(size=(300, 6))
    points /= np.linalg.norm(points, axis=1)[:, None]
    tracemalloc.start()
    hull = convex_hull(points)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 350 * len(hull.vertices), most / len(hull.vertices)
    cross = np.concatenate((np.eye(6), -np.eye(6)))
    star = np.concatenate((cross, cross[:3], (cross[:1] + cross[1:2]) / 2, 0.2 * cross[:2]))
    cube = np.array(np.meshgrid(*[(-1.0, 1.0)] * 6)).reshape(6, -1).T
    near = np.concatenate((cube, [[1 - 5e-8, 0, 0, 0, 0, 0], [1 + 5e-8, 0.5, 0, 0, 0, 0], [1 - 1e-5, 0, 0, 0, 0, 0]]))
    rows = [(g, k % 3, *map(float, p)) for g, own in enumerate((star, cube, near, points)) for k, p in enumerate(own)]
    wrenches = spark.createDataFrame(rows, "grasp int, finger int, " + ", ".join(f"{w} double" for w in GR.WRENCH))
    sizes = GR.zone_sizes(wrenches, "grasp", "finger", 0.5).toPandas().set_index(["grasp", "zone"]).sort_index()
    whole = GR.shifted_zones(wrenches, "grasp", "finger", 0.5).toPandas().groupby(["grasp", "zone"]).size()
    assert sizes["facets"].to_dict() == whole.to_dict()
    for g, own in enumerate((star, cube, near, points)):
        normals, offsets = GR.hull_facets(own[np.lexsort(own.T[::-1])])
        near_by = (np.abs(own[np.lexsort(own.T[::-1])] @ normals.T - offsets) < 1e-7).sum(1)
        assert {z: n for z, n in enumerate(near_by.tolist()) if n} == sizes.loc[g]["facets"].to_dict()


def test_wrenches_inside_are_left_out_without_hulls_of_parts(spark):
    """Wrenches that are all corners are kept in a few seconds; of a cloud of wrenches most are left out, and its hull stays the same."""
    from time import time

    draw = np.random.default_rng(9)
    sphere, cloud = draw.normal(size=(6000, 6)), draw.normal(size=(8000, 6))
    sphere /= np.linalg.norm(sphere, axis=1)[:, None]
    frame = lambda points: spark.createDataFrame([(0, *map(float, p)) for p in points], "grasp int, " + ", ".join(f"{w} double" for w in GR.WRENCH))
    began = time()
    assert GR.hull_wrenches(frame(sphere), "grasp").count() == len(sphere) and time() - began < 10
    kept = np.array([r[1:] for r in GR.hull_wrenches(frame(cloud), "grasp").collect()])
    assert len(kept) < 0.6 * len(cloud)
    ways = draw.normal(size=(6, 2000))
    assert np.array_equal((cloud @ ways).max(0), (kept @ ways).max(0))
