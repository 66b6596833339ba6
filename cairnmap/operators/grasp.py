"""Contact wrenches, grasp quality and contact regions on meshes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .hull import convex_hull
from .lineage import cut

WRENCH = ("f1", "f2", "f3", "t1", "t2", "t3")


def limit_surface(spark, kind: str = "hard", friction: float = 0.8, sides: int = 8, torsion: float = 0.1) -> DataFrame:
    """k, fx, fy, fz, tz of a contact's primitive forces: along the normal, on a friction cone, and with torsion for a soft finger."""
    if kind == "frictionless":
        return spark.range(1).select(F.col("id").cast("int").alias("k"), *(F.lit(v).alias(c) for c, v in zip(("fx", "fy", "fz", "tz"), (0.0, 0.0, 1.0, 0.0))))
    angle = F.col("id") * (2 * 3.141592653589793 / sides)
    cone = spark.range(sides).select(F.col("id").cast("int").alias("k"), (friction * F.cos(angle)).alias("fx"), (friction * F.sin(angle)).alias("fy"), F.lit(1.0).alias("fz"), F.lit(0.0).alias("tz"))
    if kind == "hard":
        return cone
    twist = spark.range(2).select((F.col("id") + sides).cast("int").alias("k"), F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"), F.lit(1.0).alias("fz"), ((2 * F.col("id") - 1) * torsion).alias("tz"))
    return cone.union(twist)


def finger_surfaces(fingers: DataFrame, finger: str, friction: str, sides: int = 8) -> DataFrame:
    """finger, k, fx, fy, fz, tz of every finger's friction cone, by the finger's own friction; a null friction gives a null cone."""
    angle = F.col("k") * (2 * 3.141592653589793 / sides)
    rows = fingers.select(finger, friction, F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("k"))
    return rows.select(finger, "k", (F.col(friction) * F.cos(angle)).alias("fx"), (F.col(friction) * F.sin(angle)).alias("fy"), F.lit(1.0).alias("fz"), F.lit(0.0).alias("tz"))


def object_wrenches(vertices: DataFrame, surface: DataFrame, scale: float | None = None) -> DataFrame:
    """id, k and the six components of every vertex's wrenches; torques over the largest vertex distance unless a scale is given.

    Forces push against the normal; a contact frame's tangents come from the axis least along the normal.
    """
    reach = G.norm(*(F.col(a) for a in G.AXES))
    n = [-F.col("n" + a) for a in G.AXES]
    flat = F.abs(F.col("nx")) < 0.9
    axis = [F.when(flat, 1.0).otherwise(0.0), F.when(flat, 0.0).otherwise(1.0), F.lit(0.0)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    side = cross(n, axis)
    size = G.norm(*side)
    side = [s / size for s in side]
    v = vertices.select("id", *G.AXES, *(c.alias(f"n{k}") for k, c in enumerate(n)), *(c.alias(f"s{k}") for k, c in enumerate(side)))
    n, s = [F.col(f"n{k}") for k in range(3)], [F.col(f"s{k}") for k in range(3)]
    o = cross(n, s)
    rows = v.crossJoin(F.broadcast(surface))  # a limit surface has a handful of rows
    force = [F.col("fx") * s[a] + F.col("fy") * o[a] + F.col("fz") * n[a] for a in range(3)]
    torque = [t + F.col("tz") * m for t, m in zip(cross([F.col(a) for a in G.AXES], force), n)]
    if scale is None:
        scale = vertices.agg(F.max(reach)).first()[0] or 1.0
    return rows.select("id", "k", *(f.alias(c) for f, c in zip(force, WRENCH[:3])), *((t / scale).alias(c) for t, c in zip(torque, WRENCH[3:])))


def hull_facets(points: np.ndarray, digits: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Outward unit normals and offsets (n . x <= offset) of the different facets of a point set's convex hull; none for flat points."""
    hull = convex_hull(points)
    if hull is None:
        return np.zeros((0, points.shape[1])), np.zeros(0)
    both = np.column_stack((hull.normals, hull.offsets))
    both = both[np.unique(np.round(both, digits) + 0.0, axis=0, return_index=True)[1]]
    return both[:, :-1], both[:, -1]


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over all cores, or by key over as many tasks as a shuffle has (200 at least). A hull takes long however few bytes it has: a fixed
    number keeps adaptive execution from putting all grasps into one task for their small size."""
    return df.repartition(max(200, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if by else df.sparkSession.sparkContext.defaultParallelism, *by)


def hull_wrenches(wrenches: DataFrame, by: str, least: int = 1000) -> DataFrame:
    """by and components of the wrenches that their grasp's hull can need: those clearly inside a small hull of the same grasp's wrenches are left
    out, so hulls of the rest are the same. A task makes a grasp's small hull once, from the outermost of the first batch that has ``least`` of the
    grasp's wrenches; fewer are all kept, as hulls of parts cost more than they spare where most wrenches are corners."""
    kind = dict(wrenches.dtypes)[by]
    ways = np.random.default_rng(3).normal(size=(6, 24))

    def run(batches):
        small: dict = {}
        for batch in batches:
            kept = [batch.iloc[:0]]
            for grasp, own in batch.groupby(by, dropna=False, sort=False):
                points = own[list(WRENCH)].to_numpy(float)
                if grasp not in small and len(points) >= least:
                    outer = points @ np.hstack((ways, -ways))
                    small[grasp] = convex_hull(points[np.unique(outer.argmax(0))])
                hull, size = small.get(grasp), 4096
                if hull is not None:
                    margin = 1e-6 * float(np.ptp(hull.points, axis=0).max())
                    parts = (points[k : k + size] for k in range(0, len(points), size))
                    own = own[np.concatenate([(p @ hull.normals.T > hull.offsets - margin).any(1) | ~np.isfinite(p).all(1) for p in parts])]
                kept.append(own)
            yield pd.concat(kept)

    return dealt(wrenches.select(by, *WRENCH).dropna()).mapInPandas(run, f"`{by}` {kind}, " + ", ".join(f"{w} double" for w in WRENCH))


def grasp_quality(wrenches: DataFrame, by: str) -> DataFrame:
    """by, facets, radius, force_closure, volume, area of each grasp's wrench set: the largest ball about the origin inside the hull, and the
    hull's contents. Wrenches clearly inside are left out before a grasp meets in one task. Flat sets give zeros; rows with nulls don't count."""

    def run(group):
        hull = convex_hull(group[list(WRENCH)].to_numpy(float))
        if hull is None:
            return group.iloc[:1][[by]].assign(facets=0, radius=0.0, force_closure=False, volume=0.0, area=0.0)
        radius = float(hull.offsets.min())
        return group.iloc[:1][[by]].assign(facets=hull.planes(), radius=max(radius, 0.0), force_closure=radius > 1e-9, volume=hull.volume(), area=hull.area())

    kind = dict(wrenches.dtypes)[by]
    return dealt(hull_wrenches(wrenches, by), by).groupBy(by).applyInPandas(run, f"`{by}` {kind}, facets long, radius double, force_closure boolean, volume double, area double")


def zone_inclusion(wrenches: DataFrame, zones: DataFrame, patches: DataFrame) -> DataFrame:
    """patch ids whose every zone holds some wrench of some point of the patch.

    wrenches: id, k, six components; zones: zone, facet, n0..n5, off; patches: patch, id. A wrench is in a zone if n . w >= off for all its facets.
    """
    value = sum((F.col(f"n{k}") * F.col(w) for k, w in enumerate(WRENCH)), F.lit(0.0))
    held = wrenches.crossJoin(F.broadcast(zones)).groupBy("id", "k", "zone").agg(F.bool_and(value >= F.col("off")).alias("ok")).filter("ok").select("id", "zone").distinct()
    n = zones.select("zone").distinct().count()
    return patches.join(held, "id").select("patch", "zone").distinct().groupBy("patch").agg(F.count("*").alias("zones")).filter(F.col("zones") == n).select("patch")


def contact_region(edges: DataFrame, qualified: DataFrame, center: int) -> DataFrame:
    """id, hops of the qualified vertices reached from a centre over mesh edges through qualified vertices only."""
    from .planning import reachable

    ok = edges.join(qualified.select(F.col("id").alias("src")), "src", "left_semi").join(qualified.select(F.col("id").alias("dst")), "dst", "left_semi")
    seed = qualified.filter(F.col("id") == center).select(F.col("id").alias("center"))
    return reachable(cut(ok), seed).select(F.col("node").alias("id"), "hops")


def patches(edges: DataFrame, vertices: DataFrame, radius: float) -> DataFrame:
    """center, node of the vertices within a ball around each vertex that are reached inside the ball over mesh edges."""
    place = vertices.select(F.col("id").alias("v"), *G.AXES)
    out = place.select(F.col("v").alias("center"), F.col("v").alias("node"))
    front = out
    c = place.select(F.col("v").alias("center"), *(F.col(a).alias("c" + a) for a in G.AXES))
    e = edges.join(place.withColumnRenamed("v", "dst"), "dst")
    near = G.distance([F.col(a) for a in G.AXES], [F.col("c" + a) for a in G.AXES]) <= radius
    while True:
        new = front.join(e, front["node"] == e["src"]).join(c, "center").filter(near).select("center", F.col("dst").alias("node")).distinct()
        new = cut(new.join(out, ["center", "node"], "left_anti"))
        if new.isEmpty():
            return out
        out, front = cut(out.unionByName(new)), new


def shared_surfaces(fingers: DataFrame, finger: str, parameters: tuple[str, ...]) -> DataFrame:
    """finger, surface: fingers with equal parameters share a limit surface, so each is computed once."""
    from pyspark.sql import Window

    kinds = fingers.select(*parameters).distinct()
    number = (F.row_number().over(Window.orderBy(*parameters)) - 1).alias("surface")  # one row a kind of finger
    return fingers.join(kinds.select(*parameters, number), list(parameters)).select(finger, "surface")


def measured_hull(points: np.ndarray) -> tuple[float, float]:
    """Volume and surface content of a point set's convex hull; zeros for flat points."""
    hull = convex_hull(points)
    return (0.0, 0.0) if hull is None else (hull.volume(), hull.area())


def _wrench_hulls(batches: Iterator[pd.DataFrame], finger: str, alpha: float):
    """A grasp's wrenches in the order of their components, their hull and the offset of its zones' facets; nothing without force closure."""
    group = pd.concat(list(batches)).sort_values([*WRENCH, finger]).reset_index(drop=True)
    hull = convex_hull(group[list(WRENCH)].to_numpy(float))
    if hull is not None and hull.offsets.min() > 1e-9:
        yield group, hull, alpha * float(hull.offsets.min())


def shifted_zones(wrenches: DataFrame, by: str, finger: str, alpha: float, held: int = 1 << 22) -> DataFrame:
    """by, finger, zone, facet, n0..n5, off of each grasp whose hull holds the origin: one zone for each wrench (numbered in the order of their
    components) at a hull vertex, bounded by its facets moved inwards to ``alpha`` times the ball's radius: outward normals, and a wrench is in the
    zone if n . w >= off for all its facets, so that a hull with a wrench in every zone still holds the smaller ball. No zones without force closure.
    A task holds ``held`` distances of wrenches from facets at a time.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha is between 0 and 1")
    kinds = dict(wrenches.dtypes)
    schema = f"`{by}` {kinds[by]}, `{finger}` {kinds[finger]}, zone int, facet int, " + ", ".join(f"n{k} double" for k in range(6)) + ", off double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, hull, off in _wrench_hulls(batches, finger, alpha):
            keys, fingers = group[by].to_numpy(), group[finger].to_numpy()
            for place, facet, zone in hull.touching(held=held):  # some facets at a time: points times facets are never held at once
                own = {by: keys[zone], finger: fingers[zone], "zone": zone, "facet": facet}
                yield pd.DataFrame(own | {f"n{k}": hull.normals[place, k] for k in range(6)} | {"off": np.full(len(zone), off)})

    return dealt(wrenches.select(by, finger, *WRENCH), by).groupBy(by).applyInPandas(run, schema)


def zone_sizes(wrenches: DataFrame, by: str, finger: str, alpha: float, held: int = 1 << 22) -> DataFrame:
    """by, finger, zone, facets, off of each zone of ``shifted_zones``: its facets are counted where the hull is, so none of them leaves its task."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha is between 0 and 1")
    kinds = dict(wrenches.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, hull, off in _wrench_hulls(batches, finger, alpha):
            sizes = np.zeros(len(group), np.int64)
            for _, _, zone in hull.touching(held=held):
                sizes += np.bincount(zone, minlength=len(group))
            zone = np.flatnonzero(sizes)
            yield pd.DataFrame({by: group[by].to_numpy()[zone], finger: group[finger].to_numpy()[zone], "zone": zone, "facets": sizes[zone], "off": np.full(len(zone), off)})

    return dealt(wrenches.select(by, finger, *WRENCH), by).groupBy(by).applyInPandas(run, f"`{by}` {kinds[by]}, `{finger}` {kinds[finger]}, zone int, facets long, off double")
