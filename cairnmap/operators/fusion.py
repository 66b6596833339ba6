"""Incremental fusion of ordered scans into one map, and sequences of frames against a volume.

A pose depends on the map of all scans before it, so scans follow each other; within a scan's step fitting, evidence and merging
are distributed, and only the scan's own cells with the map's cells in their reach meet in one task, where the matcher runs. The map lies in
tiles (see ``tiles``): a step reads and writes the tiles in the scan's reach.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import sdf
from .cells import COV, KEY, MEAN, fit, merge, transform, transform_points
from .lineage import cut, shared_folder
from .registration import match_arrays
from .tiles import TileMap, bucketed
from .updates import mean_update, rebinned

_STATE = (*KEY, "n", *MEAN, *COV)


def _numbers(t: np.ndarray) -> list[float]:
    return t.reshape(-1).tolist()


def apart(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Distance and angle between two poses."""
    d = np.linalg.inv(a) @ b
    return float(np.linalg.norm(d[:3, 3])), float(np.arccos(np.clip((np.trace(d[:3, :3]) - 1) / 2, -1, 1)))


def matched(scan: DataFrame, cells: DataFrame, size: float, guess: np.ndarray, n: int = 2, rounds: int = 30) -> tuple[np.ndarray, float]:
    """The pose that fits a scan's cells to a map's, from a guess, and its score. Cells of the map are taken within the blocks around
    the scan's moved cells, so the matching task's size is that of the scan; nothing in reach gives the guess and 0."""
    moved = transform(scan.select(*MEAN, *COV), _numbers(guess))
    blocks = moved.select(*(G.grid_key(m, size).alias(k) for m, k in zip(MEAN, KEY)))
    for k in KEY:
        blocks = blocks.withColumn(k, F.explode(F.sequence(F.col(k) - n - 1, F.col(k) + n + 1)))
    near = cells.join(blocks.distinct(), list(KEY), "left_semi")
    both = moved.withColumn("side", F.lit(0)).unionByName(near.select(*MEAN, *COV).withColumn("side", F.lit(1)))

    def run(batches):
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None:
            return
        side = rows["side"].to_numpy()
        values = np.column_stack([rows[c].to_numpy() for c in MEAN + COV]).astype(float)
        means, covs = values[:, :3], values[:, 3:][:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
        if (side == 0).any() and (side == 1).any():
            pose, score = match_arrays(means[side == 0], covs[side == 0], means[side == 1], covs[side == 1], size, n, rounds)
            yield pa.record_batch([pa.array([pose.reshape(-1).tolist()], pa.list_(pa.float64())), pa.array([score])], names=["pose", "score"])

    row = both.repartition(1).mapInArrow(run, "pose array<double>, score double").first()
    return (np.array(row["pose"]).reshape(4, 4) @ guess, row["score"]) if row else (guess, 0.0)


def _extent(points: DataFrame, size: float, origin: np.ndarray) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """Least and largest (ix, iy) of points and of the sensor's place."""
    keys = points.select(*G.grid_keys(size))
    row = keys.agg(*(f(k) for f in (F.min, F.max) for k in ("ix", "iy"))).first()
    if row[0] is None:
        return None
    at = np.floor(origin[:2] / size + 0.5).astype(int).tolist()
    return (min(row[0], at[0]), min(row[1], at[1])), (max(row[2], at[0]), max(row[3], at[1]))


def fuse_tiles(scans: DataFrame, order: str, size: float, path: str | None = None, span: int = 64, motions: dict[int, np.ndarray] | None = None, known: dict[int, np.ndarray] | None = None, first: np.ndarray | None = None, metres: float = 1.0,
               radians: float = np.pi / 4, fuse_metres: float = 0.05, fuse_radians: float = 0.01, least: int = 6, coarse: bool = False, evidence: bool = False) -> tuple[TileMap, list[dict]]:
    """The map of ordered scans (order, x, y, z in the sensor's frame) as tiles, and a dict a scan: order, pose, score, accepted, fused, and the
    tiles read and written.

    Points are stored by scan once. Each scan is fitted, matched from the pose before it times its motion (identity without one),
    refused where that deviates from the motion by more than ``metres`` or ``radians``, and merged into the map where it moved far enough
    since the last fused one. A step reads the tiles within the scan's reach and writes those that the scan's cells (with ``evidence``, its rays) lie
    in, whatever the map's size. ``known`` gives poses, which are taken without matching; ``coarse`` matches cells of three times the size first; ``evidence``
    updates occupancy by the scan's local Gaussians (column occ). The first scan starts the map; a map found at ``path`` goes on. No scans leave the map as it is.
    """
    spark = scans.sparkSession
    home = f"{shared_folder(spark)}/fusion-{uuid.uuid4().hex}"
    held = TileMap(spark, path or f"{home}/map", span)
    numbers = bucketed(scans, order, f"{home}/scans", G.AXES)
    stored = spark.read.parquet(f"{home}/scans") if numbers else None
    out, pose, last = [], np.eye(4) if first is None else np.array(first, float), None
    for number in numbers:
        points = stored.filter(F.col("_order") == number).select(F.col("_order").alias(order), *G.AXES)
        guess = known[number] if known else pose @ (motions or {}).get(number, np.eye(4)) if held.tiles else pose
        margin, reads = (9 if coarse else 3), []
        score, good, found = 0.0, True, guess
        if held.tiles and not known:
            reach = _extent(transform_points(points, _numbers(guess)), size, guess[:3, 3])
            reads = held.around(*(tuple(k + d for k in at) for at, d in zip(reach, (-margin, margin)))) if reach else []
            near = held.read(reads)
            if near is not None:
                near = near.select(*_STATE)
                start = matched(fit(points, 3 * size, least=least), rebinned(near, 3 * size), 3 * size, guess, 1)[0] if coarse else guess
                found, score = matched(cut(fit(points, size, least=least)), near, size, start)
            off = apart(guess, found)
            good = score < 0 and off[0] <= metres and off[1] <= radians
        pose = found if good else guess
        far = last is None or (good and any(v > d for v, d in zip(apart(last, pose), (fuse_metres, fuse_radians))))
        wrote = []
        if far:
            world = transform_points(points, _numbers(pose))
            own = fit(world, size, least=least).select(*_STATE)
            reach = _extent(world, size, pose[:3, 3])
            around = held.around(*reach) if reach else []
            before = held.read(around)
            reads = sorted({*reads, *around})
            if before is None:
                new = own.withColumn("occ", F.least(F.lit(255.0), F.col("n") * 0.4054651081081644)) if evidence else own
            elif evidence:
                new = mean_update(before.select(*_STATE), world, size, order)
                occ = before.select(*KEY, F.col("occ").alias("_o"))
                new = new.join(occ, list(KEY), "left").withColumn("occ", F.greatest(F.lit(-255.0), F.least(F.lit(255.0), F.col("occ") + F.coalesce("_o", F.lit(0.0))))).drop("_o")
            else:
                new = merge(before.unionByName(own))
            wrote = held.replace(new)
            last = pose
        out.append({"order": number, "pose": pose, "score": score, "accepted": good, "fused": far, "read": reads, "written": wrote})
    return held, out


def fuse_scans(scans: DataFrame, order: str, size: float, **options) -> tuple[DataFrame | None, list[dict]]:
    """``fuse_tiles`` with the whole map as a frame; an empty frame gives (None, [])."""
    held, path = fuse_tiles(scans, order, size, **options)
    return held.read(), path


def path_frame(spark, path: list[dict]) -> DataFrame:
    """The poses of ``fuse_scans`` as rows: seq, tx, ty, tz, yaw, score, accepted, fused."""
    rows = [(int(p["order"]), *map(float, p["pose"][:3, 3]), float(np.arctan2(p["pose"][1, 0], p["pose"][0, 0])), float(p["score"]), bool(p["accepted"]), bool(p["fused"])) for p in path]
    return spark.createDataFrame(rows, "seq long, tx double, ty double, tz double, yaw double, score double, accepted boolean, fused boolean")


def depth_points(frames: DataFrame, order: str, fx: float, fy: float, cx: float, cy: float, far: float | None = None) -> DataFrame:
    """Points of depth frames (order, u, v, depth), missing and far depths left out: the input of ``fuse_scans`` from a depth sequence."""
    p = G.back_project(fx, fy, cx, cy, F.col("u"), F.col("v"), F.col("depth"))
    good = F.col("depth").isNotNull() & ~F.isnan("depth") & (F.col("depth") > 0)
    return frames.filter(good if far is None else good & (F.col("depth") <= far)).select(order, *(c.alias(a) for c, a in zip(p, G.AXES)))


def track_frames(frames: DataFrame, order: str, size: float, truncation: float, rounds: int = 12) -> tuple[DataFrame, list[dict]]:
    """A volume (i, j, k, d, w) of ordered point frames (order, pid, x, y, z) and each frame's pose: every frame is brought onto the volume's
    surface from the pose before it, then its rays from the sensor are fused. The first frame starts the volume."""
    volume, pose, path = None, np.eye(4), []
    for number in [r[0] for r in frames.select(order).distinct().orderBy(order).collect()]:
        points = cut(frames.filter(F.col(order) == number).select("pid", *G.AXES))
        if volume is not None:
            pose = sdf.track(transform_points(points, _numbers(pose)), volume, size, truncation, "pid", rounds) @ pose
        world = transform_points(points, _numbers(pose))
        rays = world.select("pid", *(F.lit(float(o)).alias("o" + a) for o, a in zip(pose[:3, 3], G.AXES)), *G.AXES)
        own = sdf.fuse_points(rays, size, truncation, "pid")
        volume = cut(own if volume is None else sdf.merge(volume, own))
        path.append({"order": number, "pose": pose, "score": 0.0, "accepted": True, "fused": True})
    return volume, path
