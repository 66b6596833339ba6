"""Text and table sinks: each returns the lines or writes a table; files are written by Spark's writers only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(value: Column | str, digits: int = 6) -> Column:
    """A number with a fixed count of decimals as C's printf writes it: rounded by its exact binary value, ties to even. (``format_string`` rounds the
    shortest decimal text half up.) Nulls, NaN and infinities are written as ``format_string`` writes them; of a number above 2^53 only the first 17 digits count."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.abs(value) < float("inf"), F.call_function("format_number", value, F.lit("0." + "0" * digits))).otherwise(F.format_string(f"%.{digits}f", value))


def numbers(*values: Column | str) -> Column:
    """Numbers with six decimals and blanks between them."""
    return F.concat_ws(" ", *(fixed(v) for v in values))


def vrml_lines(points: DataFrame, by: str) -> DataFrame:
    """by, pt_idx, line: one ``x y z,`` line for each point of a point block."""
    return points.select(by, "pt_idx", F.concat(numbers("x", "y", "z"), F.lit(",")).alias("line"))


def obj_lines(triangles: DataFrame) -> DataFrame:
    """Four lines for each triangle: three vertices and a face with relative indices."""
    v = [F.concat(F.lit("v "), numbers(*(F.col(f"v{k}")[a] for a in "xyz"))) for k in range(3)]
    return triangles.select(F.concat_ws("\n", *v, F.lit("f -3 -2 -1")).alias("value"))


def pose_graph_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """ord, id, line: VERTEX_SE3:QUAT and EDGE_SE3:QUAT lines. edges carry cov, an array of 36; the information is (cov + 1e-4 I)^-1."""
    pose = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
    v = vertices.select(F.lit(0).alias("ord"), F.col("id").cast("long").alias("id"), F.concat(F.lit("VERTEX_SE3:QUAT "), F.col("id").cast("string"), F.lit(" "), numbers(*pose)).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.to_pylist(), []
            for r in rows:
                info = np.linalg.inv(np.array(r["cov"]).reshape(6, 6) + 1e-4 * np.eye(6))
                out.append(f"EDGE_SE3:QUAT {r['i']} {r['j']}" + "".join(f" {r[c]:.6f}" for c in pose) + "".join(f" {x:.6f}" for x in info[np.triu_indices(6)]))
            yield pa.record_batch([pa.array([1] * len(rows), pa.int32()), pa.array([r["i"] for r in rows], pa.int64()), pa.array(out, pa.string())], names=["ord", "id", "line"])

    return v.union(edges.select("i", "j", *pose, "cov").mapInArrow(run, "ord int, id long, line string"))


def trajectory_lines(poses: DataFrame) -> DataFrame:
    return poses.select("ts", numbers("ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw").alias("line"))


def particle_lines(particles: DataFrame) -> DataFrame:
    """pid, line: ``x y heading weight`` of each particle."""
    return particles.select("pid", numbers("x", "y", "a", "p").alias("line"))


def odometry_lines(poses: DataFrame, by: str, order: str) -> DataFrame:
    """by, order, line: planar poses as ``x y 0 0 0 sin cos`` with the heading's half angle, as messages and transforms carry them."""
    number = lambda c: fixed(F.round(c, 6) + 0.0)
    half = F.col("yaw") / 2
    return poses.select(by, order, F.concat_ws(" ", number("x"), number("y"), F.lit("0 0 0"), number(F.sin(half)), number(F.cos(half))).alias("line"))


def polygon_lines(polygons: DataFrame, by: str) -> DataFrame:
    """by, line: a polygon's corners in order on one line."""
    corners = F.transform(F.array_sort(F.collect_list(F.struct("edge", "x", "y"))), lambda p: F.concat_ws(" ", fixed(p["x"], 3), fixed(p["y"], 3)))
    return polygons.groupBy(by).agg(F.concat_ws(" ", corners).alias("line"))


def thinned(points: DataFrame, poses: DataFrame, by: str, every: int = 10) -> DataFrame:
    """Every n-th point of all scans, moved by its scan's pose (dx, dy, dz)."""
    return points.filter(F.col("pt_idx") % every == 0).join(poses, by).select(by, "pt_idx", *((F.col(a) + F.col("d" + a)).alias(a) for a in "xyz"))


def write_tiles(cells: DataFrame, path: str, size: float, tile: float) -> None:
    """Cells as Parquet, partitioned by the tile of their mean; only the tiles that occur are replaced."""
    keys = [F.floor(F.col("m" + a) / tile + 0.5).cast("int").alias("tile_" + a) for a in "xy"]
    cells.select("*", *keys).repartition("tile_x", "tile_y").write.option("partitionOverwriteMode", "dynamic").partitionBy("tile_x", "tile_y").mode("overwrite").parquet(path)


#: Shades of ellipsoids by class of the cell.
SHADES = {"ROUGH": (1.0, 0.0, 0.0), "HORIZONTAL": (0.0, 1.0, 0.0), "VERTICAL": (0.0, 0.0, 1.0), "INCLINED": (0.0, 0.5, 0.5)}


def ellipsoid_lines(cells: DataFrame, by: str) -> DataFrame:
    """by, ix, iy, iz, line: one VRML sphere a cell, stretched to its standard deviations, turned to its axes (rotations about z, y, x) and
    coloured by its class. Cells without a proper covariance give none."""
    kind = dict(cells.dtypes)[by]
    from ..operators.cells import COV, KEY, MEAN, clamped

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.column_stack([batch.column(n).to_numpy() for n in COV]).reshape(-1, 6)[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            values, axes = np.linalg.eigh(c)
            axes[np.linalg.det(axes) < 0, :, 0] *= -1
            turn = np.column_stack((np.arctan2(axes[:, 1, 0], axes[:, 0, 0]), -np.arcsin(np.clip(axes[:, 2, 0], -1, 1)), np.arctan2(axes[:, 2, 1], axes[:, 2, 2])))
            means = np.column_stack([batch.column(n).to_numpy() for n in MEAN])
            lines = []
            for m, t, s, k in zip(means, turn, np.sqrt(np.maximum(values, 0)), batch.column("class").to_pylist()):
                shape = "Transform { scale %.6f %.6f %.6f children [ Shape { geometry Sphere { radius 1 } appearance Appearance { material Material { diffuseColor %.2f %.2f %.2f } } } ] }" % (*s, *SHADES[k])
                for axis, angle in zip(("1 0 0", "0 1 0", "0 0 1"), t[::-1]):
                    shape = "Transform { rotation %s %.6f children [ %s ] }" % (axis, angle, shape)
                lines.append("Transform { translation %.6f %.6f %.6f children [ %s ] }" % (*m, shape))
            yield pa.record_batch([batch.column(by), *(batch.column(n) for n in KEY), pa.array(lines, pa.string())], names=[by, *KEY, "line"])

    return clamped(cells.select(by, *KEY, *MEAN, *COV)).mapInArrow(run, f"`{by}` {kind}, ix int, iy int, iz int, line string")


def write_regions(regions: DataFrame, path: str, by: tuple[str, ...] = ("grasp",)) -> None:
    """Contact regions as Parquet, a folder for each grasp; saving a grasp again replaces its folder only."""
    regions.repartition(*by).write.option("partitionOverwriteMode", "dynamic").partitionBy(*by).mode("overwrite").parquet(path)
