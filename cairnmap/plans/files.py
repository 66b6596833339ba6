"""Plans that write the given tables in the surveyed file layouts and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import cells as C
from ..operators.lineage import shared_folder
from ..sources import maps, readers, splits, writers
from .registry import CLOUD, POSES, ROUND_STATS, SIZE, STATS, cells, cells_sql, cloud, plan, poses, rnd, rounded
from .volumes import _BALL, volume


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(lines, by: str, path: str) -> None:
    """Lines (by, ord, line) as one text file for each value of ``by``. They are dealt by a hash of ``by``: for ``by`` itself Spark leaves the shuffle
    out where the lines are a union of parts already dealt by it, whose partitions are then joined differently, and a file falls into two."""
    lines.repartition(F.xxhash64(by)).sortWithinPartitions(by, "ord").select(by, F.col("line").alias("value")).write.partitionBy(by).text(path)


def _named(df, by: str):
    """The value of ``by`` from a file's folder."""
    return df.withColumn(by, F.regexp_extract("file", rf"{by}=(-?[0-9]+)", 1).cast("int")).drop("file")


def points(spark, sf):
    own = cloud(spark, sf)
    return own.withColumn("pt_idx", (F.row_number().over(Window.partitionBy("scan_id").orderBy("pid")) - 1).cast("int"))


_POINTS = "pt AS (SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY pid) - 1 AS INTEGER) AS pt_idx, x, y, z FROM cloud)"
_READ = ", ".join(rnd(f"CAST(printf('%.6f', {a}) AS DOUBLE)", a) for a in "xyz")


def _block(own, name: str, columns, start: int):
    """Lines of a VRML block of triples, in order from ``start``."""
    scans = own.select("scan_id").distinct()
    body = own.select("scan_id", (F.col("pt_idx") + start + 1).cast("long").alias("ord"), F.concat(writers.numbers(*columns), F.lit(",")).alias("line"))
    head = scans.select("scan_id", F.lit(start).cast("long").alias("ord"), F.lit(f"{name} [").alias("line"))
    tail = scans.select("scan_id", F.lit(start + 1_000_000_000).cast("long").alias("ord"), F.lit("] }").alias("line"))
    return body.unionByName(head).unionByName(tail)


@plan(f"WITH {CLOUD}, {_POINTS} SELECT scan_id, pt_idx, {_READ} FROM pt")
def vrml_points(spark, sf):
    own, path = points(spark, sf), folder(spark, "vrml")
    lines = writers.vrml_lines(own, "scan_id").select("scan_id", (F.col("pt_idx") + 1).cast("long").alias("ord"), "line")
    scans = own.select("scan_id").distinct()
    ends = scans.select("scan_id", F.inline(F.array(F.struct(F.lit(0).cast("long").alias("ord"), F.lit("Shape { coord Coordinate { point [").alias("line")), F.struct(F.lit(1 << 40).alias("ord"), F.lit("] } }").alias("line")))))
    written(lines.unionByName(ends), "scan_id", path)
    return rounded(_named(splits.vrml_cloud(spark, path), "scan_id"), *G.AXES)


@plan(f"WITH {CLOUD}, {_POINTS} SELECT scan_id, pt_idx, {_READ}, {', '.join(rnd(f'''CAST(printf('%.6f', abs({a})) AS DOUBLE)''', c) for a, c in zip('xyz', 'rgb'))} FROM pt")
def vrml_coloured_points(spark, sf):
    own, path = points(spark, sf), folder(spark, "vrml")
    written(_block(own, "point", G.AXES, 0).unionByName(_block(own, "color", [F.abs(a) for a in G.AXES], 2_000_000_000)), "scan_id", path)
    return rounded(_named(splits.vrml_shades(spark, path), "scan_id"), *G.AXES, "r", "g", "b")


@plan(f"WITH {CLOUD}, {_POINTS} SELECT scan_id, pt_idx, {_READ} FROM pt")
def pcd_points(spark, sf):
    own, path = points(spark, sf), folder(spark, "pcd")
    body = own.select("scan_id", (F.col("pt_idx") + 10).cast("long").alias("ord"), writers.numbers(*G.AXES).alias("line"))
    head = F.array(*(F.struct(F.lit(k).cast("long").alias("ord"), F.lit(t).alias("line")) for k, t in enumerate(("# .PCD v.7 - point cloud", "VERSION .7", "FIELDS x y z", "DATA ascii"))))
    written(body.unionByName(own.select("scan_id").distinct().select("scan_id", F.inline(head))), "scan_id", path)
    return rounded(_named(splits.pcd_cloud(spark, path), "scan_id"), *G.AXES)


_TRAJ = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


@plan(f"WITH {POSES} SELECT robot_id, count(*) AS n, {', '.join(rnd(f'''sum(CAST(printf('%.6f', {e}) AS DOUBLE))''', c, 3) for e, c in (('x', 'tx'), ('y', 'ty'), ('sin(yaw/2)', 'qz')))} FROM poses GROUP BY robot_id")
def trajectory_files(spark, sf):
    """Every robot's trajectory as a text file, read back and added up."""
    path = folder(spark, "trajectory")
    own = poses(spark, sf).select("robot_id", "seq", F.col("seq").cast("double").alias("ts"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.lit(0.0).alias("tz"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(F.col("yaw") / 2).alias("qz"), F.cos(F.col("yaw") / 2).alias("qw"))
    lines = own.select("robot_id", F.col("seq").alias("ord"), writers.numbers("ts", *_TRAJ).alias("line"))
    written(lines, "robot_id", path)
    back = _named(readers.trajectory(spark, path), "robot_id").withColumn("robot_id", F.col("robot_id").cast("long"))
    out = back.groupBy("robot_id").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("tx", "ty", "qz")))
    return rounded(out, "tx", "ty", "qz", digits=3)


_CELLS = cells_sql("cells", by="scan_id")
_GRID = (20.0, 20.0, 20.0, SIZE, SIZE, SIZE, 0.0, 0.0, 0.0)


@plan(f"WITH {CLOUD}, {_CELLS} SELECT scan_id, ix, iy, iz, CAST(n AS INTEGER) AS n, {ROUND_STATS} FROM cells")
def cell_map_files(spark, sf):
    """Every scan's cells as a binary map file, written and read by the data source in ranges of 50 records."""
    splits.registered(spark)
    path = folder(spark, "maps")
    full = maps.full_cells(cells(spark, sf, ("scan_id",)), SIZE)
    content = maps.map_contents(full, "scan_id", _GRID)
    content.select(F.concat(F.lit("scan_id="), F.col("scan_id")).alias("file"), "content").write.format("cell_map").mode("append").save(path)
    back = spark.read.format("cell_map").schema("file string, cx double, cy double, cz double, n int, " + ", ".join(f"{c} double" for c in STATS)).option("records", 50).load(path)
    out = _named(back, "scan_id").select("scan_id", *(F.round(F.col("c" + a) / SIZE).cast("int").alias("i" + a) for a in "xyz"), "n", *STATS)
    return rounded(out, *STATS)


@plan(f"WITH {_BALL}, m AS (SELECT min(i) AS a, min(j) AS b, min(k) AS c FROM ball) SELECT CAST(i-a AS INTEGER) AS i, CAST(j-b AS INTEGER) AS j, CAST(k-c AS INTEGER) AS k, {rnd('CAST(d AS FLOAT)::DOUBLE', 'd', 5)} FROM ball, m")
def volume_files(spark, sf):
    """The cloud's distance volume as an image-data file and back."""
    own = volume(spark, sf).persist()
    low = own.agg(*(F.min(v) for v in "ijk"), *(F.max(v) for v in "ijk")).first()
    moved = own.select(*((F.col(v) - low[n]).cast("int").alias(v) for n, v in enumerate("ijk")), "d", "w")
    path = folder(spark, "volume")
    maps.volume_lines(moved, tuple(low[3 + n] - low[n] + 1 for n in range(3)), SIZE).coalesce(1).sortWithinPartitions("ord").select("line").write.text(path)
    return rounded(maps.volumes(spark, path).select("i", "j", "k", "d"), "d", digits=5)
