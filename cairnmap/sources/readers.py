"""Scans of text formats as DataFrames; every file is one row until its points are unfolded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:[0-9]*\.[0-9]+|[0-9]+\.?)(?:[eE][-+]?[0-9]+)?"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def _triples(block, start: int = 0):
    """Array of (pt_idx, x, y, z) of the lines of a block of text that begin with three numbers; nan is missing, other lines are passed over."""
    lines = F.filter(F.split(block, r"[\n,]"), lambda v: v.rlike(rf"(?i)^\s*(?:(?:{NUMBER}|nan)\s+){{2}}(?:{NUMBER}|nan)"))
    parts = F.transform(lines, lambda v: F.split(F.trim(v), r"\s+"))
    number = lambda v: F.when(F.lower(v) != "nan", v.cast("double"))
    return F.transform(parts, lambda p, k: F.struct(k.alias("pt_idx"), *(number(p[n]).alias(a) for n, a in enumerate("xyz"))))


def vrml_points(spark: SparkSession, path: str) -> DataFrame:
    """file, pt_idx, x, y, z of the numbers between ``point [`` and ``]``."""
    block = F.regexp_extract("text", r"(?s)point\s*\[(.*?)\]", 1)
    return _files(spark, path).filter(F.length(block) > 0).select("file", F.inline(_triples(block)))


def vrml_coloured(spark: SparkSession, path: str) -> DataFrame:
    """file, pt_idx, x, y, z, r, g, b: the points zipped by position with the triples between ``color [`` and ``]``."""
    colour = F.regexp_extract("text", r"(?s)color\s*\[(.*?)\]", 1)
    shades = _files(spark, path).filter(F.length(colour) > 0).select("file", F.inline(_triples(colour))).toDF("file", "pt_idx", "r", "g", "b")
    return vrml_points(spark, path).join(shades, ["file", "pt_idx"], "left")


def pcd_points(spark: SparkSession, path: str) -> DataFrame:
    """file, pt_idx, x, y, z of ascii PCD files: what follows the DATA line, three numbers a line, nan as missing."""
    body = F.regexp_extract("text", r"(?s)DATA ascii\s*\n(.*)", 1)
    lines = F.filter(F.split(body, "\n"), lambda v: F.length(F.trim(v)) > 0)
    parts = _files(spark, path).select("file", F.posexplode(lines).alias("pt_idx", "line")).select("file", "pt_idx", F.split(F.trim("line"), r"\s+").alias("p"))
    number = lambda k: F.when(F.lower(F.col("p")[k]) != "nan", F.col("p")[k].cast("double"))
    return parts.select("file", "pt_idx", *(number(k).alias(a) for k, a in enumerate("xyz")))


def obj_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices (file, id, x, y, z), normals (same) and directed edges (file, src, dst) of OBJ files with v//n or plain triangles."""
    lines = _files(spark, path).select("file", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    parts = lines.select("file", "line_no", F.split(F.trim("line"), r"\s+").alias("p"))

    def kind(tag: str) -> DataFrame:
        from pyspark.sql import Window

        own = parts.filter(F.col("p")[0] == tag)
        number = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
        return own.select("file", number.cast("long").alias("id"), *(F.col("p")[k + 1].cast("double").alias(a) for k, a in enumerate("xyz")))

    faces = parts.filter(F.col("p")[0] == "f").select("file", *(F.split(F.col("p")[k], "/")[0].cast("long").alias(n) for k, n in ((1, "a"), (2, "b"), (3, "c"))))
    pairs = [F.struct(F.col(s).alias("src"), F.col(d).alias("dst")) for s, d in ("ab", "ba", "bc", "cb", "ac", "ca")]
    return kind("v"), kind("vn"), faces.select("file", F.inline(F.array(*pairs))).distinct()


def stamped_list(spark: SparkSession, path: str) -> DataFrame:
    """file, ts, values of lines ``stamp value ...`` (spaces, commas or tabs), comments left out; of equal stamps the last line holds."""
    from .splits import ordered_lines

    lines = ordered_lines(spark, path).select("file", F.struct("_block", "_no").alias("no"), F.trim(F.regexp_replace("line", r"[,\t\r]", " ")).alias("line"))
    lines = lines.filter((F.length("line") > 0) & ~F.col("line").startswith("#")).select("file", "no", F.split("line", r"\s+").alias("p")).filter(F.size("p") > 1)
    return lines.select("file", "no", F.col("p")[0].cast("double").alias("ts"), F.slice("p", F.lit(2), F.size("p") - 1).alias("values")).groupBy("file", "ts").agg(F.max_by("values", "no").alias("values"))


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """file, ts, tx, ty, tz, qx, qy, qz, qw without zero quaternions and rows with nan."""
    names = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
    rows = stamped_list(spark, path).select("file", "ts", *(F.get("values", F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)))
    good = F.lit(True)
    for n in names:
        good = good & F.col(n).isNotNull() & ~F.isnan(n)
    return rows.filter(good & ((F.col("qx") != 0) | (F.col("qy") != 0) | (F.col("qz") != 0) | (F.col("qw") != 0)))


def associations(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """ts, rgb, ts_depth, depth of association files; ``skip`` frames are left out after each one kept."""
    from pyspark.sql import Window

    rows = stamped_list(spark, path).select("file", "ts", F.get("values", F.lit(0)).alias("rgb"), F.get("values", F.lit(1)).cast("double").alias("ts_depth"), F.get("values", F.lit(2)).alias("depth"))
    no = F.row_number().over(Window.partitionBy("file").orderBy("ts")) - 1
    return rows.withColumn("no", no).filter(F.col("no") % (skip + 1) == 0).drop("no")


def laser_points(scans: DataFrame, by: tuple[str, ...], offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Points of laser scans (angle_min, angle_increment, range_min, range_max, ranges) in the carrier's frame, valid ranges only."""
    out = scans.select(*by, "angle_min", "angle_increment", "range_min", "range_max", F.posexplode("ranges").alias("pt_idx", "r"))
    out = out.filter((F.col("r") >= F.col("range_min")) & (F.col("r") < F.col("range_max")) & (F.col("r") > 0.3) & (F.col("r") < 20))
    a = F.col("angle_min") + F.col("pt_idx") * F.col("angle_increment")
    x, y, turn = offset
    return out.select(*by, "pt_idx", (x + F.col("r") * F.cos(a + turn)).alias("x"), (y + F.col("r") * F.sin(a + turn)).alias("y"), F.lit(0.0).alias("z"))


#: A binary map: tag, cell size and one record per cell; little-endian doubles and longs.
_TAG, _CELL = b"CELLMAP1", "<3i q 9d"
_MAP = "file string, ix int, iy int, iz int, n long, mx double, my double, mz double, cxx double, cxy double, cxz double, cyy double, cyz double, czz double"


def cell_maps(spark: SparkSession, path: str) -> DataFrame:
    """Cells of binary map files."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in _MAP.split(", ")]
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                if data[: len(_TAG)] != _TAG:
                    raise ValueError(f"{file} is no cell map")
                yield pd.DataFrame([(file, *record) for record in struct.iter_unpack(_CELL, data[len(_TAG) :])], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _MAP)


def cell_map_bytes(cells) -> bytes:
    """A binary map of cell rows (ix, iy, iz, n, means, covariances)."""
    return _TAG + b"".join(struct.pack(_CELL, *row) for row in cells)


def tiles_around(tiles: DataFrame, tx: int, ty: int, reach: int = 1) -> DataFrame:
    """Rows of the (2 reach + 1)^2 tiles around one; on a table partitioned by tile_x, tile_y that prunes partitions."""
    return tiles.filter(F.col("tile_x").between(tx - reach, tx + reach) & F.col("tile_y").between(ty - reach, ty + reach))


def camera_tables(cameras: DataFrame, by: str, width: int, height: int, rounds: int = 5) -> DataFrame:
    """by, u, v, x, y of every pixel of every camera (by, fx, fy, cx, cy, k1, k2): the viewing direction at depth 1 with radial distortion taken out by
    fixed-point rounds."""
    pixel = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("_p")
    out = cameras.select(by, "fx", "fy", "cx", "cy", "k1", "k2", pixel).withColumns({"u": (F.col("_p") % width).cast("int"), "v": F.floor(F.col("_p") / width).cast("int")})
    out = out.withColumns({"x0": (F.col("u") - F.col("cx")) / F.col("fx"), "y0": (F.col("v") - F.col("cy")) / F.col("fy")}).withColumns({"x": F.col("x0"), "y": F.col("y0")})
    for _ in range(rounds):
        out = out.withColumn("_r", F.col("x") * F.col("x") + F.col("y") * F.col("y")).withColumn("_f", 1 + F.col("k1") * F.col("_r") + F.col("k2") * F.col("_r") * F.col("_r"))
        out = out.withColumns({"x": F.col("x0") / F.col("_f"), "y": F.col("y0") / F.col("_f")})
    return out.select(by, "u", "v", "x", "y")


def camera_table(spark: SparkSession, width: int, height: int, fx: float, fy: float, cx: float, cy: float, k1: float = 0.0, k2: float = 0.0, rounds: int = 5) -> DataFrame:
    """u, v, x, y of one camera; see ``camera_tables``."""
    one = spark.range(1).select(F.col("id").alias("camera"), *(F.lit(float(v)).alias(n) for n, v in zip(("fx", "fy", "cx", "cy", "k1", "k2"), (fx, fy, cx, cy, k1, k2))))
    return camera_tables(one, "camera", width, height, rounds).drop("camera")
