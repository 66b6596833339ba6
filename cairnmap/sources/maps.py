"""Map and volume files in the surveyed layouts: binary cell maps of version 0.50 and image-data volumes as XML text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: tag, kinds of index, header of a grid, one cell's record (little-endian, packed).
TAG = b"#JFF V0.50"
VECTOR, TREE, GRID = 1, 2, 3
HEADER = ("size_x", "size_y", "size_z", "cell_x", "cell_y", "cell_z", "center_x", "center_y", "center_z")
#: Bytes of the dumped prototype cell between header and records on 64-bit builds; read over, written as zeros.
PROTOTYPE = 64
RECORD = np.dtype([
    ("center", "<f4", 4), ("size", "<f8", 3), ("cov", "<f8", 6), ("mean", "<f8", 3), ("d1", "<f8"), ("d2", "<f8"), ("n", "<i4"), ("empty", "<i4"),
    ("gaussian", "<i4"), ("r", "<f4"), ("g", "<f4"), ("b", "<f4"), ("occ", "<f4"), ("occval", "u1"), ("exit_a", "<f4"), ("exit_b", "<f4"), ("entry_a", "<f4"),
    ("entry_b", "<f4"), ("events", "<u8")])
#: Columns of a cell by field and place in it.
FIELDS = (
    [(f"c{a}", "center", k) for k, a in enumerate("xyz")] + [(f"s{a}", "size", k) for k, a in enumerate("xyz")] + [("c" + a, "cov", k) for k, a in enumerate(("xx", "xy", "xz", "yy", "yz", "zz"))]
    + [(f"m{a}", "mean", k) for k, a in enumerate("xyz")] + [(f, f, None) for f in ("d1", "d2", "n", "empty", "gaussian", "r", "g", "b", "occ", "occval", "exit_a", "exit_b", "entry_a", "entry_b", "events")])
_KINDS = {"n": ("int", pa.int32()), "empty": ("int", pa.int32()), "gaussian": ("boolean", pa.bool_()), "occval": ("int", pa.int32()), "events": ("long", pa.int64())}
_SCHEMA = ", ".join(f"{c} {_KINDS.get(c, ('double', None))[0]}" for c, _, _ in FIELDS)


def _kind(column: str) -> pa.DataType:
    return _KINDS.get(column, (None, pa.float64()))[1]


def _opened(data: bytes, file: str) -> tuple[int, np.ndarray, int]:
    """Kind of index, grid header (empty for others) and the first record's place."""
    if data[: len(TAG)] != TAG:
        raise ValueError(f"{file} is no cell map of version 0.50")
    kind = int(np.frombuffer(data, "<i4", 1, len(TAG))[0])
    if kind not in (VECTOR, GRID):
        raise ValueError(f"{file} has an index of kind {kind}; cells are written for kinds {VECTOR} and {GRID} only")
    at = len(TAG) + 4
    header = np.frombuffer(data, "<f8", len(HEADER), at) if kind == GRID else np.zeros(0)
    return kind, header, at + 8 * len(header)


def map_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, kind and the grid's extent (nulls for cell vectors) of map files: the header's bytes only are kept."""
    schema = "file string, kind int, " + ", ".join(f"{c} double" for c in HEADER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                kind, header, _ = _opened(data.as_buffer().to_pybytes(), file)
                values = header.tolist() or [None] * len(HEADER)
                yield pa.record_batch([pa.array([file]), pa.array([kind], pa.int32()), *(pa.array([v], pa.float64()) for v in values)], names=["file", "kind", *HEADER])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def map_cells(spark: SparkSession, path: str, prototype: int = PROTOTYPE) -> DataFrame:
    """file and the cells of map files, kinds grid and vector; cells of a grid whose centre lies outside its extent are left out.

    The layout dumps a cell of the writer's build, so ``prototype`` may differ. A file is one task's row; a rest shorter than a record ends it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = data.as_buffer().to_pybytes()
                _, header, at = _opened(content, file)
                at += prototype
                rows = np.frombuffer(content, RECORD, max(0, len(content) - at) // RECORD.itemsize, at)
                if len(header):
                    off = np.abs(rows["center"][:, :3] - header[6:9]) - header[:3] / 2
                    rows = rows[(off <= header[3:6] / 2).all(1)]
                columns = [rows[f] if k is None else rows[f][:, k] for _, f, k in FIELDS]
                arrays = [pa.array(c != 0 if name == "gaussian" else c.astype(_kind(name).to_pandas_dtype())) for (name, _, _), c in zip(FIELDS, columns)]
                yield pa.record_batch([pa.array([file] * len(rows), pa.string()), *arrays], names=["file", *(c for c, _, _ in FIELDS)])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, " + _SCHEMA)


def map_contents(cells: DataFrame, by: str, grid: tuple[float, ...] | None = None, prototype: int = PROTOTYPE) -> DataFrame:
    """by, content: the file of each map. With ``grid``, its nine header values, all cells go out; without, as a vector, those with a Gaussian.

    A map is one file and so one task's group; large maps are cut to tiles first.
    """
    kind = dict(cells.dtypes)[by]
    head = TAG + np.int32(GRID if grid else VECTOR).tobytes() + (np.array(grid, "<f8").tobytes() if grid else b"") + bytes(prototype)
    names = [c for c, _, _ in FIELDS]

    def run(key, group):
        rows = np.zeros(group.num_rows, RECORD)
        for name, field, k in FIELDS:
            value = group[name].to_numpy()
            if k is None:
                rows[field] = value
            else:
                rows[field][:, k] = value
        return pa.table({by: pa.array([key[0].as_py()], group.schema.field(by).type), "content": pa.array([head + rows.tobytes()], pa.binary())})

    kept = cells if grid else cells.filter("gaussian")
    return kept.select(by, *names).groupBy(by).applyInArrow(run, f"`{by}` {kind}, content binary")


def full_cells(cells: DataFrame, size: float) -> DataFrame:
    """Engine cells (ix, iy, iz, n, means, covariances) with every field of the file's record; what is unknown is 0."""
    keys = dict(zip("xyz", ("ix", "iy", "iz")))
    own = {f"c{a}": F.col(k) * size for a, k in keys.items()} | {f"s{a}": F.lit(size) for a in "xyz"} | {"gaussian": F.col("cxx").isNotNull(), "n": F.col("n").cast("int")}
    for name, _, _ in FIELDS:
        if name not in own and name not in cells.columns:
            own[name] = F.lit(0).cast(_KINDS.get(name, ("double",))[0])
    return cells.withColumns(own)


def volume_lines(voxels: DataFrame, dims: tuple[int, int, int], size: float) -> DataFrame:
    """ord, line: an image-data XML file of a volume (i, j, k, d, w); values by place, x fastest, missing voxels with weight 0."""
    nx, ny, nz = dims
    place = F.col("i") + nx * (F.col("j") + ny * F.col("k")).cast("long")
    spark, total = voxels.sparkSession, nx * ny * nz
    values = spark.range(total).withColumnRenamed("id", "at").join(voxels.select(place.alias("at"), "d", "w"), "at", "left")
    extent = f"0 {nx - 1} 0 {ny - 1} 0 {nz - 1}"
    origin = " ".join(str(-size * n / 2) for n in dims)
    texts = {
        -1: f'<?xml version="1.0"?>\n<VTKFile type="ImageData" version="0.1" byte_order="LittleEndian">\n<ImageData WholeExtent="{extent}" Origin="{origin}" Spacing="{size} {size} {size}">\n<Piece Extent="{extent}">\n<PointData>\n<DataArray type="Float32" Name="Distance" format="ascii">',
        total: '</DataArray>\n<DataArray type="Float32" Name="Weight" format="ascii">',
        2 * total + 1: "</DataArray>\n</PointData>\n</Piece>\n</ImageData>\n</VTKFile>"}
    frame = spark.createDataFrame(list(texts.items()), "ord long, line string")
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("float").cast("string")
    return frame.unionByName(values.select(F.col("at").alias("ord"), number("d").alias("line"))).unionByName(values.select((total + 1 + F.col("at")).alias("ord"), number("w").alias("line")))


def volumes(spark: SparkSession, path: str) -> DataFrame:
    """file, size, i, j, k, d, w of ascii image-data XML files with the arrays Distance and Weight; voxels of weight 0 are left out."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("t"))
    extent = F.split(F.regexp_extract("t", r'WholeExtent="([^"]*)"', 1), r"\s+")
    found = lambda name: F.split(F.regexp_extract("t", rf'(?s)<DataArray[^>]*Name="{name}"[^>]*>\s*(.*?)\s*</DataArray>', 1), r"\s+")
    held = text.select("file", F.split(F.regexp_extract("t", r'Spacing="([^"]*)"', 1), r"\s+")[0].cast("double").alias("size"), (extent[1].cast("long") + 1).alias("nx"), (extent[3].cast("long") + 1).alias("ny"), F.posexplode(F.arrays_zip(found("Distance").alias("d"), found("Weight").alias("w"))).alias("at", "v"))
    keys = [F.col("at") % F.col("nx"), F.floor(F.col("at") / F.col("nx")) % F.col("ny"), F.floor(F.col("at") / (F.col("nx") * F.col("ny")))]
    return held.select("file", "size", *(k.cast("int").alias(a) for k, a in zip(keys, "ijk")), F.col("v.d").cast("double").alias("d"), F.col("v.w").cast("double").alias("w")).filter("w > 0")


def occupancy_raster(spark: SparkSession, path: str, below: int = 125) -> DataFrame:
    """file, i, j, occ of image files (rows i, columns j): occupied where the grey value is below a threshold."""
    schema = "file string, i int, j int, occ boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shape = (row["height"], row["width"], row["nChannels"])
                pixels = np.frombuffer(row["data"], np.uint8).reshape(shape)
                grey = pixels[:, :, 0].astype(float) if shape[2] == 1 else pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])  # channels are blue, green, red
                i, j = np.indices(shape[:2])
                yield pa.record_batch([pa.array([row["origin"]] * grey.size, pa.string()), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array((grey < below).ravel())], names=["file", "i", "j", "occ"])

    return spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, schema)


def path_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Settings (file, image, center_x, center_y, res_x, res_y, length, width) and path points (file, seq, x, y, a, v, w) of polygon
    configurations: a line with the image's path, one with its frame, one with the vehicle's extent, then a point a line."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("l"))
    part = lambda k: F.split(F.trim(F.col("l")[k]), r"\s+")
    named = lambda k, names: [part(k)[n].cast("double").alias(c) for n, c in enumerate(names)]
    settings = lines.select("file", F.trim(F.col("l")[0]).alias("image"), *named(1, ("center_x", "center_y", "res_x", "res_y")), *named(2, ("length", "width")))
    points = lines.select("file", F.posexplode("l").alias("no", "line")).filter((F.col("no") > 2) & (F.length(F.trim("line")) > 0))
    p = F.split(F.trim("line"), r"\s+")
    return settings, points.select("file", (F.col("no") - 3).alias("seq"), *(F.get(p, F.lit(n)).cast("double").alias(c) for n, c in enumerate(("x", "y", "a", "v", "w"))))
