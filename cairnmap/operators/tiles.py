"""A map of cells in tiles on shared storage: touched tiles are written anew, a manifest switches to them at once.

Folder layout: ``cells/<version>/tx=../ty=..`` holds the tiles that a version wrote, ``manifest/<version>`` a row for every tile with the
version that holds it. A version counts from the moment its manifest's success mark is there; a step that dies before leaves the map
as it was. Cells belong to the tile of their key, so a cell never changes its tile. What the driver holds is the manifest: a row for each tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TileMap:
    """The tiles of a map at ``path``; opening it takes the newest version. ``span``: cells along a tile's side."""

    def __init__(self, spark: SparkSession, path: str, span: int):
        self.spark, self.path, self.span = spark, path, span
        self.version, self.tiles, self.schema = 0, {}, None
        done = [v for v in self._versions("manifest") if self._exists(f"manifest/{v:08d}/_SUCCESS")]
        if done:
            self.version = max(done)
            rows = spark.read.schema("tx int, ty int, version int").json(f"{path}/manifest/{self.version:08d}").collect()
            self.tiles = {(r["tx"], r["ty"]): r["version"] for r in rows}
            self.schema = self._load(sorted(self.tiles)[:1]).schema if rows else None

    def _fs(self, place: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, place: str) -> bool:
        fs, path = self._fs(place)
        return fs.exists(path)

    def _versions(self, place: str) -> list[int]:
        fs, path = self._fs(place)
        return [int(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []

    def tile_of(self, cells: DataFrame) -> DataFrame:
        return cells.withColumns({"t" + a: F.floor(F.col("i" + a) / self.span).cast("int") for a in "xy"})

    def around(self, low: tuple[int, int], high: tuple[int, int]) -> list[tuple[int, int]]:
        """The map's tiles that hold cells of keys from ``low`` to ``high`` (ix, iy)."""
        (x0, y0), (x1, y1) = ((k[0] // self.span, k[1] // self.span) for k in (low, high))
        return [t for t in self.tiles if x0 <= t[0] <= x1 and y0 <= t[1] <= y1]

    def _load(self, tiles: list[tuple[int, int]]) -> DataFrame:
        frames = None
        for version in sorted({self.tiles[t] for t in tiles}):
            folder = f"{self.path}/cells/{version:08d}"
            own = [f"{folder}/tx={x}/ty={y}" for x, y in tiles if self.tiles[x, y] == version]
            reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
            part = reader.option("basePath", folder).parquet(*own).drop("tx", "ty")
            frames = part if frames is None else frames.unionByName(part)
        return frames

    def read(self, tiles: list[tuple[int, int]] | None = None) -> DataFrame | None:
        """The cells of some tiles (all by default); only their files are listed. None where there are none."""
        own = [t for t in (self.tiles if tiles is None else tiles) if t in self.tiles]
        return self._load(own) if own else None

    def replace(self, cells: DataFrame) -> list[tuple[int, int]]:
        """Write the tiles of some cells anew, each from all rows given for it, and switch to them; the other tiles stay. Returns the tiles written."""
        new = self.version + 1
        for place in (f"cells/{new:08d}", f"manifest/{new:08d}"):  # what a step that died has left
            fs, path = self._fs(place)
            fs.delete(path, True)
        self.schema = self.schema or cells.schema
        self.tile_of(cells).repartition("tx", "ty").write.partitionBy("tx", "ty").parquet(f"{self.path}/cells/{new:08d}")
        fs, path = self._fs(f"cells/{new:08d}")
        written = []
        for x in fs.listStatus(path):
            if x.isDirectory():
                written += [(int(x.getPath().getName()[3:]), int(y.getPath().getName()[3:])) for y in fs.listStatus(x.getPath())]
        self.tiles |= dict.fromkeys(written, new)
        rows = [(x, y, v) for (x, y), v in sorted(self.tiles.items())]
        self.spark.createDataFrame(rows, "tx int, ty int, version int").coalesce(1).write.json(f"{self.path}/manifest/{new:08d}")
        self.version = new
        return written

    def prune(self, keep: int = 1) -> None:
        """Delete manifests but the newest ``keep`` and the versions' tiles that the newest manifest does not name. Frames read before are gone then."""
        for v in sorted(self._versions("manifest"))[:-keep]:
            fs, path = self._fs(f"manifest/{v:08d}")
            fs.delete(path, True)
        for v in set(self._versions("cells")):
            fs, path = self._fs(f"cells/{v:08d}")
            if v not in self.tiles.values():
                fs.delete(path, True)


def bucketed(scans: DataFrame, order: str, path: str, columns: tuple[str, ...], parts: int = 8) -> list:
    """Write points by scan, so that a step reads its own scan only, and return the scans' numbers in order. A scan of any size is spread over
    ``parts`` files at most; points with a null number are left out."""
    spread = F.pmod(F.xxhash64(*columns), F.lit(parts))
    own = scans.filter(F.col(order).isNotNull()).select(F.col(order).alias("_order"), *columns)
    own.repartition("_order", spread).write.partitionBy("_order").parquet(path)
    return [r[0] for r in scans.filter(F.col(order).isNotNull()).select(order).distinct().orderBy(order).collect()]
