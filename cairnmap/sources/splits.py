"""Large files in several partitions: lines in file order without whole files, and cell maps by ranges of records.

Text comes from Spark's line reader, which cuts files into blocks; a line's place is (file, block, number within the block). What depends on the
lines before it (an open block of points, a position) is settled from one small row for each marker or block, so no file is ever one row or one task.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import maps

NUMBER = r"[-+]?(?:[0-9]*\.[0-9]+|[0-9]+\.?)(?:[eE][-+]?[0-9]+)?"
_PLACE = ("_block", "_no")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, _block, _no, line of text files: (_block, _no) ascends through a file. Blocks are as long as the session's
    ``spark.sql.files.maxPartitionBytes`` at most; a line is in the block that it begins in."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_no"), F.col("value").alias("line"))
    return rows


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows of ordered lines with their position in their file, from 0: counts by block are summed up, and each block numbers its own."""
    per = rows.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = per.select("file", "_block", (F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")).alias("_before"))
    own = rows.withColumn("_in", F.row_number().over(Window.partitionBy("file", "_block").orderBy("_no")) - 1)
    return own.join(before, ["file", "_block"]).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_before", "_in")


def between_marks(lines: DataFrame, opens: str, closes: str) -> DataFrame:
    """The lines of every file's first stretch from one that matches ``opens`` to the next that matches ``closes``, these two included, as far as
    there is one; without the closing line, the rest. One row a file is joined back."""
    at = F.struct(*_PLACE)
    first = lines.filter(F.col("line").rlike(opens)).groupBy("file").agg(F.min(at).alias("_from"))
    last = lines.join(first, "file").filter((at >= F.col("_from")) & F.col("line").rlike(closes)).groupBy("file").agg(F.min(at).alias("_to"))
    return lines.join(first.join(last, "file", "left"), "file").filter((at >= F.col("_from")) & (F.col("_to").isNull() | (at <= F.col("_to"))))


def _triples(lines: DataFrame, opens: str, names: tuple[str, str, str]) -> DataFrame:
    """file, pt_idx and three numbers of the lines between ``opens`` and a closing bracket; several triples on a line may be parted by commas."""
    own = between_marks(lines, opens, r"\]")
    text = F.when((F.col("_block") == F.col("_from._block")) & (F.col("_no") == F.col("_from._no")), F.regexp_replace("line", rf"^.*?{opens}", "")).otherwise(F.col("line"))
    parts = own.select("file", *_PLACE, F.posexplode(F.split(F.regexp_replace(text, r"\].*$", ""), ",")).alias("_k", "_t"))
    parts = parts.select("file", "_block", F.struct("_no", "_k").alias("_no"), F.split(F.trim("_t"), r"\s+").alias("_p"))
    number = rf"(?i)^(?:{NUMBER}|nan)$"
    parts = parts.filter((F.size("_p") >= 3) & F.forall(F.slice("_p", 1, 3), lambda v: v.rlike(number)))
    value = lambda k: F.when(F.lower(F.col("_p")[k]) != "nan", F.col("_p")[k].cast("double"))
    return numbered(parts, "pt_idx").select("file", F.col("pt_idx").cast("int").alias("pt_idx"), *(value(k).alias(n) for k, n in enumerate(names)))


def vrml_cloud(spark: SparkSession, path: str) -> DataFrame:
    """file, pt_idx, x, y, z of the numbers between ``point [`` and ``]``; nan is missing, other lines are passed over."""
    return _triples(ordered_lines(spark, path), r"point\s*\[", ("x", "y", "z"))


def vrml_shades(spark: SparkSession, path: str) -> DataFrame:
    """file, pt_idx, x, y, z, r, g, b: points with the triples between ``color [`` and ``]`` of equal position; null shades where there are none."""
    return vrml_cloud(spark, path).join(_triples(ordered_lines(spark, path), r"color\s*\[", ("r", "g", "b")), ["file", "pt_idx"], "left")


def pcd_cloud(spark: SparkSession, path: str) -> DataFrame:
    """file, pt_idx, x, y, z of ascii PCD files: what follows the DATA line, three numbers a line, nan as missing."""
    lines = ordered_lines(spark, path).filter(F.length(F.trim("line")) > 0)
    body = between_marks(lines, r"^DATA ascii", r"(?!)").filter(~((F.col("_block") == F.col("_from._block")) & (F.col("_no") == F.col("_from._no"))))
    p = F.split(F.trim("line"), r"\s+")
    value = lambda k: F.when(F.lower(F.get(p, F.lit(k))) != "nan", F.get(p, F.lit(k)).try_cast("double"))
    return numbered(body, "pt_idx").select("file", F.col("pt_idx").cast("int").alias("pt_idx"), *(value(k).alias(a) for k, a in enumerate("xyz")))


@dataclass
class _Range(InputPartition):
    file: str
    first: int
    count: int
    grid: tuple


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


class CellMapSource(DataSource):
    """Cell maps of version 0.50 as a data source: ``spark.read.format("cell_map").load(path)`` plans ranges of ``records`` records a partition, over a
    file, a folder or a pattern; a schema given with ``.schema()`` reads those columns only. Writing takes rows (file, content) of
    ``maps.map_contents`` and puts each in place under its name once it is whole. Paths are those of a file system that all executors mount; for other
    stores ``maps.map_cells`` reads a file a row. Options: ``prototype`` bytes, ``records``."""

    @classmethod
    def name(cls) -> str:
        return "cell_map"

    def schema(self) -> str:
        return "file string, " + maps._SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MapReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _MapWriter(_local(self.options["path"]))


class _MapReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path = schema.fieldNames(), _local(options["path"])
        self.prototype, self.records = int(options.get("prototype", maps.PROTOTYPE)), int(options.get("records", 100_000))

    def partitions(self) -> list[InputPartition]:
        files = sorted(f for f in (glob.glob(f"{self.path}/*") if os.path.isdir(self.path) else glob.glob(self.path)) if os.path.isfile(f) and not os.path.basename(f).startswith((".", "_")))
        out = []
        for file in files:
            with open(file, "rb") as f:
                _, header, at = maps._opened(f.read(len(maps.TAG) + 4 + 8 * len(maps.HEADER)), file)
            total = max(0, os.path.getsize(file) - at - self.prototype) // maps.RECORD.itemsize
            out += [_Range(file, at + self.prototype + n * maps.RECORD.itemsize, min(self.records, total - n), tuple(header.tolist())) for n in range(0, total, self.records)]
        return out or [_Range("", 0, 0, ())]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        with open(part.file, "rb") as f:
            f.seek(part.first)
            rows = np.frombuffer(f.read(part.count * maps.RECORD.itemsize), maps.RECORD)
        if part.grid:
            header = np.array(part.grid)
            off = np.abs(rows["center"][:, :3] - header[6:9]) - header[:3] / 2
            rows = rows[(off <= header[3:6] / 2).all(1)]
        fields = {name: (field, k) for name, field, k in maps.FIELDS}
        arrays = []
        for name in self.names:
            if name == "file":
                arrays.append(pa.array([part.file] * len(rows), pa.string()))
                continue
            field, k = fields[name]
            values = rows[field] if k is None else rows[field][:, k]
            arrays.append(pa.array(values != 0 if name == "gaussian" else values.astype(maps._kind(name).to_pandas_dtype())))
        for start in range(0, len(rows), 10_000):
            yield pa.record_batch([a.slice(start, 10_000) for a in arrays], names=self.names)


class _MapWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            part = f"{self.path}/.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(bytes(row["content"]))
            os.replace(part, f"{self.path}/{row['file']}")
        return WriterCommitMessage()


def registered(spark: SparkSession) -> SparkSession:
    """The session with the data source ``cell_map``."""
    spark.dataSource.register(CellMapSource)
    return spark
