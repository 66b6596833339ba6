"""Files in the surveyed layouts, replays, draws."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from cairnmap.operators import particles as P
from cairnmap.sources import maps, writers
from cairnmap.streaming import logs


def cells(spark):
    rows = [("a", k, -k, 2, 10 + k, 0.4 * k, -0.4 * k, 0.8, 0.04, 0.001, 0.0, 0.03, 0.0, 0.02 + k / 100) for k in range(3)]
    return spark.createDataFrame(rows, "m string, ix int, iy int, iz int, n long, mx double, my double, mz double, cxx double, cxy double, cxz double, cyy double, cyz double, czz double")


def test_map_files(spark, tmp_path):
    full = maps.full_cells(cells(spark), 0.4).withColumn("gaussian", F.col("ix") < 2).withColumn("events", F.lit(77).cast("long"))
    grid = (10.0, 10.0, 10.0, 0.4, 0.4, 0.4, 0.0, 0.0, 0.0)
    for name, header, kept, kind in (("grid", grid, 3, 3), ("vector", None, 2, 1)):
        content = bytes(maps.map_contents(full, "m", header).first()["content"])
        assert content[:10] == b"#JFF V0.50" and struct.unpack_from("<i", content, 10) == (kind,)
        assert len(content) == 14 + (72 if header else 0) + 64 + kept * 181
        (tmp_path / name).write_bytes(content)
        got = maps.map_cells(spark, str(tmp_path / name)).orderBy("n").collect()
        assert [r["n"] for r in got] == [10, 11, 12][:kept] and got[1]["mx"] == 0.4 and got[1]["czz"] == 0.03 and got[0]["events"] == 77
        assert abs(got[1]["cx"] - 0.4) < 1e-6 and [r["gaussian"] for r in got] == [True, True, False][:kept]
    assert maps.map_headers(spark, str(tmp_path / "grid")).first()["cell_x"] == 0.4
    far = maps.map_contents(full.withColumn("cx", F.lit(99.0)), "m", grid).first()["content"]
    (tmp_path / "far").write_bytes(bytes(far))
    assert maps.map_cells(spark, str(tmp_path / "far")).count() == 0


def test_volume_round_trip(spark, tmp_path):
    voxels = spark.createDataFrame([(0, 0, 0, 0.25, 1.0), (2, 1, 1, -0.5, 3.0), (1, 0, 1, 0.125, 2.0)], "i int, j int, k int, d double, w double")
    lines = [r["line"] for r in maps.volume_lines(voxels, (3, 2, 2), 0.1).orderBy("ord").collect()]
    (tmp_path / "v.vti").write_text("\n".join(lines))
    got = maps.volumes(spark, str(tmp_path)).select("i", "j", "k", "d", "w", "size")
    assert sorted(map(tuple, got.collect())) == sorted((*r, 0.1) for r in map(tuple, voxels.collect()))


def test_config(spark, tmp_path):
    (tmp_path / "c.txt").write_text("map.png\n1 2 0.1 0.1\n2.5 1.5\n0 1 0.5 1 0\n3 4 0.6 1 0\n")
    settings, points = maps.path_config(spark, str(tmp_path))
    assert tuple(settings.first())[1:] == ("map.png", 1.0, 2.0, 0.1, 0.1, 2.5, 1.5)
    assert [tuple(r)[1:4] for r in points.orderBy("seq").collect()] == [(0, 0.0, 1.0), (1, 3.0, 4.0)]


def test_raster(spark, tmp_path):
    import zlib

    pixels = np.array([[0, 200, 124], [125, 255, 10]], np.uint8)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in pixels))) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    got = {(r["i"], r["j"]): r["occ"] for r in maps.occupancy_raster(spark, str(tmp_path)).collect()}
    assert got == {(i, j): bool(pixels[i, j] < 125) for i in range(2) for j in range(3)}


def test_ellipsoids(spark):
    lines = [r["line"] for r in writers.ellipsoid_lines(cells(spark), "m").collect()]
    assert len(lines) == 3 and all(x.count("{") == x.count("}") and "diffuseColor" in x for x in lines)


def test_replay_is_logged(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).withColumn("scan", F.lit(k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = logs.replayed(spark, str(tmp_path / "in"), "id long, scan int")
    logs.logged(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ("scan",)).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("scan").count().orderBy("scan").collect() == [(0, 10), (1, 10), (2, 10)]


def test_draws_and_sizes(spark):
    rows = spark.range(4000).select("id", *(F.lit(v).alias(c) for c, v in (("a", 1.0), ("b", 2.0), ("c", 3.0), ("xx", 4.0), ("xy", 1.0), ("xz", 0.0), ("yy", 1.0), ("yz", 0.2), ("zz", 0.5))))
    got = np.array(P.drawn(rows, ("a", "b", "c"), ("xx", "xy", "xz", "yy", "yz", "zz"), ("x", "y", "z"), 5).select("x", "y", "z").collect())
    assert np.abs(got.mean(0) - [1, 2, 3]).max() < 0.15 and np.abs(np.cov(got.T) - [[4, 1, 0], [1, 1, 0.2], [0, 0.2, 0.5]]).max() < 0.3
    few = spark.createDataFrame([(0, 0.1, 1.0), (1, 0.4, 1.0), (2, 0.4, 1.0), (3, 0.1, 1.0)], "pid long, p double, lik double")
    assert [tuple(r) for r in P.resized(few, 2).select("pid", "p").orderBy("pid").collect()] == [(1, 0.5), (2, 0.5)]
    given = P.injected(few, spark.createDataFrame([(2, 9.0)], "pid long, lik double"))
    assert {r["pid"]: r["lik"] for r in given.collect()} == {0: 1.0, 1: 1.0, 2: 9.0, 3: 1.0}
