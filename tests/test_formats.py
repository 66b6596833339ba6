"""Readers and the streaming gate."""

from __future__ import annotations

from cairnmap.plans import files
from cairnmap.sources import readers, writers


def test_pcd(spark, tmp_path):
    (tmp_path / "a.pcd").write_text("# .PCD v.7\nVERSION .7\nPOINTS 2\nDATA ascii\n1 2 3\nnan 5 6\n")
    rows = readers.pcd_points(spark, str(tmp_path)).orderBy("pt_idx").collect()
    assert [(r["x"], r["y"], r["z"]) for r in rows] == [(1.0, 2.0, 3.0), (None, 5.0, 6.0)]


def test_obj(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nvn 0 0 1\nf 1//1 2//1 3//1\n")
    v, n, e = readers.obj_mesh(spark, str(tmp_path))
    assert (v.count(), n.count(), e.count()) == (3, 1, 6)


def test_trajectory(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# c\n1 0 0 0 0 0 0 1\n2 0 0 0 0 0 0 0\n3 nan 0 0 0 0 0 1\n4,1,1,1,0,0,0,1\n")
    assert [r["ts"] for r in readers.trajectory(spark, str(tmp_path)).orderBy("ts").collect()] == [1.0, 4.0]


def test_binary_map_round_trip(spark, tmp_path):
    row = (1, -2, 3, 9, *[0.5 * k for k in range(9)])
    (tmp_path / "m.bin").write_bytes(readers.cell_map_bytes([row]))
    assert tuple(readers.cell_maps(spark, str(tmp_path)).drop("file").first()) == row


def test_vrml_round_trip(spark, tmp_path):
    points = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0), ("a", 1, 4.0, 5.0, 6.0)], "scan string, pt_idx int, x double, y double, z double")
    lines = [r["line"] for r in writers.vrml_lines(points, "scan").orderBy("pt_idx").collect()]
    (tmp_path / "a.wrl").write_text("Shape { point [\n" + "\n".join(lines) + "\n] }")
    assert [tuple(r)[2:] for r in readers.vrml_points(spark, str(tmp_path)).orderBy("pt_idx").collect()] == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]


#: Numbers whose seventh decimal is an exact 5, or looks like one in decimals only.
TIES = [0.0078125, -0.0078125, 0.0234375, 1.5e-06, 2.5e-06, 0.5, -0.0, 123456.0000005]


def test_lines_round_as_printf(spark):
    own = spark.createDataFrame([(k, x, -x, 2 * x, x) for k, x in enumerate(TIES)], "pid long, x double, y double, a double, p double")
    got = {r["pid"]: r["line"] for r in writers.particle_lines(own).collect()}
    assert got == {k: "%.6f %.6f %.6f %.6f" % (x, -x, 2 * x, x) for k, x in enumerate(TIES)}


def cloud_of_ties(spark, folder):
    rows = [(k, [TIES[(k + n) % len(TIES)] for n in range(64)], k % 2) for k in range(8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return {(k % 2, k // 2 * 21 + m): tuple(round(float("%.6f" % TIES[(k + 3 * m + n) % len(TIES)]), 6) + 0.0 for n in range(3)) for k in range(8) for m in range(21)}


def test_pcd_files_round_as_printf(spark, tmp_path):
    want = cloud_of_ties(spark, tmp_path)
    assert {(r["scan_id"], r["pt_idx"]): (r["x"], r["y"], r["z"]) for r in files.pcd_points(spark, str(tmp_path)).collect()} == want


def test_coloured_files_round_as_printf(spark, tmp_path):
    want = cloud_of_ties(spark, tmp_path)
    rows = files.vrml_coloured_points(spark, str(tmp_path)).collect()
    assert {(r["scan_id"], r["pt_idx"]): (r["x"], r["y"], r["z"]) for r in rows} == want
    assert {(r["scan_id"], r["pt_idx"]): (r["r"], r["g"], r["b"]) for r in rows} == {k: tuple(map(abs, v)) for k, v in want.items()}


def test_vrml_files_round_as_printf(spark, tmp_path):
    want = cloud_of_ties(spark, tmp_path)
    assert {(r["scan_id"], r["pt_idx"]): (r["x"], r["y"], r["z"]) for r in files.vrml_points(spark, str(tmp_path)).collect()} == want
