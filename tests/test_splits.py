"""Large files in several partitions: equal rows whatever the blocks, markers at borders, record ranges."""

from __future__ import annotations

import numpy as np
import pytest

from cairnmap.sources import maps, splits


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_points_of_many_blocks(spark, tmp_path, small_blocks):
    r = np.random.default_rng(1)
    x = r.normal(0, 3, (3000, 3)).round(5)
    line = lambda p: "{} {} {}".format(*p)
    head = "#VRML V2.0 utf8\nShape { geometry PointSet { coord Coordinate { point [ 1 2 3,\n"
    body = head + ",\n".join(map(line, x[:2000])) + ",\nnan 1 2\n# note\n 7 8 9, 4 5 6 ] }\ncolor Color { color [\n" + "\n".join(map(line, np.abs(x[:1500]))) + "\n] }\n 1 1 1\n"
    (tmp_path / "a.wrl").write_text(body)
    (tmp_path / "b.wrl").write_text("point [ 0 0 1, 0 0 2 ]")
    (tmp_path / "c.wrl").write_text("nothing\n1 2 3\n")
    lines = splits.ordered_lines(spark, str(tmp_path))
    assert lines.select("_block").distinct().count() > 8
    want = [(1.0, 2.0, 3.0), *map(tuple, x[:2000].tolist()), (None, 1.0, 2.0), (7.0, 8.0, 9.0), (4.0, 5.0, 6.0)]
    got = {}
    for row in splits.vrml_shades(spark, str(tmp_path)).collect():
        got.setdefault(row.file[-5:], {})[row.pt_idx] = row
    assert set(got) == {"a.wrl", "b.wrl"} and [(got["b.wrl"][k].z, got["b.wrl"][k].r) for k in (0, 1)] == [(1.0, None), (2.0, None)]
    own = got["a.wrl"]
    assert [(own[k].x, own[k].y, own[k].z) for k in range(len(own))] == want
    assert [own[k].g for k in range(1500)] == np.abs(x[:1500, 1]).tolist() and own[1500].g is None
    (tmp_path / "pcd").mkdir()
    (tmp_path / "pcd/a.pcd").write_text("# .PCD\nFIELDS x y z\nDATA ascii\n" + "\n".join(map(line, x)) + "\nnan 5 6\n")
    rows = {p.pt_idx: (p.x, p.y, p.z) for p in splits.pcd_cloud(spark, str(tmp_path / "pcd")).collect()}
    assert [rows[k] for k in range(3001)] == [*map(tuple, x.tolist()), (None, 5.0, 6.0)]


def test_a_large_file_is_read_in_parts(spark, tmp_path):
    """12 MB of points in blocks of 1 MB: as many partitions, no line lost or doubled."""
    n = 400_000
    with open(tmp_path / "big.wrl", "w") as f:
        f.write("point [\n" + "".join(f"{k} {k + 0.5} -{k}.25,\n" for k in range(n)) + "]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        cloud = splits.vrml_cloud(spark, str(tmp_path / "big.wrl"))
        assert splits.ordered_lines(spark, str(tmp_path / "big.wrl")).rdd.getNumPartitions() >= 9
        row = cloud.selectExpr("count(*) as n", "sum(x) as x", "count(distinct pt_idx) as d", "max(pt_idx) as top", "count_if(x = pt_idx and y = x + 0.5 and z = -x - if(x = 0, 0.25, 0.25)) as same").first()
        assert (row.n, row.d, row.top, row.same) == (n, n, n - 1, n) and row.x == n * (n - 1) / 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_cell_maps_by_ranges(spark, tmp_path):
    splits.registered(spark)
    rows = [("a" if k % 3 else "b", k, -k, k % 5, 5 + k, *(0.1 * k + c for c in range(9))) for k in range(200)]
    cells = spark.createDataFrame(rows, "m string, ix int, iy int, iz int, n long, mx double, my double, mz double, cxx double, cxy double, cxz double, cyy double, cyz double, czz double")
    full = maps.full_cells(cells, 0.5)
    for name, grid in (("vector", None), ("grid", (400.0, 400.0, 400.0, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0)), ("few", (40.0, 40.0, 40.0, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0))):
        path = str(tmp_path / name)
        maps.map_contents(full, "m", grid).selectExpr("m as file", "content").write.format("cell_map").mode("append").save(path)
        read = spark.read.format("cell_map").option("records", 17).load(path)
        assert read.rdd.getNumPartitions() == 4 + 8
        whole = maps.map_cells(spark, path)
        tidy = lambda d: sorted(map(tuple, d.drop("file").collect()))
        assert tidy(read) == tidy(whole) and (len(tidy(read)) == 200 or name == "few")
        few = spark.read.format("cell_map").schema("mx double, n int").load(path).filter("n > 100")
        assert sorted(map(tuple, few.collect())) == sorted((r.mx, r.n) for r in whole.collect() if r.n > 100) and few.columns == ["mx", "n"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("cell_map").load(str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").write_bytes(b"something else")
    with pytest.raises(Exception, match="no cell map"):
        spark.read.format("cell_map").load(str(tmp_path / "bad")).count()


def test_one_file_for_each_key(spark, tmp_path):
    """A long part and a short one, both dealt by the key before: their lines meet in one file, heads first, though adaptive execution joins their partitions differently."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from cairnmap.plans.files import written

    tuned = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in tuned}
    for k, v in tuned.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(60_000).select((F.col("id") % 10).cast("int").alias("k"), "id")
        number = F.row_number().over(Window.partitionBy("k").orderBy("id")).cast("long")
        body = rows.select("k", number.alias("ord"), F.concat(F.lit("row "), number, F.repeat(F.lit("."), 20)).alias("line"))
        head = rows.select("k").distinct().select("k", F.lit(0).cast("long").alias("ord"), F.lit("head").alias("line"))
        written(body.unionByName(head), "k", str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for k in range(10):
        (file,) = (tmp_path / f"out/k={k}").glob("*.txt")
        lines = file.read_text().splitlines()
        assert lines[0] == "head" and [int(x.split(".")[0][4:]) for x in lines[1:]] == list(range(1, 6001))
