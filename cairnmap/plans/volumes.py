"""Plans of distance volumes, depth images, meshes and grasps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import grasp as GR
from ..operators import sdf as S
from ..sources.readers import laser_points
from .registry import CLOUD, SIZE, cloud, key_sql, plan, rnd, rounded, table

FX, FY, CX, CY = 10.0, 10.0, 4.0, 4.0


def depth_images(spark, sf):
    """frame, u, v, depth: an 8 x 8 depth image from every embedding; some pixels are missing."""
    d = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("p", "e"))
    missing = (F.col("frame") + F.col("p")) % 50 == 0
    return d.select("frame", (F.col("p") % 8).cast("int").alias("u"), F.floor(F.col("p") / 8).cast("int").alias("v"), F.when(~missing, 1.2 + F.col("e").cast("double")).alias("depth"))


_DEPTH = "depth AS (SELECT vec_id AS frame, CAST(p % 8 AS INTEGER) AS u, CAST(p // 8 AS INTEGER) AS v, CASE WHEN (vec_id + p) % 50 <> 0 THEN 1.2 + CAST(embedding[p+1] AS DOUBLE) END AS depth FROM embeddings, (SELECT unnest(range(64)) AS p))"
_SEEN = "pts AS (SELECT frame, u, v, depth, (u-4.0::DOUBLE)*depth/10.0::DOUBLE AS x, (v-4.0::DOUBLE)*depth/10.0::DOUBLE AS y, depth AS z FROM depth WHERE depth IS NOT NULL)"


def depth_points(spark, sf):
    d = depth_images(spark, sf).filter("depth is not null")
    p = G.back_project(FX, FY, CX, CY, F.col("u"), F.col("v"), F.col("depth"))
    return d.select("frame", "u", "v", "depth", *(c.alias(a) for c, a in zip(p, G.AXES)))


@plan(f"WITH {_DEPTH}, {_SEEN} SELECT frame, u, v, {', '.join(rnd(a, a) for a in 'xyz')} FROM pts")
def depth_cloud(spark, sf):
    return rounded(depth_points(spark, sf).drop("depth"), *G.AXES)


@plan(f"WITH {_DEPTH}, g AS (SELECT *, depth > 0.9 AND NOT isnan(depth) AS own, lag(depth) OVER (PARTITION BY frame, v ORDER BY u) AS l, lag(depth) OVER (PARTITION BY frame, u ORDER BY v) AS t FROM depth) SELECT frame, count(*) AS valid FROM g WHERE own AND l > 0.9 AND t > 0.9 GROUP BY frame")
def valid_depth(spark, sf):
    return S.valid_depth(depth_images(spark, sf), ("frame",), 0.9).filter("valid").groupBy("frame").agg(F.count("*").alias("valid"))


_MOMENTS = ", ".join([rnd(f"avg({a})", f"m{a}") for a in "xyz"] + [rnd(f"covar_samp({c[0]},{c[1]})", f"c{c}", 8) for c in G.SYM])


@plan(f"WITH {_DEPTH}, {_SEEN} SELECT frame, count(*) AS n, {rnd('avg(depth)', 'mean')}, {rnd('var_pop(depth)', 'var', 8)}, {_MOMENTS} FROM pts WHERE abs(u - (2 + frame % 4)) <= 2 AND abs(v - (2 + frame // 4 % 4)) <= 2 GROUP BY frame")
def depth_patches(spark, sf):
    """The patch around each image's key pixel: depth's mean and variance, and the Gaussian of its points."""
    k = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), (2 + F.col("vec_id") % 4).cast("int").alias("u"), (2 + F.floor(F.col("vec_id") / 4) % 4).cast("int").alias("v"))
    for c in "uv":
        k = k.withColumn(c, F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2)))
    own = [F.count("*").alias("n"), F.avg("depth").alias("mean"), F.var_pop("depth").alias("var"), *(F.avg(a).alias("m" + a) for a in G.AXES), *(F.covar_samp(c[0], c[1]).alias("c" + c) for c in G.SYM)]
    out = k.join(depth_points(spark, sf), ["frame", "u", "v"]).groupBy("frame").agg(*own)
    return rounded(rounded(out, "mean", *("m" + a for a in G.AXES)), "var", *("c" + c for c in G.SYM), digits=8)


def _near(c: str) -> str:
    return f"CAST(floor({c}/0.1::DOUBLE+0.5::DOUBLE) AS INTEGER)"


@plan(f"WITH {_DEPTH}, {_SEEN}, box AS (SELECT DISTINCT frame, {_near('x')} AS i, {_near('y')} AS j, {_near('z')} + CAST(o AS INTEGER) AS k FROM pts, (SELECT unnest(range(-3, 4)) AS o)), p AS (SELECT *, CAST(floor(10.0::DOUBLE*(i*0.1::DOUBLE)/(k*0.1::DOUBLE)+4.0::DOUBLE+0.5::DOUBLE) AS INTEGER) AS u, CAST(floor(10.0::DOUBLE*(j*0.1::DOUBLE)/(k*0.1::DOUBLE)+4.0::DOUBLE+0.5::DOUBLE) AS INTEGER) AS v FROM box WHERE k > 0), "
      f"f AS (SELECT i, j, k, least(depth-k*0.1::DOUBLE, 0.3::DOUBLE) AS d FROM p JOIN depth USING (frame, u, v) WHERE depth IS NOT NULL AND depth-k*0.1::DOUBLE > -0.3::DOUBLE) SELECT i, j, k, {rnd('avg(d)', 'd')}, least(count(*), 40)::DOUBLE AS w FROM f GROUP BY i, j, k")
def sdf_fuse_depth(spark, sf):
    """All depth images fused into one volume: each image's voxels around its points, then running averages with weights of 40 at most."""
    box = depth_points(spark, sf).select("frame", *(F.floor(F.col(a) / 0.1 + 0.5).cast("int").alias(v) for a, v in zip(G.AXES, S.VOXEL)))
    box = box.select("frame", "i", "j", F.explode(F.sequence(F.col("k") - 3, F.col("k") + 3)).alias("k")).distinct()
    return rounded(S.merge(S.fuse_depth(box, depth_images(spark, sf), FX, FY, CX, CY, 0.1, 0.3, ("frame",)), most=40.0), "d")


def volume(spark, sf):
    """i, j, k, d, w: the cloud's mean distance from a shell in every voxel, cut off at 0.35."""
    far = cloud(spark, sf).select(*(G.grid_key(a, SIZE).alias(v) for a, v in zip(G.AXES, S.VOXEL)), G.norm(*(F.col(a) for a in G.AXES)).alias("r"))
    d = F.greatest(F.lit(-0.35), F.least(F.lit(0.35), F.avg("r") - 0.2))
    return far.groupBy(*S.VOXEL).agg(d.alias("d"), F.count("*").cast("double").alias("w"))


_BALL = f"{CLOUD}, ball AS (SELECT i, j, k, greatest(-0.35, least(0.35, avg(r) - 0.2)) AS d FROM (SELECT {key_sql('x')} AS i, {key_sql('y')} AS j, {key_sql('z')} AS k, sqrt(x*x+y*y+z*z) AS r FROM cloud) GROUP BY i, j, k)"


_SIX = ("i", 1), ("i", -1), ("j", 1), ("j", -1), ("k", 1), ("k", -1)
_STEPS = " ".join(f"JOIN ball n{m} ON " + " AND ".join(f"n{m}.{o} = b.{o}" + (f" + {s}" if o == a else "") for o in "ijk") for m, (a, s) in enumerate(_SIX))


@plan(f"WITH {_BALL} SELECT b.i, b.j, b.k, {', '.join(rnd(f'(n{2 * m}.d-n{2 * m + 1}.d)/0.2', g) for m, g in enumerate(('gx', 'gy', 'gz')))} FROM ball b {_STEPS}")
def sdf_gradient(spark, sf):
    return rounded(S.gradient(volume(spark, sf), 0.1), "gx", "gy", "gz")


_LOOK = "q AS (SELECT c_custkey AS id, (c_custkey % 100)/120.0::DOUBLE-0.4 AS x, (c_custkey % 37)/60.0::DOUBLE-0.3 AS y, (c_custkey % 11)/20.0::DOUBLE-0.25 AS z FROM customer), f AS (SELECT id, x/0.1 AS x, y/0.1 AS y, z/0.1 AS z FROM q), c AS (SELECT *, CAST(floor(x) AS INTEGER)+a AS i, CAST(floor(y) AS INTEGER)+b AS j, CAST(floor(z) AS INTEGER)+e AS k, (CASE WHEN a=1 THEN x-floor(x) ELSE 1-x+floor(x) END)*(CASE WHEN b=1 THEN y-floor(y) ELSE 1-y+floor(y) END)*(CASE WHEN e=1 THEN z-floor(z) ELSE 1-z+floor(z) END) AS wt FROM f, (SELECT unnest([0,1]) AS a), (SELECT unnest([0,1]) AS b), (SELECT unnest([0,1]) AS e))"


@plan(f"WITH {_BALL}, {_LOOK} SELECT id, {rnd('sum(wt*coalesce(d, 0.35))', 'sdf')} FROM c LEFT JOIN ball USING (i, j, k) GROUP BY id")
def sdf_lookup(spark, sf):
    k = F.col("c_custkey")
    q = table(spark, sf, "customer").select(k.alias("id"), ((k % 100) / 120.0 - 0.4).alias("x"), ((k % 37) / 60.0 - 0.3).alias("y"), ((k % 11) / 20.0 - 0.25).alias("z"))
    return rounded(S.lookup(q, volume(spark, sf), 0.1, 0.35, "id"), "sdf")


@plan()
def sdf_surface(spark, sf):
    """Triangles of the zero level by voxel, with the distances of their first corners from the origin."""
    t = S.surface(volume(spark, sf), 0.1, 0.35)
    r = G.norm(*(F.col("v0")[a] for a in G.AXES))
    return rounded(t.groupBy(*S.VOXEL).agg(F.count("*").alias("triangles"), F.min(r).alias("least"), F.max(r).alias("most")), "least", "most", digits=4)


_SCAN = "s AS (SELECT c_custkey AS id, unnest(range(8)) AS pt_idx, 0.1 + (c_custkey % 50) / 4.0::DOUBLE AS base FROM customer), r AS (SELECT id, pt_idx, base * (pt_idx + 1) AS r FROM s)"


@plan(f"WITH {_SCAN} SELECT id, CAST(pt_idx AS INTEGER) AS pt_idx, {rnd('0.2 + r*cos(-1.0 + pt_idx*0.25)', 'x')}, {rnd('r*sin(-1.0 + pt_idx*0.25)', 'y')} FROM r WHERE r >= 0.05 AND r < 30 AND r > 0.3 AND r < 20")
def laser_cloud(spark, sf):
    base = 0.1 + (F.col("c_custkey") % 50) / 4.0
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1.0).alias("angle_min"), F.lit(0.25).alias("angle_increment"), F.lit(0.05).alias("range_min"), F.lit(30.0).alias("range_max"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: base * k).alias("ranges"))
    return rounded(laser_points(s, ("id",), (0.2, 0.0, 0.0)).select("id", "pt_idx", "x", "y"), "x", "y")


def mesh(spark, sf):
    """Vertices with outward normals, one an embedding, on a dented sphere; directed edges between ids 1 and 12 apart."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *(e(k).alias(f"e{k}") for k in range(4)))
    size = G.norm(F.col("e0"), F.col("e1"), F.col("e2"))
    v = v.select("id", *((F.col(f"e{k}") / size).alias("n" + a) for k, a in enumerate(G.AXES)), (0.5 * (1 + 0.2 * F.col("e3"))).alias("r"))
    vertices = v.select("id", *((F.col("r") * F.col("n" + a)).alias(a) for a in G.AXES), *("n" + a for a in G.AXES))
    ids = v.select(F.col("id").alias("dst"))
    edges = v.select(F.col("id").alias("src"), F.explode(F.array(*(F.col("id") + k for k in (-12, -1, 1, 12)))).alias("dst")).join(ids, "dst", "left_semi")
    return vertices, edges.select("src", "dst")


_VERT = "vt AS (SELECT id, r*nx AS x, r*ny AS y, r*nz AS z, nx, ny, nz FROM (SELECT id, a/sqrt(a*a+b*b+c*c) AS nx, b/sqrt(a*a+b*b+c*c) AS ny, c/sqrt(a*a+b*b+c*c) AS nz, 0.5*(1+0.2*d) AS r FROM (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings)))"
_EDGES = "me AS (SELECT a.id AS src, b.id AS dst FROM vt a JOIN vt b ON abs(a.id - b.id) IN (1, 12))"
_CONE = "fk AS (SELECT k, 0.8*cos(k*(2*3.141592653589793/8)) AS fx, 0.8*sin(k*(2*3.141592653589793/8)) AS fy, 1.0::DOUBLE AS fz FROM (SELECT CAST(unnest(range(8)) AS INTEGER) AS k))"
_FRAME = """fr AS (SELECT id, x, y, z, -nx AS ax, -ny AS ay, -nz AS az, CASE WHEN abs(nx) < 0.9 THEN 1.0 ELSE 0.0 END AS ux, CASE WHEN abs(nx) < 0.9 THEN 0.0 ELSE 1.0 END AS uy FROM vt),
sd AS (SELECT *, -az*uy AS bx0, az*ux AS by0, ax*uy-ay*ux AS bz0 FROM fr), sn AS (SELECT *, bx0/sqrt(bx0*bx0+by0*by0+bz0*bz0) AS bx, by0/sqrt(bx0*bx0+by0*by0+bz0*bz0) AS by_, bz0/sqrt(bx0*bx0+by0*by0+bz0*bz0) AS bz FROM sd),
on_ AS (SELECT *, ay*bz-az*by_ AS cx, az*bx-ax*bz AS cy, ax*by_-ay*bx AS cz FROM sn),
fc AS (SELECT id, k, x, y, z, fx*bx+fy*cx+fz*ax AS f1, fx*by_+fy*cy+fz*ay AS f2, fx*bz+fy*cz+fz*az AS f3 FROM on_, fk), sc AS (SELECT max(sqrt(x*x+y*y+z*z)) AS s FROM vt)"""


@plan(f"WITH {_VERT}, {_CONE}, {_FRAME} SELECT id, k, {', '.join(rnd(e, n) for n, e in (('f1', 'f1'), ('f2', 'f2'), ('f3', 'f3'), ('t1', '(y*f3-z*f2)/s'), ('t2', '(z*f1-x*f3)/s'), ('t3', '(x*f2-y*f1)/s')))} FROM fc, sc")
def object_wrenches(spark, sf):
    return rounded(GR.object_wrenches(mesh(spark, sf)[0], GR.limit_surface(spark)), *GR.WRENCH)


@plan(f"SELECT c_custkey, CAST(k AS INTEGER) AS k, {rnd('(0.4+c_custkey%5/10.0::DOUBLE)*cos(k*(2*3.141592653589793/8))', 'fx')}, {rnd('(0.4+c_custkey%5/10.0::DOUBLE)*sin(k*(2*3.141592653589793/8))', 'fy')}, 1.0::DOUBLE AS fz, 0.0::DOUBLE AS tz FROM customer, (SELECT unnest(range(8)) AS k)")
def limit_surface(spark, sf):
    """A friction cone for every finger, by the finger's own friction."""
    fingers = table(spark, sf, "customer").select("c_custkey", (0.4 + F.col("c_custkey") % 5 / 10.0).alias("friction"))
    return rounded(GR.finger_surfaces(fingers, "c_custkey", "friction"), "fx", "fy")


def grasps(spark, sf, kind: str):
    """The wrenches of the contacts of every grasp: a label's vertices."""
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grasp"), (F.col("vec_id") % 3).cast("int").alias("finger"))
    return rounded(GR.object_wrenches(mesh(spark, sf)[0], GR.limit_surface(spark, kind, sides=3)).join(labels, "id"), *GR.WRENCH)


@plan()
def grasp_quality(spark, sf):
    return rounded(GR.grasp_quality(grasps(spark, sf, "soft"), "grasp"), "radius", "volume", "area", digits=5)


_REACHED = "rc(center, node) AS (SELECT id, id FROM vt UNION SELECT rc.center, me.dst FROM rc JOIN me ON me.src = rc.node JOIN vt a ON a.id = rc.center JOIN vt b ON b.id = me.dst WHERE sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) <= 0.3)"


@plan(f"WITH RECURSIVE {_VERT}, {_EDGES}, {_REACHED} SELECT center, count(*) AS n FROM rc GROUP BY center")
def mesh_patches(spark, sf):
    v, e = mesh(spark, sf)
    return GR.patches(e, v, 0.3).groupBy("center").agg(F.count("*").alias("n"))


@plan("SELECT label AS scan_id, count(*) AS n, " + f"{rnd('8.0/3.0*pi()*pi()/5.0*avg(embedding[1]::DOUBLE)**0', 'unit')} FROM embeddings GROUP BY label")
def ball_volumes(spark, sf):
    e = table(spark, sf, "embeddings").groupBy(F.col("label").alias("scan_id")).agg(F.count("*").alias("n"))
    return rounded(e.withColumn("unit", G.ball_volume(5, F.lit(1.0))), "unit")
