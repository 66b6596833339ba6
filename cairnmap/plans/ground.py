"""Plans of standing places, camera tables, contacts and volumes' normal equations."""

from __future__ import annotations

from math import sin

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import grasp as GR
from ..operators import joins as J
from ..operators import planning as P
from ..operators import sdf as S
from ..operators.lineage import cut
from ..sources.readers import camera_tables
from .extents import EIG, KIND
from .registry import CLOUD, COV, FIRM, SIZE, firm, inverse_sql, plan, quadratic_sql, rnd, rounded, table
from .volumes import _BALL, _VERT, mesh, volume
from .volumes import _EDGES as _LINKS

_KINDS = f"{FIRM}, {EIG}, kd AS (SELECT *, ix || ':' || iy || ':' || iz AS name, ix*0.1::DOUBLE AS x, iy*0.1::DOUBLE AS y, iz*0.1::DOUBLE AS z, {KIND} AS class FROM eig WHERE l0 > 0)"


def kinds(spark, sf):
    return cut(C.with_kind(firm(spark, sf)))


@plan(f"WITH {CLOUD}, {_KINDS}, p AS (SELECT a.ix, a.iy, a.iz, b.name AS near, round(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2), 9) AS dist FROM kd a JOIN kd b ON b.class = 'HORIZONTAL' AND sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) <= 0.25), r AS (SELECT *, row_number() OVER (PARTITION BY ix, iy, iz ORDER BY dist, near) AS rn FROM p) SELECT ix, iy, iz, near, {rnd('dist', 'dist')} FROM r WHERE rn = 1")
def closest_floor(spark, sf):
    return rounded(P.closest_of_class(kinds(spark, sf), 0.25, SIZE), "dist")


ROBOT, INCLINE = (0.31, 0.27, 0.33), 0.3
_FLAT, _RAD, _LIM = (0.31**2 + 0.27**2) ** 0.5 / 2, (0.31**2 + 0.27**2 + 0.33**2) ** 0.5 / 2, 2 * sin(INCLINE)
_INVB = inverse_sql(["b." + c for c in COV])
_HIT = (f"ps AS (SELECT a.ix, a.iy, a.iz, b.class AS t_class, a.z < b.z AND a.z+0.33 > b.z-0.1 AND sqrt((a.x-b.x)**2+(a.y-b.y)**2) < {_FLAT!r} AS above, a.x-b.mx AS g0, a.y-b.my AS g1, a.mz-b.mz AS g2, {quadratic_sql(('a.x-b.mx', 'a.y-b.my', 'a.mz-b.mz'), _INVB)} AS form FROM kd a JOIN kd b ON sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) <= {_RAD!r}), "
        f"pl AS (SELECT *, sqrt(g0*g0+g1*g1+g2*g2) AS len FROM ps), ph AS (SELECT ix, iy, iz, bool_or(above AND CASE WHEN abs(g2)/greatest(len, 1e-9) > {_LIM!r} THEN len < {_RAD!r} OR coalesce(((len-{_RAD!r})/nullif(len, 0))**2*form < 1, false) ELSE t_class NOT IN ('HORIZONTAL', 'INCLINED') END) AS hit FROM pl GROUP BY 1, 2, 3), "
        "co AS (SELECT ix, iy, iz, name, class NOT IN ('HORIZONTAL', 'INCLINED') OR coalesce(hit, false) AS collides FROM kd LEFT JOIN ph USING (ix, iy, iz))")


@plan(f"WITH {CLOUD}, {_KINDS}, {_HIT} SELECT ix, iy, iz, collides FROM co")
def collision_cells(spark, sf):
    return P.collisions(kinds(spark, sf), SIZE, ROBOT, INCLINE)


_EDGES = "pr AS (SELECT a.name AS src, b.name AS dst, sqrt((b.mx-a.mx)**2+(b.my-a.my)**2+(b.mz-a.mz)**2) AS d, abs(b.mz-a.mz) AS up, sqrt((b.mx-a.mx)**2+(b.my-a.my)**2) AS flat FROM kd a JOIN kd b ON a.name <> b.name AND abs(a.ix-b.ix) <= 2 AND abs(a.iy-b.iy) <= 2 AND abs(a.iz-b.iz) <= 2), ed AS (SELECT src, dst FROM pr JOIN co s ON s.name = src AND NOT s.collides JOIN co t ON t.name = dst AND NOT t.collides WHERE d <= 0.3 AND up <= greatest(flat, 1e-9))"


@plan(f"WITH RECURSIVE {CLOUD}, {_KINDS}, {_HIT}, {_EDGES}, rc(node) AS (SELECT min(name) FROM co WHERE NOT collides UNION SELECT ed.dst FROM rc JOIN ed ON ed.src = rc.node) SELECT name AS node, name IN (SELECT node FROM rc) AS drivable FROM kd")
def drivable_cells(spark, sf):
    own = kinds(spark, sf)
    blocked = P.collisions(own, SIZE, ROBOT, INCLINE)
    seed = blocked.filter("not collides").select(F.min(F.concat_ws(":", *C.KEY)).alias("s")).first()["s"]
    return P.drivable(own, blocked, P.transit_edges(own, SIZE, 0.3, n=2), seed or "")


def _rounds(n: int) -> str:
    step = "c{k} AS (SELECT camera, u, v, x0, y0, x0/(1+0.1*(x*x+y*y)-0.05*(x*x+y*y)*(x*x+y*y)) AS x, y0/(1+0.1*(x*x+y*y)-0.05*(x*x+y*y)*(x*x+y*y)) AS y FROM c{j})"
    return ", ".join(step.replace("{k}", str(k)).replace("{j}", str(k - 1)) for k in range(1, n + 1))


@plan(f"WITH p AS (SELECT s_suppkey AS camera, CAST(i % 16 AS INTEGER) AS u, CAST(i // 16 AS INTEGER) AS v, 15.0::DOUBLE + s_suppkey % 7 AS f FROM supplier, (SELECT unnest(range(16*12)) AS i)), c0 AS (SELECT camera, u, v, (u-8.0::DOUBLE)/f AS x0, (v-6.0::DOUBLE)/f AS y0, (u-8.0::DOUBLE)/f AS x, (v-6.0::DOUBLE)/f AS y FROM p), {_rounds(5)} SELECT camera, u, v, {rnd('x', 'x')}, {rnd('y', 'y')} FROM c5")
def camera_table(spark, sf):
    """The viewing directions of every camera: one a supplier."""
    k = F.col("s_suppkey")
    cameras = table(spark, sf, "supplier").select(k.alias("camera"), *((15.0 + k % 7).alias(f) for f in ("fx", "fy")), F.lit(8.0).alias("cx"), F.lit(6.0).alias("cy"), F.lit(0.1).alias("k1"), F.lit(-0.05).alias("k2"))
    return rounded(camera_tables(cameras, "camera", 16, 12), "x", "y")


_TOUCH = "tc AS (SELECT c_custkey AS contact, 0.5*sin(p)*cos(t) AS x, 0.5*sin(p)*sin(t) AS y, 0.5*cos(p) AS z FROM (SELECT c_custkey, (c_custkey % 311 + 1)*0.01::DOUBLE AS p, (c_custkey % 627)*0.01::DOUBLE AS t FROM customer))"


@plan(f"WITH {_VERT}, {_TOUCH}, d AS (SELECT contact, id, round(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2), 9) AS dist FROM tc a, vt b), r AS (SELECT *, row_number() OVER (PARTITION BY contact ORDER BY dist, id) AS rn FROM d WHERE dist <= 0.3) SELECT contact, id, {rnd('dist', 'dist')} FROM r WHERE rn = 1")
def contact_vertices(spark, sf):
    p, t = (F.col("c_custkey") % 311 + 1) * 0.01, F.col("c_custkey") % 627 * 0.01
    points = table(spark, sf, "customer").select(F.col("c_custkey").alias("contact"), (0.5 * F.sin(p) * F.cos(t)).alias("x"), (0.5 * F.sin(p) * F.sin(t)).alias("y"), (0.5 * F.cos(p)).alias("z"))
    return rounded(J.nearest_vertex(points, mesh(spark, sf)[0], 0.3, "contact", "id"), "dist")


_MESH = f"{_LINKS}, mo AS (SELECT src, dst FROM me JOIN vt a ON a.id = src AND a.nz > -0.2 JOIN vt b ON b.id = dst AND b.nz > -0.2), st AS (SELECT min(id) AS id FROM vt WHERE nz > -0.2)"


@plan(f"WITH RECURSIVE {_VERT}, {_MESH}, gr(id, hops) AS (SELECT id, 0 FROM st UNION SELECT dst, hops + 1 FROM gr JOIN mo ON src = gr.id WHERE hops < 150) SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM gr GROUP BY id")
def contact_region(spark, sf):
    v, e = mesh(spark, sf)
    good = v.filter("nz > -0.2").persist()
    return GR.contact_region(e, good, good.agg(F.min("id")).first()[0])


@plan("WITH f AS (SELECT c_custkey, c_custkey % 3 AS kind, c_custkey % 4 AS sides FROM customer) SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY kind, sides) - 1 AS INTEGER) AS surface FROM f")
def shared_surfaces(spark, sf):
    f = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("kind"), (F.col("c_custkey") % 4).alias("sides"))
    return GR.shared_surfaces(f, "c_custkey", ("kind", "sides"))


_Q = "q AS (SELECT c_custkey AS id, (c_custkey % 100)/120.0::DOUBLE-0.4 AS x, (c_custkey % 37)/60.0::DOUBLE-0.3 AS y, (c_custkey % 11)/20.0::DOUBLE-0.23 AS z FROM customer)"
_SEVEN = "o AS (SELECT * FROM (VALUES (0, 0, 0, 0), (1, 1, 0, 0), (2, -1, 0, 0), (3, 0, 1, 0), (4, 0, -1, 0), (5, 0, 0, 1), (6, 0, 0, -1)) t(kk, dx, dy, dz)), s7 AS (SELECT id, kk, (x+dx*0.05::DOUBLE)/0.1 AS fx, (y+dy*0.05::DOUBLE)/0.1 AS fy, (z+dz*0.05::DOUBLE)/0.1 AS fz FROM q, o)"
_CORN = "cn AS (SELECT id, kk, CAST(floor(fx) AS INTEGER)+a AS i, CAST(floor(fy) AS INTEGER)+b AS j, CAST(floor(fz) AS INTEGER)+c AS k, CASE WHEN a = 1 THEN fx-floor(fx) ELSE 1-(fx-floor(fx)) END*CASE WHEN b = 1 THEN fy-floor(fy) ELSE 1-(fy-floor(fy)) END*CASE WHEN c = 1 THEN fz-floor(fz) ELSE 1-(fz-floor(fz)) END AS wt FROM s7, (SELECT unnest(range(2)) AS a), (SELECT unnest(range(2)) AS b), (SELECT unnest(range(2)) AS c))"
_VAL = "lk AS (SELECT id, kk, sum(wt*coalesce(d, 0.35)) AS d FROM cn LEFT JOIN ball USING (i, j, k) GROUP BY id, kk), pv AS (SELECT id, " + "max(CASE WHEN kk = 0 THEN d END) AS d, " + ", ".join(f"(max(CASE WHEN kk = {2 * n + 1} THEN d END)-max(CASE WHEN kk = {2 * n + 2} THEN d END))/0.1 AS g{a}" for n, a in enumerate("xyz")) + " FROM lk GROUP BY id)"
_JAC = ("gz*y-gy*z", "gx*z-gz*x", "gy*x-gx*y", "gx", "gy", "gz")
_EQ = "je AS (SELECT d, " + ", ".join(f"{e} AS j{i}" for i, e in enumerate(_JAC)) + ", CASE WHEN abs(d) < 0.05 THEN 1.0 ELSE 0.05/abs(d) END AS w FROM pv JOIN q USING (id) WHERE abs(d) < 0.35*(1-1e-9))"
_UP = [(i, k) for i in range(6) for k in range(i, 6)]


@plan(f"WITH {_BALL}, {_Q}, {_SEVEN}, {_CORN}, {_VAL}, {_EQ} SELECT count(*) AS n, {', '.join(rnd(f'sum(w*j{i}*d)', f'g{i}', 4) for i in range(6))}, {', '.join(rnd(f'sum(w*j{i}*j{k})', f'a{i}{k}', 3) for i, k in _UP)} FROM je")
def sdf_normal_equations(spark, sf):
    k = F.col("c_custkey")
    q = table(spark, sf, "customer").select(k.alias("id"), ((k % 100) / 120.0 - 0.4).alias("x"), ((k % 37) / 60.0 - 0.3).alias("y"), ((k % 11) / 20.0 - 0.23).alias("z"))
    out = S.normal_equations(q, volume(spark, sf), 0.1, 0.35, "id", 0.05)
    return rounded(rounded(out, *(f"g{i}" for i in range(6)), digits=4), *(f"a{i}{k}" for i, k in _UP), digits=3)
