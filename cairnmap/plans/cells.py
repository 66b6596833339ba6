"""Plans over points and Gaussian cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import cells as C
from ..operators import registration as R
from .registry import FIRM, firm, CELLS, CLOUD, COV, FORM, KEYS, ROUND_STATS, SIZE, STATS, cells, cells_sql, cloud, inverse_sql, key_sql, plan, quadratic_sql, rnd, rounded

TURN = (0.36, 0.48, -0.8, 0.1, -0.8, 0.6, 0.0, -0.2, 0.48, 0.64, 0.6, 0.3, 0.0, 0.0, 0.0, 1.0)


@plan(f"WITH {CLOUD}, {CELLS} SELECT ix, iy, iz, n, {ROUND_STATS} FROM cells")
def cell_fit(spark, sf):
    return rounded(cells(spark, sf), *STATS)


@plan(f"WITH {CLOUD}, {cells_sql(by='scan_id')} SELECT scan_id, ix, iy, iz, n, {ROUND_STATS} FROM cells")
def cell_fit_by_scan(spark, sf):
    return rounded(cells(spark, sf, ("scan_id",)), *STATS)


_MERGE = ", ".join(rnd(f"(sum((n-1)*{c} + n*{a}*{b}) - sum(n)*(sum(n*{a})/sum(n))*(sum(n*{b})/sum(n)))/(sum(n)-1)", c) for c, a, b in zip(COV, ("mx", "mx", "mx", "my", "my", "mz"), ("mx", "my", "mz", "my", "mz", "mz")))


@plan(f"WITH {CLOUD}, {cells_sql(by='scan_id')} SELECT ix, iy, iz, CAST(sum(n) AS BIGINT) AS n, {', '.join(rnd(f'sum(n*{m})/sum(n)', m) for m in ('mx', 'my', 'mz'))}, {_MERGE} FROM cells GROUP BY ix, iy, iz")
def cell_merge(spark, sf):
    return rounded(C.merge(cells(spark, sf, ("scan_id",))), *STATS)


def _moved(x, y, z):
    return [f"{TURN[4 * r]}*{x}+({TURN[4 * r + 1]})*{y}+({TURN[4 * r + 2]})*{z}+({TURN[4 * r + 3]})" for r in range(3)]


_FULL = [["cxx", "cxy", "cxz"], ["cxy", "cyy", "cyz"], ["cxz", "cyz", "czz"]]
_TURNED = [" + ".join(f"({TURN[4 * i + a]})*({TURN[4 * j + b]})*{_FULL[a][b]}" for a in range(3) for b in range(3)) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]


@plan(f"WITH {CLOUD}, {CELLS} SELECT ix, iy, iz, n, {', '.join(rnd(e, m) for e, m in zip(_moved('mx', 'my', 'mz') + _TURNED, STATS))} FROM cells")
def cell_transform(spark, sf):
    return rounded(C.transform(cells(spark, sf), TURN), *STATS)


@plan(f"WITH {CLOUD} SELECT scan_id, pid, {', '.join(rnd(e, a) for e, a in zip(_moved('x', 'y', 'z'), 'xyz'))} FROM cloud")
def point_transform(spark, sf):
    return rounded(C.transform_points(cloud(spark, sf), TURN), *G.AXES)


@plan(f"WITH {CLOUD} SELECT scan_id, count(*) AS n, {rnd('sum(x)', 'sx')} FROM cloud WHERE sqrt(x*x+y*y+z*z) <= 0.3 AND z <= 0.1 GROUP BY scan_id")
def point_range_filter(spark, sf):
    return rounded(C.valid_points(cloud(spark, sf), 0.3, max_z=0.1).groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx")), "sx")


@plan(f"WITH {CLOUD}, keyed AS (SELECT *, {KEYS} FROM cloud), {FIRM} SELECT pid, {rnd(f'coalesce(exp(-0.5*{FORM}), -1)', 'likelihood')} FROM keyed JOIN cells USING (ix, iy, iz)")
def point_likelihood(spark, sf):
    from ..operators.joins import own_cell

    found = own_cell(cloud(spark, sf), firm(spark, sf), SIZE, "inner")
    return rounded(found.select("pid", G.likelihood(C.columns(G.AXES), C.columns(C.MEAN), C.columns(C.COV)).alias("likelihood")), "likelihood")


_INV = inverse_sql(COV)
_LEN = "sqrt(x*x+y*y+z*z)"
_W = [f"(x/len*{_INV[a]}+y/len*{_INV[b]}+z/len*{_INV[c]})" for a, b, c in ((0, 1, 2), (1, 3, 4), (2, 4, 5))]


@plan(
    f"WITH {CLOUD}, keyed AS (SELECT *, {KEYS}, {_LEN} AS len FROM cloud), {FIRM}, j AS (SELECT * FROM keyed JOIN cells USING (ix, iy, iz)), "
    f"t AS (SELECT *, -({_W[0]}*(x-mx)+{_W[1]}*(y-my)+{_W[2]}*(z-mz))/nullif({_W[0]}*x/len+{_W[1]}*y/len+{_W[2]}*z/len, 0) AS t FROM j) "
    f"SELECT pid, {rnd('exp(-0.5*' + quadratic_sql(('x+t*x/len-mx', 'y+t*y/len-my', 'z+t*z/len-mz'), _INV) + ')', 'peak', 5)} FROM t"
)
def likelihood_along_ray(spark, sf):
    from ..operators.joins import own_cell

    found = own_cell(cloud(spark, sf), firm(spark, sf), SIZE, "inner")
    found = C.peak_on_line(found, [F.lit(0.0)] * 3, C.columns(G.AXES))
    return rounded(found.select("pid", "peak"), "peak", digits=5)


@plan(f"WITH {CLOUD}, keyed AS (SELECT *, {KEYS} FROM cloud), {CELLS} SELECT pid FROM keyed WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.ix = keyed.ix AND c.iy = keyed.iy AND c.iz = keyed.iz)")
def conflict_points(spark, sf):
    points = cloud(spark, sf)
    return C.binned(points, SIZE).join(cells(spark, sf), list(C.KEY), "left_anti").select("pid")


@plan(f"WITH {CLOUD} SELECT DISTINCT scan_id, {KEYS} FROM cloud")
def dirty_cells(spark, sf):
    return C.binned(cloud(spark, sf), SIZE).select("scan_id", *C.KEY).distinct()


@plan(f"WITH {CLOUD}, {CELLS} SELECT count(*) AS active, CAST(sum(n) AS BIGINT) AS points FROM cells")
def active_cells(spark, sf):
    return cells(spark, sf).agg(F.count("*").alias("active"), F.sum("n").alias("points"))


@plan(f"WITH {CLOUD} SELECT scan_id, {key_sql('x', 0.2)} AS ix, {key_sql('y', 0.2)} AS iy, {key_sql('z', 0.2)} AS iz, min(pid) AS first_pid, {rnd('avg(x)', 'x')}, {rnd('avg(y)', 'y')}, {rnd('avg(z)', 'z')} FROM cloud GROUP BY ALL")
def voxel_subsample(spark, sf):
    out = C.binned(cloud(spark, sf), 0.2).groupBy("scan_id", *C.KEY).agg(F.min("pid").alias("first_pid"), *(F.avg(a).alias(a) for a in G.AXES))
    return rounded(out, *G.AXES)


@plan(f"WITH {CLOUD}, {CELLS}, t AS (SELECT *, (cxx+cyy+czz)/3 AS q FROM cells), p AS (SELECT *, sqrt(((cxx-q)**2+(cyy-q)**2+(czz-q)**2+2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) AS p FROM t) SELECT ix, iy, iz, {rnd('q', 'third_trace', 7)}, {rnd('p', 'spread', 7)} FROM p")
def cell_spread(spark, sf):
    xx, xy, xz, yy, yz, zz = C.columns(C.COV)
    low, middle, high = G.eigenvalues(C.columns(C.COV))
    q = (low + middle + high) / 3
    spread = F.sqrt(((low - q) ** 2 + (middle - q) ** 2 + (high - q) ** 2) / 6)
    return rounded(cells(spark, sf).select(*C.KEY, q.alias("third_trace"), spread.alias("spread")), "third_trace", "spread", digits=7)


@plan()
def cell_classes(spark, sf):
    return C.clamped(cells(spark, sf)).groupBy("class").agg(F.count("*").alias("n"))


@plan()
def cell_student_t(spark, sf):
    return rounded(C.student_t(cloud(spark, sf), SIZE), *STATS)


@plan()
def cell_normality(spark, sf):
    return rounded(C.normality(cloud(spark, sf), SIZE), "ep", "p", digits=4)


@plan(
    f"WITH RECURSIVE {CLOUD}, fine AS (SELECT CAST(floor(x/0.1) AS BIGINT) ix, CAST(floor(y/0.1) AS BIGINT) iy, CAST(floor(z/0.1) AS BIGINT) iz, count(*) n FROM cloud GROUP BY ALL), "
    "lv AS (SELECT 4-s AS level, CAST(floor(ix/(1<<s)) AS BIGINT) AS ix, CAST(floor(iy/(1<<s)) AS BIGINT) AS iy, CAST(floor(iz/(1<<s)) AS BIGINT) AS iz, CAST(sum(n) AS BIGINT) AS n FROM fine, (SELECT unnest(range(5)) AS s) GROUP BY ALL) "
    "SELECT CAST(c.level AS INTEGER) AS level, c.ix, c.iy, c.iz, c.n FROM lv c LEFT JOIN lv p ON p.level = c.level-1 AND p.ix = CAST(floor(c.ix/2) AS BIGINT) AND p.iy = CAST(floor(c.iy/2) AS BIGINT) AND p.iz = CAST(floor(c.iz/2) AS BIGINT) "
    "WHERE (c.level = 0 OR p.n > 10) AND (c.n <= 10 OR c.level = 4)"
)
def octree_leaves(spark, sf):
    return C.octree_leaves(cloud(spark, sf), 1.6, 10, 4)


_SRC, _TGT = cells_sql("src", "scan_id % 2 = 1"), cells_sql("tgt", "scan_id % 2 = 0")
_SUM = [f"s.{c}+t.{c}" for c in COV]
_PAIR = quadratic_sql(("s.mx-t.mx", "s.my-t.my", "s.mz-t.mz"), inverse_sql(_SUM))
_BLOCK = " AND ".join(f"t.i{a} BETWEEN {key_sql('s.m' + a)}-2 AND {key_sql('s.m' + a)}+2" for a in "xyz")


def halves(spark, sf):
    return cells(spark, sf, where="scan_id % 2 = 1"), cells(spark, sf, where="scan_id % 2 = 0")


@plan(f"WITH {CLOUD}, {_SRC}, {_TGT}, f AS (SELECT {_PAIR} AS l FROM src s JOIN tgt t ON {_BLOCK}) SELECT count(*) AS pairs, {rnd('sum(-exp(-0.025*l))', 'score', 4)} FROM f WHERE l IS NOT NULL AND NOT isnan(l)")
def pair_score(spark, sf):
    return rounded(R.pair_score(*halves(spark, sf), SIZE), "score", digits=4)


_BINV = inverse_sql(_SUM)
_DX = ("(s.mx-t.mx)", "(s.my-t.my)", "(s.mz-t.mz)")
_BX = [f"({_BINV[a]}*{_DX[0]}+{_BINV[b]}*{_DX[1]}+{_BINV[c]}*{_DX[2]})" for a, b, c in ((0, 1, 2), (1, 3, 4), (2, 4, 5))]


@plan(f"WITH {CLOUD}, {_SRC}, {_TGT}, f AS (SELECT {_PAIR} AS l, {_BX[0]} AS v0, {_BX[1]} AS v1, {_BX[2]} AS v2 FROM src s JOIN tgt t ON {_BLOCK}) SELECT count(*) AS pairs, {', '.join(rnd(f'sum(0.05*exp(-0.025*l)*v{k})', f'g{k}', 3) for k in range(3))} FROM f WHERE l IS NOT NULL AND NOT isnan(l)")
def pair_gradient(spark, sf):
    return rounded(R.derivatives(*halves(spark, sf), SIZE).select("pairs", "g0", "g1", "g2"), "g0", "g1", "g2", digits=3)


@plan()
def match_cells(spark, sf):
    pose, score = R.match_cells(*(C.fit(cloud(spark, sf).filter(w), SIZE, least=8) for w in ("scan_id % 2 = 1", "scan_id % 2 = 0")), SIZE)
    return spark.createDataFrame([(i, j, float(round(pose[i, j], 6))) for i in range(4) for j in range(4)] + [(4, 0, float(round(score, 3)))], "i int, j int, value double")


@plan()
def icp_pose(spark, sf):
    points = cloud(spark, sf)
    pose = R.icp(points.filter("scan_id % 2 = 1"), points.filter("scan_id % 2 = 0"), SIZE)
    return spark.createDataFrame([(i, j, float(round(pose[i, j], 6))) for i in range(4) for j in range(4)], "i int, j int, value double")


@plan()
def ransac_pose(spark, sf):
    points = cloud(spark, sf)
    moved = C.transform_points(points, TURN)
    pairs = points.select("pid", *(F.col(a).alias("s" + a) for a in G.AXES)).join(moved.select("pid", *(F.col(a).alias("t" + a) for a in G.AXES)), "pid").drop("pid")
    pose, found = R.ransac(pairs)
    return spark.createDataFrame([(i, j, float(round(pose[i, j], 6))) for i in range(4) for j in range(4)] + [(4, 0, float(found))], "i int, j int, value double")


def _p2d(size: float = SIZE, outliers: float = 0.35):
    import numpy as np

    c1, c2 = (1 - outliers) / 0.1, outliers / size**3
    d3 = -np.log(c2)
    a = -np.log(c1 + c2) - d3
    return float(a), float(-np.log((-np.log(c1 * np.exp(-0.5) + c2) - d3) / a))


@plan(f"WITH {CLOUD}, keyed AS (SELECT *, {KEYS} FROM cloud WHERE scan_id % 2 = 1), {cells_sql('cells', 'scan_id % 2 = 0', least=8)}, f AS (SELECT {FORM} AS l FROM keyed JOIN cells USING (ix, iy, iz)) SELECT count(*) AS used, {rnd(f'sum({_p2d()[0]}*exp(-{_p2d()[1]}*l/2))', 'score', 4)} FROM f WHERE l IS NOT NULL AND NOT isnan(l) AND l <= 120")
def point_score(spark, sf):
    points = cloud(spark, sf)
    return rounded(R.point_score(points.filter("scan_id % 2 = 1"), firm(spark, sf, "scan_id % 2 = 0"), SIZE), "score", digits=4)
