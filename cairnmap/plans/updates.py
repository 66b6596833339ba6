"""Plans of cell updates, evidence along rays and views rendered from a map."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import occupancy as O
from ..operators import updates as U
from .cells import _MERGE
from .registry import CELLS, CLOUD, COV, FIRM, KEYS, SIZE, STATS, cells, cells_sql, cloud, firm, inverse_sql, key_sql, plan, quadratic_sql, rnd, rounded
from .spatial import rays

OLD, NEW = "scan_id % 2 = 0", "scan_id % 2 = 1"
_OLD, _NEW = cells_sql("old", OLD, least=8), cells_sql("new", NEW, least=8)
_BOTH = "both_ AS (SELECT o.*, " + ", ".join(f"n.{c} AS b_{c}" for c in ("n", *STATS)) + " FROM old o JOIN new n USING (ix, iy, iz))"
_SYM = [[0, 1, 2], [1, 3, 4], [2, 4, 5]]


def old_new(spark, sf):
    points = cloud(spark, sf)
    return C.fit(points.filter(OLD), SIZE, least=8), points.filter(NEW)


_INV1 = "i1 AS (SELECT *, " + ", ".join(f"{e} AS o{k}" for k, e in enumerate(inverse_sql(COV))) + ", " + ", ".join(f"{e} AS n{k}" for k, e in enumerate(inverse_sql(["b_" + c for c in COV]))) + " FROM both_)"
_INV2 = "i2 AS (SELECT *, " + ", ".join(f"0.98*o{k}+0.02*n{k} AS j{k}" for k in range(6)) + " FROM i1)"
_INV3 = "i3 AS (SELECT *, " + ", ".join(f"{e} AS w{k}" for k, e in enumerate(inverse_sql([f"j{k}" for k in range(6)]))) + ", " + ", ".join("+".join(f"0.98*o{_SYM[r][c]}*m{a}+0.02*n{_SYM[r][c]}*b_m{a}" for c, a in enumerate("xyz")) + f" AS v{r}" for r in range(3)) + " FROM i2)"


@plan(f"WITH {CLOUD}, {_OLD}, {_NEW}, {_BOTH}, {_INV1}, {_INV2}, {_INV3} SELECT ix, iy, iz, n+b_n AS n, {', '.join(rnd('+'.join(f'w{_SYM[r][c]}*v{c}' for c in range(3)), m) for r, m in enumerate(('mx', 'my', 'mz')))}, {', '.join(rnd(f'w{k}', c) for k, c in enumerate(COV))} FROM i3")
def cell_intersection(spark, sf):
    old, new = old_new(spark, sf)
    return rounded(U.intersected(old, C.fit(new, SIZE, least=8)), *STATS)


_STEP = ", ".join([f"m{a}+e*(p.{a}-m{a})" for a in "xyz"] + [f"{c}+e*((1-e)*(1-e)*(p.{c[1]}-m{c[1]})*(p.{c[2]}-m{c[2]})-{c})" for c in COV])


@plan(f"WITH RECURSIVE {CLOUD}, {_OLD}, pts AS (SELECT {KEYS}, x, y, z, row_number() OVER (PARTITION BY {', '.join(key_sql(a) for a in 'xyz')} ORDER BY pid) AS rn, count(*) OVER (PARTITION BY {', '.join(key_sql(a) for a in 'xyz')}) AS total FROM cloud WHERE {NEW}), "
      f"f AS (SELECT ix, iy, iz, n, {', '.join(STATS)}, (5e-4-5e-2)/20.0*(greatest(-10, least(10, n*ln(0.6/0.4)))+10.0)+5e-2 AS e, CAST(0 AS BIGINT) AS rn FROM old UNION ALL SELECT f.ix, f.iy, f.iz, f.n, {_STEP}, e, p.rn FROM f JOIN pts p ON p.ix = f.ix AND p.iy = f.iy AND p.iz = f.iz AND p.rn = f.rn + 1) "
      f"SELECT f.ix, f.iy, f.iz, n + total AS n, {', '.join(rnd('f.' + c, c) for c in STATS)} FROM f JOIN (SELECT DISTINCT ix, iy, iz, total FROM pts) t ON t.ix = f.ix AND t.iy = f.iy AND t.iz = f.iz AND f.rn = t.total")
def cell_refinement(spark, sf):
    old, new = old_new(spark, sf)
    return rounded(U.refined(old.withColumn("occ", F.col("n") * O.HIT), new, SIZE, "pid"), *STATS)


def peak_sql(source: str, start=("0.0", "0.0", "0.0"), end=("x", "y", "z"), name: str = "pk") -> str:
    """Relations that add peak_x, peak_y, peak_z and peak to ``source`` (with a cell's columns): the most likely point on a line."""
    inv = ", ".join(f"{e} AS i{k}_" for k, e in enumerate(inverse_sql(COV)))
    length = "sqrt(" + "+".join(f"({e}-({s}))**2" for s, e in zip(start, end)) + ")"
    line = ", ".join(f"({e}-({s}))/nullif({length}, 0) AS l{k}_" for k, (s, e) in enumerate(zip(start, end)))
    w = ", ".join("+".join(f"l{a}_*i{_SYM[a][b]}_" for a in range(3)) + f" AS w{b}_" for b in range(3))
    sigma = "(w0_*l0_+w1_*l1_+w2_*l2_)"
    t = "-(" + "+".join(f"w{k}_*({e}-{m})" for k, (e, m) in enumerate(zip(end, ("mx", "my", "mz")))) + f")/nullif({sigma}, 0)"
    peaks = ", ".join(f"{e}+t_*l{k}_ AS peak_{a}" for k, (e, a) in enumerate(zip(end, "xyz")))
    form = quadratic_sql(("peak_x-mx", "peak_y-my", "peak_z-mz"), [f"i{k}_" for k in range(6)])
    return (f"{name}1 AS (SELECT *, {inv}, {line} FROM {source}), {name}2 AS (SELECT *, {w} FROM {name}1), {name}3 AS (SELECT *, {sigma} AS s_, {t} AS t_ FROM {name}2), {name}4 AS (SELECT *, {peaks} FROM {name}3), "
            f"{name} AS (SELECT *, CASE WHEN coalesce(s_, 0) = 0 THEN 1.0 ELSE exp(-0.5*{form}) END AS peak FROM {name}4)")


_D = "sqrt((peak_x-x)**2+(peak_y-y)**2+(peak_z-z)**2)"
_SW = f"CASE WHEN n < 12 THEN 0 ELSE coalesce((1-1/(1+exp(least(n*ln(0.6/0.4)/10.0, 5))))*(0.49+0.5*exp(-0.5*{_D}*{_D}/((0.5*sqrt(x*x+y*y+z*z)/20.0+0.1)**2))), 0) END"


@plan(f"WITH {CLOUD}, {_OLD}, k AS (SELECT {KEYS}, x, y, z FROM cloud WHERE {NEW}), b AS (SELECT ix, iy, iz, avg(x) AS bx, avg(y) AS by_, avg(z) AS bz FROM k GROUP BY 1, 2, 3), j AS (SELECT * FROM k JOIN old USING (ix, iy, iz) JOIN b USING (ix, iy, iz)), {peak_sql('j')}, w AS (SELECT *, {_SW} AS w FROM pk), "
      "g AS (SELECT ix, iy, iz, n, " + ", ".join(STATS) + ", bx AS b_mx, by_ AS b_my, bz AS b_mz, count(*) AS m, " + ", ".join(f"sum((1-w)*({a}-{ba})*({b}-{bb})+w*(coalesce(peak_{a}, m{a})-m{a})*(coalesce(peak_{b}, m{b})-m{b})) AS q{k}" for k, (a, ba, b, bb) in enumerate((("x", "bx", "x", "bx"), ("x", "bx", "y", "by_"), ("x", "bx", "z", "bz"), ("y", "by_", "y", "by_"), ("y", "by_", "z", "bz"), ("z", "bz", "z", "bz")))) + " FROM w GROUP BY ALL) "
      f"SELECT ix, iy, iz, n+m AS n, {', '.join(rnd(f'(n*{c}+m*b_{c})/(n+m)', c) for c in ('mx', 'my', 'mz'))}, " + ", ".join(rnd(f"((n-1)*{c}+q{k}+n*m/(n+m)*(b_m{c[1]}-m{c[1]})*(b_m{c[2]}-m{c[2]}))/(n+m-1)", c) for k, c in enumerate(COV)) + " FROM g")
def cell_surface_estimate(spark, sf):
    old, new = old_new(spark, sf)
    return rounded(U.surface_estimate(old.withColumn("occ", F.col("n") * O.HIT), new, SIZE, least=12), *STATS)


@plan(f"WITH {CLOUD}, {cells_sql(by='scan_id')} SELECT ix, iy, iz, least(CAST(sum(n) AS BIGINT), 40) AS n, {', '.join(rnd(f'sum(n*{m})/sum(n)', m) for m in ('mx', 'my', 'mz'))}, {_MERGE} FROM cells GROUP BY ix, iy, iz")
def capped_merge(spark, sf):
    return rounded(U.capped(C.merge(cells(spark, sf, ("scan_id",))), 40), *STATS)


@plan(f"WITH {CLOUD}, b AS (SELECT {KEYS}, scan_id, avg((pid % 256)/255.0::DOUBLE) AS r, avg((pid % 64)/63.0::DOUBLE) AS g FROM cloud GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY ix, iy, iz ORDER BY scan_id)-1 AS k, count(*) OVER (PARTITION BY ix, iy, iz)-1 AS m FROM b) SELECT ix, iy, iz, count(*) AS batches, {rnd('sum(pow(0.9, m-k)*CASE WHEN k > 0 THEN 0.1 ELSE 1 END*r)', 'r', 4)}, {rnd('sum(pow(0.9, m-k)*CASE WHEN k > 0 THEN 0.1 ELSE 1 END*g)', 'g', 4)} FROM k GROUP BY ix, iy, iz")
def cell_colour_blend(spark, sf):
    points = cloud(spark, sf).withColumns({"r": F.col("pid") % 256 / 255.0, "g": F.col("pid") % 64 / 63.0})
    return rounded(U.blended_colours(points, SIZE, "scan_id", ("r", "g")), "r", "g", digits=4)


def steps_sql(source: str, by: str = "pid") -> str:
    """Relations ending in ``steps``: the cells that lines from the origin to x, y, z cross (with by, len)."""
    n = f"CAST(floor(len/{SIZE}) AS INTEGER)"
    at = ", ".join(f"0.0+({a}-0.0)/len*step*{SIZE} AS p{a}" for a in "xyz")
    return (f"st AS (SELECT *, sqrt(x*x+y*y+z*z) AS len FROM {source}), ex AS (SELECT *, unnest(range(1, {n} - 1)) AS step FROM st WHERE {n} > 2), pt AS (SELECT *, {at} FROM ex), "
            f"kk AS (SELECT * EXCLUDE (px, py, pz), {', '.join(key_sql('p' + a) + f' AS i{a}' for a in 'xyz')} FROM pt), lg AS (SELECT *, lag(ix) OVER w AS lx, lag(iy) OVER w AS ly, lag(iz) OVER w AS lz FROM kk WINDOW w AS (PARTITION BY {by} ORDER BY step)), "
            "steps AS (SELECT * EXCLUDE (lx, ly, lz) FROM lg WHERE lx IS NULL OR lx <> ix OR ly <> iy OR lz <> iz)")


_RAYS = "rays AS (SELECT pid, x*4 AS x, y*4 AS y, z*4 AS z FROM cloud)"
_SEEN = f"peak*(1-exp(-0.5*{_D}*{_D}/((0.5*len/30+0.06)**2)))"
_EVID = f"cr AS (SELECT * FROM steps LEFT JOIN cells USING (ix, iy, iz)), {peak_sql('cr')}, ev AS (SELECT ix, iy, iz, pid, CASE WHEN mx IS NULL THEN -0.2 WHEN {_SEEN} < 0.3 THEN 0 ELSE ln((1-(0.1*{_SEEN}+0.5))/(0.1*{_SEEN}+0.5)) END AS e FROM pk)"


@plan(f"WITH {CLOUD}, {FIRM}, {_RAYS}, {steps_sql('rays')}, {_EVID} SELECT ix, iy, iz, count(*) AS rays, {rnd('sum(e)', 'evidence', 4)} FROM ev GROUP BY 1, 2, 3")
def ray_evidence(spark, sf):
    return rounded(O.ray_evidence(rays(spark, sf, "true"), firm(spark, sf), SIZE, ("pid",)), "evidence", digits=4)


@plan(f"WITH {CLOUD}, {FIRM}, {_RAYS}, {steps_sql('rays')}, {_EVID}, s AS (SELECT ix, iy, iz, sum(e) AS e FROM ev GROUP BY 1, 2, 3) SELECT ix, iy, iz, coalesce(n, 0) AS n, {rnd('greatest(-255, least(255, coalesce(n, 0)*ln(0.6/0.4)+coalesce(e, 0)))', 'occ', 4)} FROM cells FULL JOIN s USING (ix, iy, iz)")
def occupancy_update(spark, sf):
    own = firm(spark, sf)
    return rounded(O.updated(own, O.ray_evidence(rays(spark, sf, "true"), own, SIZE, ("pid",))), "occ", digits=4)


@plan(f"WITH {CLOUD}, {FIRM}, {_RAYS}, {steps_sql('rays')}, {_EVID} SELECT pid, count(*) AS cells, {rnd('sum(e)', 'evidence', 4)} FROM ev GROUP BY pid")
def measurement_evidence(spark, sf):
    return rounded(O.measurement_evidence(rays(spark, sf, "true"), firm(spark, sf), SIZE, ("pid",)), "evidence", digits=4)


@plan(f"WITH {CLOUD}, k AS (SELECT {KEYS} FROM cloud WHERE z <= 0.1) SELECT ix, iy, iz, count(*) AS n FROM k GROUP BY 1, 2, 3")
def plain_insertion(spark, sf):
    return C.binned(C.valid_points(cloud(spark, sf), max_z=0.1), SIZE).groupBy(*C.KEY).agg(F.count("*").alias("n"))


@plan(f"WITH {CLOUD}, {_RAYS}, {steps_sql('rays')}, h AS (SELECT ix, iy, iz, count(*) AS hits FROM (SELECT {KEYS} FROM rays) GROUP BY 1, 2, 3), m AS (SELECT ix, iy, iz, count(*) AS misses FROM steps GROUP BY 1, 2, 3) SELECT ix, iy, iz, coalesce(hits, 0) AS hits, coalesce(misses, 0) AS misses, {rnd('greatest(-255, least(255, coalesce(hits, 0)*ln(0.6/0.4)-0.2*coalesce(misses, 0)))', 'occ')} FROM h FULL JOIN m USING (ix, iy, iz)")
def hit_miss_map(spark, sf):
    return rounded(O.hit_miss(rays(spark, sf, "true"), SIZE, ("pid",)), "occ")


_LOCAL = "loc AS (SELECT scan_id, ix AS jx, iy AS jy, iz AS jz, n AS ray_n, mx AS x, my AS y, mz AS z FROM lc)"
_FAR = "sqrt(peak_x**2+peak_y**2+peak_z**2)"
_ML = f"(0.2*peak*(1-exp(-0.5*{_D}*{_D}/((0.5*{_FAR}/30+0.06)**2)))+0.5)"
_ME = (f"{cells_sql('cells', OLD, least=8)}, {cells_sql('lc', NEW, by='scan_id')}, {_LOCAL}, {steps_sql('loc', 'scan_id, jx, jy, jz')}, cr AS (SELECT * FROM steps LEFT JOIN cells USING (ix, iy, iz)), {peak_sql('cr')}, "
       f"ev AS (SELECT ix, iy, iz, CASE WHEN mx IS NULL THEN -0.85*ray_n WHEN coalesce({_FAR} > len, false) THEN 0 ELSE ray_n*ln((1-{_ML})/{_ML}) END AS e FROM pk)")


@plan(f"WITH {CLOUD}, {_ME} SELECT ix, iy, iz, count(*) AS rays, {rnd('sum(e)', 'evidence', 4)} FROM ev GROUP BY 1, 2, 3")
def mean_evidence(spark, sf):
    old, new = old_new(spark, sf)
    own = C.fit(new, SIZE, ("scan_id",)).withColumn("_ray", F.struct("scan_id", *C.KEY)).select("_ray", "n", *C.MEAN)
    return rounded(U.mean_evidence(own, old, SIZE, ("_ray",)), "evidence", digits=4)


@plan(f"WITH {CLOUD}, {_ME}, s AS (SELECT ix, iy, iz, sum(e) AS e FROM ev GROUP BY 1, 2, 3), h AS (SELECT ix, iy, iz, sum(n) AS hits FROM lc GROUP BY 1, 2, 3), u AS (SELECT ix, iy, iz, n FROM cells UNION ALL SELECT ix, iy, iz, n FROM lc), w AS (SELECT ix, iy, iz, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1, 2, 3) SELECT ix, iy, iz, n, {rnd('greatest(-255, least(255, coalesce(hits, 0)*ln(0.6/0.4)+coalesce(e, 0)))', 'occ', 4)} FROM w LEFT JOIN h USING (ix, iy, iz) LEFT JOIN s USING (ix, iy, iz)")
def mean_update(spark, sf):
    old, new = old_new(spark, sf)
    return rounded(U.mean_update(old, new, SIZE, "scan_id").select(*C.KEY, "n", "occ"), "occ", digits=4)


_BIG = ", ".join(f"{key_sql('m' + a, 0.2)} AS j{a}" for a in "xyz")


@plan(f"WITH {CLOUD}, {CELLS}, b AS (SELECT *, {_BIG} FROM cells) SELECT jx AS ix, jy AS iy, jz AS iz, CAST(sum(n) AS BIGINT) AS n, {', '.join(rnd(f'sum(n*{m})/sum(n)', m) for m in ('mx', 'my', 'mz'))}, {_MERGE} FROM b GROUP BY jx, jy, jz")
def rebinned_cells(spark, sf):
    return rounded(U.rebinned(cells(spark, sf), 0.2), *STATS)


_HIT = f"cr AS (SELECT * FROM steps JOIN cells USING (ix, iy, iz)), {peak_sql('cr')}"


@plan(f"WITH {CLOUD}, {FIRM}, {_RAYS}, {steps_sql('rays')}, {_HIT}, f AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY step) AS rn FROM pk WHERE peak > 0.1) SELECT r.pid, {rnd(f'CASE WHEN f.pid IS NULL THEN sqrt(r.x**2+r.y**2+r.z**2)+1 ELSE sqrt(peak_x**2+peak_y**2+peak_z**2) END', 'depth', 5)} FROM rays r LEFT JOIN (SELECT * FROM f WHERE rn = 1) f ON f.pid = r.pid")
def ray_depth(spark, sf):
    return rounded(O.ray_depth(rays(spark, sf, "true"), firm(spark, sf), SIZE, "pid"), "depth", digits=5)


_AROUND = " AND ".join(f"c.i{a} BETWEEN p.i{a}-1 AND p.i{a}+1" for a in "xyz")
_LIK2 = "greatest(-1, coalesce(exp(-0.5*" + quadratic_sql(("p.peak_x-c.mx", "p.peak_y-c.my", "p.peak_z-c.mz"), inverse_sql(["c." + c for c in COV])) + "), -1))"


@plan(f"WITH {CLOUD}, {FIRM}, {_RAYS}, {steps_sql('rays')}, {_HIT}, sm AS (SELECT p.pid, p.step, p.peak_x, p.peak_y, p.peak_z, p.peak + 5*coalesce(sum(CASE WHEN c.ix = p.ix AND c.iy = p.iy AND c.iz = p.iz THEN 0 ELSE {_LIK2} END), 0) AS lik FROM pk p JOIN cells c ON {_AROUND} GROUP BY p.pid, p.step, p.peak_x, p.peak_y, p.peak_z, p.peak), f AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY step) AS rn FROM sm WHERE lik > 0.2) "
      f"SELECT r.pid, {rnd(f'CASE WHEN f.pid IS NULL THEN sqrt(r.x**2+r.y**2+r.z**2)+1 ELSE sqrt(peak_x**2+peak_y**2+peak_z**2) END', 'depth', 5)} FROM rays r LEFT JOIN (SELECT * FROM f WHERE rn = 1) f ON f.pid = r.pid")
def smooth_ray_depth(spark, sf):
    return rounded(O.ray_depth(rays(spark, sf, "true"), firm(spark, sf), SIZE, "pid", threshold=0.2, smooth=5.0), "depth", digits=5)


_VIEW = "rays AS (SELECT CAST(i AS BIGINT) AS pid, (i % 32-15.5)/40.0*2.0 AS x, (i // 32-11.5)/40.0*2.0 AS y, 2.0::DOUBLE AS z FROM (SELECT unnest(range(32*24)) AS i))"


@plan(f"WITH {CLOUD}, {FIRM}, {_VIEW}, {steps_sql('rays')}, {_HIT}, f AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY step) AS rn FROM pk WHERE peak > 0.1) SELECT CAST(r.pid % 32 AS INTEGER) AS u, CAST(r.pid // 32 AS INTEGER) AS v, {rnd('CASE WHEN f.pid IS NULL THEN sqrt(r.x**2+r.y**2+r.z**2)+1 ELSE sqrt(peak_x**2+peak_y**2+peak_z**2) END', 'depth', 5)} FROM rays r LEFT JOIN (SELECT * FROM f WHERE rn = 1) f ON f.pid = r.pid")
def depth_view(spark, sf):
    return rounded(O.depth_view(firm(spark, sf), SIZE, 32, 24, 40.0, 2.0), "depth", digits=5)
