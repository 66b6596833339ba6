"""Plans of extents, groups, predicates, split tests and small column functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import cells as C
from ..operators import extents as X
from ..operators import joins as J
from ..operators import occupancy as O
from .motion import _REL, _L, _PAIRS, pairs
from .registry import CELLS, CLOUD, FIRM, FITS, FORM, KEYS, POSES, ROUND_STATS, SIZE, STATS, cells, cells_sql, cloud, firm, plan, poses, rnd, rounded, table
from .spatial import _DIST, _EV, _KEYED, _ON, rates

#: Eigenvalues l0 <= l1 <= l2 of a cell's covariance in DuckDB, as columns of a relation ``eig`` over ``cells``.
EIG = """eq AS (SELECT *, (cxx+cyy+czz)/3 AS q FROM cells), ep AS (SELECT *, sqrt(((cxx-q)**2+(cyy-q)**2+(czz-q)**2+2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) AS p FROM eq),
er AS (SELECT *, acos(greatest(-1, least(1, (((cxx-q)/p)*(((cyy-q)/p)*((czz-q)/p)-(cyz/p)*(cyz/p)) - (cxy/p)*((cxy/p)*((czz-q)/p)-(cyz/p)*(cxz/p)) + (cxz/p)*((cxy/p)*(cyz/p)-((cyy-q)/p)*(cxz/p)))/2)))/3 AS phi FROM ep),
es AS (SELECT *, q+2*p*cos(phi+2*3.141592653589793/3) AS l0, q+2*p*cos(phi) AS l2 FROM er), eig AS (SELECT *, 3*q-l2-l0 AS l1 FROM es)"""
UP = "sqrt(greatest(0, least(1, ((cxx-l0)*(cyy-l0)-cxy*cxy)/((l1-l0)*(l2-l0)))))"
KIND = f"CASE WHEN greatest(l0, l2/100) > 0.1 THEN 'ROUGH' WHEN {UP} < 0.17364817766693041 THEN 'VERTICAL' WHEN {UP} > 1-0.17364817766693041 THEN 'HORIZONTAL' ELSE 'INCLINED' END"
_BITS = "bits AS (SELECT user_id, max(event_id) AS history FROM events GROUP BY user_id)"
_PO = "1-1/(1+exp(bit_count(history & 65535)*ln(0.6/0.4)+(16-bit_count(history & 65535))*ln(0.3/0.7)))"


@plan(f"WITH {CLOUD}, {FIRM}, {EIG} SELECT ix, iy, iz, {KIND} AS class FROM eig WHERE l0 > 0")
def cell_kinds(spark, sf):
    return C.with_kind(firm(spark, sf)).select(*C.KEY, "class")


@plan(f"WITH {_EV}, {_BITS}, p AS (SELECT *, {_PO} AS po FROM e JOIN bits USING (user_id)) SELECT user_id, {rnd('CASE WHEN obs < 50 THEN 0.5 ELSE (1-po)*en+po*(1-lv) END', 'now')}, "
      f"{rnd('CASE WHEN obs < 20 THEN 0.5 WHEN 0.5*(1-lv)+0.5*en > 0.6 THEN 0.9 ELSE en/(en+lv)+pow(1-en-lv, 8)*(po-en/(en+lv)) END', 'later')} FROM p")
def occupancy_prediction(spark, sf):
    history = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("history"))
    p = rates(spark, sf).join(history, "user_id").withColumn("po", O.short_term(F.col("history"), 16))
    made = O.predicted(F.col("en"), F.col("lv"), F.col("obs"), F.col("po"), 3)
    return rounded(p.select("user_id", *(c.alias(n) for c, n in zip(made, ("now", "later")))), "now", "later")


@plan("WITH k AS (SELECT c_custkey, c_custkey % 13 AS n, c_custkey % 13 % 5 AS i, (c_custkey % 9 + 1)/10.0::DOUBLE AS p FROM customer) SELECT c_custkey, CAST(factorial(CAST(n AS INTEGER)) AS BIGINT) AS fac, "
      f"CAST(coalesce(list_product(list_filter(range(1, n+1), lambda k: (n-k) % 2 = 0)), 1) AS BIGINT) AS dfac, {rnd('CASE WHEN i <= n THEN factorial(CAST(n AS INTEGER))/(factorial(CAST(i AS INTEGER))*factorial(CAST(n-i AS INTEGER)))::DOUBLE*pow(p, i)*pow(1-p, n-i) END', 'binomial')}, {rnd('p*0.7/(p*0.7+(1-p)*0.3)', 'bayes')}, {rnd('greatest(0.25, least(0.75, p))', 'clamped')} FROM k")
def probability_helpers(spark, sf):
    k = F.col("c_custkey")
    n, i, p = (k % 13).cast("int"), (k % 13 % 5).cast("int"), (k % 9 + 1) / 10.0
    c = table(spark, sf, "customer").select("c_custkey", F.factorial(n).alias("fac"), X.double_factorial(n).alias("dfac"), F.when(i <= n, X.binomial(n, i, p)).alias("binomial"), X.bayes(p, F.lit(0.7)).alias("bayes"), X.clamp(p, 0.25, 0.75).alias("clamped"))
    return rounded(c, "binomial", "bayes", "clamped")


@plan(f"WITH {CLOUD} SELECT pid, {', '.join(rnd(e, f's{k}') for k, e in enumerate(('0.0::DOUBLE', '-z', 'y', 'z', '0.0::DOUBLE', '-x', '-y', 'x', '0.0::DOUBLE')))} FROM cloud")
def skew_matrices(spark, sf):
    names = [f"s{k}" for k in range(9)]
    return rounded(cloud(spark, sf).select("pid", *(c.alias(n) for c, n in zip(X.skew(C.columns(G.AXES)), names))), *names)


@plan(f"WITH {CLOUD}, p AS (SELECT pid, CAST(floor((x-0.05)/0.02)+40 AS INTEGER) AS i, CAST(floor((y+0.05)/0.02)+30 AS INTEGER) AS j FROM cloud) SELECT pid, i, j, {rnd('(i-40)*0.02+0.05', 'wx')}, {rnd('(j-30)*0.02-0.05', 'wy')} FROM p")
def raster_pixels(spark, sf):
    at = (0.02, (0.05, -0.05), (40, 30))
    i, j = X.to_pixel(F.col("x"), F.col("y"), *at)
    out = cloud(spark, sf).select("pid", i.alias("i"), j.alias("j"))
    wx, wy = X.to_world(F.col("i"), F.col("j"), *at)
    return rounded(out.select("*", wx.alias("wx"), wy.alias("wy")), "wx", "wy")


@plan(f"WITH {CLOUD} SELECT scan_id, count(*) AS n, {', '.join(rnd(f'sum({a}*2.5)', 's' + a) for a in 'xyz')} FROM cloud GROUP BY scan_id")
def scaled_object(spark, sf):
    moved = C.transform_points(cloud(spark, sf), (2.5, 0, 0, 0, 0, 2.5, 0, 0, 0, 0, 2.5, 0))
    return rounded(moved.groupBy("scan_id").agg(F.count("*").alias("n"), *(F.sum(a).alias("s" + a) for a in G.AXES)), "sx", "sy", "sz")


@plan(f"SELECT c_custkey AS id, {rnd('(c_custkey % 64)*0.5::DOUBLE', 'u')}, {rnd('(c_custkey % 48)*0.5::DOUBLE', 'v')}, {rnd('(c_custkey % 7 + 1)*1.5::DOUBLE', 'size')} FROM customer")
def scaled_key_points(spark, sf):
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("id"), (k % 64 * 1.0).alias("u"), (k % 48 * 1.0).alias("v"), (k % 7 + 1.0).alias("size"))
    return rounded(p.select("id", (F.col("u") * 0.5).alias("u"), (F.col("v") * 0.5).alias("v"), (F.col("size") * 1.5).alias("size")), "u", "v", "size")


@plan(f"WITH {CLOUD}, {FIRM}, {EIG}, k AS (SELECT *, {KIND} AS class FROM eig WHERE l0 > 0), c AS (SELECT ix, iy, iz, CASE class WHEN 'ROUGH' THEN 1.0 ELSE 0.0 END AS r, CASE class WHEN 'HORIZONTAL' THEN 1.0 WHEN 'INCLINED' THEN 0.5 ELSE 0.0 END AS g, CASE class WHEN 'VERTICAL' THEN 1.0 WHEN 'INCLINED' THEN 0.5 ELSE 0.0 END AS b, greatest(0, least(1, (mz+1)/2)) AS h, 1-1/(1+exp(least(5, n*ln(0.6/0.4)))) AS o FROM k) "
      f"SELECT ix, iy, iz, {', '.join(rnd(f'CAST({e} AS DOUBLE)', n) for e, n in (('r', 'class_r'), ('g', 'class_g'), ('b', 'class_b'), ('h', 'height_r'), ('o', 'occ_r')))} FROM c")
def cell_colours(spark, sf):
    own = C.with_kind(firm(spark, sf)).withColumn("occ", F.least(F.lit(5.0), F.col("n") * O.HIT))
    out = X.cell_colour(own, "class").withColumnsRenamed({"r": "class_r", "g": "class_g", "b": "class_b"})
    out = X.cell_colour(out, "height").withColumnRenamed("r", "height_r").drop("g", "b")
    out = X.cell_colour(out, "occupancy").withColumnRenamed("r", "occ_r")
    return rounded(out.select(*C.KEY, "class_r", "class_g", "class_b", "height_r", "occ_r"), "class_r", "class_g", "class_b", "height_r", "occ_r")


@plan(f"WITH {CLOUD} SELECT scan_id, count(*) AS n, {rnd('sum(z)', 'sz')} FROM cloud WHERE z BETWEEN -0.05 AND 0.1 GROUP BY scan_id")
def height_band(spark, sf):
    return rounded(cloud(spark, sf).filter(F.col("z").between(-0.05, 0.1)).groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("z").alias("sz")), "sz")


@plan(f"WITH {CLOUD} SELECT pid, x >= -0.1 AND x < 0.1 AND y >= -0.2 AND y < 0.1 AND z >= 0 AND z < 0.3 AS inside FROM cloud")
def points_in_box(spark, sf):
    return cloud(spark, sf).select("pid", X.in_box(C.columns(G.AXES), (-0.1, -0.2, 0.0), (0.1, 0.1, 0.3)).alias("inside"))


_GAP = "+".join(f"greatest(({k}-0.5)*0.1-({c}), 0, {c}-({k}+0.5)*0.1)**2" for k, c in (("ix", "0.1"), ("iy", "0.05"), ("iz", "-0.1")))


@plan(f"WITH {CLOUD}, {CELLS} SELECT ix, iy, iz FROM cells WHERE {_GAP} <= 0.257*0.257")
def cells_meeting_sphere(spark, sf):
    low, high = ([(F.col(k) + s) * SIZE for k in C.KEY] for s in (-0.5, 0.5))
    return cells(spark, sf).filter(X.sphere_meets_box((0.1, 0.05, -0.1), 0.257, low, high)).select(*C.KEY)


@plan(f"WITH {CLOUD}, k AS (SELECT CAST(floor(x/0.4) AS INTEGER) AS ix, CAST(floor(y/0.4) AS INTEGER) AS iy, CAST(floor(z/0.4) AS INTEGER) AS iz, count(*) AS n, max(x)-min(x) AS w FROM cloud GROUP BY 1, 2, 3) SELECT ix, iy, iz, n FROM k WHERE w <= 0.3")
def cells_below_size(spark, sf):
    keys = [F.floor(F.col(a) / 0.4).cast("int").alias("i" + a) for a in G.AXES]
    own = cloud(spark, sf).groupBy(*keys).agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"))
    return own.filter("w <= 0.3").select(*C.KEY, "n")


@plan(f"WITH {CLOUD} SELECT pid, {', '.join(rnd(f'{a}*100', a) for a in 'xyz')} FROM cloud WHERE pid % 20 = 0")
def thinned_cloud(spark, sf):
    kept = cloud(spark, sf).filter("pid % 20 = 0")
    return rounded(kept.select("pid", *((F.col(a) * 100).alias(a) for a in G.AXES)), *G.AXES)


@plan(f"WITH {POSES}, {_PAIRS}, {_L}, {_REL} SELECT robot_id, count(*) AS kept FROM r WHERE sqrt((e0-t0)**2+(e1-t1)**2) <= 0.025 AND abs(atan2(sin(e2-t2), cos(e2-t2))) <= 0.0025 GROUP BY robot_id")
def consistent_steps(spark, sf):
    w = Window.partitionBy("robot_id").orderBy("seq")
    p = pairs(spark, sf)
    ahead = {c: F.lead(c, 3).over(w) for c in ("x", "y", "yaw", "ex", "ey", "eyaw")}
    o = G.difference2(*(F.col(c) for c in ("x", "y", "yaw")), *(ahead[c] for c in ("x", "y", "yaw")))
    e = G.difference2(*(F.col(c) for c in ("ex", "ey", "eyaw")), *(ahead[c] for c in ("ex", "ey", "eyaw")))
    steps = p.select("robot_id", *(c.alias(n) for c, n in zip((*o, *e), ("ox", "oy", "oa", "ex", "ey", "ea")))).filter("ox is not null")
    return X.consistent(steps, 0.025, 0.0025).groupBy("robot_id").agg(F.count("*").alias("kept"))


@plan("WITH k AS (SELECT c_custkey, c_custkey % 7 AS x1, c_custkey % 11 AS y1, c_custkey % 5 AS x2, c_custkey % 13 AS y2, c_custkey % 17 AS px, c_custkey % 19 AS py, c_custkey % 3 AS cx, c_custkey % 23 AS cy FROM customer) SELECT c_custkey, (px*(y2-y1)+py*(x1-x2))*(cx*(y2-y1)+cy*(x1-x2)) > 0 AS convex FROM k")
def convex_sides(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.convex_side(*(F.col("c_custkey") % m for m in (7, 11, 5, 13, 17, 19, 3, 23))).alias("convex"))


_SNAP = f"s AS (SELECT scan_id, {', '.join(f'0.013+floor((avg({a})-0.013)/0.1)*0.1 AS c{a}' for a in 'xyz')} FROM cloud GROUP BY scan_id)"


@plan(f"WITH {CLOUD}, {_SNAP} SELECT scan_id, {', '.join(f'CAST(floor(({a}-c{a})/0.1+0.5) AS INTEGER) AS i{a}' for a in 'xyz')}, count(*) AS n FROM cloud JOIN s USING (scan_id) GROUP BY ALL")
def aligned_cells(spark, sf):
    return X.aligned_load(cloud(spark, sf), ("scan_id",), SIZE, (0.013, 0.013, 0.013)).groupBy("scan_id", *C.KEY).agg(F.count("*").alias("n"))


@plan(f"WITH {CLOUD}, g AS (SELECT pid % 50 AS cell_id, pid FROM cloud UNION ALL SELECT 50 + pid % 5, pid FROM cloud WHERE pid % 7 = 0) SELECT cell_id, n, {ROUND_STATS} FROM (SELECT cell_id, {FITS} FROM g JOIN cloud USING (pid) GROUP BY cell_id)")
def grouped_cells(spark, sf):
    points = cloud(spark, sf)
    groups = points.select((F.col("pid") % 50).alias("cell_id"), "pid").union(points.filter("pid % 7 = 0").select((50 + F.col("pid") % 5).alias("cell_id"), "pid"))
    return rounded(X.grouped_fit(points, groups, "cell_id", "pid"), *STATS)


@plan(f"WITH {CLOUD}, {cells_sql('cells', by='scan_id')}, e AS (SELECT scan_id, {', '.join(f'min(i{a}) AS l{a}, max(i{a}) AS h{a}' for a in 'xyz')} FROM cells GROUP BY scan_id), d AS (SELECT scan_id, ix, iy, unnest(range(lz, hz+1)) AS iz FROM (SELECT *, unnest(range(ly, hy+1)) AS iy FROM (SELECT *, unnest(range(lx, hx+1)) AS ix FROM e))) SELECT scan_id, count(*) AS cells, count(n) AS filled FROM d LEFT JOIN cells USING (scan_id, ix, iy, iz) GROUP BY scan_id")
def dense_cells(spark, sf):
    return X.dense(cells(spark, sf, ("scan_id",)), ("scan_id",)).groupBy("scan_id").agg(F.count("*").alias("cells"), F.count_if(F.col("n") > 0).alias("filled"))


@plan(f"WITH {CLOUD}, c AS (SELECT scan_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM cloud GROUP BY scan_id), e AS (SELECT scan_id, cx, cy, cz, 4*max(sqrt((x-cx)**2+(y-cy)**2+(z-cz)**2)) AS side, 3*(max(z)-min(z)) AS height, count(*) AS n FROM cloud JOIN c USING (scan_id) GROUP BY ALL) SELECT scan_id, n, {', '.join(rnd(c, c) for c in ('cx', 'cy', 'cz', 'side', 'height'))}, CAST(ceil(side/0.1) AS INTEGER) AS cells_x, CAST(ceil(side/0.1) AS INTEGER) AS cells_y, CAST(ceil(height/0.1) AS INTEGER) AS cells_z FROM e")
def guessed_extent(spark, sf):
    return rounded(X.guessed_extent(cloud(spark, sf), ("scan_id",), SIZE), "cx", "cy", "cz", "side", "height")


@plan(f"WITH {CLOUD}, {FIRM}, {EIG} SELECT ix, iy, iz, l0*10 < l1 AS flat FROM eig")
def flat_cells(spark, sf):
    return C.with_eigenvalues(firm(spark, sf)).select(*C.KEY, X.flat().alias("flat"))


@plan(f"WITH {CLOUD}, k AS (SELECT *, {KEYS} FROM cloud), m AS (SELECT ix, iy, iz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM k GROUP BY 1, 2, 3 HAVING count(*) >= 4), r AS (SELECT ix, iy, iz, {_DIST} AS r FROM k JOIN m USING (ix, iy, iz)) SELECT ix, iy, iz, count(*) AS n, {rnd('sum(r*r)/var_samp(r)+ln(count(*))', 'bic', 4)} FROM r GROUP BY 1, 2, 3")
def cell_bic(spark, sf):
    return rounded(X.residual_bic(cloud(spark, sf), SIZE), "bic", digits=4)


def _level(k: int) -> str:
    side = 0.8 / 2**k
    keys = ", ".join(f"CAST(floor({a}/{side}) AS INTEGER) AS i{a}" for a in "xyz")
    inner = EIG.replace("FROM cells)", f"FROM f{k})").replace("eq AS", f"q{k} AS").replace("FROM eq", f"FROM q{k}").replace("ep AS", f"p{k} AS").replace("FROM ep", f"FROM p{k}").replace("er AS", f"r{k} AS").replace("FROM er", f"FROM r{k}").replace("es AS", f"s{k} AS").replace("FROM es", f"FROM s{k}").replace("eig AS", f"g{k} AS")
    up = "true" if k == 0 else f"EXISTS (SELECT 1 FROM o{k - 1} p WHERE p.sp AND {' AND '.join(f'p.i{a} = CAST(floor(g.i{a}/2) AS INTEGER)' for a in 'xyz')})"
    return f"f{k} AS (SELECT {keys}, {FITS} FROM cloud GROUP BY 1, 2, 3), {inner}, o{k} AS (SELECT g.ix, g.iy, g.iz, g.n, g.n >= 8 AND NOT coalesce(l0*10 < l1, true) AS sp FROM g{k} g WHERE {up})"


@plan(f"WITH {CLOUD}, {', '.join(_level(k) for k in range(4))} " + " UNION ALL ".join(f"SELECT {k} AS level, ix, iy, iz, n FROM o{k}{'' if k == 3 else ' WHERE NOT sp'}" for k in range(4)))
def adaptive_leaves(spark, sf):
    return X.adaptive_leaves(cloud(spark, sf), 0.8, 3)


@plan(f"WITH {CLOUD}, {_KEYED}, {CELLS}, r AS (SELECT pid, c.ix, c.iy, c.iz, CAST(row_number() OVER (PARTITION BY pid ORDER BY {_DIST}, c.ix, c.iy, c.iz) AS INTEGER) AS rank, {_DIST} AS dist FROM k JOIN cells c ON {_ON}) SELECT pid, ix, iy, iz, rank, {rnd('dist', 'dist')} FROM r WHERE rank <= 4")
def four_nearest_cells(spark, sf):
    return rounded(X.four_nearest(cloud(spark, sf), cells(spark, sf), SIZE, "pid"), "dist")


_OWN = "own AS (SELECT ix || ':' || iy || ':' || iz AS name, * FROM cells)"


@plan(f"WITH {CLOUD}, {CELLS}, {_OWN} SELECT a.name AS l_id, b.name AS r_id, {rnd('sqrt((a.mx-b.mx)**2+(a.my-b.my)**2+(a.mz-b.mz)**2)', 'dist')} FROM own a JOIN own b ON sqrt((a.mx-b.mx)**2+(a.my-b.my)**2+(a.mz-b.mz)**2) <= 0.2")
def cells_in_radius(spark, sf):
    own = cells(spark, sf).select(F.concat_ws(":", *C.KEY).alias("name"), *(F.col(m).alias(a) for m, a in zip(C.MEAN, G.AXES)))
    return rounded(J.radius_pairs(own, own, 0.2, "name", "name"), "dist")


@plan(f"WITH {POSES}, c AS (SELECT *, count(*) OVER (PARTITION BY robot_id) AS n, row_number() OVER (PARTITION BY robot_id ORDER BY seq DESC) AS r FROM poses) SELECT robot_id, seq FROM c WHERE n <= 8 OR r = 1")
def trimmed_frames(spark, sf):
    return X.trimmed(poses(spark, sf).select("robot_id", "seq"), ("robot_id",), "seq", 8)


@plan(f"WITH {POSES} SELECT robot_id, seq FROM poses WHERE seq > 3")
def started_frames(spark, sf):
    return X.after_first(poses(spark, sf).select("robot_id", "seq"), ("robot_id",), "seq")


_NEG = "neg AS (SELECT pid, scan_id, x*f AS x, y*f AS y, z*f AS z FROM (SELECT *, greatest(0, (sqrt(x*x+y*y+z*z)-(0.02+(pid % 20)/100.0::DOUBLE))/sqrt(x*x+y*y+z*z)) AS f FROM cloud))"


def negatives(spark, sf):
    return X.pulled_back(cloud(spark, sf), 0.02 + F.col("pid") % 20 / 100.0)


@plan(f"WITH {CLOUD}, {_NEG} SELECT pid, {', '.join(rnd(a, a) for a in 'xyz')} FROM neg")
def negative_points(spark, sf):
    return rounded(negatives(spark, sf).select("pid", *G.AXES), *G.AXES)


@plan(f"WITH {CLOUD}, {FIRM}, {_NEG}, both_ AS (SELECT x, y, z, true AS positive FROM cloud UNION ALL SELECT x, y, z, false FROM neg), k AS (SELECT *, {KEYS} FROM both_), f AS (SELECT positive, round(greatest(0, coalesce(exp(-0.5*{FORM}), -1)), 9) AS s FROM k JOIN cells USING (ix, iy, iz)), b AS (SELECT positive, least(100, floor(s*100)) AS bin FROM f), t AS (SELECT CAST(unnest(range(100)) AS INTEGER) AS threshold) SELECT threshold, count(*) FILTER (positive AND bin > threshold) AS tp, count(*) FILTER (NOT positive AND bin > threshold) AS fp, count(*) FILTER (positive AND bin <= threshold) AS fn, count(*) FILTER (NOT positive AND bin <= threshold) AS tn FROM t, b GROUP BY threshold")
def roc_counts(spark, sf):
    both = cloud(spark, sf).select(*G.AXES, F.lit(True).alias("positive")).union(negatives(spark, sf).select(*G.AXES, F.lit(False)))
    found = J.own_cell(both, firm(spark, sf), SIZE, "inner")
    score = F.round(F.greatest(F.lit(0.0), G.likelihood(C.columns(G.AXES), C.columns(C.MEAN), C.columns(C.COV))), 9)
    return X.roc_counts(found.select(score.alias("s"), "positive"), "s", "positive")


@plan(f"SELECT p_partkey, {rnd('sqrt((p_size/10.0)**2+(p_size % 7/10.0)**2)/2', 'flat_radius')}, {rnd('sqrt((p_size/10.0)**2+(p_size % 7/10.0)**2+(p_size % 5/10.0)**2)/2', 'radius')} FROM part")
def robot_radii(spark, sf):
    x, y, z = F.col("p_size") / 10.0, F.col("p_size") % 7 / 10.0, F.col("p_size") % 5 / 10.0
    return rounded(table(spark, sf, "part").select("p_partkey", (G.norm(x, y) / 2).alias("flat_radius"), (G.norm(x, y, z) / 2).alias("radius")), "flat_radius", "radius")
