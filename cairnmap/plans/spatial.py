"""Plans of spatial joins, evidence and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import cells as C
from ..operators import joins as J
from ..operators import occupancy as O
from ..operators import planning as P
from ..operators.within import neighbour_counts
from .registry import FIRM, firm, CELLS, CLOUD, FORM, KEYS, SIZE, cells, cloud, key_sql, plan, rnd, rounded, table

_ON = " AND ".join(f"c.i{a} BETWEEN k.i{a}-1 AND k.i{a}+1" for a in "xyz")
_KEYED = f"k AS (SELECT *, {KEYS} FROM cloud)"
_DIST = "sqrt((x-mx)**2+(y-my)**2+(z-mz)**2)"


@plan(f"WITH {CLOUD}, {_KEYED}, {CELLS} SELECT pid, coalesce(c.n, 0) AS cell_n FROM k LEFT JOIN cells c USING (ix, iy, iz)")
def own_cell(spark, sf):
    return J.own_cell(cloud(spark, sf), cells(spark, sf), SIZE).select("pid", F.coalesce("n", F.lit(0)).alias("cell_n"))


@plan(f"WITH {CLOUD}, {_KEYED}, {CELLS} SELECT pid, count(*) AS blocks, CAST(sum(c.n) AS BIGINT) AS points FROM k JOIN cells c ON {_ON} GROUP BY pid")
def neighbour_block(spark, sf):
    return J.neighbour_block(cloud(spark, sf), cells(spark, sf), SIZE).groupBy("pid").agg(F.count("*").alias("blocks"), F.sum("n").alias("points"))


_NEAR = f"near AS (SELECT pid, c.ix, c.iy, c.iz, {_DIST} AS dist, row_number() OVER (PARTITION BY pid ORDER BY {_DIST}, c.ix, c.iy, c.iz) AS rn FROM k JOIN cells c ON {_ON})"


@plan(f"WITH {CLOUD}, {_KEYED}, {CELLS}, {_NEAR} SELECT pid, {rnd('dist', 'dist')}, ix, iy, iz FROM near WHERE rn = 1")
def nearest_cell(spark, sf):
    return rounded(J.nearest_cell(cloud(spark, sf), cells(spark, sf), SIZE, ("pid",)), "dist")


@plan(f"WITH {CLOUD}, {_KEYED}, {FIRM}, {_NEAR}, own AS (SELECT pid, ix, iy, iz FROM near WHERE rn = 1), f AS (SELECT p.pid, mx, coalesce(exp(-0.5*{FORM}), -1) AS l FROM cloud p LEFT JOIN own USING (pid) LEFT JOIN cells USING (ix, iy, iz)) SELECT pid, {rnd('CASE WHEN mx IS NULL THEN 0.001 ELSE greatest(0, l) END', 'likelihood', 5)} FROM f")
def map_likelihood(spark, sf):
    return rounded(J.map_likelihood(cloud(spark, sf), firm(spark, sf), SIZE, ("pid",)), "likelihood", digits=5)


_RADIUS = "sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) <= 0.05"


@plan(f"WITH {CLOUD} SELECT a.pid AS l_id, count(*) AS near FROM cloud a JOIN cloud b ON a.scan_id = b.scan_id AND abs(a.x-b.x) <= 0.05 AND {_RADIUS} GROUP BY 1")
def radius_neighbours(spark, sf):
    near = neighbour_counts(cloud(spark, sf), "pid", 0.05, ("scan_id",))
    return near.filter("near > 0").select(F.col("pid").alias("l_id"), "near")


@plan(f"WITH {CLOUD} SELECT a.pid FROM cloud a JOIN cloud b ON a.scan_id = b.scan_id AND a.pid <> b.pid AND abs(a.x-b.x) <= 0.05 AND {_RADIUS} GROUP BY 1 HAVING count(*) >= 3")
def density_filter(spark, sf):
    return J.nth_neighbour_within(cloud(spark, sf), "pid", 0.05, 3, ("scan_id",)).select("pid")


_RAYS = f"""rays AS (SELECT pid, x*4 AS x, y*4 AS y, z*4 AS z FROM cloud),
st AS (SELECT pid, x, y, z, sqrt(x*x+y*y+z*z) AS len FROM rays), ex AS (SELECT *, unnest(range(1, CAST(floor(len/{SIZE}) AS INTEGER) - 1)) AS step FROM st WHERE CAST(floor(len/{SIZE}) AS INTEGER) > 2),
pt AS (SELECT *, {", ".join(f"0.0+({a}-0.0)/len*step*{SIZE} AS p{a}" for a in "xyz")} FROM ex), kk AS (SELECT *, {", ".join(f"{key_sql('p' + a)} AS i{a}" for a in "xyz")} FROM pt),
lg AS (SELECT *, lag(ix) OVER w AS lx, lag(iy) OVER w AS ly, lag(iz) OVER w AS lz FROM kk WINDOW w AS (PARTITION BY pid ORDER BY step)),
steps AS (SELECT * FROM lg WHERE lx IS NULL OR lx <> ix OR ly <> iy OR lz <> iz)"""


def rays(spark, sf, where="true"):
    """Rays from the origin to all points, four times as far, or to some."""
    return cloud(spark, sf).filter(where).select("pid", *(F.lit(0.0).alias("o" + a) for a in G.AXES), *((F.col(a) * 4).alias(a) for a in G.AXES))


@plan(f"WITH {CLOUD}, {_RAYS} SELECT pid, CAST(step AS INTEGER) AS step, ix, iy, iz FROM steps")
def ray_cells(spark, sf):
    return J.ray_cells(rays(spark, sf), SIZE, ("pid",)).select("pid", "step", *C.KEY)


@plan(f"WITH {CLOUD}, {CELLS}, {_RAYS} SELECT s.pid, CAST(coalesce(min(CASE WHEN c.n IS NOT NULL THEN step END), -1) AS INTEGER) AS first_step FROM steps s LEFT JOIN cells c USING (ix, iy, iz) GROUP BY s.pid")
def first_hit(spark, sf):
    hit = J.ray_cells(rays(spark, sf), SIZE, ("pid",)).join(cells(spark, sf), list(C.KEY), "left")
    return hit.groupBy("pid").agg(F.coalesce(F.min(F.when(F.col("n").isNotNull(), F.col("step"))), F.lit(-1)).alias("first_step"))


@plan(f"WITH {CLOUD}, {CELLS}, {_RAYS} SELECT s.ix, s.iy, s.iz, count(*) AS rays, count(c.n) AS in_cells FROM steps s LEFT JOIN cells c USING (ix, iy, iz) GROUP BY ALL")
def ray_crossings(spark, sf):
    hit = J.ray_cells(rays(spark, sf), SIZE, ("pid",)).join(cells(spark, sf), list(C.KEY), "left")
    return hit.groupBy(*C.KEY).agg(F.count("*").alias("rays"), F.count("n").alias("in_cells"))


@plan(f"WITH {CLOUD}, {CELLS} SELECT ix, iy, iz, {rnd('1-1/(1+exp(least(5, n*ln(0.6/0.4))))', 'p')} FROM cells")
def hit_probability(spark, sf):
    return rounded(cells(spark, sf).select(*C.KEY, G.occupancy_probability(F.least(F.lit(5.0), F.col("n") * O.HIT)).alias("p")), "p")


_FOLD = """ev AS (SELECT user_id, event_type = 'click' AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS total FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, total, 1.0::DOUBLE AS ax, 1.0::DOUBLE AS bx, 1.0::DOUBLE AS ae, 1.0::DOUBLE AS be, CAST(0 AS BIGINT) AS h, false AS was FROM ev UNION ALL
SELECT f.user_id, e.rn, f.total, CASE WHEN was THEN least(30000, ax*(5000.0/5001.0)::DOUBLE)+CASE WHEN m THEN 0 ELSE 1 END ELSE ax END, CASE WHEN was THEN least(30000, bx*(5000.0/5001.0)::DOUBLE)+1 ELSE bx END,
  CASE WHEN NOT was THEN least(30000, ae*(5000.0/5001.0)::DOUBLE)+CASE WHEN m THEN 1 ELSE 0 END ELSE ae END, CASE WHEN NOT was THEN least(30000, be*(5000.0/5001.0)::DOUBLE)+1 ELSE be END, ((h << 1) | CAST(m AS BIGINT)) & 65535, m FROM f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1)"""


@plan(f"WITH RECURSIVE {_FOLD} SELECT user_id, total AS observations, {rnd('ax', 'a_exit')}, {rnd('bx', 'b_exit')}, {rnd('ae', 'a_entry')}, {rnd('be', 'b_entry')}, h AS recent, was FROM f WHERE rn = total")
def event_counts(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("m"))
    out = O.event_counts(e, ("user_id",), "event_id", "m").withColumn("recent", F.col("history").bitwiseAND(F.lit(65535))).drop("history")
    return rounded(out, "a_exit", "b_exit", "a_entry", "b_entry")


_EV = "e AS (SELECT user_id, count(*) AS obs, (count(*) FILTER (event_type = 'click') + 1) / (count(*) + 2.0)::DOUBLE AS en, (count(*) FILTER (event_type = 'view') + 1) / (count(*) + 2.0)::DOUBLE AS lv FROM events GROUP BY user_id)"
_POW = "c AS (SELECT *, (en + lv * pow(1-lv-en, 8)) / (lv+en) AS po, (lv + en * pow(1-lv-en, 8)) / (lv+en) AS pf FROM e)"


def rates(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("obs"), F.count_if(F.col("event_type") == "click").alias("c"), F.count_if(F.col("event_type") == "view").alias("v"))
    return e.select("user_id", "obs", ((F.col("c") + 1) / (F.col("obs") + 2.0)).alias("en"), ((F.col("v") + 1) / (F.col("obs") + 2.0)).alias("lv"))


@plan(f"WITH {_EV}, {_POW} SELECT user_id, {rnd('CASE WHEN obs < 20 THEN 0 ELSE greatest(0.001, least(0.999, po*pf/(po*pf+(1-po)*(1-pf)))) END', 'likelihood')} FROM c")
def semi_static_cells(spark, sf):
    return rounded(rates(spark, sf).select("user_id", O.semi_static_likelihood(F.col("lv"), F.col("en"), F.col("obs"), 3).alias("likelihood")), "likelihood")


@plan(f"WITH {_EV} SELECT user_id, {rnd('CASE WHEN obs >= 20 THEN 0.5*(1-lv)+0.5*en ELSE 0.5 END', 'occupied')}, {rnd('CASE WHEN obs >= 20 THEN 1-(0.5*(1-lv)+0.5*en) ELSE 0.5 END', 'free')} FROM e")
def static_likelihood(spark, sf):
    occupied, free = O.static_likelihood(F.col("en"), F.col("lv"), F.col("obs"))
    return rounded(rates(spark, sf).select("user_id", occupied.alias("occupied"), free.alias("free")), "occupied", "free")


@plan(f"SELECT event_id, {rnd('1-1/(1+exp(bit_count(event_id & 65535)*ln(0.6/0.4)+(16-bit_count(event_id & 65535))*ln(0.3/0.7)))', 'p')} FROM events")
def short_term_occupancy(spark, sf):
    return rounded(table(spark, sf, "events").select("event_id", O.short_term(F.col("event_id"), 16).alias("p")), "p")


_E = f"""own AS (SELECT ix || ':' || iy || ':' || iz AS name, ix, iy, iz, mx, my, mz FROM cells),
pr AS (SELECT a.name AS src, b.name AS dst, sqrt((b.mx-a.mx)**2+(b.my-a.my)**2+(b.mz-a.mz)**2) AS d, abs(b.mz-a.mz) AS up, sqrt((b.mx-a.mx)**2+(b.my-a.my)**2) AS flat FROM own a JOIN own b ON a.name <> b.name AND abs(a.ix-b.ix) <= 1 AND abs(a.iy-b.iy) <= 1 AND abs(a.iz-b.iz) <= 1),
edges AS (SELECT src, dst, d + 1 AS cost FROM pr WHERE d <= 0.15 AND up <= greatest(flat, 1e-9))"""


@plan(f"WITH {CLOUD}, {CELLS}, {_E} SELECT src, dst, {rnd('cost', 'cost')} FROM edges")
def transit_edges(spark, sf):
    return rounded(P.transit_edges(cells(spark, sf), SIZE, 0.15), "cost")


def _wave(spark, sf):
    """Costs to the cell at the origin; a cell's tile is that of its key, 16 cells wide."""
    tile = lambda name: F.concat_ws(":", *(F.floor(F.split(name, ":")[k].cast("int") / 16) for k in (0, 1)))
    return P.wavefront(P.transit_edges(cells(spark, sf), SIZE, 0.15), "0:0:0", delta=1.0, tile=tile)


@plan(f"WITH RECURSIVE {CLOUD}, {CELLS}, {_E}, reach(node) AS (SELECT '0:0:0' UNION SELECT e.src FROM reach r JOIN edges e ON e.dst = r.node) SELECT node FROM reach")
def wavefront_reach(spark, sf):
    return _wave(spark, sf).select("node")


@plan(f"WITH RECURSIVE {CLOUD}, {CELLS}, {_E}, wave(node, cost) USING KEY (node) AS (SELECT '0:0:0', 0.0::DOUBLE UNION SELECT e.src, min(w.cost + e.cost) FROM wave w JOIN edges e ON e.dst = w.node LEFT JOIN recurring.wave r ON r.node = e.src WHERE r.cost IS NULL OR w.cost + e.cost < r.cost - 1e-12 GROUP BY e.src) SELECT node, {rnd('cost', 'cost')} FROM wave")
def wavefront_costs(spark, sf):
    return rounded(_wave(spark, sf).select("node", "cost"), "cost")


@plan()
def wavefront_path(spark, sf):
    costs = _wave(spark, sf)
    far = costs.orderBy(F.col("cost").desc(), "node").first()["node"]
    return P.path(costs, far)


def raster(spark, sf):
    """A pixel for every customer, in rows of 40."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(F.floor(k / 40).cast("int").alias("i"), (k % 40).cast("int").alias("j")).withColumn("occ", (7 * F.col("i") + 13 * F.col("j")) % 37 == 0)


_RASTER = "raster AS (SELECT CAST(c_custkey // 40 AS INTEGER) AS i, CAST(c_custkey % 40 AS INTEGER) AS j, (7*(c_custkey // 40)+13*(c_custkey % 40)) % 37 = 0 AS occ FROM customer)"


@plan(f"WITH {_RASTER} SELECT r.i, r.j FROM raster r WHERE NOT EXISTS (SELECT 1 FROM raster o WHERE o.occ AND o.i - r.i IN (0, 1) AND o.j - r.j IN (0, 1))")
def allowed_positions(spark, sf):
    return P.allowed_positions(raster(spark, sf), [(0, 0), (0, 1), (1, 0), (1, 1)])


@plan("WITH l AS (SELECT c_custkey, CAST(c_custkey % 17 AS INTEGER) i0, CAST(c_custkey % 13 AS INTEGER) j0, CAST(c_custkey % 7 AS INTEGER) i1, CAST(c_custkey % 29 AS INTEGER) j1 FROM customer), s AS (SELECT *, unnest(range(greatest(abs(i1-i0), abs(j1-j0)) + 1)) AS step FROM l) SELECT c_custkey, CAST(step AS INTEGER) AS step, CAST(i0 + sign(i1-i0)*least(step, abs(i1-i0)) AS INTEGER) AS i, CAST(j0 + sign(j1-j0)*least(step, abs(j1-j0)) AS INTEGER) AS j FROM s")
def line_pixels(spark, sf):
    k = F.col("c_custkey")
    return P.line_pixels(table(spark, sf, "customer").select("c_custkey", *((k % m).cast("int").alias(n) for n, m in (("i0", 17), ("j0", 13), ("i1", 7), ("j1", 29)))), "c_custkey")


def squares(spark, sf):
    """Axis-parallel rectangles (by nation) as polygons."""
    corner = F.array(*[F.struct(F.lit(k).alias("edge"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    p = table(spark, sf, "nation").select(F.col("n_nationkey").alias("poly"), F.inline(corner))
    return p.select("poly", "edge", (F.col("poly") + F.col("a") * 2.0).alias("x"), (F.col("poly") % 5 + F.col("b") * 3.0).alias("y"))


@plan("WITH c AS (SELECT n_nationkey AS poly, edge, n_nationkey + [0,1,1,0][edge+1]*2.0::DOUBLE AS x, n_nationkey % 5 + [0,0,1,1][edge+1]*3.0::DOUBLE AS y FROM nation, (SELECT unnest(range(4)) AS edge)), n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first(x) OVER w AS fx, first(y) OVER w AS fy FROM c WINDOW w AS (PARTITION BY poly ORDER BY edge)), p AS (SELECT poly, edge, x, y, coalesce(nx, fx) AS nx, coalesce(ny, fy) AS ny FROM n) SELECT poly, CAST(edge AS INTEGER) AS edge, ny-y AS a0, x-nx AS a1, (ny-y)*x+(x-nx)*y AS b FROM p")
def half_planes(spark, sf):
    return P.half_planes(squares(spark, sf), "poly")


@plan("SELECT c_custkey, c_nationkey AS poly FROM customer WHERE (c_custkey % 30) * 1.0 BETWEEN c_nationkey AND c_nationkey + 2 AND (c_custkey % 11) * 1.0 BETWEEN c_nationkey % 5 AND c_nationkey % 5 + 3")
def inside_polygons(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("poly"), (F.col("c_custkey") % 30 * 1.0).alias("x"), (F.col("c_custkey") % 11 * 1.0).alias("y"))
    return P.inside(c, P.half_planes(squares(spark, sf), "poly"), "poly", "c_custkey")
