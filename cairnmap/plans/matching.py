"""Plans of registration: full derivatives, point-to-cell sums, score surfaces, shape and direction histograms, pose graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import registration as R
from .cells import _BINV, _BLOCK, _DX, _PAIR, _SRC, _TGT, _p2d, halves
from .extents import EIG
from .registry import CLOUD, COV, KEYS, SIZE, cells, cells_sql, cloud, inverse_sql, key_sql, plan, quadratic_sql, rnd, rounded

_J = [["1", "0", "0"], ["0", "1", "0"], ["0", "0", "1"], ["0", "-my", "mx"], ["mz", "0", "-mx"], ["-my", "mx", "0"]]
_J[3] = ["0", "-mz", "my"]
_Z = [
    [["0", "-cxz", "cxy"], ["-cxz", "-2*cyz", "cyy-czz"], ["cxy", "cyy-czz", "2*cyz"]],
    [["2*cxz", "cyz", "czz-cxx"], ["cyz", "0", "-cxy"], ["czz-cxx", "-cxy", "-2*cxz"]],
    [["-2*cxy", "cxx-cyy", "-cyz"], ["cxx-cyy", "2*cxy", "cxz"], ["-cyz", "cxz", "0"]],
]
_AT = [[0, 1, 2], [1, 3, 4], [2, 4, 5]]


def _q(i: int) -> str:
    flat = "2*(" + "+".join(f"v{a}*({_J[i][a]})" for a in range(3)) + ")"
    return flat if i < 3 else flat + "-(" + "+".join(f"v{a}*({_Z[i - 3][a][c]})*v{c}" for a in range(3) for c in range(3)) + ")"


def _h(i: int, j: int) -> str:
    terms = [f"({_J[i][a]})*b{_AT[a][c]}*({_J[j][c]})" for a in range(3) for c in range(3) if _J[i][a] != "0" and _J[j][c] != "0"]
    return "2*(" + "+".join(terms) + ")"


_TERMS = (f"pr AS (SELECT s.mx, s.my, s.mz, {', '.join('s.' + c for c in COV)}, {', '.join(f'{d} AS x{k}' for k, d in enumerate(_DX))}, {', '.join(f'{e} AS b{k}' for k, e in enumerate(_BINV))}, {_PAIR} AS l FROM src s JOIN tgt t ON {_BLOCK}), "
          f"vv AS (SELECT *, {', '.join('+'.join(f'b{_AT[r][c]}*x{c}' for c in range(3)) + f' AS v{r}' for r in range(3))}, 0.025*exp(-0.025*l) AS gain FROM pr WHERE l IS NOT NULL AND NOT isnan(l))")
_HS = [(i, j) for i in range(6) for j in range(i, 6)]


@plan(f"WITH {CLOUD}, {_SRC.replace('>= 3', '>= 8')}, {_TGT.replace('>= 3', '>= 8')}, {_TERMS} SELECT count(*) AS pairs, {rnd('sum(-gain/0.025)', 'score', 4)}, {', '.join(rnd(f'sum(gain*({_q(i)}))', f'g{i}', 3) for i in range(6))}, {', '.join(rnd(f'sum(gain*({_h(i, j)}))', f'h{i}{j}', 1) for i, j in _HS)} FROM vv")
def pair_derivatives(spark, sf):
    src, tgt = (c.filter("n >= 8") for c in halves(spark, sf))
    names = [f"g{i}" for i in range(6)]
    out = R.derivatives(src, tgt, SIZE).select("pairs", "score", *names, *(f"h{i}{j}" for i, j in _HS))
    return rounded(rounded(rounded(out, "score", digits=4), *names, digits=3), *(f"h{i}{j}" for i, j in _HS), digits=1)


_INV = inverse_sql(COV)
_P = ("x-mx", "y-my", "z-mz")
_PJ = [[e.replace("mx", "x").replace("my", "y").replace("mz", "z") for e in row] for row in _J]
_L1, _L2 = _p2d()
_PV = ", ".join("+".join(f"({_P[c]})*{_INV[_AT[r][c]]}" for c in range(3)) + f" AS v{r}" for r in range(3))


@plan(f"WITH {CLOUD}, keyed AS (SELECT *, {KEYS} FROM cloud WHERE scan_id % 2 = 1), {cells_sql('cells', 'scan_id % 2 = 0', least=8)}, f AS (SELECT x, y, z, {quadratic_sql(_P, _INV)} AS l, {_PV} FROM keyed JOIN cells USING (ix, iy, iz)), w AS (SELECT *, exp(-{_L2}*l/2) AS e FROM f WHERE l IS NOT NULL AND NOT isnan(l) AND l <= 120) "
      f"SELECT count(*) AS used, {rnd(f'sum({_L1}*e)', 'score', 3)}, {', '.join(rnd(f'sum(-({_L1})*{_L2}*e*(' + '+'.join(f'v{a}*({_PJ[i][a]})' for a in range(3)) + '))', f'g{i}', 2) for i in range(6))} FROM w")
def point_derivatives(spark, sf):
    points, fixed = cloud(spark, sf).filter("scan_id % 2 = 1"), C.fit(cloud(spark, sf).filter("scan_id % 2 = 0"), SIZE, least=8)
    names = [f"g{i}" for i in range(6)]
    return rounded(rounded(R.point_derivatives(points, fixed, SIZE).select("used", "score", *names), "score", digits=3), *names, digits=2)


_SHIFTS = "g AS (SELECT CAST(i AS INTEGER) AS gi, CAST(j AS INTEGER) AS gj FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j))"
_MOVED = "mv AS (SELECT gi, gj, mx+gi*0.02::DOUBLE AS mx, my+gj*0.02::DOUBLE AS my, mz, " + ", ".join(COV) + " FROM src, g)"
_SURF = f"sf AS (SELECT gi, gj, {_PAIR} AS l FROM mv s JOIN tgt t ON {_BLOCK}), sc AS (SELECT gi, gj, count(*) AS pairs, sum(-exp(-0.025*l)) AS score FROM sf WHERE l IS NOT NULL AND NOT isnan(l) GROUP BY gi, gj)"
_FIRM2 = f"{_SRC.replace('>= 3', '>= 8')}, {_TGT.replace('>= 3', '>= 8')}"


def surface(spark, sf):
    src, tgt = (c.filter("n >= 8") for c in halves(spark, sf))
    grid = spark.range(25).select((F.floor(F.col("id") / 5) - 2).cast("int").alias("gi"), (F.col("id") % 5 - 2).cast("int").alias("gj"))
    return R.score_surface(src, tgt, grid, SIZE, 0.02)


@plan(f"WITH {CLOUD}, {_FIRM2}, {_SHIFTS}, {_MOVED}, {_SURF} SELECT gi, gj, pairs, {rnd('score', 'score', 4)} FROM sc")
def score_surface(spark, sf):
    return rounded(surface(spark, sf), "score", digits=4)


@plan(f"WITH {CLOUD}, {_FIRM2}, {_SHIFTS}, {_MOVED}, {_SURF} SELECT gi, gj, {rnd('score', 'score', 4)} FROM sc ORDER BY round(score, 6), gi, gj LIMIT 3")
def best_hypotheses(spark, sf):
    return rounded(R.best_hypotheses(surface(spark, sf), 3, ("gi", "gj")).select("gi", "gj", "score"), "score", digits=4)


_BYSCAN = cells_sql(by="scan_id", least=6)
_SHAPE = "sh AS (SELECT scan_id, CASE WHEN l2 > 50*l1 THEN 'line' WHEN l1 > 50*l0 THEN 'plane' ELSE 'sphere' END AS kind, CASE WHEN d < 0.1 THEN 0 WHEN d < 0.2 THEN 1 ELSE 2 END AS band FROM (SELECT *, sqrt(mx*mx+my*my+mz*mz) AS d FROM eig))"
_HIST = f"{_BYSCAN}, {EIG}, {_SHAPE}, h AS (SELECT scan_id, kind, CAST(band AS INTEGER) AS band, count(*) AS n FROM sh GROUP BY ALL)"


def histograms(spark, sf):
    return R.shape_histogram(cells(spark, sf, ("scan_id",)).filter("n >= 6"), ("scan_id",), (0.1, 0.2))


@plan(f"WITH {CLOUD}, {_HIST} SELECT scan_id, kind, band, n FROM h")
def scan_shapes(spark, sf):
    return histograms(spark, sf)


_SIM = ("p AS (SELECT a.scan_id AS a, b.scan_id AS b FROM (SELECT DISTINCT scan_id FROM h) a, (SELECT DISTINCT scan_id FROM h) b WHERE a.scan_id < b.scan_id), s AS (SELECT *, n/sum(n) OVER (PARTITION BY scan_id, band) AS sh FROM h), "
        "k AS (SELECT DISTINCT kind, band FROM h), f AS (SELECT p.a, p.b, k.band, coalesce(x.sh, 0) AS xs, coalesce(y.sh, 0) AS ys, coalesce(x.n, 0) AS xn, coalesce(y.n, 0) AS yn FROM p CROSS JOIN k LEFT JOIN s x ON x.scan_id = p.a AND x.kind = k.kind AND x.band = k.band LEFT JOIN s y ON y.scan_id = p.b AND y.kind = k.kind AND y.band = k.band), "
        "d AS (SELECT a, b, band, sqrt(sum((xs-ys)**2)) AS d, sum(xn) AS xn, sum(yn) AS yn FROM f GROUP BY ALL), sim AS (SELECT a, b, sum(CASE WHEN band < 2 THEN d ELSE 0 END)*greatest(sum(xn), sum(yn))/least(sum(xn), sum(yn)) AS similarity FROM d GROUP BY a, b)")


@plan(f"WITH {CLOUD}, {_HIST}, {_SIM} SELECT a, b, {rnd('similarity', 'similarity', 5)} FROM sim")
def scan_similarity(spark, sf):
    return rounded(R.similarities(histograms(spark, sf), "scan_id"), "similarity", digits=5)


@plan(f"WITH {CLOUD}, {_HIST}, {_SIM} SELECT a, b FROM sim WHERE similarity < 0.8")
def loop_candidates(spark, sf):
    return R.similarities(histograms(spark, sf), "scan_id").filter("similarity < 0.8").select("a", "b")


_DIRS = "dirs AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for k, (x, y, z) in enumerate(R.directions())) + ") t(bin, dx, dy, dz))"
_A1 = [["cxx-l1", "cxy", "cxz"], ["cxy", "cyy-l1", "cyz"], ["cxz", "cyz", "czz-l1"]]
_A2 = [["cxx-l2", "cxy", "cxz"], ["cxy", "cyy-l2", "cyz"], ["cxz", "cyz", "czz-l2"]]
_M = ", ".join("+".join(f"({_A1[r][k]})*({_A2[k][c]})" for k in range(3)) + f" AS m{r}{c}" for r in range(3) for c in range(3))
_NORMAL = ("pm AS (SELECT *, " + _M + " FROM eig WHERE l2 <= 50*l1), pn AS (SELECT *, " + ", ".join(f"CASE WHEN m00 >= m11 AND m00 >= m22 THEN m0{c} WHEN m11 >= m22 THEN m1{c} ELSE m2{c} END AS n{c}" for c in range(3)) + " FROM pm), "
           "po AS (SELECT scan_id, ix, iy, iz, n0*f AS n0, n1*f AS n1, n2*f AS n2 FROM (SELECT *, CASE WHEN n0*mx+n1*my+n2*mz > 0 THEN -1 ELSE 1 END/sqrt(n0*n0+n1*n1+n2*n2) AS f FROM pn)), "
           "pd AS (SELECT scan_id, ix, iy, iz, arg_max(bin, n0*dx+n1*dy+n2*dz) AS bin FROM po, dirs GROUP BY scan_id, ix, iy, iz)")


@plan(f"WITH {CLOUD}, {cells_sql(by='scan_id', least=6)}, {EIG}, {_DIRS}, {_NORMAL} SELECT scan_id, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM pd GROUP BY ALL")
def direction_histogram(spark, sf):
    return R.direction_histogram(cells(spark, sf, ("scan_id",)).filter("n >= 6"), ("scan_id",))


@plan()
def dominant_directions(spark, sf):
    return R.dominant_directions(direction_histogram(spark, sf), ("scan_id",))


@plan()
def consecutive_poses(spark, sf):
    """Registrations of all consecutive scans of the cloud."""
    own = cells(spark, sf, ("scan_id",)).filter("n >= 6").withColumn("scan_id", F.col("scan_id").cast("long"))
    out = R.consecutive(own, "scan_id", SIZE)
    return rounded(out, "tx", "ty", "tz", "qx", "qy", "qz", "qw", "score", digits=5)
