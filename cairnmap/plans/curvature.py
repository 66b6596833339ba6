"""Plans of full second derivatives and of the other scores of two maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import registration as R
from .cells import _BINV, _BLOCK, _DX, _PAIR, _SRC, _TGT, _p2d, halves
from .matching import _HS
from .registry import CLOUD, COV, KEYS, SIZE, cells_sql, cloud, inverse_sql, key_sql, plan, quadratic_sql, rnd, rounded

#: The counterpart is written from matrices: generators of the turns, first and second derivatives of mean and covariance.
_GEN = [[["0", "0", "0"], ["0", "0", "-1"], ["0", "1", "0"]], [["0", "0", "1"], ["0", "0", "0"], ["-1", "0", "0"]], [["0", "-1", "0"], ["1", "0", "0"], ["0", "0", "0"]]]
_C = [["cxx", "cxy", "cxz"], ["cxy", "cyy", "cyz"], ["cxz", "cyz", "czz"]]
_B = [["b0", "b1", "b2"], ["b1", "b3", "b4"], ["b2", "b4", "b5"]]
_V = [["v0"], ["v1"], ["v2"]]


def _minus(x):
    return "1" if x == "-1" else f"(-({x}))"


def _mul(a, b):
    out = []
    for row in a:
        out.append([])
        for k in range(len(b[0])):
            terms = [x if y == "1" else y if x == "1" else _minus(y) if x == "-1" else _minus(x) if y == "-1" else f"({x})*({y})" for x, y in zip(row, [r[k] for r in b]) if x != "0" and y != "0"]
            out[-1].append("+".join(terms) or "0")
    return out


def _add(*ms):
    return [["+".join(f"({m[i][j]})" for m in ms if m[i][j] != "0") or "0" for j in range(len(ms[0][0]))] for i in range(len(ms[0]))]


def _t(a):
    return [list(c) for c in zip(*a)]


def _zero(r, c):
    return [["0"] * c for _ in range(r)]


def _jac(i, at):
    return [["1" if k == i else "0"] for k in range(3)] if i < 3 else _mul(_GEN[i - 3], at)


def _jac2(i, j, at):
    return _mul(_mul(_GEN[i - 3], _GEN[j - 3]), at) if i > 2 else _zero(3, 1)


def _z(i):
    return _add(_mul(_GEN[i - 3], _C), _mul(_C, _t(_GEN[i - 3]))) if i > 2 else _zero(3, 3)


def _z2(i, j):
    if i < 3:
        return _zero(3, 3)
    d = _mul(_GEN[i - 3], _GEN[j - 3])
    return _add(_mul(d, _C), _mul(_C, _t(d)), _mul(_mul(_GEN[i - 3], _C), _t(_GEN[j - 3])), _mul(_mul(_GEN[j - 3], _C), _t(_GEN[i - 3])))


_M = [["mx"], ["my"], ["mz"]]


def _form2(i, j):
    """Second derivative of the form x' B x, term by term."""
    one = lambda m: m[0][0]
    parts = [
        f"2*({one(_mul(_mul(_t(_jac(i, _M)), _B), _jac(j, _M)))})", f"2*({one(_mul(_t(_V), _jac2(i, j, _M)))})", f"-({one(_mul(_mul(_t(_V), _z2(i, j)), _V))})",
        f"-2*({one(_mul(_mul(_mul(_t(_jac(i, _M)), _B), _z(j)), _V))})", f"-2*({one(_mul(_mul(_mul(_t(_jac(j, _M)), _B), _z(i)), _V))})", f"2*({one(_mul(_mul(_mul(_mul(_t(_V), _z(i)), _B), _z(j)), _V))})",
    ]
    return "+".join(p for p in parts if not p.endswith("*(0)") and p != "-(0)")


def _form1(i):
    return f"2*({_mul(_t(_V), _jac(i, _M))[0][0]})-({_mul(_mul(_t(_V), _z(i)), _V)[0][0]})"


_VS = ", ".join("+".join(f"{_B[r][c]}*x{c}" for c in range(3)) + f" AS v{r}" for r in range(3))
_FIRM2 = f"{_SRC.replace('>= 3', '>= 8')}, {_TGT.replace('>= 3', '>= 8')}"
_PAIRS = f"pr AS (SELECT s.mx, s.my, s.mz, {', '.join('s.' + c for c in COV)}, {', '.join(f'{d} AS x{k}' for k, d in enumerate(_DX))}, {', '.join(f'{e} AS b{k}' for k, e in enumerate(_BINV))}, {_PAIR} AS l FROM src s JOIN tgt t ON {_BLOCK}), vv AS (SELECT *, {_VS}, 0.025*exp(-0.025*l) AS gain FROM pr WHERE l IS NOT NULL AND NOT isnan(l)), qq AS (SELECT *, {', '.join(f'{_form1(i)} AS q{i}' for i in range(6))} FROM vv)"
_HN = [f"h{i}{j}" for i, j in _HS]
_GN = [f"g{i}" for i in range(6)]


def _scaled(out, size):
    """Curvatures at the digits that their size leaves."""
    return rounded(rounded(rounded(out, "score", digits=4), *_GN, digits=3), *_HN, digits=size)


@plan(f"WITH {CLOUD}, {_FIRM2}, {_PAIRS} SELECT count(*) AS pairs, {rnd('sum(-gain/0.025)', 'score', 4)}, {', '.join(rnd(f'sum(gain*q{i})', f'g{i}', 3) for i in range(6))}, {', '.join(rnd(f'sum(gain*({_form2(i, j)}-0.025*q{i}*q{j}))', f'h{i}{j}', 1) for i, j in _HS)} FROM qq")
def pair_hessian(spark, sf):
    return _scaled(R.hessian(*(c.filter("n >= 8") for c in halves(spark, sf)), SIZE), 1)


_L1, _L2 = _p2d()
_P = [["x"], ["y"], ["z"]]
_D = ("x-mx", "y-my", "z-mz")
_INV = inverse_sql(COV)
_PT = f"keyed AS (SELECT *, {KEYS} FROM cloud WHERE scan_id % 2 = 1), {cells_sql('cells', 'scan_id % 2 = 0', least=8)}, f AS (SELECT x, y, z, {quadratic_sql(_D, _INV)} AS l, {', '.join(f'{e} AS b{k}' for k, e in enumerate(_INV))}, {', '.join(f'{d} AS x{k}' for k, d in enumerate(_D))} FROM keyed JOIN cells USING (ix, iy, iz)), w AS (SELECT *, {_VS}, exp(-{_L2}*l/2) AS e FROM f WHERE l IS NOT NULL AND NOT isnan(l) AND l <= 120), q AS (SELECT *, {', '.join(f'{_mul(_t(_V), _jac(i, _P))[0][0]} AS q{i}' for i in range(6))} FROM w)"


def _point2(i, j):
    return f"{_mul(_mul(_t(_jac(i, _P)), _B), _jac(j, _P))[0][0]}+{_mul(_t(_V), _jac2(i, j, _P))[0][0]}-{_L2}*q{i}*q{j}"


@plan(f"WITH {CLOUD}, {_PT} SELECT count(*) AS used, {rnd(f'sum({_L1}*e)', 'score', 4)}, {', '.join(rnd(f'sum(-({_L1})*{_L2}*e*q{i})', f'g{i}', 3) for i in range(6))}, {', '.join(rnd(f'sum(-({_L1})*{_L2}*e*({_point2(i, j)}))', f'h{i}{j}', 0) for i, j in _HS)} FROM q")
def point_hessian(spark, sf):
    points, fixed = cloud(spark, sf).filter("scan_id % 2 = 1"), C.fit(cloud(spark, sf).filter("scan_id % 2 = 0"), SIZE, least=8)
    return _scaled(R.point_hessian(points, fixed, SIZE), 0)


def _evidence(name, odd):
    has = lambda value, c: f"CASE WHEN count(*) >= 8 THEN {value} END AS {c}"
    stats = ", ".join([has(f"avg({a})", f"m{a}") for a in "xyz"] + [has(f"covar_samp({c[1]},{c[2]})", c) for c in COV])
    return f"{name} AS (SELECT {KEYS}, (count(*) - 4) * 0.3 AS occ, {stats} FROM cloud WHERE scan_id % 2 = {odd} GROUP BY {', '.join(key_sql(a) for a in 'xyz')})"


_NEAR = " AND ".join(f"abs(t.i{a} - s.i{a}) <= 2" for a in "xyz")
_FAR = "sqrt((s.ix-t.ix)**2+(s.iy-t.iy)**2+(s.iz-t.iz)**2)/sqrt(3.0::DOUBLE)"


@plan(f"WITH {CLOUD}, {_evidence('src', 1)}, {_evidence('tgt', 0)}, f AS (SELECT {_PAIR} AS l, 1-1/(1+exp(s.occ)) AS o, 1-1/(1+exp(t.occ)) AS p, greatest(0, 1-{_FAR}) AS near FROM src s JOIN tgt t ON {_NEAR}), "
      f"g AS (SELECT *, CASE WHEN l IS NOT NULL AND NOT isnan(l) THEN -exp(-0.025*l) END AS s FROM f) SELECT count(*) AS pairs, count(s) AS gaussian, {rnd('sum(coalesce(o*p*s, 0) - 0.1*near*((1-o)*(1-p)-o*(1-p)-p*(1-o)))', 'score', 4)} FROM g")
def occupied_score(spark, sf):
    """Two maps compared by their Gaussians and by what is occupied and free."""
    firm = lambda c: F.when(F.col("n") >= 8, F.col(c)).alias(c)
    maps = [C.fit(cloud(spark, sf).filter(f"scan_id % 2 = {odd}"), SIZE, least=1).select(*C.KEY, *(firm(c) for c in C.MEAN + C.COV), ((F.col("n") - 4) * 0.3).alias("occ")) for odd in (1, 0)]
    return rounded(R.occupied_score(*maps, SIZE), "score", digits=4)


_OWN = " AND ".join(f"t.i{a} = {key_sql('s.m' + a)}" for a in "xyz")


@plan(f"WITH {CLOUD}, {_FIRM2}, f AS (SELECT {_PAIR} AS l FROM src s LEFT JOIN tgt t ON {_OWN}), g AS (SELECT CASE WHEN l <= 120 AND NOT isnan(l) THEN exp(-0.025*l) END AS e FROM f) SELECT count(*) AS cells, count(e) AS met, {rnd('sum(coalesce(1-e, 0.1))', 'score', 4)} FROM g")
def positive_score(spark, sf):
    return rounded(R.positive_score(*(c.filter("n >= 8") for c in halves(spark, sf)), SIZE), "score", digits=4)


@plan(f"WITH {CLOUD}, {_FIRM2}, f AS (SELECT {_PAIR} AS l FROM src s JOIN tgt t USING (ix, iy, iz)), g AS (SELECT -exp(-0.025*l) AS s, row_number() OVER (ORDER BY -exp(-0.025*l)) AS rn, count(*) OVER () AS n FROM f WHERE l <= 120 AND NOT isnan(l)) SELECT max(n) AS pairs, count(*) AS used, {rnd('sum(s)', 'score', 4)} FROM g WHERE rn <= CAST(floor(0.8 * (n - 1)) AS BIGINT) + 1")
def trimmed_score(spark, sf):
    """Corresponding cells of two maps, the best four fifths."""
    src, tgt = (c.filter("n >= 8") for c in halves(spark, sf))
    pairs = src.join(tgt.select(*C.KEY, *(F.col(c).alias("t_" + c) for c in C.MEAN + C.COV)), list(C.KEY))
    return rounded(R.trimmed_score(pairs, 0.8), "score", digits=4)
