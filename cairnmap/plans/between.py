"""Plans of poses between stamps, of the nearest cell at any distance, and of six-degree prediction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import between as B
from ..operators import nearest as N
from ..operators import particles as PF
from .registry import CELLS, CLOUD, SIZE, POSES, cells, cloud, plan, poses, rnd, rounded

_HALF = [("cr", "sr", "roll"), ("cp", "sp", "pitch"), ("cy", "sy", "yaw")]
_RPY = "{sr}*{cp}*{cy}-{cr}*{sp}*{sy}", "{cr}*{sp}*{cy}+{sr}*{cp}*{sy}", "{cr}*{cp}*{sy}-{sr}*{sp}*{cy}", "{cr}*{cp}*{cy}+{sr}*{sp}*{sy}"


def _quaternion(roll, pitch, yaw):
    parts = {c: f"cos(({a})/2)" for (c, _, _), a in zip(_HALF, (roll, pitch, yaw))} | {s: f"sin(({a})/2)" for (_, s, _), a in zip(_HALF, (roll, pitch, yaw))}
    return [e.format(**parts) for e in _RPY]


_REACH = 6 * 3600.0
_NAMES = B.POSE
_PO = f"po AS (SELECT robot_id, t, x AS tx, y AS ty, dx*2 AS tz, {', '.join(f'{e} AS {n}' for e, n in zip(_quaternion('dx*0.5', 'dyaw*5', 'yaw'), ('qx', 'qy', 'qz', 'qw')))} FROM poses WHERE seq % 2 = 0)"
_DOT = "+".join(f"a{c}*b{c}" for c in _NAMES[3:])
_MSG = "SELECT robot_id, seq, t FROM poses WHERE seq % 2 = 1"
_ASOF = f"""ab AS (SELECT m.robot_id, m.seq, m.t, a.t AS t0, {', '.join(f'a.{c} AS a{c}' for c in _NAMES)} FROM ({_MSG}) m ASOF JOIN po a ON m.robot_id = a.robot_id AND m.t >= a.t),
bb AS (SELECT ab.*, b.t AS t1, {', '.join(f'b.{c} AS b{c}' for c in _NAMES)} FROM ab ASOF JOIN po b ON ab.robot_id = b.robot_id AND ab.t <= b.t),
f AS (SELECT *, CASE WHEN t1 > t0 THEN (t-t0)/(t1-t0) ELSE 0 END AS f, acos(least(abs({_DOT}), 1)) AS w, CASE WHEN {_DOT} < 0 THEN -1 ELSE 1 END AS sg FROM bb WHERE t-t0 <= {_REACH} AND t1-t <= {_REACH}),
u AS (SELECT *, CASE WHEN w < 1e-6 THEN 1-f ELSE sin((1-f)*w)/sin(w) END AS u, sg*CASE WHEN w < 1e-6 THEN f ELSE sin(f*w)/sin(w) END AS v FROM f),
q AS (SELECT *, {', '.join(f'u*a{c}+v*b{c} AS {c}' for c in _NAMES[3:])} FROM u)"""


@plan(f"WITH {POSES}, {_PO}, {_ASOF} SELECT robot_id, seq, {', '.join(rnd(f'a{c}+f*(b{c}-a{c})', c, 5) for c in _NAMES[:3])}, {', '.join(rnd(f'{c}/sqrt(qx*qx+qy*qy+qz*qz+qw*qw)', c, 5) for c in _NAMES[3:])} FROM q")
def asof_pose_interpolated(spark, sf):
    """Every second event of a robot gets its pose from the events around it, six hours off at most."""
    path = poses(spark, sf)
    q = G.rpy_quaternion(F.col("dx") * 0.5, F.col("dyaw") * 5, F.col("yaw"))
    known = path.filter("seq % 2 = 0").select("robot_id", "t", F.col("x").alias("tx"), F.col("y").alias("ty"), (F.col("dx") * 2).alias("tz"), *(e.alias(n) for e, n in zip(q, _NAMES[3:])))
    found = B.interpolated_pose(path.filter("seq % 2 = 1").select("robot_id", "t", "seq"), known, "t", "robot_id", _REACH)
    return rounded(found.drop("t"), *_NAMES, digits=5)


_DIST = "sqrt((p.x*3-c.mx)**2+(p.y*3-c.my)**2+(p.z*3-c.mz)**2)"


@plan(f"WITH {CLOUD}, {CELLS}, r AS (SELECT pid, ix, iy, iz, {_DIST} AS dist, row_number() OVER (PARTITION BY pid ORDER BY {_DIST}, ix, iy, iz) AS rn FROM cloud p, cells c) SELECT pid, ix, iy, iz, {rnd('dist', 'dist')} FROM r WHERE rn = 1")
def nearest_cell_any(spark, sf):
    """The cloud stretched threefold, so that most points lie far from any cell."""
    far = cloud(spark, sf).select("pid", *((F.col(a) * 3).alias(a) for a in G.AXES))
    return rounded(N.nearest_any(far, cells(spark, sf), SIZE, ("pid",)), "dist")


#: A motion, and a covariance in which all six directions hang together.
MOTION = (0.3, -0.1, 0.05, 0.02, -0.03, 0.1, 0.99)
_ROOT = np.tril(np.array([[0.05, 0, 0, 0, 0, 0], [0.01, 0.04, 0, 0, 0, 0], [0.0, 0.01, 0.03, 0, 0, 0], [0.005, 0.0, 0.002, 0.02, 0, 0], [0.0, 0.004, 0.0, 0.003, 0.02, 0], [0.01, 0.0, 0.003, 0.0, 0.002, 0.03]]))
COVARIANCE = (_ROOT @ _ROOT.T).tolist()


def _draw(stream: int) -> str:
    x = f"((pid % {PF.DRAW_P}) * {PF.DRAW_A} + {stream * PF.DRAW_C % PF.DRAW_P})"
    for _ in range(2):
        x = f"((({x} % {PF.DRAW_P}) * ({x} % {PF.DRAW_P})) % {PF.DRAW_P} + {(stream + 1) * PF.DRAW_A % PF.DRAW_P})"
    return f"(({x} % {PF.DRAW_P}) + 0.5::DOUBLE) / {PF.DRAW_P}"


def _product(a, b):
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return f"{aw}*{bx}+{ax}*{bw}+{ay}*{bz}-{az}*{by}", f"{aw}*{by}-{ax}*{bz}+{ay}*{bw}+{az}*{bx}", f"{aw}*{bz}+{ax}*{by}-{ay}*{bx}+{az}*{bw}", f"{aw}*{bw}-{ax}*{bx}-{ay}*{by}-{az}*{bz}"


def _turned(q, v):
    """R v with R written out."""
    x, y, z, w = q
    r = [[f"(1-2*({y}*{y}+{z}*{z}))", f"(2*({x}*{y}-{z}*{w}))", f"(2*({x}*{z}+{y}*{w}))"], [f"(2*({x}*{y}+{z}*{w}))", f"(1-2*({x}*{x}+{z}*{z}))", f"(2*({y}*{z}-{x}*{w}))"], [f"(2*({x}*{z}-{y}*{w}))", f"(2*({y}*{z}+{x}*{w}))", f"(1-2*({x}*{x}+{y}*{y}))"]]
    return ["+".join(f"{e}*{c}" for e, c in zip(row, v)) for row in r]


_LEN = float(np.linalg.norm(MOTION[3:]))
_TURN = [f"({float(v) / _LEN!r})" for v in MOTION[3:]]
_START = _quaternion("x", "y*0.5", "z*2")
_SIX = f"""p0 AS (SELECT pid, x, y, z, {', '.join(f'{e} AS q{k}' for k, e in enumerate(_START))} FROM cloud),
un AS (SELECT *, {', '.join(f'{_draw(k)} AS u{k}' for k in range(12))} FROM p0),
zs AS (SELECT *, {', '.join(f'sqrt(-2*ln(u{2 * k}))*cos(2*3.141592653589793*u{2 * k + 1}) AS z{k}' for k in range(6))} FROM un),
ns AS (SELECT *, {', '.join('+'.join(f'({float(_ROOT[i, k])!r})*z{k}' for k in range(i + 1)) + f' AS n{i}' for i in range(6))} FROM zs),
ms AS (SELECT *, {', '.join(f'{e} AS m{k}' for k, e in enumerate(_product([f'q{k}' for k in range(4)], _TURN)))} FROM ns),
es AS (SELECT *, {', '.join(f'{e} AS e{k}' for k, e in enumerate(_quaternion('n3', 'n4', 'n5')))} FROM ms)"""
_AT = [f"{a}+{f}+{s}" for a, f, s in zip("xyz", _turned([f"q{k}" for k in range(4)], [f"({v})" for v in MOTION[:3]]), _turned([f"m{k}" for k in range(4)], ["n0", "n1", "n2"]))]


@plan(f"WITH {CLOUD}, {_SIX} SELECT pid, {', '.join(rnd(e, a, 5) for e, a in zip(_AT, 'xyz'))}, {', '.join(rnd(e, n, 5) for e, n in zip(_product([f'm{k}' for k in range(4)], [f'e{k}' for k in range(4)]), ('qx', 'qy', 'qz', 'qw')))} FROM es")
def particle_predict_six(spark, sf):
    """The cloud's points as particles, moved in six degrees with noise of full covariance."""
    q = G.rpy_quaternion(F.col("x"), F.col("y") * 0.5, F.col("z") * 2)
    own = cloud(spark, sf).select("pid", *G.AXES, *(e.alias(n) for e, n in zip(q, ("qx", "qy", "qz", "qw"))))
    return rounded(PF.predict6(own, MOTION, COVARIANCE), *G.AXES, "qx", "qy", "qz", "qw", digits=5)
