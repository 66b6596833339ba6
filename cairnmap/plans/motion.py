"""Plans of pose streams, particles and stream joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import joins as J
from ..operators import particles as PF
from ..operators import trajectory as T
from ..streaming import latest, synchronised
from .cells import halves
from .registry import CLOUD, COV, ODOMETRY, POSES, SIZE, cells_sql, cloud, inverse_sql, key_sql, odometry, plan, poses, quadratic_sql, rnd, rounded, sql_poses, table


@plan(f"WITH {POSES} SELECT robot_id, seq, {rnd('x', 'x')}, {rnd('y', 'y')}, {rnd('yaw', 'yaw')} FROM poses")
def pose_chain(spark, sf):
    return rounded(poses(spark, sf).select("robot_id", "seq", "x", "y", "yaw"), "x", "y", "yaw")


_D = "d AS (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lag(yaw) OVER w AS la FROM poses WINDOW w AS (PARTITION BY robot_id ORDER BY seq))"
_DX, _DY, _DA = "((x-lx)*cos(la)+(y-ly)*sin(la))", "(-(x-lx)*sin(la)+(y-ly)*cos(la))", "atan2(sin(yaw-la), cos(yaw-la))"


@plan(f"WITH {POSES}, {_D} SELECT robot_id, seq, {rnd(_DX, 'ddx', 5)}, {rnd(_DY, 'ddy', 5)}, {rnd(_DA, 'dda', 5)} FROM d WHERE lx IS NOT NULL")
def pose_deltas(spark, sf):
    return rounded(T.deltas(poses(spark, sf), ("robot_id",), "seq").filter("ddx is not null").select("robot_id", "seq", "ddx", "ddy", "dda"), "ddx", "ddy", "dda", digits=5)


@plan(f"WITH {POSES}, {_D}, m AS (SELECT robot_id, coalesce(sqrt({_DX}**2+{_DY}**2), 0) AS s, coalesce(abs({_DA}), 0) AS r FROM d) SELECT robot_id, {rnd('sum(s)', 'distance', 4)}, {rnd('sum(r)', 'rotation', 4)} FROM m GROUP BY robot_id")
def travelled(spark, sf):
    t = T.travelled(poses(spark, sf), ("robot_id",), "seq")
    return rounded(t.groupBy("robot_id").agg(F.max("distance").alias("distance"), F.max("rotation").alias("rotation")), "distance", "rotation", digits=4)


@plan(f"WITH {POSES}, {_D} SELECT robot_id, count(*) AS kept FROM d WHERE lx IS NULL OR sqrt({_DX}**2+{_DY}**2) >= 0.4 OR abs({_DA}) >= 0.025 GROUP BY robot_id")
def motion_gate(spark, sf):
    return T.motion_gate(sql_poses(spark, sf), ("robot_id",), "seq", 0.4, 0.025).groupBy("robot_id").agg(F.count("*").alias("kept"))


_KEPT = """k AS (SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY seq) AS rn FROM poses),
g AS (SELECT robot_id, rn, seq, x, y, yaw, true AS kept FROM k WHERE rn = 1 UNION ALL
SELECT g.robot_id, k.rn, CASE WHEN far THEN k.seq ELSE g.seq END, CASE WHEN far THEN k.x ELSE g.x END, CASE WHEN far THEN k.y ELSE g.y END, CASE WHEN far THEN k.yaw ELSE g.yaw END, far
FROM g JOIN k ON k.robot_id = g.robot_id AND k.rn = g.rn + 1, LATERAL (SELECT sqrt((k.x-g.x)**2+(k.y-g.y)**2) > 0.5 OR abs(atan2(sin(k.yaw-g.yaw), cos(k.yaw-g.yaw))) > 0.025 AS far))"""


@plan(f"WITH RECURSIVE {POSES}, {_KEPT} SELECT robot_id, seq, {rnd('x', 'x')}, {rnd('y', 'y')}, {rnd('yaw', 'yaw')} FROM g WHERE kept")
def fuse_gate(spark, sf):
    return rounded(T.fuse_gate(sql_poses(spark, sf).select("robot_id", "seq", "x", "y", "yaw"), ("robot_id",), "seq", 0.5, 0.025), "x", "y", "yaw")


def pairs(spark, sf):
    """Truth and an estimate that is off by a small, fixed pattern."""
    off = (F.col("seq") % 5 - 2) / 100.0
    return poses(spark, sf).select("robot_id", "seq", "t", "x", "y", "yaw", (F.col("x") + off).alias("ex"), (F.col("y") - off).alias("ey"), (F.col("yaw") + off / 10).alias("eyaw"))


_PAIRS = "pairs AS (SELECT *, x + (seq % 5 - 2) / 100.0::DOUBLE AS ex, y - (seq % 5 - 2) / 100.0::DOUBLE AS ey, yaw + (seq % 5 - 2) / 100.0::DOUBLE / 10 AS eyaw FROM poses)"


@plan(f"WITH {POSES}, {_PAIRS}, e AS (SELECT robot_id, sqrt((x-ex)**2+(y-ey)**2) AS e FROM pairs) SELECT robot_id, count(*) AS n, {', '.join(rnd(x, n) for x, n in (('sqrt(avg(e*e))', 'rmse'), ('avg(e)', 'mean'), ('median(e)', 'median'), ('stddev_pop(e)', 'std'), ('min(e)', 'min'), ('max(e)', 'max')))} FROM e GROUP BY robot_id")
def error_statistics(spark, sf):
    e = pairs(spark, sf).withColumn("e", F.sqrt((F.col("x") - F.col("ex")) ** 2 + (F.col("y") - F.col("ey")) ** 2))
    return rounded(T.statistics(e, "e", ("robot_id",)), "rmse", "mean", "median", "std", "min", "max")


def _rel(p, q, x, y, a):
    return f"((l{x}-{x})*cos({a})+(l{y}-{y})*sin({a}))", f"(-(l{x}-{x})*sin({a})+(l{y}-{y})*cos({a}))", f"atan2(sin(l{a}-{a}), cos(l{a}-{a}))"


_L = "l AS (SELECT *, " + ", ".join(f"lead({c}, 3) OVER w AS l{c}" for c in ("x", "y", "yaw", "ex", "ey", "eyaw")) + " FROM pairs WINDOW w AS (PARTITION BY robot_id ORDER BY seq))"
_T, _M = _rel(0, 0, "x", "y", "yaw"), _rel(0, 0, "ex", "ey", "eyaw")
_REL = f"r AS (SELECT robot_id, seq, {_T[0]} AS t0, {_T[1]} AS t1, {_T[2]} AS t2, {_M[0]} AS e0, {_M[1]} AS e1, {_M[2]} AS e2 FROM l WHERE lx IS NOT NULL)"


@plan(f"WITH {POSES}, {_PAIRS}, {_L}, {_REL} SELECT robot_id, seq, {rnd('sqrt((e0-t0)**2+(e1-t1)**2)', 'trans', 5)}, {rnd('abs(atan2(sin(e2-t2), cos(e2-t2)))', 'rot', 5)} FROM r")
def relative_errors(spark, sf):
    return rounded(T.relative_errors(pairs(spark, sf), ("robot_id",), "seq", 3), "trans", "rot", digits=5)


@plan()
def aligned_errors(spark, sf):
    p = pairs(spark, sf).withColumn("z", F.lit(0.0) + F.col("seq") % 3).withColumn("ez", F.col("z") + 1.0)
    return T.statistics(T.aligned_errors(p, ("ex", "ey", "ez"), ("x", "y", "z"), ("robot_id",)), "error")


@plan(f"WITH {ODOMETRY}, g AS (SELECT robot_id, t - lag(t) OVER (PARTITION BY robot_id ORDER BY seq) AS g FROM odometry) SELECT robot_id, {rnd('median(g)', 'gap', 3)} FROM g WHERE g IS NOT NULL GROUP BY robot_id")
def median_gap(spark, sf):
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("robot_id").orderBy("seq"))
    return rounded(odometry(spark, sf).withColumn("g", gap).filter("g is not null").groupBy("robot_id").agg(F.median("g").alias("gap")), "gap", digits=3)


_GRID = f"{CLOUD}, g AS (SELECT pid, x * 4 AS x, y * 4 AS y, z AS a, 1.0::DOUBLE / count(*) OVER () AS p FROM cloud)"


def two_streams(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.filter("event_type = 'click'").select("user_id", "t", "event_id"), e.filter("event_type = 'purchase'").select("user_id", "t", F.col("event_id").alias("other"))


_CP = "c AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events WHERE event_type = 'click'), p AS (SELECT user_id, epoch_us(ts) AS t, event_id AS other FROM events WHERE event_type = 'purchase')"


@plan(f"WITH {_CP} SELECT c.event_id, coalesce(p.other, -1) AS prev_other FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t")
def asof_pose(spark, sf):
    return J.asof(*two_streams(spark, sf), "t", ("user_id",), ("other",)).select("event_id", F.coalesce("prev_other", F.lit(-1)).alias("prev_other"))


@plan(f"WITH {_CP}, g AS (SELECT c.event_id, p.other, abs(c.t - p.t) AS gap, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(c.t - p.t), p.t) AS rn FROM c JOIN p USING (user_id)) SELECT event_id, other, gap FROM g WHERE rn = 1")
def closest_stamp(spark, sf):
    return J.closest(*two_streams(spark, sf), "t", ("user_id",), "other").filter("other is not null").select("event_id", "other", "gap")


@plan(f"WITH {_CP} SELECT c.event_id, coalesce(CASE WHEN p.t - c.t <= 7200000000 THEN p.other END, -1) AS next_other FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t <= p.t")
def replayed_poses(spark, sf):
    """The first purchase after each click, read ahead by two hours at most."""
    l, r = (d.withColumn("t", -F.col("t")) for d in two_streams(spark, sf))
    found = J.asof(l, r, "t", ("user_id",), ("other",))
    return found.select("event_id", F.coalesce(F.when(F.col("t") - F.col("prev_t") <= 7_200_000_000, F.col("prev_other")), F.lit(-1)).alias("next_other"))


@plan(f"WITH {_GRID} SELECT pid, printf('%.6f %.6f %.6f %.6f', x, y, a, p) AS line FROM g")
def particle_lines(spark, sf):
    from ..sources.writers import particle_lines as lines

    return lines(grid(spark, sf))


@plan(f"WITH {POSES}, r AS (SELECT robot_id, seq, x, y, yaw FROM poses) SELECT robot_id, seq, printf('%.6f %.6f 0 0 0 %.6f %.6f', round(x, 6)+0.0, round(y, 6)+0.0, round(sin(yaw/2), 6)+0.0, round(cos(yaw/2), 6)+0.0) AS line FROM r")
def odometry_lines(spark, sf):
    from ..sources.writers import odometry_lines as lines

    return lines(poses(spark, sf), "robot_id", "seq")


@plan()
def associated_stamps(spark, sf):
    l, r = two_streams(spark, sf)
    return J.associate(l, r, "t", 3.6e9, "event_id", "other", ("user_id",))


@plan(f"WITH {_CP} SELECT c.event_id AS id_a, p.other AS id_b FROM c JOIN p ON c.user_id = p.user_id AND abs(c.t - p.t) <= 3600000000")
def synchronised_streams(spark, sf):
    e = table(spark, sf, "events")
    l = e.filter("event_type = 'click'").select("user_id", F.col("ts").cast("timestamp").alias("ts_a"), F.col("event_id").alias("id_a"))
    r = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").cast("timestamp").alias("ts_b"), F.col("event_id").alias("id_b"))
    return synchronised(l, r, "user_id", "60 minutes").select("id_a", "id_b")


@plan("SELECT user_id, max(event_id) FILTER (ts = m) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def latest_contact(spark, sf):
    return latest(table(spark, sf, "events"), "user_id", "ts", ("event_id",)).select("user_id", "event_id")




def grid(spark, sf):
    """The cloud's points as particles of equal weight: x and y four times as far, z as the heading."""
    own = cloud(spark, sf).select("pid", (F.col("x") * 4).alias("x"), (F.col("y") * 4).alias("y"), F.col("z").alias("a"), F.lit(1.0).alias("lik"))
    return own.crossJoin(F.broadcast(own.agg((1 / F.count("*")).alias("p"))))


@plan(f"WITH {_GRID} SELECT pid, {rnd('x+0.1*cos(a)-0.05*sin(a)', 'x')}, {rnd('y+0.1*sin(a)+0.05*cos(a)', 'y')}, {rnd('atan2(sin(a+0.02), cos(a+0.02))', 'a')} FROM g")
def particle_predict(spark, sf):
    return rounded(PF.predict(grid(spark, sf), 0.1, 0.05, 0.02).select("pid", "x", "y", "a"), "x", "y", "a")


_LIK = "w AS (SELECT *, exp(-(x*x+y*y)) AS lik FROM g), n AS (SELECT pid, x, y, a, p*lik/sum(p*lik) OVER () AS p FROM w)"


def weighted(spark, sf):
    return PF.normalise(grid(spark, sf).withColumn("lik", F.exp(-(F.col("x") ** 2 + F.col("y") ** 2))))


@plan(f"WITH {_GRID}, {_LIK} SELECT pid, {rnd('p', 'p', 9)} FROM n")
def particle_weights(spark, sf):
    return rounded(weighted(spark, sf).select("pid", "p"), "p", digits=9)


_C2 = "1/(1-sum(p*p))"


@plan(f"WITH {_GRID}, {_LIK} SELECT {rnd('sum(p*x)', 'mean_x')}, {rnd('sum(p*y)', 'mean_y')}, {rnd('atan2(sum(p*sin(a)), sum(p*cos(a)))', 'mean_a')}, {rnd(f'(sum(p*x*x)-sum(p*x)**2)*{_C2}', 'var_x')}, {rnd(f'(sum(p*y*y)-sum(p*y)**2)*{_C2}', 'var_y')}, {rnd(f'(sum(p*x*y)-sum(p*x)*sum(p*y))*{_C2}', 'cov_xy')} FROM n")
def particle_moments(spark, sf):
    return rounded(PF.moments(weighted(spark, sf)), "mean_x", "mean_y", "mean_a", "var_x", "var_y", "cov_xy")


@plan(f"WITH {_GRID}, {_LIK}, c AS (SELECT pid, sum(p) OVER (ORDER BY pid) AS c, p, count(*) OVER () AS n FROM n), k AS (SELECT pid, CAST(ceil(round(n*c-0.37, 9))-ceil(round(n*(c-p)-0.37, 9)) AS INTEGER) AS copies FROM c) SELECT pid, copies FROM k WHERE copies > 0")
def particle_resampling(spark, sf):
    return PF.resample(weighted(spark, sf), 0.37, 1000).select("pid", "copies")


@plan(f"WITH {_GRID}, {_LIK}, b AS (SELECT * FROM n ORDER BY p DESC, pid LIMIT 50) SELECT {rnd('avg(a)', 'a', 2)} FROM b")
def particle_best(spark, sf):
    return rounded(PF.best(weighted(spark, sf), 50).select("a"), "a", digits=2)


@plan(f"WITH {_GRID}, {_LIK} SELECT {rnd('stddev_pop(p)', 'std', 9)}, stddev_pop(p) > 0.006 OR 30 > 25 AS resample FROM n")
def particle_trigger(spark, sf):
    return rounded(PF.needs_resampling(weighted(spark, sf), 30), "std", digits=9)


_TURNED = """mv AS (SELECT pid, c*mx-s*my+px AS mx, s*mx+c*my+py AS my, mz, c*c*cxx-2*c*s*cxy+s*s*cyy AS cxx, c*s*cxx+(c*c-s*s)*cxy-c*s*cyy AS cxy, c*cxz-s*cyz AS cxz,
  s*s*cxx+2*c*s*cxy+c*c*cyy AS cyy, s*cxz+c*cyz AS cyz, czz FROM src, (SELECT pid, x AS px, y AS py, cos(z) AS c, sin(z) AS s FROM cloud))"""
_HELD = " AND ".join(f"t.i{a} = {key_sql('s.m' + a)}" for a in "xyz")
_MET = quadratic_sql(("s.mx-t.mx", "s.my-t.my", "s.mz-t.mz"), inverse_sql([f"s.{c}+t.{c}" for c in COV]))


@plan(f"WITH {CLOUD}, {cells_sql('src', 'scan_id % 2 = 1', least=12)}, {cells_sql('tgt', 'scan_id % 2 = 0', least=12)}, {_TURNED}, f AS (SELECT pid, {_MET} AS l FROM mv s JOIN tgt t ON {_HELD}), g AS (SELECT pid, sum(CASE WHEN l IS NOT NULL AND NOT isnan(l) THEN 0.1+0.9*exp(-0.05*l/2) ELSE 0 END) AS v FROM f GROUP BY pid) SELECT pid, {rnd('1+coalesce(v, 0)', 'lik', 4)} FROM cloud LEFT JOIN g USING (pid)")
def particle_likelihood(spark, sf):
    """The cloud's points as particles (z the heading), weighed by one half's cells against the other's."""
    src, tgt = (c.filter("n >= 12") for c in halves(spark, sf))
    own = cloud(spark, sf).select("pid", "x", "y", F.col("z").alias("a"))
    return rounded(PF.weigh(own, src, tgt, SIZE).select("pid", "lik"), "lik", digits=4)


@plan("SELECT event_id, " + ", ".join(rnd(e, n) for e, n in (("1-2*(y*y+z*z)", "r00"), ("2*(x*y-z*w)", "r01"), ("2*(x*z+y*w)", "r02"), ("2*(x*z-y*w)", "r20"))) + " FROM (SELECT event_id, qx/n AS x, qy/n AS y, qz/n AS z, qw/n AS w FROM (SELECT *, sqrt(qx*qx+qy*qy+qz*qz+qw*qw) AS n FROM (SELECT event_id, (event_id % 7)*1.0::DOUBLE AS qx, (event_id % 5)*1.0::DOUBLE AS qy, (event_id % 3)*1.0::DOUBLE AS qz, 1.0::DOUBLE AS qw FROM events)))")
def quaternion_matrix(spark, sf):
    e = table(spark, sf, "events")
    m = G.quaternion_matrix(*((F.col("event_id") % k).cast("double") for k in (7, 5, 3)), F.lit(1.0))
    return rounded(e.select("event_id", m[0].alias("r00"), m[1].alias("r01"), m[2].alias("r02"), m[6].alias("r20")), "r00", "r01", "r02", "r20")


@plan("WITH a AS (SELECT event_id, (event_id % 7)/10.0::DOUBLE AS r, (event_id % 5)/10.0::DOUBLE AS p, (event_id % 3)/10.0::DOUBLE AS y FROM events) SELECT event_id, " + ", ".join(rnd(e, n) for e, n in (("sin(r/2)*cos(p/2)*cos(y/2)-cos(r/2)*sin(p/2)*sin(y/2)", "qx"), ("cos(r/2)*sin(p/2)*cos(y/2)+sin(r/2)*cos(p/2)*sin(y/2)", "qy"), ("cos(r/2)*cos(p/2)*sin(y/2)-sin(r/2)*sin(p/2)*cos(y/2)", "qz"), ("cos(r/2)*cos(p/2)*cos(y/2)+sin(r/2)*sin(p/2)*sin(y/2)", "qw"))) + " FROM a")
def rpy_quaternion(spark, sf):
    q = G.rpy_quaternion(*((F.col("event_id") % k) / 10.0 for k in (7, 5, 3)))
    return rounded(table(spark, sf, "events").select("event_id", *(c.alias(n) for c, n in zip(q, ("qx", "qy", "qz", "qw")))), "qx", "qy", "qz", "qw")
