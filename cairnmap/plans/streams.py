"""Plans of state across messages, of poses between stamps, and of paired topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import state as S
from .registry import POSES, plan, rnd, rounded, sql_poses, table

_POINTS = "pt AS (SELECT *, dx * j * 0.48713 AS px, dyaw * j * 9.71317 AS py, j * 0.24773::DOUBLE AS pz FROM poses, (SELECT unnest(range(1, 5)) AS j))"
_GATED = """k AS (SELECT robot_id, seq, x, y, yaw, row_number() OVER (PARTITION BY robot_id ORDER BY seq) - 3 AS rn FROM poses QUALIFY rn > 0),
g AS (SELECT robot_id, rn, seq, x, y, yaw, true AS kept FROM k WHERE rn = 1 UNION ALL
SELECT g.robot_id, k.rn, CASE WHEN far THEN k.seq ELSE g.seq END, CASE WHEN far THEN k.x ELSE g.x END, CASE WHEN far THEN k.y ELSE g.y END, CASE WHEN far THEN k.yaw ELSE g.yaw END, far
FROM g JOIN k ON k.robot_id = g.robot_id AND k.rn = g.rn + 1, LATERAL (SELECT sqrt((k.x-g.x)**2+(k.y-g.y)**2) > 0.5 OR abs(atan2(sin(k.yaw-g.yaw), cos(k.yaw-g.yaw))) > 0.025 AS far)),
kn AS (SELECT robot_id, seq, x, y, yaw, row_number() OVER w AS n, first_value(seq) OVER (PARTITION BY robot_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS oldest FROM g WHERE kept WINDOW w AS (PARTITION BY robot_id ORDER BY seq)),
wp AS (SELECT kn.robot_id, kn.seq, CAST(least(kn.n, 10) AS INTEGER) AS frames, kn.oldest, cos(kn.yaw)*px - sin(kn.yaw)*py + kn.x AS x, sin(kn.yaw)*px + cos(kn.yaw)*py + kn.y AS y, pz AS z FROM kn JOIN pt USING (robot_id, seq))"""
_CELL = ", ".join(f"CAST(floor({a} / 0.5 + 0.5) AS INTEGER) AS i{a}" for a in "xyz")
_STATS = ", ".join([rnd(f"avg({a})", f"m{a}", 6) for a in "xyz"] + [rnd(f"covar_samp({p[0]},{p[1]})", f"c{p}", 6) for p in ("xx", "xy", "xz", "yy", "yz", "zz")])


def messages(spark, sf):
    """Every robot's poses with four points seen from each."""
    point = lambda j: F.struct((F.col("dx") * j * 0.48713).alias("x"), (F.col("dyaw") * j * 9.71317).alias("y"), F.lit(j * 0.24773).alias("z"))
    return sql_poses(spark, sf).select("robot_id", "seq", "x", "y", "yaw", F.array(*(point(j) for j in range(1, 5))).alias("points"))


@plan(f"WITH RECURSIVE {POSES}, {_POINTS}, {_GATED}, c AS (SELECT *, {_CELL} FROM wp) SELECT robot_id, ix, iy, iz, max(seq) AS seq, max_by(frames, seq) AS frames, max_by(oldest, seq) AS oldest, count(*) AS n, {_STATS} FROM c GROUP BY robot_id, ix, iy, iz")
def streamed_map(spark, sf):
    """Each robot's map, gate and last ten frames as its stateful processor leaves them after all messages."""
    cells = S.newest_cells(S.fused_map(messages(spark, sf), 0.5, 0.5, 0.025, skip=3, frames=10, newest=True))
    return rounded(cells, "mx", "my", "mz", "cxx", "cxy", "cxz", "cyy", "cyz", "czz")


@plan()
def approximate_pairs(spark, sf):
    """Clicks and purchases of a user paired one to one by approximate time, within half a day."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), "event_type")
    return S.paired_topics(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), 12 * 3_600_000)
