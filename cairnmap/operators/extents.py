"""Grid extents, index groups, box and sphere predicates, split tests and other column-level operators over points and cells."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .cells import KEY, MEAN, binned, columns, with_eigenvalues
from .lineage import cut


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def bayes(p: Column, likelihood: Column) -> Column:
    """Two-state Bayes update of a probability."""
    return p * likelihood / (p * likelihood + (1 - p) * (1 - likelihood))


def double_factorial(n: Column) -> Column:
    """n (n - 2) (n - 4) ... of integers up to 33; 1 below 2."""
    steps = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (n - k) % 2 == 0)
    return F.aggregate(steps, F.lit(1).cast("long"), lambda s, k: s * k)


def binomial(n: Column, k: Column, p: Column) -> Column:
    """Probability of k hits in n trials; n up to 20."""
    ways = F.factorial(n) / (F.factorial(k) * F.factorial(n - k))
    return ways * F.pow(p, k) * F.pow(1 - p, n - k)


def skew(v: Sequence[Column]) -> list[Column]:
    """Row-major 3x3 with skew(v) w = v x w."""
    x, y, z = v
    zero = F.lit(0.0)
    return [zero, -z, y, z, zero, -x, -y, x, zero]


def to_pixel(x: Column, y: Column, size: float, centre: tuple[float, float], middle: tuple[int, int]) -> tuple[Column, Column]:
    """Row and column of a raster whose pixel ``middle`` holds the world point ``centre``."""
    return (F.floor((x - centre[0]) / size) + middle[0]).cast("int"), (F.floor((y - centre[1]) / size) + middle[1]).cast("int")


def to_world(i: Column, j: Column, size: float, centre: tuple[float, float], middle: tuple[int, int]) -> tuple[Column, Column]:
    return (i - middle[0]) * size + centre[0], (j - middle[1]) * size + centre[1]


def in_box(point: Sequence[Column], low: Sequence, high: Sequence) -> Column:
    """Half-open containment."""
    return reduce(lambda a, b: a & b, [(p >= l) & (p < h) for p, l, h in zip(point, low, high)])


def sphere_meets_box(centre: Sequence, radius: float, low: Sequence[Column], high: Sequence[Column]) -> Column:
    """Whether the box's nearest point to the centre lies within the radius."""
    gaps = [F.greatest(l - c, F.lit(0.0), c - h) for c, l, h in zip(map(F.lit, centre), low, high)]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2] <= radius * radius


def convex_side(x1: Column, y1: Column, x2: Column, y2: Column, px: Column, py: Column, cx: Column, cy: Column) -> Column:
    """Whether p and c, seen as vectors, lie on one side of the direction normal to the line 1-2."""
    nx, ny = y2 - y1, x1 - x2
    return (px * nx + py * ny) * (cx * nx + cy * ny) > 0


def guessed_extent(points: DataFrame, by: tuple[str, ...], size: float) -> DataFrame:
    """Centre and extent of a map guessed from its points: the centroid, 4 times the largest distance from it sideways, 3 times the height.

    Two aggregations: centroids, then distances against them by an equality join. cells_x, cells_y, cells_z: the extent in cells.
    """
    centre = points.groupBy(*by).agg(*(F.avg(a).alias("c" + a) for a in G.AXES))
    far = points.join(centre, list(by)).withColumn("d", G.distance(columns(G.AXES), [F.col("c" + a) for a in G.AXES]))
    out = far.groupBy(*by, *("c" + a for a in G.AXES)).agg((4 * F.max("d")).alias("side"), (3 * (F.max("z") - F.min("z"))).alias("height"), F.count("*").alias("n"))
    cells = lambda c: F.abs(F.ceil(F.col(c) / size)).cast("int")
    return out.withColumns({"cells_x": cells("side"), "cells_y": cells("side"), "cells_z": cells("height")})


def snapped(points: DataFrame, by: tuple[str, ...], size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Each key's centroid moved onto another map's lattice: origin + floor(difference / size) * size."""
    own = points.groupBy(*by).agg(*(F.avg(a).alias("c" + a) for a in G.AXES))
    return own.select(*by, *((o + F.floor((F.col("c" + a) - o) / size) * size).alias("c" + a) for a, o in zip(G.AXES, origin)))


def aligned_load(points: DataFrame, by: tuple[str, ...], size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Points with their cell's index against their key's snapped centre."""
    out = points.join(snapped(points, by, size, origin), list(by))
    return out.select(*points.columns, *(F.floor((F.col(a) - F.col("c" + a)) / size + 0.5).cast("int").alias("i" + a) for a in G.AXES))


def grouped_fit(points: DataFrame, groups: DataFrame, by: str, point_id: str, least: int = 3) -> DataFrame:
    """One Gaussian for each explicit group of point ids; a point may be in several groups."""
    pairs = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))
    own = [F.count("*").alias("n"), *(F.avg(a).alias(f"m{a}") for a in G.AXES), *(F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs)]
    return groups.join(points, point_id).groupBy(by).agg(*own).filter(F.col("n") >= least)


def dense(cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Every cell of each key's bounding box of indices, those without points with n = 0."""
    ends = cells.groupBy(*by).agg(*(f(k).alias(n + k) for k in KEY for f, n in ((F.min, "lo_"), (F.max, "hi_"))))
    for k in KEY:
        ends = ends.withColumn(k, F.explode(F.sequence("lo_" + k, "hi_" + k)))
    return ends.select(*by, *KEY).join(cells.select(*by, *KEY, "n"), [*by, *KEY], "left").fillna(0, ["n"])


def flat() -> Column:
    """The flatness test on columns l0, l1: ten times the smallest eigenvalue is still below the middle one."""
    return F.col("l0") * 10 < F.col("l1")


def residual_bic(points: DataFrame, size: float, by: tuple[str, ...] = (), least: int = 4) -> DataFrame:
    """Per cell: squared distances from the mean over the variance of the distances, plus the log of the number of points."""
    keyed = binned(points, size)
    means = keyed.groupBy(*by, *KEY).agg(F.count("*").alias("n"), *(F.avg(a).alias("m" + a) for a in G.AXES)).filter(F.col("n") >= least)
    r = G.distance(columns(G.AXES), columns(MEAN))
    out = keyed.join(means, [*by, *KEY]).withColumn("r", r).groupBy(*by, *KEY).agg(F.count("*").alias("n"), F.sum(F.col("r") * F.col("r")).alias("rss"), F.var_samp("r").alias("v"))
    return out.select(*by, *KEY, "n", (F.col("rss") / F.nullif(F.col("v"), F.lit(0.0)) + F.log(F.col("n").cast("double"))).alias("bic"))


def adaptive_leaves(points: DataFrame, big: float, depth: int = 3, least: int = 8) -> DataFrame:
    """Leaves (level, ix, iy, iz, n) of cornered boxes of side ``big``, split in eight while they hold ``least`` points and aren't flat, down to ``depth``.

    Every level is one aggregation, checkpointed; a box is looked at where its parent is split, by one equality join a level.
    """
    out, parents = None, None
    pairs = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))
    splits = (F.col("n") >= least) & ~F.coalesce(flat(), F.lit(True))
    for level in range(depth + 1):
        side = big / 2**level
        keyed = points.select(*G.AXES, *(F.floor(F.col(a) / side).cast("int").alias("i" + a) for a in G.AXES))
        own = keyed.groupBy(*KEY).agg(F.count("*").alias("n"), *(F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs))
        if parents is not None:
            up = F.struct(*(F.floor(F.col(k) / 2).cast("int").alias(k) for k in KEY))
            own = own.withColumn("_up", up).join(parents.select(F.struct(*KEY).alias("_up")), "_up", "left_semi").drop("_up")
        own = cut(with_eigenvalues(own))
        leaf = (own if level == depth else own.filter(~splits)).select(F.lit(level).alias("level"), *KEY, "n")
        out = leaf if out is None else out.union(leaf)
        parents = own.filter(splits).select(*KEY)
    return out


def four_nearest(points: DataFrame, cells: DataFrame, size: float, by: str, n: int = 4, reach: int = 1) -> DataFrame:
    """by, rank, ix, iy, iz, dist of the n cells of a block whose means are nearest."""
    from .joins import cell_blocks, in_block

    held = in_block(points.select(by, *G.AXES), cell_blocks(cells, reach), size)
    rank = F.row_number().over(Window.partitionBy(by).orderBy("dist", *KEY))
    return held.select(by, *KEY, "dist").withColumn("rank", rank).filter(F.col("rank") <= n)


def trimmed(frames: DataFrame, by: tuple[str, ...], order: str, most: int) -> DataFrame:
    """Bounded history: a key with more than ``most`` frames keeps its last one only."""
    w = Window.partitionBy(*by)
    last = F.row_number().over(w.orderBy(F.col(order).desc()))
    return frames.withColumn("_n", F.count("*").over(w)).withColumn("_r", last).filter((F.col("_n") <= most) | (F.col("_r") == 1)).drop("_n", "_r")


def after_first(frames: DataFrame, by: tuple[str, ...], order: str, skip: int = 3) -> DataFrame:
    """Frames from the ``skip`` + 1-th on."""
    return frames.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("_r") > skip).drop("_r")


def consistent(steps: DataFrame, metres: float = 1.0, radians: float = 3.141592653589793 / 4) -> DataFrame:
    """Registered motions (ex, ey, ea) that deviate from the odometry (ox, oy, oa) by at most a distance and an angle."""
    off = G.norm(F.col("ex") - F.col("ox"), F.col("ey") - F.col("oy"))
    return steps.filter((off <= metres) & (F.abs(G.wrap_angle(F.col("ea") - F.col("oa"))) <= radians))


def pulled_back(points: DataFrame, offset: Column, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Negative samples: each point moved towards the origin along its ray by an offset, at most to the origin."""
    d = [F.col(a) - o for a, o in zip(G.AXES, origin)]
    length = G.norm(*d)
    factor = F.greatest(F.lit(0.0), (length - offset) / F.nullif(length, F.lit(0.0)))
    return points.select(*[c for c in points.columns if c not in G.AXES], *((o + F.coalesce(factor, F.lit(0.0)) * x).alias(a) for a, o, x in zip(G.AXES, origin, d)))


def roc_counts(scores: DataFrame, score: str, positive: str, steps: int = 100) -> DataFrame:
    """threshold, tp, fp, fn, tn at ``steps`` thresholds: a histogram of the scores, then running sums over its few rows.

    A score with floor(score * steps) above a threshold's number counts as found.
    """
    spark = scores.sparkSession
    bin_ = F.least(F.floor(F.col(score) * steps), F.lit(steps)).cast("int")
    held = scores.groupBy(bin_.alias("bin")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    every = spark.range(steps + 1).select(F.col("id").cast("int").alias("bin")).join(held, "bin", "left").fillna(0)
    above, whole = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    tp, fp = (F.coalesce(F.sum(c).over(above), F.lit(0)) for c in "pn")
    out = every.select(F.col("bin").alias("threshold"), tp.alias("tp"), fp.alias("fp"), (F.sum("p").over(whole) - tp).alias("fn"), (F.sum("n").over(whole) - fp).alias("tn"))
    return out.filter(F.col("threshold") < steps)


def cell_colour(cells: DataFrame, kind: str) -> DataFrame:
    """r, g, b of cells by class, occupancy, cost or height (columns class, occ, cost, mz)."""
    if kind == "class":
        c = F.col("class")
        r, g, b = (F.when(c == "ROUGH", 1.0).otherwise(0.0), F.when(c == "HORIZONTAL", 1.0).when(c == "INCLINED", 0.5).otherwise(0.0), F.when(c == "VERTICAL", 1.0).when(c == "INCLINED", 0.5).otherwise(0.0))
    elif kind == "occupancy":
        p = G.occupancy_probability(F.col("occ"))
        r, g, b = p, 1 - p, F.lit(0.0)
    elif kind == "cost":
        share = F.least(F.lit(1.0), F.col("cost") / 100.0)
        r, g, b = F.when(F.col("cost") < 0, 1.0).otherwise(share), F.when(F.col("cost") < 0, 0.0).otherwise(1 - share), F.lit(0.0)
    else:
        share = clamp((F.col("mz") + 1) / 2, 0.0, 1.0)
        r, g, b = share, F.lit(0.2), 1 - share
    return cells.select("*", r.alias("r"), g.alias("g"), b.alias("b"))
