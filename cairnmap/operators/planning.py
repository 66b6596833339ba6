"""Path planning over cell graphs and rasters."""

from __future__ import annotations

import uuid
from itertools import count
from math import log, sin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .cells import COV, KEY, MEAN, columns
from .lineage import cut, listed, shared_folder

#: Rows that a round of ``reachable`` may broadcast, by its front and the most edges of a node, and hops of a round, at most.
BALL, MOST_HOPS = 1 << 20, 16


def transit_edges(cells: DataFrame, size: float, step: float, slope: float = 1.0, n: int = 1) -> DataFrame:
    """src, dst, cost between cells of one block whose means are near enough and not too steep: cost is distance + 1. Ids are struct keys as strings."""
    name = F.concat_ws(":", *KEY)
    own = cells.select(name.alias("src"), *(F.col(k).alias("p" + k) for k in KEY), *(F.col(m).alias("s" + m) for m in MEAN))
    for k in KEY:
        own = own.withColumn(k, F.explode(F.sequence(F.col("p" + k) - n, F.col("p" + k) + n)))
    both = own.join(cells.select(*KEY, *MEAN, name.alias("dst")), list(KEY)).filter("src != dst")
    gap = [F.col(m) - F.col("s" + m) for m in MEAN]
    both = both.select("src", "dst", G.norm(*gap).alias("d"), F.abs(gap[2]).alias("up"), G.norm(gap[0], gap[1]).alias("flat"))
    return both.filter((F.col("d") <= step) & (F.col("up") <= slope * F.greatest(F.col("flat"), F.lit(1e-9)))).select("src", "dst", (F.col("d") + 1).alias("cost"))


def wavefront(edges: DataFrame, goal: str, most: float = 1e9, delta: float | None = None, symmetric: bool = True, tile=None) -> DataFrame:
    """node, cost, next: least cost to the goal over edges (src, dst, cost > 0), by buckets of cost of width ``delta`` (the mean edge by default).

    Buckets are settled in order. Offers lie in files by bucket, so a round reads its own bucket's; edges shorter than ``delta`` are followed within the
    bucket until nothing gets cheaper, then the bucket's nodes are appended to the settled ones and send along all edges once. Nothing that is
    settled is written again. With ``tile``, a column function of a node's name, edges are stored by dst's tile, and a round reads those of the bucket's nodes only. In a
    ``symmetric`` graph a node that is offered was settled no more than twice the longest edge before, so only those buckets are looked
    at. Costs beyond ``most`` end the wave; unreachable nodes have no row. Rows with nulls don't count.
    """
    spark = edges.sparkSession
    home = f"{shared_folder(spark)}/wavefront-{uuid.uuid4().hex}"
    tiled = tile is not None
    own = edges.select("src", "dst", F.col("cost").cast("double").alias("cost"), *([tile("dst").alias("tile")] if tiled else [])).dropna()
    (own.repartition("tile").write.partitionBy("tile") if tiled else own.write).parquet(f"{home}/edges")
    own = spark.read.schema(own.schema).parquet(f"{home}/edges")
    mean, longest, shortest = own.agg(F.avg("cost"), F.max("cost"), F.min("cost")).first()
    delta = delta or mean or 1.0
    rank = lambda cost: F.floor(cost / delta).cast("long")
    schema = "node string, cost double, next string"
    back = int(2 * (longest or 0) / delta) + 2
    rounds: dict[int, list[int]] = {0: [0]}
    spark.createDataFrame([(goal, 0.0, goal, 0)], schema + ", bucket long").write.partitionBy("bucket").parquet(f"{home}/offers/0")
    settled: list[int] = []

    def sent(front: DataFrame) -> DataFrame:
        near = own
        if tiled:  # a round's tiles: as many as the bucket's nodes lie in
            near = own.filter(F.col("tile").isin([r[0] for r in front.select(tile("node")).distinct().collect()]))
        return front.select(F.col("node").alias("dst"), F.col("cost").alias("c")).join(near, "dst").select(F.col("src").alias("node"), (F.col("c") + F.col("cost")).alias("cost"), F.col("dst").alias("next"), F.col("cost").alias("edge")).filter(F.col("cost") <= most)

    def least(offers: DataFrame) -> DataFrame:
        return offers.groupBy("node").agg(F.min(F.struct("cost", "next")).alias("o")).select("node", "o.cost", "o.next")

    while rounds:
        bucket = min(rounds)
        files = [f"{home}/offers/{r}/bucket={bucket}" for r in rounds.pop(bucket)]
        known = [f"{home}/settled/{b}" for b in settled if not symmetric or b >= bucket - back]
        done = spark.read.schema(schema).parquet(*known).select("node") if known else None
        fresh = lambda d: d if done is None else d.join(done, "node", "left_anti")  # noqa: B023, E731
        held = cut(fresh(least(spark.read.schema(schema).parquet(*files))))
        front = held
        while shortest is not None and shortest < delta and not front.isEmpty():
            light = sent(front).filter((F.col("edge") < delta) & (rank(F.col("cost")) == bucket)).drop("edge")
            new = fresh(least(light)).join(held.select("node", F.col("cost").alias("had")), "node", "left")
            front = cut(new.filter("had is null or cost < had - 1e-12").drop("had"))
            if not front.isEmpty():
                held = cut(least(held.unionByName(front)))
        if held.isEmpty():
            continue
        held.write.parquet(f"{home}/settled/{bucket}")
        settled.append(bucket)
        number = len(settled)
        out = sent(held).drop("edge").withColumn("bucket", rank(F.col("cost"))).filter(F.col("bucket") > bucket)
        out.write.partitionBy("bucket").parquet(f"{home}/offers/{number}")
        for name in listed(spark, f"{home}/offers/{number}"):
            rounds.setdefault(int(name[7:]), []).append(number)
    return spark.read.schema(schema).parquet(*(f"{home}/settled/{b}" for b in settled))


def path(costs: DataFrame, start: str) -> DataFrame:
    """step, node from a start to the goal along ``next``, by pointer doubling: rounds are the logarithm of the length."""
    hops = costs.select("node", "next")
    walk = hops.filter(F.col("node") == start).select(F.lit(0).cast("long").alias("step"), "node")
    length = 1
    while True:
        more = walk.join(hops, "node").select((F.col("step") + length).alias("step"), F.col("next").alias("node"))
        grown = cut(walk.union(more).groupBy("node").agg(F.min("step").alias("step")).select("step", "node"))
        if grown.count() == walk.count():
            break
        walk, length = grown, length * 2
        hops = cut(hops.join(hops.select(F.col("node").alias("next"), F.col("next").alias("after")), "next").select("node", F.col("after").alias("next")))
    return walk


def allowed_positions(raster: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Free positions (i, j) whose footprint (offsets) meets no occupied pixel: occupied pixels are dilated by equality, then an anti-join."""
    blocked = raster.filter("occ").select("i", "j", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])).alias("o"))
    blocked = blocked.select((F.col("i") - F.col("o.a")).cast("int").alias("i"), (F.col("j") - F.col("o.b")).cast("int").alias("j")).distinct()
    return raster.select("i", "j").join(blocked, ["i", "j"], "left_anti")


def line_pixels(lines: DataFrame, by: str) -> DataFrame:
    """by, step, i, j of walks from (i0, j0) to (i1, j1): diagonal while both coordinates differ, then straight, both ends included."""
    di, dj = F.col("i1") - F.col("i0"), F.col("j1") - F.col("j0")
    out = lines.withColumn("step", F.explode(F.sequence(F.lit(0), F.greatest(F.abs(di), F.abs(dj)))))
    at = lambda start, d: (F.col(start) + F.signum(d.cast("double")).cast("int") * F.least(F.col("step"), F.abs(d))).cast("int")
    return out.select(by, "step", at("i0", di).alias("i"), at("j0", dj).alias("j"))


def half_planes(polygons: DataFrame, by: str) -> DataFrame:
    """by, edge, a0, a1, b with a . p <= b inside, of convex polygons (by, edge, x, y) given counter-clockwise."""
    from pyspark.sql import Window

    w, whole = Window.partitionBy(by).orderBy("edge"), Window.partitionBy(by).orderBy("edge").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("x", "y"))
    out = polygons.withColumn("nx", nx).withColumn("ny", ny)
    a0, a1 = F.col("ny") - F.col("y"), F.col("x") - F.col("nx")
    return out.select(by, "edge", a0.alias("a0"), a1.alias("a1"), (a0 * F.col("x") + a1 * F.col("y")).alias("b"))


def inside(points: DataFrame, planes: DataFrame, by: str, point_id: str) -> DataFrame:
    """point_id, by of points (with their polygon's id) that satisfy all half-planes."""
    held = points.join(planes, by).groupBy(point_id, by).agg(F.bool_and(F.col("a0") * F.col("x") + F.col("a1") * F.col("y") <= F.col("b") + 1e-9).alias("ok"))
    return held.filter("ok").select(point_id, by)


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """center, node, hops: breadth-first growth of all seeds (center) at once over allowed edges (src, dst).

    A round takes as many hops as a front of its size can take without passing ``BALL`` rows: the ball is broadcast to the edges, which are not
    shuffled, and carries what it has reached by edges of no length to the nodes themselves. A front too large for that takes one hop by a
    shuffled join. Every round appends its new nodes; what was found before is read, not written again.
    """
    spark = edges.sparkSession
    home = f"{shared_folder(spark)}/reachable-{uuid.uuid4().hex}"
    new = seeds.select("center", F.col("center").alias("node"), F.lit(0).alias("hops")).distinct()
    schema, done = new.schema, 0
    loops = edges.select(F.col("dst").alias("src"), "dst").distinct().withColumn("_d", F.lit(0))
    steps = cut(edges.select("src", "dst").withColumn("_d", F.lit(1)).unionByName(loops))
    branches = max(2, steps.groupBy("src").count().agg(F.max("count")).first()[0] or 0)
    for k in count(1):
        new.write.parquet(f"{home}/{k - 1}")
        found = spark.read.schema(schema).parquet(*(f"{home}/{n}" for n in range(k)))
        front = spark.read.schema(schema).parquet(f"{home}/{k - 1}").filter(F.col("hops") == done)
        size = front.count()
        if not size:
            return found
        hops = min(MOST_HOPS, int(log(max(BALL / size, 1), branches)))
        for _ in range(max(hops, 1)):
            ball = F.broadcast(front) if hops else front
            met = ball.withColumnRenamed("node", "src").join(steps, "src").groupBy("center", F.col("dst").alias("node"))
            front, done = met.agg(F.min(F.col("hops") + F.col("_d")).alias("hops")), done + 1
        new = front.join(found.select("center", "node"), ["center", "node"], "left_anti").select(*schema.names)


def _around(cells: DataFrame, radius: float, size: float) -> DataFrame:
    """Pairs of cells whose centres lie within a radius: columns of the first, those of the second with the prefix t_, and dist."""
    from .joins import radius_pairs

    name = F.concat_ws(":", *KEY)
    place = cells.select(name.alias("name"), *((F.col(k) * size).alias(a) for k, a in zip(KEY, G.AXES)))
    pairs = radius_pairs(place, place, radius, "name", "name")
    own = cells.withColumn("l_id", name)
    other = cells.select(name.alias("r_id"), *(F.col(c).alias("t_" + c) for c in cells.columns))
    return pairs.join(own, "l_id").join(other, "r_id")


def closest_of_class(cells: DataFrame, radius: float, size: float, kind: str = "HORIZONTAL") -> DataFrame:
    """ix, iy, iz, near, dist: each cell's nearest cell (by centre, ties to the smaller name) of a class within a radius."""
    pairs = _around(cells, radius, size).filter(F.col("t_class") == kind)
    best = F.min(F.struct(F.round("dist", 9).alias("dist"), F.col("r_id").alias("near"))).alias("b")
    return pairs.groupBy(*KEY).agg(best).select(*KEY, "b.near", "b.dist")


def collisions(cells: DataFrame, size: float, robot: tuple[float, float, float], incline: float) -> DataFrame:
    """ix, iy, iz, collides of cells with a class: whether a robot of a size can't stand there.

    It can't on cells that are neither horizontal nor inclined. Of the cells within its radius, those above whose bottom is below its height and
    whose centre is within its flat radius are looked at: one off the vertical counts if its mean is nearer than the radius or its
    ellipsoid reaches into it (Mahalanobis form below 1), one near the vertical if it is no support (neither horizontal nor inclined).
    """
    flat = (robot[0] ** 2 + robot[1] ** 2) ** 0.5 / 2
    radius = sum(r * r for r in robot) ** 0.5 / 2
    limit = 2 * sin(incline)
    firm = lambda c: F.col(c).isin("HORIZONTAL", "INCLINED")
    pairs = _around(cells, radius, size)
    z, tz = F.col("iz") * size, F.col("t_iz") * size
    above = (z < tz) & (z + robot[2] > tz - size) & (G.norm((F.col("ix") - F.col("t_ix")) * size, (F.col("iy") - F.col("t_iy")) * size) < flat)
    gap = [F.col("ix") * size - F.col("t_mx"), F.col("iy") * size - F.col("t_my"), F.col("mz") - F.col("t_mz")]
    pairs = pairs.withColumns({f"_g{k}": g for k, g in enumerate(gap)}).withColumn("_above", above)
    g = [F.col(f"_g{k}") for k in range(3)]
    length = G.norm(*g)
    share = (length - radius) / F.nullif(length, F.lit(0.0))
    form = share * share * G.quadratic(g, G.inverse([F.col("t_" + c) for c in COV]))
    side = F.abs(g[2]) / F.greatest(length, F.lit(10e-10)) > limit
    hit = F.col("_above") & F.when(side, (length < radius) | F.coalesce(form < 1, F.lit(False))).otherwise(~firm("t_class"))
    found = pairs.groupBy(*KEY).agg(F.bool_or(hit).alias("hit"))
    return cells.join(found, list(KEY), "left").select(*KEY, (~firm("class") | F.coalesce("hit", F.lit(False))).alias("collides"))


def drivable(cells: DataFrame, blocked: DataFrame, edges: DataFrame, seed: str) -> DataFrame:
    """node, drivable of all cells: those reached from a seed over edges between cells that don't collide, and the rest."""
    free = cut(blocked.filter(~F.col("collides")).select(F.concat_ws(":", *KEY).alias("node")))
    open_edges = edges.join(free.withColumnRenamed("node", "src"), "src", "left_semi").join(free.withColumnRenamed("node", "dst"), "dst", "left_semi")
    found = reachable(cut(open_edges), free.filter(F.col("node") == seed).withColumnRenamed("node", "center"))
    return cells.select(F.concat_ws(":", *KEY).alias("node")).join(found.select("node", F.lit(True).alias("drivable")), "node", "left").fillna(False, ["drivable"])


def _walls_before(full, di: int, dj: int):
    """Blocked pixels on the way to each pixel in steps of (di, dj), itself included."""
    import numpy as np

    out = full.astype(np.int16)
    if not di:
        return out.cumsum(1, dtype=np.int16)
    for i in range(1, len(out)):
        if not dj:
            out[i] += out[i - 1]
        elif dj > 0:
            out[i, 1:] += out[i - 1, :-1]
        else:
            out[i, :-1] += out[i - 1, 1:]
    return out


def _grown(now, towards, full, moves: int, start: int, apart: int):
    """Corners (n x 4 x 2) of quadrangles grown around places, and which of them started free; all in pixels of the raster ``full``.

    now: n x 2 places; towards: two n x 2 places each with a mask of those that exist. An edge goes diagonally, then straight, so sums along
    the raster's rows, columns and diagonals tell by two differences whether it meets a blocked pixel.
    """
    import numpy as np

    down, right, falling, rising = (_walls_before(full, *d) for d in ((1, 0), (0, 1), (1, 1), (1, -1)))

    def on(sums, i, j, to_i, to_j):
        """Blocked pixels from a place to another along the sums' direction, but for the first."""
        return np.abs(sums[to_i, to_j].astype(np.int32) - sums[i, j]) + np.where((to_i > i) | ((to_i == i) & (to_j > j)), 0, full[to_i, to_j].astype(np.int32) - full[i, j])

    def blocked(c):
        found = np.zeros(len(c), bool)
        for k in range(4):
            (i, j), (to_i, to_j) = c[:, k].T, c[:, (k + 1) % 4].T
            di, dj = to_i - i, to_j - j
            both = np.minimum(np.abs(di), np.abs(dj))
            mi, mj = i + np.sign(di) * both, j + np.sign(dj) * both
            found |= full[i, j] > 0
            found |= np.where(di * dj >= 0, on(falling, i, j, mi, mj), on(rising, i, j, mi, mj)) != 0
            found |= np.where(mi == to_i, on(right, mi, mj, to_i, to_j), on(down, mi, mj, to_i, to_j)) != 0
        return found

    best = now[:, None] + start * np.array([(-1, -1), (-1, 1), (1, 1), (1, -1)])
    begun = ~blocked(best)
    at = np.flatnonzero(begun & (towards[0][1] | towards[1][1]))
    for _ in range(moves):
        if not len(at):
            break
        move, row = best[at], np.arange(len(at))
        for goals, known in towards:
            goal, k = goals[at], known[at]
            gap = np.hypot(*(move - goal[:, None]).transpose(2, 0, 1))
            one = gap.argmin(1)
            last, after = (one - 1) % 4, (one + 1) % 4
            two = np.where(gap[row, last] < gap[row, after], last, after)
            for corner in (one, two):
                move[row, corner] += np.where(k[:, None], np.where(move[row, corner] > goal, -1, 1), 0)
            off = move[row, one] - move[row, two]
            push = np.where(k[:, None] & (np.abs(off) < apart), np.where(off > 0, 2, -2), 0)
            move[row, one] += push
            move[row, two] -= push
        free = ~blocked(move)
        at = at[free]
        best[at] = move[free]
    return best, begun


def grow_polygons(path: DataFrame, blocked: DataFrame, by: str, moves: int = 50, start: int = 5, apart: int = 10, most: int = 20_000) -> DataFrame:
    """by, seq, edge, i, j: a free quadrangle around every point (by, seq, i, j: pixels) of a path, grown towards the points before and after it.

    It starts as a square of ``start`` pixels each way. In a move, for the point before and then the one after, the corner nearest to that point
    and the nearer of its neighbours step one pixel towards it in both coordinates, and two pixels away from each other in each
    coordinate in which they are closer than ``apart``. The last quadrangle without a blocked pixel on its edges stays; a start that meets one
    gives no rows. A task's group is about ``most`` seeds of a tile with a raster of the tile and its surroundings in reach, so it doesn't grow with the
    number of seeds or of blocked pixels.
    """
    from pyspark.sql import Window

    reach, tile = start + 6 * moves, 512
    along = Window.partitionBy(by).orderBy("seq")
    seeds = path.select(by, "seq", "i", "j", *(f(c).over(along).alias(p + c) for f, p in ((F.lag, "b"), (F.lead, "a")) for c in "ij"))
    seeds = seeds.select("*", *(F.floor(F.col(c) / tile).alias("t" + c) for c in "ij"))
    parts = seeds.groupBy("ti", "tj").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    seeds = seeds.join(parts, ["ti", "tj"]).withColumn("part", F.pmod(F.xxhash64(by, "seq"), "parts").cast("int")).drop("parts")
    tiles = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    walls = blocked.select("i", "j").distinct().select("i", "j", F.explode(tiles("i")).alias("ti")).withColumn("tj", F.explode(tiles("j")))
    walls = walls.join(parts, ["ti", "tj"]).select("i", "j", "ti", "tj", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    kind = dict(path.dtypes)[by]

    def run(key, seed, walls):
        import numpy as np
        import pandas as pd

        corner = np.array([int(k) * tile - reach for k in key[:2]])
        full = np.zeros((tile + 2 * reach + 1,) * 2, np.int8)
        full[tuple((walls[["i", "j"]].to_numpy(np.int64) - corner).T)] = 1
        towards = [(seed[[p + "i", p + "j"]].fillna(0).to_numpy(np.int64) - corner, seed[p + "i"].notna().to_numpy()) for p in "ba"]
        best, begun = _grown(seed[["i", "j"]].to_numpy(np.int64) - corner, towards, full, moves, start, apart)
        best = best[begun] + corner
        own = {c: np.repeat(seed[c].to_numpy()[begun], 4) for c in (by, "seq")}
        return pd.DataFrame(own | {"edge": np.tile(np.arange(4), len(best)), "i": best[:, :, 0].reshape(-1), "j": best[:, :, 1].reshape(-1)})

    keys = ("ti", "tj", "part")
    return seeds.groupBy(*keys).cogroup(walls.groupBy(*keys)).applyInPandas(run, f"`{by}` {kind}, seq long, edge int, i int, j int")
