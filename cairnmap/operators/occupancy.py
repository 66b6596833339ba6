"""Occupancy evidence: rays against a snapshot of the map, sums per cell, clamped logs and two-state event models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .cells import COV, KEY, MEAN, columns, peak_on_line
from .joins import ray_cells

#: Log-odds of one hit.
HIT = 0.4054651081081644  # ln(0.6 / 0.4)


def crossing_evidence(rays: DataFrame, cells: DataFrame, size: float, by: tuple[str, ...], noise: float = 0.06, weight: float = 1.0) -> DataFrame:
    """by, ix, iy, iz, e: what each ray says against each cell that it crosses.

    In a cell with a Gaussian: with d the distance from its most likely point on the ray to the ray's end, l the
    likelihood there times 1 - exp(-d^2 / (2 s^2)), s = 0.5 * length / 30 + noise, and p = 0.1 l + 0.5, evidence ln((1 - p) / p)
    counts where l >= 0.3; without a Gaussian -0.2. All rays see the map before the scan. Rays over 200 are skipped.
    """
    steps = ray_cells(rays, size, by).filter("length <= 200")
    crossed = peak_on_line(steps.join(cells, list(KEY), "left"), [F.col("o" + a) for a in G.AXES], columns(G.AXES))
    d = G.distance([F.col("peak_" + a) for a in G.AXES], columns(G.AXES))
    spread = 0.5 * F.col("length") / 30 + noise
    crossed = crossed.withColumn("seen", F.col("peak") * (1 - F.exp(-0.5 * d * d / (spread * spread)))).withColumn("p", 0.1 * F.col("seen") + 0.5)
    value = F.when(F.col("mx").isNull(), -0.2).when(F.col("seen") < 0.3, 0.0).otherwise(weight * F.log((1 - F.col("p")) / F.col("p")))
    return crossed.select(*by, *KEY, value.alias("e"))


def ray_evidence(rays: DataFrame, cells: DataFrame, size: float, by: tuple[str, ...], noise: float = 0.06, weight: float = 1.0) -> DataFrame:
    """ix, iy, iz, rays, evidence: what rays say against the cells they cross, summed by cell."""
    return crossing_evidence(rays, cells, size, by, noise, weight).groupBy(*KEY).agg(F.count("*").alias("rays"), F.sum("e").alias("evidence"))


def measurement_evidence(rays: DataFrame, cells: DataFrame, size: float, by: tuple[str, ...], noise: float = 0.06) -> DataFrame:
    """by, cells, evidence: what each single measurement says, summed over the cells it crosses."""
    return crossing_evidence(rays, cells, size, by, noise).groupBy(*by).agg(F.count("*").alias("cells"), F.sum("e").alias("evidence"))


def hit_miss(rays: DataFrame, size: float, by: tuple[str, ...], limit: float = 255.0, hit: float = HIT, miss: float = 0.2) -> DataFrame:
    """ix, iy, iz, hits, misses, occ: ray ends against crossings, as the older occupancy map counts them."""
    hits = rays.select(*G.grid_keys(size)).groupBy(*KEY).agg(F.count("*").alias("hits"))
    misses = ray_cells(rays, size, by).groupBy(*KEY).agg(F.count("*").alias("misses"))
    out = hits.join(misses, list(KEY), "full").fillna(0, ["hits", "misses"])
    return out.withColumn("occ", F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("hits") * hit - miss * F.col("misses"))))


def _with_neighbours(cells: DataFrame) -> DataFrame:
    """Cells (key, mean, covariance) with _near: the means and inverse covariances (_mx, _my, _mz, _i0 .. _i5) of their 27 blocks, and which are their own."""
    from .joins import cell_blocks

    full = cells.select(*KEY, *MEAN, *COV, *(c.alias(f"i{k}") for k, c in enumerate(G.inverse(columns(COV)))))
    blocks = cell_blocks(full, 1, tuple(full.columns)).withColumnsRenamed({"k" + a: k for a, k in zip(G.AXES, KEY)})
    own = lambda c: (c["ix"] == F.col("ix")) & (c["iy"] == F.col("iy")) & (c["iz"] == F.col("iz"))
    form = (*MEAN, *(f"i{k}" for k in range(6)))
    near = F.transform("_block", lambda c: F.struct(*(c[n].alias("_" + n) for n in form), own(c).alias("_own")))
    held = blocks.select(*KEY, F.get(F.filter("_block", own), F.lit(0)).alias("_c"), near.alias("_near")).filter("_c is not null")
    return held.select(*KEY, *(F.col("_c")[n].alias(n) for n in (*MEAN, *COV)), "_near")


def ray_depth(rays: DataFrame, cells: DataFrame, size: float, by: str, threshold: float = 0.1, smooth: float = 0.0) -> DataFrame:
    """by, depth: the distance to the most likely point of the first crossed cell whose likelihood there passes the threshold; a miss is the length + 1.

    ``smooth`` adds that many times the likelihoods of the point in the neighbouring cells. Rays are dealt by ``by`` first and a cell carries its
    neighbours in an array, so the pairs of crossings and neighbours are summed in the task that makes them.
    """
    origin = [F.col("o" + a) for a in G.AXES]
    own = cells.select(*KEY, *MEAN, *COV)
    lines = rays
    if smooth:
        own, lines = _with_neighbours(own), rays.repartition(by)
    hit = peak_on_line(ray_cells(lines, size, (by,)).join(own, list(KEY)), origin, columns(G.AXES))
    peak = [F.col("peak_" + a) for a in G.AXES]
    hit = hit.select(by, "step", *peak, "peak", G.distance(peak, origin).alias("depth"), *(("_near",) if smooth else ()))
    if smooth:
        around = hit.select(by, "step", *peak, "peak", "depth", F.inline("_near"))
        lik = F.exp(-0.5 * G.quadratic([p - F.col("_" + m) for p, m in zip(peak, MEAN)], [F.col(f"_i{k}") for k in range(6)]))
        lik = F.when(F.col("_own"), 0.0).otherwise(F.coalesce(F.nanvl(lik, F.lit(-1.0)), F.lit(-1.0)))
        hit = around.groupBy(by, "step", "depth", "peak").agg(F.sum(lik).alias("near")).withColumn("peak", F.col("peak") + smooth * F.col("near"))
    # a condition inside the aggregate: a filter would be pushed down and repeat all of the peak's terms
    first = hit.groupBy(by).agg(F.min_by("depth", F.when(F.col("peak") > threshold, F.col("step"))).alias("depth"))
    length = G.distance(origin, columns(G.AXES))
    return rays.join(first, by, "left").select(by, F.coalesce("depth", length + 1).alias("depth"))


def depth_view(cells: DataFrame, size: float, width: int, height: int, focal: float, far: float) -> DataFrame:
    """u, v, depth: a depth image of a map seen from the origin along z, one ray a pixel."""
    i = F.col("pid")
    pixels = cells.sparkSession.range(width * height).withColumnRenamed("id", "pid")
    u, v = i % width, F.floor(i / width)
    rays = pixels.select("pid", *(F.lit(0.0).alias("o" + a) for a in G.AXES), ((u - (width - 1) / 2) / focal * far).alias("x"), ((v - (height - 1) / 2) / focal * far).alias("y"), F.lit(far).alias("z"))
    return ray_depth(rays, cells, size, "pid").select(u.cast("int").alias("u"), v.cast("int").alias("v"), "depth")


def updated(cells: DataFrame, evidence: DataFrame, limit: float = 255.0, hit: float = HIT) -> DataFrame:
    """Cells with occ: hits of their points and the rays' evidence, clamped; keys that only rays saw come with n = 0."""
    both = cells.select(*KEY, "n").join(evidence, list(KEY), "full")
    total = F.coalesce(F.col("n"), F.lit(0)) * hit + F.coalesce(F.col("evidence"), F.lit(0.0))
    return both.select(*KEY, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.greatest(F.lit(-limit), F.least(F.lit(limit), total)).alias("occ"))


def short_term(events: Column, used: int = 64) -> Column:
    """Occupancy from the last ``used`` measurements, kept as bits of a long."""
    mask = F.lit(-1 if used >= 64 else (1 << used) - 1).cast("long")
    hits = F.bit_count(events.bitwiseAND(mask))
    return G.occupancy_probability(hits * 0.4054651081081644 + (used - hits) * -0.8472978603872037)  # ln(.6/.4), ln(.3/.7)


def rate(events: Column, seen: Column) -> Column:
    return events / seen


def static_likelihood(enter: Column, leave: Column, observations: Column) -> tuple[Column, Column]:
    """Occupied and free likelihood one step of the two-state chain from even odds; 0.5 under 20 observations."""
    occupied = 0.5 * (1 - leave) + 0.5 * enter
    known = observations >= 20
    return F.when(known, occupied).otherwise(0.5), F.when(known, 1 - occupied).otherwise(0.5)


def semi_static_likelihood(leave: Column, enter: Column, observations: Column, steps: int) -> Column:
    """Odds that a cell is as it was after 2 ** steps moves, combined by Bayes and clamped to [0.001, 0.999]; 0 under 20 observations."""
    occupied, free = G.two_state_power(leave, enter, steps)
    joined = occupied * free / (occupied * free + (1 - occupied) * (1 - free))
    return F.when(observations < 20, 0.0).otherwise(F.greatest(F.lit(0.001), F.least(F.lit(0.999), joined)))


def predicted(enter: Column, leave: Column, observations: Column, current: Column, steps: int) -> tuple[Column, Column]:
    """Occupancy one step on (0.5 under 50 observations) and after 2 ** steps moves of the two-state chain.

    The second is 0.5 under 20 observations and 0.9 where the static likelihood passes 0.6.
    """
    now = (1 - current) * enter + current * (1 - leave)
    level, decay = enter / (enter + leave), F.pow(1 - enter - leave, F.lit(float(2**steps)))
    static, _ = static_likelihood(enter, leave, observations)
    later = F.when(observations < 20, 0.5).when(static > 0.6, 0.9).otherwise(level + decay * (current - level))
    return F.when(observations < 50, 0.5).otherwise(now), later


def event_counts(measurements: DataFrame, by: tuple[str, ...], order: str, occupied: str, forget: float = 5000.0 / 5001.0, cap: float = 30_000.0) -> DataFrame:
    """Per key, the ordered fold of occupied/free measurements: entry and exit counts with forgetting and a cap, and the last 64 as bits.

    State: exit, seen_occupied, entry, seen_free (doubles), history (long). An occupied measurement while the state
    was occupied adds to seen_occupied; a free one adds an exit as well; the reverse for the free state.
    """
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(occupied).cast("boolean").alias("m"))))
    start = F.struct(F.lit(1.0).alias("a_exit"), F.lit(1.0).alias("b_exit"), F.lit(1.0).alias("a_entry"), F.lit(1.0).alias("b_entry"), F.lit(0).cast("long").alias("history"), F.lit(False).alias("was"))

    def kept(value: Column) -> Column:
        return F.least(F.lit(cap), value * forget)

    def step(s: Column, x: Column) -> Column:
        now, was = x["m"], s["was"]
        return F.struct(
            F.when(was, kept(s["a_exit"]) + F.when(~now, 1.0).otherwise(0.0)).otherwise(s["a_exit"]).alias("a_exit"),
            F.when(was, kept(s["b_exit"]) + 1).otherwise(s["b_exit"]).alias("b_exit"),
            F.when(~was, kept(s["a_entry"]) + F.when(now, 1.0).otherwise(0.0)).otherwise(s["a_entry"]).alias("a_entry"),
            F.when(~was, kept(s["b_entry"]) + 1).otherwise(s["b_entry"]).alias("b_entry"),
            (F.shiftleft(s["history"], 1).bitwiseOR(now.cast("long"))).alias("history"),
            now.alias("was"),
        )

    folded = measurements.groupBy(*by).agg(held.alias("_m"), F.count("*").alias("observations")).withColumn("s", F.aggregate("_m", start, step))
    return folded.select(*by, "observations", *(F.col("s")[c].alias(c) for c in ("a_exit", "b_exit", "a_entry", "b_entry", "history", "was")))
