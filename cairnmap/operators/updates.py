"""Ways to update Gaussian cells with a batch of points besides merging moments: covariance intersection, error refinement,
surface estimation, capped averages, colours, mean updates and re-binning. Cells are rows as in ``cells``; old columns keep
their names, a batch's come with the prefix ``b_``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .cells import COV, KEY, MEAN, binned, columns, fit, merge, peak_on_line
from .joins import ray_cells

_AT = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def beside(cells: DataFrame, batch: DataFrame) -> DataFrame:
    """Old cells with the batch's cell of the same key."""
    return cells.join(batch.select(*KEY, *(F.col(c).alias("b_" + c) for c in ("n", *MEAN, *COV))), list(KEY))


def intersected(cells: DataFrame, batch: DataFrame, weight: float = 0.98) -> DataFrame:
    """Covariance intersection: information matrices and information means blended, ``weight`` old. A singular blend gives nulls.

    Clamp either side first (``cells.clamped``) where eigenvalues may vanish.
    """
    both = beside(cells, batch)
    both = both.withColumns({f"_o{k}": c for k, c in enumerate(G.inverse(columns(COV)))})
    both = both.withColumns({f"_b{k}": c for k, c in enumerate(G.inverse(columns(COV, "b_")))})
    old, new = ([F.col(f"_{p}{k}") for k in range(6)] for p in "ob")
    both = both.withColumns({f"_i{k}": weight * a + (1 - weight) * b for k, (a, b) in enumerate(zip(old, new))})
    both = both.withColumns({f"_c{k}": c for k, c in enumerate(G.inverse([F.col(f"_i{k}") for k in range(6)]))})
    full = lambda m: [[m[0], m[1], m[2]], [m[1], m[3], m[4]], [m[2], m[4], m[5]]]
    fo, fb, fc = full(old), full(new), full([F.col(f"_c{k}") for k in range(6)])
    both = both.withColumns({f"_m{r}": sum((weight * fo[r][c] * F.col(MEAN[c]) + (1 - weight) * fb[r][c] * F.col("b_" + MEAN[c]) for c in range(3)), F.lit(0.0)) for r in range(3)})
    mean = [sum((fc[r][c] * F.col(f"_m{c}") for c in range(3)), F.lit(0.0)).alias(MEAN[r]) for r in range(3)]
    return both.select(*KEY, (F.col("n") + F.col("b_n")).alias("n"), *mean, *(F.col(f"_c{k}").alias(c) for k, c in enumerate(COV)))


def refined(cells: DataFrame, points: DataFrame, size: float, order: str, occ: str = "occ") -> DataFrame:
    """Error refinement: each point, in order, moves mean and covariance by a rate that falls from 0.05 to 0.0005 with the cell's occupancy (+-10).

    The fold collects one batch's points of a cell.
    """
    held = binned(points, size).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(order, *G.AXES))).alias("_p"))
    level = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col(occ)))
    both = cells.join(held, list(KEY)).withColumn("_e", (5e-4 - 5e-2) / 20.0 * (level + 10.0) + 5e-2)
    rate = F.col("_e")

    def step(s: Column, p: Column) -> Column:
        # the covariance sees the point against the moved mean: p - m' = (1 - rate) (p - m)
        off = [p[a] - s[m] for a, m in zip(G.AXES, MEAN)]
        mean = [(s[m] + rate * o).alias(m) for m, o in zip(MEAN, off)]
        cov = [(s[c] + rate * ((1 - rate) * (1 - rate) * off[i] * off[j] - s[c])).alias(c) for c, (i, j) in zip(COV, _AT)]
        return F.struct(*mean, *cov)

    both = both.withColumn("_s", F.aggregate("_p", F.struct(*MEAN, *COV), step))
    return both.select(*KEY, (F.col("n") + F.size("_p")).alias("n"), *(F.col("_s")[c].alias(c) for c in MEAN + COV))


def surface_estimate(cells: DataFrame, points: DataFrame, size: float, noise: float = 0.1, least: int = 100, occ: str = "occ") -> DataFrame:
    """Merges a batch whose scatter blends measured points with their cells' most likely points on the rays from the origin.

    A point's weight for the map: (1 - 1 / (1 + exp(min(occ / 10, 5)))) * (0.49 + 0.5 exp(-d^2 / (2 s^2))), d the distance between the two and
    s = distance / 40 + noise; 0 in cells of fewer than ``least`` points.
    """
    both = binned(points, size).join(cells, list(KEY))
    batch = points.select(*G.AXES, *G.grid_keys(size)).groupBy(*KEY).agg(*(F.avg(a).alias("b" + a) for a in G.AXES))
    both = peak_on_line(both.join(batch, list(KEY)), [F.lit(0.0)] * 3, columns(G.AXES))
    spread = 0.5 * G.norm(*columns(G.AXES)) / 20.0 + noise
    d = G.distance([F.col("peak_" + a) for a in G.AXES], columns(G.AXES))
    trust = 0.49 + 0.5 * F.exp(-0.5 * d * d / (spread * spread))
    weight = (1 - 1 / (1 + F.exp(F.least(F.col(occ) / 10.0, F.lit(5.0))))) * trust
    both = both.withColumn("_w", F.when(F.col("n") < least, 0.0).otherwise(F.coalesce(weight, F.lit(0.0))))
    off = [F.col(a) - F.col("b" + a) for a in G.AXES]
    seen = [F.coalesce(F.col("peak_" + a), F.col(m)) - F.col(m) for a, m in zip(G.AXES, MEAN)]
    sums = [F.sum((1 - F.col("_w")) * off[i] * off[j] + F.col("_w") * seen[i] * seen[j]).alias(f"_q{k}") for k, (i, j) in enumerate(_AT)]
    old = [F.first(c).alias(c) for c in ("n", *MEAN, *COV)]
    made = both.groupBy(*KEY).agg(F.count("*").alias("b_n"), *old, *(F.first("b" + a).alias("b_m" + a) for a in G.AXES), *sums)
    n, m = F.col("n"), F.col("b_n")
    gap = [F.col("b_" + c) - F.col(c) for c in MEAN]
    mean = [((n * F.col(c) + m * F.col("b_" + c)) / (n + m)).alias(c) for c in MEAN]
    cov = [(((n - 1) * F.col(c) + F.col(f"_q{k}") + n * m / (n + m) * gap[i] * gap[j]) / (n + m - 1)).alias(c) for k, (c, (i, j)) in enumerate(zip(COV, _AT))]
    return made.select(*KEY, (n + m).alias("n"), *mean, *cov)


def capped(cells: DataFrame, most: int) -> DataFrame:
    """The sliding average's cap: sums are scaled so that a cell counts as ``most`` points at most; mean and covariance stay as they are."""
    return cells.withColumn("n", F.least("n", F.lit(most).cast("long")))


def blended_colours(points: DataFrame, size: float, batch: str, colours: tuple[str, ...], old: float = 0.9) -> DataFrame:
    """Per cell, each batch's mean colour blended in batch order, ``old`` of what is there: the fold's closed form, a weighted sum."""
    means = binned(points, size).groupBy(*KEY, batch).agg(*(F.avg(c).alias(c) for c in colours))
    w = Window.partitionBy(*KEY)
    means = means.withColumn("_k", F.row_number().over(w.orderBy(batch)) - 1).withColumn("_m", F.count("*").over(w) - 1)
    weight = F.pow(F.lit(old), F.col("_m") - F.col("_k")) * F.when(F.col("_k") > 0, 1 - old).otherwise(1.0)
    return means.groupBy(*KEY).agg(F.count("*").alias("batches"), *(F.sum(weight * F.col(c)).alias(c) for c in colours))


def mean_evidence(locals_: DataFrame, cells: DataFrame, size: float, by: tuple[str, ...], noise: float = 0.06) -> DataFrame:
    """ix, iy, iz, rays, evidence: a scan's local Gaussians (by, n, means), seen from the origin, against the cells before their means.

    A ray counts as many times as its Gaussian has points. In a cell with a Gaussian, p = 0.2 l + 0.5 with l as for single rays, evidence
    n ln((1 - p) / p), unless the cell's most likely point on the ray is farther than the mean; without one, -0.85 n.
    """
    rays = locals_.select(*by, F.col("n").alias("ray_n"), *(F.lit(0.0).alias("o" + a) for a in G.AXES), *(F.col(m).alias(a) for m, a in zip(MEAN, G.AXES)))
    crossed = peak_on_line(ray_cells(rays, size, by).join(cells, list(KEY), "left"), [F.col("o" + a) for a in G.AXES], columns(G.AXES))
    d = G.distance([F.col("peak_" + a) for a in G.AXES], columns(G.AXES))
    spread = 0.5 * G.norm(*(F.col("peak_" + a) for a in G.AXES)) / 30 + noise
    crossed = crossed.withColumn("_far", G.norm(*(F.col("peak_" + a) for a in G.AXES)) > F.col("length"))
    crossed = crossed.withColumn("_l", 0.2 * F.col("peak") * (1 - F.exp(-0.5 * d * d / (spread * spread))) + 0.5)
    value = F.when(F.col("mx").isNull(), -0.85 * F.col("ray_n")).when(F.coalesce("_far", F.lit(False)), 0.0).otherwise(F.col("ray_n") * F.log((1 - F.col("_l")) / F.col("_l")))
    return crossed.withColumn("_e", value).groupBy(*KEY).agg(F.count("*").alias("rays"), F.sum("_e").alias("evidence"))


def mean_update(cells: DataFrame, points: DataFrame, size: float, by: str, noise: float = 0.06, limit: float = 255.0) -> DataFrame:
    """A map with occ after scans are fused by their local Gaussians: evidence against the snapshot, then the Gaussians merged."""
    own = fit(points, size, (by,))
    named = own.withColumn("_ray", F.struct(by, *KEY))
    seen = mean_evidence(named.select("_ray", "n", *MEAN), cells, size, ("_ray",), noise)
    whole = merge(cells.select(*KEY, "n", *MEAN, *COV).unionByName(own.select(*KEY, "n", *MEAN, *COV)))
    added = own.groupBy(*KEY).agg((F.sum("n") * 0.4054651081081644).alias("hits"))
    out = whole.join(added, list(KEY), "left").join(seen, list(KEY), "left")
    occ = F.coalesce("hits", F.lit(0.0)) + F.coalesce("evidence", F.lit(0.0))
    return out.withColumn("occ", F.greatest(F.lit(-limit), F.least(F.lit(limit), occ))).drop("hits", "evidence", "rays")


def rebinned(cells: DataFrame, size: float) -> DataFrame:
    """Cells of any lattice moved to one of another size by the key of their means, and merged: the import of a map."""
    return merge(cells.select(*(G.grid_key(m, size).alias(k) for m, k in zip(MEAN, KEY)), "n", *MEAN, *COV))
