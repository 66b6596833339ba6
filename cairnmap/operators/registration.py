"""Scan registration: scores over cell pairs as joins and sums, optimisers as driver loops over one small row per step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .cells import COV, KEY, MEAN, columns, fit, transform, transform_points, with_eigenvalues
from .joins import cell_blocks, in_block
from .linesearch import more_thuente
from .lineage import cut
from .trajectory import alignment

#: Score scale of cell pairs: s = -exp(-LFD2 * l / 2).
LFD2 = 0.05


def cell_pairs(source: DataFrame, target: DataFrame, size: float, n: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """Source cells with every target cell of the block around their mean; target columns get the prefix t_."""
    own = source.select(*keep, *MEAN, *COV, *(G.grid_key(m, size).alias("p" + k) for m, k in zip(MEAN, KEY)))
    for k in KEY:
        own = own.withColumn(k, F.explode(F.sequence(F.col("p" + k) - n, F.col("p" + k) + n)))
    other = target.select(*KEY, *(F.col(c).alias("t_" + c) for c in MEAN + COV))
    return own.join(other, list(KEY)).drop(*("p" + k for k in KEY))


def _terms():
    x = [F.col(m) - F.col("t_" + m) for m in MEAN]
    b = G.inverse([F.col(c) + F.col("t_" + c) for c in COV])
    return x, b, -F.exp(-0.5 * LFD2 * G.quadratic(x, b))


def pair_score(source: DataFrame, target: DataFrame, size: float, n: int = 2) -> DataFrame:
    """One row: pairs, score."""
    _, _, s = _terms()
    made = cell_pairs(source, target, size, n).select(s.alias("s")).filter("s is not null and not isnan(s)")
    return made.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("score"))


def derivatives(source: DataFrame, target: DataFrame, size: float, n: int = 2, outer: bool = False) -> DataFrame:
    """One row: pairs, score, g0..g5 and h00..h55 (upper triangle): gradient and Gauss-Newton curvature of the pair score.

    Parameters are tx, ty, tz, rx, ry, rz about the origin, at the source's current pose. All sums are one aggregation.
    """
    x, b, s = _terms()
    xx, xy, xz, yy, yz, zz = b
    rows = [[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]
    pairs = cell_pairs(source, target, size, n)
    mx, my, mz = columns(MEAN)
    c00, c01, c02, c11, c12, c22 = columns(COV)
    names = {f"b{i}{j}": rows[i][j] for i in range(3) for j in range(i, 3)}
    pairs = pairs.select(*MEAN, *COV, *(v.alias(k) for k, v in names.items()), *(c.alias(f"x{k}") for k, c in enumerate(x)), s.alias("s")).filter("s is not null and not isnan(s)")
    bm = [[F.col(f"b{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    bx = [sum((bm[i][j] * F.col(f"x{j}") for j in range(3)), F.lit(0.0)) for i in range(3)]
    pairs = pairs.withColumns({f"v{i}": bx[i] for i in range(3)})
    v = [F.col(f"v{i}") for i in range(3)]
    zero, one = F.lit(0.0), F.lit(1.0)
    jac = [[one, zero, zero], [zero, one, zero], [zero, zero, one], [zero, -mz, my], [mz, zero, -mx], [-my, mx, zero]]
    turns = [
        [[zero, -c02, c01], [-c02, -2 * c12, c11 - c22], [c01, c11 - c22, 2 * c12]],
        [[2 * c02, c12, c22 - c00], [c12, zero, -c01], [c22 - c00, -c01, -2 * c02]],
        [[-2 * c01, c00 - c11, -c12], [c00 - c11, 2 * c01, c02], [-c12, c02, zero]],
    ]
    q = []
    for i in range(6):
        term = 2 * sum((v[a] * jac[i][a] for a in range(3)), F.lit(0.0))
        if i > 2:
            term = term - sum((v[a] * turns[i - 3][a][c] * v[c] for a in range(3) for c in range(3)), F.lit(0.0))
        q.append(term)
    pairs = pairs.withColumns({f"q{i}": q[i] for i in range(6)}).withColumns({f"j{i}{a}": jac[i][a] for i in range(6) for a in range(3)})
    gain = -LFD2 / 2 * F.col("s")
    sums = [F.count("*").alias("pairs"), F.sum("s").alias("score"), *(F.sum(gain * F.col(f"q{i}")).alias(f"g{i}") for i in range(6))]
    for i in range(6):
        for j in range(i, 6):
            flat = 2 * sum((F.col(f"j{i}{a}") * bm[a][c] * F.col(f"j{j}{c}") for a in range(3) for c in range(3)), F.lit(0.0))
            sums.append(F.sum(gain * flat).alias(f"h{i}{j}"))
            if outer:
                sums.append(F.sum(gain * F.col(f"q{i}") * gain * F.col(f"q{j}")).alias(f"o{i}{j}"))
    return pairs.agg(*sums)


def _prod(a, b):
    """A product in which plain 0.0 and 1.0 leave no expression behind."""
    for x, y in ((a, b), (b, a)):
        if isinstance(x, float) and x in (0.0, 1.0):
            return y if x else 0.0
    return a * b


def _plus(a, b, sign: int = 1):
    if isinstance(b, float) and b == 0.0:
        return a
    if isinstance(a, float) and a == 0.0:
        return b if sign > 0 else -b
    return a + b if sign > 0 else a - b


def _dot(a: list, b: list):
    total = 0.0
    for x, y in zip(a, b):
        total = _plus(total, _prod(x, y))
    return total


def _less(a: list, b: list) -> list:
    return [_plus(x, y, -1) for x, y in zip(a, b)]


def _axis_cross(axis: int, v: list) -> list:
    """e_axis x v."""
    minus = [0.0 if isinstance(e, float) and e == 0.0 else -e for e in v]
    return [[0.0, minus[2], v[1]], [v[2], 0.0, minus[0]], [minus[1], v[0], 0.0]][axis]


def _unit(axis: int) -> list:
    return [1.0 if k == axis else 0.0 for k in range(3)]


def _times(sym: list, v: list) -> list:
    """A symmetric matrix (xx, xy, xz, yy, yz, zz) times a vector."""
    return [_dot([sym[k] for k in row], v) for row in ((0, 1, 2), (1, 3, 4), (2, 4, 5))]


def _named(rows: DataFrame, name: str, values: list) -> tuple[DataFrame, list]:
    """Values as columns of their own, so that each is computed once."""
    names = [f"_{name}{k}" for k in range(len(values))]
    return rows.withColumns(dict(zip(names, values))), [F.col(n) for n in names]


def hessian(source: DataFrame, target: DataFrame, size: float, n: int = 2) -> DataFrame:
    """One row: pairs, score, g0..g5 and h00..h55 (upper triangle) of the pair score with all second derivatives, in one aggregation.

    Parameters are tx, ty, tz and the angles of Rx Ry Rz about the origin, at the source's current pose. With x the difference of the
    means, B the inverse of the summed covariances, v = B x and, for each parameter, x_i and Z_i the first derivatives of x and of the
    source's covariance C: the form's second derivative is 2 (x_i - Z_i v)' B (x_j - Z_j v) + 2 v' x_ij - v' Z_ij v. A turn about axis a followed in the
    product by b >= a gives v' x_ij = d . m and v' Z_ij v = 2 d . (C v) + 2 r_a' C r_b with d = e_b x (e_a x v) and r_a = v x e_a.
    """
    x, b, s = _terms()
    pairs = cell_pairs(source, target, size, n).select(*MEAN, *COV, *(e.alias(f"_b{k}") for k, e in enumerate(b)), *(e.alias(f"_x{k}") for k, e in enumerate(x)), s.alias("s")).filter("s is not null and not isnan(s)")
    m, c, b, x = columns(MEAN), columns(COV), [F.col(f"_b{k}") for k in range(6)], [F.col(f"_x{k}") for k in range(3)]
    pairs, v = _named(pairs, "v", _times(b, x))
    pairs, y = _named(pairs, "y", _times(c, v))
    turned = [_less([0.0] * 3, _axis_cross(a, v)) for a in range(3)]
    pairs, cr = _named(pairs, "cr", [e for a in range(3) for e in _times(c, turned[a])])
    spread = [[_plus(p, q) for p, q in zip(_axis_cross(a, y), cr[3 * a : 3 * a + 3])] for a in range(3)]
    pairs, own = _named(pairs, "u", [e for a in range(3) for e in _less(_axis_cross(a, m), spread[a])])
    u = [*(_unit(a) for a in range(3)), *(own[3 * a : 3 * a + 3] for a in range(3))]
    pairs, own = _named(pairs, "bu", [e for a in range(3) for e in _times(b, u[3 + a])])
    bu = [*(_times(b, _unit(a)) for a in range(3)), *(own[3 * a : 3 * a + 3] for a in range(3))]
    # v' (2 x_i - Z_i v): the part of Z_i v is in u already once
    pairs, q = _named(pairs, "q", [2 * v[a] for a in range(3)] + [2 * (_dot(v, _axis_cross(a, m)) - _dot(turned[a], y)) for a in range(3)])
    gain = -LFD2 / 2 * F.col("s")
    sums = [F.count("*").alias("pairs"), F.sum("s").alias("score"), *(F.sum(gain * q[i]).alias(f"g{i}") for i in range(6))]
    for i in range(6):
        for j in range(i, 6):
            term = 2 * _dot(u[i], bu[j]) - LFD2 / 2 * q[i] * q[j]
            if i > 2:
                d = _axis_cross(j - 3, _axis_cross(i - 3, v))
                term = term + 2 * _dot(d, _less(m, y)) - 2 * _dot(turned[i - 3], cr[3 * (j - 3) : 3 * (j - 3) + 3])
            sums.append(F.sum(gain * term).alias(f"h{i}{j}"))
    return pairs.agg(*sums)


def point_hessian(points: DataFrame, cells: DataFrame, size: float, outliers: float = 0.35) -> DataFrame:
    """One row: used, score, g0..g5, h00..h55 of the point-to-cell score at the points' current pose, with all second derivatives; parameters as
    in ``hessian``."""
    lfd1, lfd2 = point_scale(size, outliers)
    p = columns(G.AXES)
    found = points.select(*G.AXES, *G.grid_keys(size)).join(cells, list(KEY))
    found, b = _named(found, "b", G.inverse(columns(COV)))
    d = [a - m for a, m in zip(p, columns(MEAN))]
    found, v = _named(found, "v", _times(b, d))
    found = found.withColumn("l", _dot(v, d)).filter("l is not null and not isnan(l) and l <= 120")
    found, q = _named(found.withColumn("_e", F.exp(-lfd2 * F.col("l") / 2)), "q", [*v, *(_dot(v, _axis_cross(a, p)) for a in range(3))])
    first = [*(_unit(a) for a in range(3)), *(_axis_cross(a, p) for a in range(3))]
    gain = -lfd1 * lfd2 * F.col("_e")
    sums = [F.count("*").alias("used"), F.sum(lfd1 * F.col("_e")).alias("score"), *(F.sum(gain * q[i]).alias(f"g{i}") for i in range(6))]
    for i in range(6):
        for j in range(i, 6):
            term = _dot(first[i], _times(b, first[j])) - lfd2 * q[i] * q[j]
            if i > 2:
                term = term + _dot(_axis_cross(j - 3, _axis_cross(i - 3, v)), p)
            sums.append(F.sum(gain * term).alias(f"h{i}{j}"))
    return found.agg(*sums)


def point_scale(size: float, outliers: float) -> tuple[float, float]:
    """Height and rate of the point-to-cell score of a cell size and a share of outliers."""
    c1, c2 = (1 - outliers) / 0.1, outliers / size**3
    d3 = -np.log(c2)
    height = -np.log(c1 + c2) - d3
    return float(height), float(-np.log((-np.log(c1 * np.exp(-0.5) + c2) - d3) / height))


def turned_pose(p: np.ndarray) -> np.ndarray:
    """4x4 of translation p[:3] and angles p[3:] as Rx Ry Rz: the parameters of ``hessian``."""
    (cx, cy, cz), (sx, sy, sz) = np.cos(p[3:]), np.sin(p[3:])
    out = np.eye(4)
    out[:3, :3] = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    out[:3, 3] = p[:3]
    return out


def _with_form(pairs: DataFrame) -> DataFrame:
    """Pairs with their form _l and score _s; the difference and the inverse are columns of their own, computed once."""
    x, b, _ = _terms()
    pairs, x = _named(pairs, "x", x)
    pairs, b = _named(pairs, "b", b)
    return pairs.withColumn("_l", _dot(x, _times(b, x))).withColumn("_s", -F.exp(-0.5 * LFD2 * F.col("_l")))


def occupied_score(source: DataFrame, target: DataFrame, size: float, n: int = 2, free_weight: float = 0.1) -> DataFrame:
    """One row: pairs, gaussian (pairs with two Gaussians), score of an occupancy-aware comparison of two maps.

    Cells carry a key, occ (evidence) and a Gaussian or nulls. A source cell meets every target cell of the block around it. With o, p the
    two probabilities of being occupied, two Gaussians add o p times their usual score, and every pair adds -free_weight (1 - d / diagonal), not
    below 0, times (1 - o)(1 - p) - o (1 - p) - p (1 - o), d the distance of the cells' centres.
    """
    own = source.select(*(F.col(k).alias("p" + k) for k in KEY), *MEAN, *COV, "occ")
    for k in KEY:
        own = own.withColumn(k, F.explode(F.sequence(F.col("p" + k) - n, F.col("p" + k) + n)))
    both = own.join(target.select(*KEY, *(F.col(c).alias("t_" + c) for c in (*MEAN, *COV, "occ"))), list(KEY))
    both = _with_form(both)
    both = both.withColumns({"_s": F.when(~F.isnan("_s"), F.col("_s")), "_o": G.occupancy_probability(F.col("occ")), "_p": G.occupancy_probability(F.col("t_occ"))})
    o, p = F.col("_o"), F.col("_p")
    far = G.norm(*((F.col(k) - F.col("p" + k)) * 1.0 for k in KEY)) / 3**0.5
    empty = -free_weight * F.greatest(F.lit(0.0), 1 - far) * ((1 - o) * (1 - p) - o * (1 - p) - p * (1 - o))
    return both.agg(F.count("*").alias("pairs"), F.count("_s").alias("gaussian"), F.coalesce(F.sum(F.coalesce(o * p * F.col("_s"), F.lit(0.0)) + empty), F.lit(0.0)).alias("score"))


def positive_score(source: DataFrame, target: DataFrame, size: float, lost: float = 0.1) -> DataFrame:
    """One row: cells, met, score: each source cell against the target cell that holds its mean adds 1 less the likelihood, or ``lost``
    where there is none, no usable Gaussian, or a form beyond 120."""
    own = source.select(*MEAN, *COV, *(G.grid_key(m, size).alias(k) for m, k in zip(MEAN, KEY)))
    both = own.join(target.select(*KEY, *(F.col(c).alias("t_" + c) for c in MEAN + COV)), list(KEY), "left")
    e = F.when(~F.isnan("_l") & (F.col("_l") <= 120), -F.col("_s"))
    return _with_form(both).select(e.alias("e")).agg(F.count("*").alias("cells"), F.count("e").alias("met"), F.coalesce(F.sum(F.coalesce(1 - F.col("e"), F.lit(lost))), F.lit(0.0)).alias("score"))


def order_statistic(rows: DataFrame, column: str, index: int, gather: int = 10_000, buckets: int = 4096) -> float | None:
    """The value of rank ``index`` (from 0, ascending; nulls and NaN don't count), exactly: histograms narrow the range until at most
    ``gather`` values, or one value, are left."""
    values = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if index < 0 or index >= n:
        return None
    while n > gather and low < high:
        width = (high - low) / buckets
        if low + width <= low:
            break
        place = F.least(F.floor((F.col("v") - low) / width), F.lit(buckets - 1))
        counts = values.filter(F.col("v").between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()
        for r in counts:
            if index < r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            index -= r["n"]
    if low == high:
        return low
    return values.filter(F.col("v").between(low, high)).orderBy("v").offset(index).first()["v"]


def trimmed_score(pairs: DataFrame, keep: float = 0.9) -> DataFrame:
    """One row: pairs, used, score of given correspondences (means, covariances and t_ ones) with a form of at most 120: of n pairs the
    floor(keep (n - 1)) + 1 lowest scores, added up."""
    own = cut(_with_form(pairs).filter("_l is not null and not isnan(_l) and _l <= 120").select(F.col("_s").alias("s")))
    n = own.count()
    used = int(keep * (n - 1)) + 1 if n else 0
    bar = order_statistic(own, "s", used - 1)
    below = F.col("s") < F.lit(bar)
    total = F.coalesce(F.sum(F.when(below, F.col("s"))), F.lit(0.0)) + (F.lit(used) - F.count_if(below)) * F.coalesce(F.lit(bar), F.lit(0.0))
    return own.agg(F.lit(n).cast("long").alias("pairs"), F.lit(used).cast("long").alias("used"), total.alias("score"))


def twist(p: np.ndarray) -> np.ndarray:
    """4x4 of translation p[:3] and rotation vector p[3:] (Rodrigues)."""
    w, t = np.asarray(p[3:], float), np.linalg.norm(p[3:])
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    r = np.eye(3) + k if t < 1e-12 else np.eye(3) + np.sin(t) / t * k + (1 - np.cos(t)) / t**2 * k @ k
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, p[:3]
    return out


def _solve(row, free: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = np.array([row[f"g{i}"] or 0.0 for i in range(6)])
    h = np.array([[row[f"h{min(i, j)}{max(i, j)}"] or 0.0 for j in range(6)] for i in range(6)])
    own = np.ix_(free, free)
    values, vectors = np.linalg.eigh(h[own])
    size = np.linalg.norm(g[list(free)])
    if values[0] < 1e-9:
        values = values + (size if size + values[0] > 0 else 0.001 * values[-1] - values[0]) + 1e-9
    step = np.zeros(6)
    step[list(free)] = -vectors @ ((vectors.T @ g[list(free)]) / values)
    return g, h, step


def match_cells(source: DataFrame, target: DataFrame, size: float, start: np.ndarray | None = None, rounds: int = 30, free: tuple[int, ...] = (0, 1, 2, 3, 4, 5), tolerance: float = 1e-3, n: int = 2, full: bool = False) -> tuple[np.ndarray, float]:
    """Newton-like search of the pose that fits source cells to target cells: one aggregation per evaluation, the driver solves 6x6.

    ``full`` takes all second derivatives (``hessian``) in place of the Gauss-Newton curvature. Steps are halved while they don't improve the score; the best pose and its score are returned. ``free`` (0, 1, 5) is the planar case.
    """
    pose = np.eye(4) if start is None else np.array(start, float)
    source, target = cut(source), cut(target)
    at = lambda t: transform(source, t.reshape(-1).tolist())
    terms, move = (hessian, turned_pose) if full else (derivatives, twist)
    row = terms(at(pose), target, size, n).first()
    score = row["score"] or 0.0
    for _ in range(rounds):
        g, _, step = _solve(row, free)
        if np.linalg.norm(g) <= tolerance or np.linalg.norm(step) < tolerance:
            break
        for _ in range(5):
            tried = move(step) @ pose
            new = terms(at(tried), target, size, n).first()
            if (new["score"] or 0.0) < score - 1e-9:
                break
            step = step / 2
        else:
            break
        pose, row, score = tried, new, new["score"]
    return pose, float(score)


def match_scans(source: DataFrame, target: DataFrame, sizes: tuple[float, ...] = (2.0, 1.0, 0.5, 0.2), start: np.ndarray | None = None, free: tuple[int, ...] = (0, 1, 2, 3, 4, 5)) -> tuple[np.ndarray, float]:
    """Coarse to fine: at each cell size both scans are fitted and matched from the pose so far."""
    pose, score = np.eye(4) if start is None else np.array(start, float), 0.0
    for size in sizes:
        fixed = cut(fit(target, size))
        moved = cut(fit(transform_points(source, pose.reshape(-1).tolist()), size))
        step, score = match_cells(moved, fixed, size, free=free)
        pose = step @ pose
    return pose, score


def covariance(source: DataFrame, target: DataFrame, size: float, sigma: float = 0.03) -> np.ndarray:
    """Pose covariance H^-1 (sigma^2 J'J) H^-1: H the score's curvature, J'J the sum over pairs of the outer products of their gradients."""
    row = derivatives(source, target, size, outer=True).first()
    six = range(6)
    h, o = (np.array([[row[f"{p}{min(i, j)}{max(i, j)}"] or 0.0 for j in six] for i in six]) for p in "ho")
    back = np.linalg.pinv(h)
    return back @ (sigma**2 * o) @ back


def point_score(points: DataFrame, cells: DataFrame, size: float, outliers: float = 0.35) -> DataFrame:
    """One row: points used and the sum of lfd1 exp(-lfd2 l / 2) over points in their own cells, l <= 120."""
    c1, c2 = (1 - outliers) / 0.1, outliers / size**3
    d3 = -np.log(c2)
    lfd1 = -np.log(c1 + c2) - d3
    lfd2 = float(-np.log((-np.log(c1 * np.exp(-0.5) + c2) - d3) / lfd1))
    found = points.select(*G.AXES, *G.grid_keys(size)).join(cells, list(KEY))
    form = G.mahalanobis(columns(G.AXES), columns(MEAN), columns(COV))
    return found.select(form.alias("l")).filter("l is not null and not isnan(l) and l <= 120").agg(F.count("*").alias("used"), F.sum(float(lfd1) * F.exp(-lfd2 * F.col("l") / 2)).alias("score"))


def point_derivatives(points: DataFrame, cells: DataFrame, size: float, outliers: float = 0.35) -> DataFrame:
    """One row: used, score, g0..g5, h00..h55 of the point-to-cell score at the points' current pose (Gauss-Newton curvature)."""
    c1, c2 = (1 - outliers) / 0.1, outliers / size**3
    d3 = -np.log(c2)
    lfd1 = float(-np.log(c1 + c2) - d3)
    lfd2 = float(-np.log((-np.log(c1 * np.exp(-0.5) + c2) - d3) / lfd1))
    x, y, z = columns(G.AXES)
    found = points.select(*G.AXES, *G.grid_keys(size)).join(cells, list(KEY))
    found = found.withColumns({f"_i{k}": c for k, c in enumerate(G.inverse(columns(COV)))})
    inv = [[F.col(f"_i{min(i, j) * 3 + max(i, j) - (0, 1, 3)[min(i, j)]}") for j in range(3)] for i in range(3)]
    d = [F.col(a) - F.col(m) for a, m in zip(G.AXES, MEAN)]
    found = found.withColumns({f"_v{i}": sum((inv[i][j] * d[j] for j in range(3)), F.lit(0.0)) for i in range(3)})
    v = [F.col(f"_v{i}") for i in range(3)]
    found = found.withColumn("l", sum((a * b for a, b in zip(v, d)), F.lit(0.0)))
    zero, one = F.lit(0.0), F.lit(1.0)
    jac = [[one, zero, zero], [zero, one, zero], [zero, zero, one], [zero, -z, y], [z, zero, -x], [-y, x, zero]]
    used = F.col("l").isNotNull() & ~F.isnan("l") & (F.col("l") <= 120)
    e = F.when(used, F.exp(-lfd2 * F.col("l") / 2))
    found = found.withColumn("_e", e).withColumns({f"_q{i}": sum((v[a] * jac[i][a] for a in range(3)), F.lit(0.0)) for i in range(6)})
    gain = -lfd1 * lfd2 * F.col("_e")
    sums = [F.count("_e").alias("used"), F.sum(lfd1 * F.col("_e")).alias("score"), *(F.sum(gain * F.col(f"_q{i}")).alias(f"g{i}") for i in range(6))]
    for i in range(6):
        for j in range(i, 6):
            flat = sum((jac[i][a] * inv[a][c] * jac[j][c] for a in range(3) for c in range(3)), F.lit(0.0))
            sums.append(F.sum(gain * (flat - lfd2 * F.col(f"_q{i}") * F.col(f"_q{j}"))).alias(f"h{i}{j}"))
    return found.agg(*sums)


def match_points(points: DataFrame, target: DataFrame, sizes: tuple[float, ...] = (2.0, 1.0, 0.5), start: np.ndarray | None = None, rounds: int = 100, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Point-to-cell matching, coarse to fine: subsampled to the first point of each half cell, Newton steps of at most four cells and 45 degrees.

    Each evaluation is one aggregation; the driver solves 6x6. Steps are found by the line search.
    """
    pose, score = np.eye(4) if start is None else np.array(start, float), 0.0
    for size in sizes:
        fixed = cut(fit(target, size, least=6))
        few = points.select(*G.AXES, *G.grid_keys(size / 2)).groupBy(*KEY).agg(F.min(F.struct(*G.AXES)).alias("p")).select("p.*")
        few = cut(few)

        def at(t: np.ndarray, few=few, fixed=fixed, size=size):
            return point_derivatives(transform_points(few, t.reshape(-1).tolist()), fixed, size).first()

        row = at(pose)
        for _ in range(rounds):
            g, _, step = _solve(row, (0, 1, 2, 3, 4, 5))
            if np.linalg.norm(g) <= tolerance or not np.isfinite(step).all() or np.linalg.norm(step) < tolerance:
                break
            step[:3] *= min(1.0, 4 * size / max(np.linalg.norm(step[:3]), 1e-12))
            step[3:] *= min(1.0, np.pi / 4 / max(np.linalg.norm(step[3:]), 1e-12))
            seen = {}

            def along(a: float, step=step, pose=pose, at=at, seen=seen) -> tuple[float, float]:
                seen[a] = made = at(twist(a * step) @ pose)
                return made["score"] or 0.0, float(sum((made[f"g{i}"] or 0.0) * step[i] for i in range(6)))

            a = more_thuente(along, row["score"] or 0.0, float(g @ step))
            new = seen.get(a) or at(twist(a * step) @ pose)
            if (new["score"] or 0.0) >= (row["score"] or 0.0) - 1e-9:
                break
            pose, row = twist(a * step) @ pose, new
        score = row["score"] or 0.0
    return pose, float(score)


def score_surface(source: DataFrame, target: DataFrame, grid: DataFrame, size: float, step: float, n: int = 2) -> DataFrame:
    """gi, gj, pairs, score of the source moved by every (gi, gj) * step of a grid of hypotheses: one job for all of them.

    The grid's moves are unfolded on the source's cells, as many rows as cells times hypotheses.
    """
    moves = F.array(*[F.struct(F.lit(r["gi"]).alias("gi"), F.lit(r["gj"]).alias("gj")) for r in grid.collect()])
    moved = source.select("*", F.inline(moves)).withColumns({"mx": F.col("mx") + F.col("gi") * step, "my": F.col("my") + F.col("gj") * step})
    _, _, s = _terms()
    made = cell_pairs(moved, target, size, n, ("gi", "gj")).select("gi", "gj", s.alias("s"))
    good = F.col("s").isNotNull() & ~F.isnan("s")
    return made.filter(good).groupBy("gi", "gj").agg(F.count("*").alias("pairs"), F.sum("s").alias("score"))


def best_hypotheses(scores: DataFrame, n: int, ties: tuple[str, ...]) -> DataFrame:
    """The n lowest scores; scores within a millionth tie, in the order of ``ties``."""
    return scores.orderBy(F.round("score", 6), *ties).limit(n)


def _pair_terms(ms: np.ndarray, cs: np.ndarray, mt: np.ndarray, ct: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Score, gradient and Gauss-Newton curvature of aligned arrays of cell pairs."""
    x, total = ms - mt, cs + ct
    good = np.abs(np.linalg.det(total)) > 1e-18
    x, total, ms, cs = x[good], total[good], ms[good], cs[good]
    b = np.linalg.inv(total)
    v = np.einsum("nij,nj->ni", b, x)
    s = -np.exp(-0.5 * LFD2 * np.einsum("ni,ni->n", v, x))
    w = np.zeros((len(x), 3, 3))  # minus the cross-product matrix of the source mean
    w[:, 0, 1], w[:, 0, 2], w[:, 1, 2] = ms[:, 2], -ms[:, 1], ms[:, 0]
    w -= w.transpose(0, 2, 1)
    jac = np.concatenate((np.broadcast_to(np.eye(3), w.shape), w), 2)
    q = 2 * np.einsum("ni,nij->nj", v, jac)
    turned = np.cross(v[:, None], np.eye(3)[None])  # rows: v x e_i, so that v' Z_i v = 2 (C v) . (v x e_i)
    q[:, 3:] -= 2 * np.einsum("nij,nj->ni", turned, np.einsum("nij,nj->ni", cs, v))
    gain = -LFD2 / 2 * s
    return float(s.sum()), gain @ q, np.einsum("n,nki,nkl,nlj->ij", 2 * gain, jac, b, jac)


def match_arrays(ms: np.ndarray, cs: np.ndarray, mt: np.ndarray, ct: np.ndarray, size: float, n: int = 2, rounds: int = 30, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """The cell matcher on two maps' arrays (means, 3x3 covariances), for tasks that register many pairs of maps in parallel."""
    at = {}
    for k, key in enumerate(map(tuple, np.floor(mt / size + 0.5).astype(int))):
        at.setdefault(key, []).append(k)
    block = [(a, b, c) for a in range(-n, n + 1) for b in range(-n, n + 1) for c in range(-n, n + 1)]

    def evaluated(t: np.ndarray):
        m, c = ms @ t[:3, :3].T + t[:3, 3], t[:3, :3] @ cs @ t[:3, :3].T
        left, right = [], []
        for i, (x, y, z) in enumerate(np.floor(m / size + 0.5).astype(int).tolist()):
            own = [k for a, b, d in block for k in at.get((x + a, y + b, z + d), ())]
            left += [i] * len(own)
            right += own
        return _pair_terms(m[left], c[left], mt[right], ct[right])

    pose, (score, g, h) = np.eye(4), evaluated(np.eye(4))
    for _ in range(rounds):
        row = {f"g{i}": g[i] for i in range(6)} | {f"h{i}{j}": h[i, j] for i in range(6) for j in range(i, 6)}
        _, _, step = _solve(row, (0, 1, 2, 3, 4, 5))
        if np.linalg.norm(g) <= tolerance or np.linalg.norm(step) < tolerance:
            break
        for _ in range(6):
            new = evaluated(twist(step) @ pose)
            if new[0] < score - 1e-9:
                break
            step = step / 2
        else:
            break
        pose, (score, g, h) = twist(step) @ pose, new
    return pose, score


def consecutive(cells: DataFrame, order: str, size: float, n: int = 2) -> DataFrame:
    """pair, tx, ty, tz, qx, qy, qz, qw, score: every map registered onto the one before it, all pairs in parallel, each in one task.

    A task holds two maps' cells. ``order`` numbers the maps from 0 without gaps.
    """
    names = [*MEAN, *COV]
    own = cells.select(F.col(order).cast("long").alias("pair"), *names)
    before = own.select(F.col("pair") + 1, *names).toDF("after", *("t_" + c for c in names))

    def arrays(t, prefix=""):
        rows = np.column_stack([t[prefix + c].to_numpy() for c in names]).astype(float).reshape(-1, 9)
        return rows[:, :3], rows[:, 3:][:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)

    schema = "pair long, tx double, ty double, tz double, qx double, qy double, qz double, qw double, score double"
    kinds = [("pair", pa.int64()), *((c, pa.float64()) for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw", "score"))]

    def run(key, moved, fixed):
        if not moved.num_rows or not fixed.num_rows:
            return pa.table({c: pa.array([], k) for c, k in kinds})
        pose, score = match_arrays(*arrays(moved), *arrays(fixed, "t_"), size, n)
        w = np.sqrt(max(1e-12, 1 + np.trace(pose[:3, :3]))) / 2
        r = pose[:3, :3]
        q = [(r[2, 1] - r[1, 2]) / (4 * w), (r[0, 2] - r[2, 0]) / (4 * w), (r[1, 0] - r[0, 1]) / (4 * w), w]
        values = [key[0].as_py(), *pose[:3, 3].tolist(), *map(float, q), score]
        return pa.table({c: pa.array([x], k) for (c, k), x in zip(kinds, values)})

    return own.groupBy("pair").cogroup(before.groupBy("after")).applyInArrow(run, schema)


def icp(source: DataFrame, target: DataFrame, size: float, rounds: int = 10) -> np.ndarray:
    """Iterated closest points: nearest target voxel means within a block, then the closed-form pose."""
    pose = np.eye(4)
    cells = cut(target.select(*G.AXES, *G.grid_keys(size)).groupBy(*KEY).agg(*(F.avg(a).alias("m" + a) for a in G.AXES)))
    blocks = cut(cell_blocks(cells))
    source = cut(source.select(F.monotonically_increasing_id().alias("sid"), *G.AXES))
    for _ in range(rounds):
        moved = transform_points(source, pose.reshape(-1).tolist())
        near = in_block(moved, blocks, size).groupBy("sid").agg(F.min(F.struct("dist", *KEY, *MEAN, *G.AXES)).alias("b")).select("b.*")
        r, t = alignment(near, G.AXES, MEAN)
        step = np.eye(4)
        step[:3, :3], step[:3, 3] = r, t
        pose = step @ pose
        if np.abs(step - np.eye(4)).max() < 1e-6:
            break
    return pose


def ransac(matches: DataFrame, hypotheses: int = 200, within: float = 0.05, seed: int = 4, sample: int = 512) -> tuple[np.ndarray, int]:
    """Pose from point matches (sx, sy, sz -> tx, ty, tz): hypotheses from seeded triples of a bounded ``sample``, inliers counted over all
    matches by one aggregation for fifty hypotheses."""
    rows = matches.orderBy(F.xxhash64(*matches.columns)).limit(sample).collect()
    draw, poses = np.random.default_rng(seed), []
    s, t = (np.array([[r[p + a] for a in G.AXES] for r in rows]) for p in "st")
    for _ in range(hypotheses if len(rows) >= 3 else 0):
        own = draw.choice(len(rows), 3, replace=False)
        a, b = s[own] - s[own].mean(0), t[own] - t[own].mean(0)
        u, _, vt = np.linalg.svd(b.T @ a)
        r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
        poses.append((r, t[own].mean(0) - r @ s[own].mean(0)))
    if not poses:
        return np.eye(4), 0
    counts = []
    for r, shift in poses:
        moved = G.transform_point([x for k in range(3) for x in (*r[k].tolist(), float(shift[k]))], *(F.col("s" + a) for a in G.AXES))
        counts.append(F.sum((G.distance(moved, [F.col("t" + a) for a in G.AXES]) < within).cast("int")).alias(f"h{len(counts)}"))
    found = []
    for k in range(0, len(counts), 50):
        found += [v or 0 for v in matches.agg(*counts[k : k + 50]).first()]
    best = int(np.argmax(found))
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = poses[best]
    return out, int(found[best])


def directions(n: int = 40) -> list[tuple[float, float, float]]:
    """n directions on a golden spiral."""
    out, turn = [], np.pi * (3 - np.sqrt(5))
    for k in range(n):
        z = 1 - (2 * k + 1) / n
        r = np.sqrt(1 - z * z)
        out.append((float(r * np.cos(turn * k)), float(r * np.sin(turn * k)), float(z)))
    return out


def shape_histogram(cells: DataFrame, by: tuple[str, ...] = (), bands: tuple[float, float] = (5.0, 10.0)) -> DataFrame:
    """Counts of cells by kind (line, plane, sphere, from the eigenvalues) and distance band: by, kind, band, n."""
    made = with_eigenvalues(cells).select(*by, "l0", "l1", "l2", G.norm(*columns(MEAN)).alias("d"))
    kind = F.when(F.col("l2") > 50 * F.col("l1"), "line").when(F.col("l1") > 50 * F.col("l0"), "plane").otherwise("sphere")
    band = F.when(F.col("d") < bands[0], 0).when(F.col("d") < bands[1], 1).otherwise(2)
    return made.select(*by, kind.alias("kind"), band.alias("band")).groupBy(*by, "kind", "band").agg(F.count("*").alias("n"))


def similarities(histograms: DataFrame, by: str) -> DataFrame:
    """a, b, similarity of all pairs of histograms: the L2 of their shares within each band, summed over the nearer bands, times the ratio of
    their totals. A histogram is one row with at most nine bins; pairs are of histograms, as many as maps are compared."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(by, "band"))
    maps = histograms.withColumn("s", share).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.col("band").cast("string")), "s"))).alias("h"), F.sum("n").alias("n"))
    pairs = maps.toDF("a", "ha", "na").join(maps.toDF("b", "hb", "nb"), F.col("a") < F.col("b"))
    gap = lambda kind, band: F.coalesce(F.col("ha")[f"{kind}{band}"], F.lit(0.0)) - F.coalesce(F.col("hb")[f"{kind}{band}"], F.lit(0.0))
    near = [F.sqrt(sum((gap(k, band) * gap(k, band) for k in ("line", "plane", "sphere")), F.lit(0.0))) for band in (0, 1)]
    return pairs.select("a", "b", ((near[0] + near[1]) * F.greatest("na", "nb") / F.least("na", "nb")).alias("similarity"))


def direction_histogram(cells: DataFrame, by: tuple[str, ...], n: int = 40) -> DataFrame:
    """by, bin, n: cells that are no lines by the nearest of n directions to their normal, turned towards the origin.

    (C - l1)(C - l2) has the normal in every column: the one with the largest diagonal entry is taken.
    """
    out = with_eigenvalues(cells).filter(F.col("l2") <= 50 * F.col("l1"))
    full = [["cxx", "cxy", "cxz"], ["cxy", "cyy", "cyz"], ["cxz", "cyz", "czz"]]
    less = lambda r, c, l: F.col(full[r][c]) - F.col(l) if r == c else F.col(full[r][c])
    out = out.withColumns({f"_m{r}{c}": sum((less(r, k, "l1") * less(k, c, "l2") for k in range(3)), F.lit(0.0)) for r in range(3) for c in range(3)})
    m = lambda r, c: F.col(f"_m{r}{c}")
    out = out.withColumns({f"_n{c}": F.when((m(0, 0) >= m(1, 1)) & (m(0, 0) >= m(2, 2)), m(0, c)).when(m(1, 1) >= m(2, 2), m(1, c)).otherwise(m(2, c)) for c in range(3)})
    v = [F.col(f"_n{c}") for c in range(3)]
    out = out.withColumn("_f", F.when(v[0] * F.col("mx") + v[1] * F.col("my") + v[2] * F.col("mz") > 0, -1.0).otherwise(1.0) / G.norm(*v))
    known = F.array(*[F.struct(*(F.lit(x).alias(a) for x, a in zip(d, G.AXES)), F.lit(k).alias("k")) for k, d in enumerate(directions(n))])
    dot = lambda d: (v[0] * d["x"] + v[1] * d["y"] + v[2] * d["z"]) * F.col("_f")
    best = F.array_max(F.transform(known, lambda d: F.struct(dot(d).alias("dot"), (-d["k"]).alias("k"))))
    return out.select(*by, (-best["k"]).cast("int").alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def dominant_directions(histogram: DataFrame, by: tuple[str, ...], n: int = 3, least: int = 3) -> DataFrame:
    """by, rank, bin, n: the fullest bins in turn, each hiding its neighbours, down to a support of ``least``; ties take the smaller bin.

    A histogram's bins (40 at most) are folded in one row.
    """
    held = histogram.groupBy(*by).agg(F.collect_list(F.struct("n", (-F.col("bin")).alias("bin"))).alias("h"))
    start = F.struct(F.col("h").alias("h"), F.array().cast("array<struct<n:bigint,bin:int>>").alias("out"))

    def step(s, _):
        top = F.array_max(s["h"])
        found = top.isNotNull() & (top["n"] >= least)
        rest = F.filter(s["h"], lambda x: F.abs(x["bin"] - top["bin"]) > 1)
        return F.when(found, F.struct(rest.alias("h"), F.concat(s["out"], F.array(F.struct(top["n"].alias("n"), (-top["bin"]).alias("bin")))).alias("out"))).otherwise(s)

    folded = held.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step))
    return folded.select(*by, F.posexplode("s.out").alias("rank", "o")).select(*by, "rank", "o.bin", "o.n")
