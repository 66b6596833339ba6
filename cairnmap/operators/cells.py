"""Gaussian cells: binning, fitting, merging, transforming, clamping, classifying.

A cell is a row (ix, iy, iz, n, mx, my, mz, cxx, cxy, cxz, cyy, cyz, czz) beside any grouping columns. Fitting is one
partial and one final hash aggregation on the grid key, whatever the number of points in a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

KEY = ("ix", "iy", "iz")
MEAN = ("mx", "my", "mz")
COV = tuple("c" + s for s in G.SYM)


def columns(names, prefix: str = "") -> list:
    return [F.col(prefix + n) for n in names]


def valid_points(points: DataFrame, limit: float | None = None, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), max_z: float | None = None) -> DataFrame:
    """Points without missing coordinates, within a range of an origin and below a height."""
    for a in G.AXES:
        points = points.filter(F.col(a).isNotNull() & ~F.isnan(a))
    if limit is not None:
        points = points.filter(G.norm(*(F.col(a) - o for a, o in zip(G.AXES, origin))) <= limit)
    return points if max_z is None else points.filter(F.col("z") <= max_z)


def binned(points: DataFrame, size: float) -> DataFrame:
    return points.select("*", *G.grid_keys(size))


def fit(points: DataFrame, size: float, by: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """One Gaussian per cell with at least ``least`` points: mean and unbiased covariance."""
    pairs = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))
    own = [F.count("*").alias("n"), *(F.avg(a).alias(f"m{a}") for a in G.AXES), *(F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs)]
    return binned(points, size).groupBy(*by, *KEY).agg(*own).filter(F.col("n") >= least)


def merge(cells: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """Cells of equal key merged by their moments (associative, so any number of them): the Gaussian of the union.

    Sums are taken about one of the key's means, so that far-off coordinates cost no digits.
    """
    pairs = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    base = cells.groupBy(*by).agg(F.min(F.struct(*MEAN)).alias("_r"))
    n, off = F.col("n").cast("double"), [F.col(m) - F.col("_r")[m] for m in MEAN]
    sums = [F.sum(n).alias("_n"), F.first("_r").alias("_r"), *(F.sum(n * o).alias(f"_s{k}") for k, o in enumerate(off))]
    sums += [F.sum((n - 1) * F.col(c) + n * off[i] * off[j]).alias(f"_q{k}") for k, (c, (i, j)) in enumerate(zip(COV, pairs))]
    total = cells.join(base, list(by)).groupBy(*by).agg(*sums)
    shift = [F.col(f"_s{k}") / F.col("_n") for k in range(3)]
    cov = [((F.col(f"_q{k}") - F.col("_n") * shift[i] * shift[j]) / (F.col("_n") - 1)).alias(COV[k]) for k, (i, j) in enumerate(pairs)]
    return total.select(*by, F.col("_n").cast("long").alias("n"), *((F.col("_r")[m] + d).alias(m) for m, d in zip(MEAN, shift)), *cov)


def transform(cells: DataFrame, t) -> DataFrame:
    """Means and covariances under a rigid transform; other columns stay."""
    mean = G.transform_point(t, *columns(MEAN))
    cov = G.rotate_sym(t, columns(COV))
    other = [c for c in cells.columns if c not in MEAN + COV]
    return cells.select(*other, *(m.alias(a) for m, a in zip(mean, MEAN)), *(c.alias(a) for c, a in zip(cov, COV)))


def transform_points(points: DataFrame, t) -> DataFrame:
    moved = G.transform_point(t, *columns(G.AXES))
    return points.select(*[c for c in points.columns if c not in G.AXES], *(m.alias(a) for m, a in zip(moved, G.AXES)))


def peak_on_line(rows: DataFrame, start, end) -> DataFrame:
    """Rows with a cell and a line gain peak_x, peak_y, peak_z, the cell's most likely point on the line, and peak, the likelihood there.

    peak is 1 where the quadratic form along the line vanishes. The inverse, the direction and the step are columns of
    their own, so each is computed once.
    """
    rows = rows.withColumns({f"_i{k}": c for k, c in enumerate(G.inverse(columns(COV)))})
    length = G.distance(end, start)
    rows = rows.withColumns({f"_l{k}": (e - s) / F.nullif(length, F.lit(0.0)) for k, (s, e) in enumerate(zip(start, end))})
    inv, line = [F.col(f"_i{k}") for k in range(6)], [F.col(f"_l{k}") for k in range(3)]
    full = [[inv[0], inv[1], inv[2]], [inv[1], inv[3], inv[4]], [inv[2], inv[4], inv[5]]]
    rows = rows.withColumns({f"_w{b}": sum((line[a] * full[a][b] for a in range(3)), F.lit(0.0)) for b in range(3)})
    weighted = [F.col(f"_w{k}") for k in range(3)]
    rows = rows.withColumn("_sigma", sum((w * li for w, li in zip(weighted, line)), F.lit(0.0)))
    rows = rows.withColumn("_t", -sum((w * (e - m) for w, e, m in zip(weighted, end, columns(MEAN))), F.lit(0.0)) / F.nullif(F.col("_sigma"), F.lit(0.0)))
    rows = rows.withColumns({f"peak_{a}": e + F.col("_t") * li for a, e, li in zip(G.AXES, end, line)})
    form = G.quadratic([F.col(f"peak_{a}") - F.col(m) for a, m in zip(G.AXES, MEAN)], inv)
    rows = rows.withColumn("peak", F.when(F.coalesce("_sigma", F.lit(0.0)) == 0, 1.0).otherwise(F.exp(-0.5 * form)))
    return rows.drop(*(f"_{n}{k}" for n, m in (("i", 6), ("l", 3), ("w", 3)) for k in range(m)), "_sigma", "_t")


def clamped(cells: DataFrame, factor: float = 100.0, rough: float = 0.1, angle_cos: float = 0.17364817766693041) -> DataFrame:
    """Cells with covariances whose eigenvalues are raised to the largest over ``factor``, cells with one <= 0 dropped, and a class.

    class: ROUGH if the smallest eigenvalue passes ``rough``; else by |z| of its direction: VERTICAL below ``angle_cos``,
    HORIZONTAL above 1 - ``angle_cos``, INCLINED between. Batched eigen-decompositions, no shuffle.
    """
    names = [f.name for f in cells.schema.fields]
    at = [names.index(c) for c in COV]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields) + ", l0 double, l1 double, l2 double, class string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in at]).astype(float).reshape(-1, 6)
            full = c[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            good = np.isfinite(full).all((1, 2))
            values, vectors = np.linalg.eigh(np.where(good[:, None, None], full, 0))
            good &= values[:, 0] > 0
            raised = np.maximum(values, values[:, 2:] / factor)
            made = (vectors * raised[:, None]) @ vectors.transpose(0, 2, 1)
            up = np.abs(vectors[:, 2, 0])
            kind = np.where(raised[:, 0] > rough, "ROUGH", np.where(up < angle_cos, "VERTICAL", np.where(up > 1 - angle_cos, "HORIZONTAL", "INCLINED")))
            columns = [pa.array(made[:, i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]
            out = [columns[at.index(k)] if k in at else batch.column(k) for k in range(len(names))]
            out += [pa.array(raised[:, k]) for k in range(3)] + [pa.array(kind.tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "l0", "l1", "l2", "class"]).filter(pa.array(good))

    return cells.mapInArrow(run, schema)


def _let(value, body):
    """``body`` of a value that is computed once, in one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_eigenvalues(cells: DataFrame) -> DataFrame:
    """Cells with l0 <= l1 <= l2, the covariance's eigenvalues by the trigonometric form.

    Shared terms are bound once inside one expression, which stays small wherever the optimiser repeats it.
    """
    cov = columns(COV)

    def roots(s, p, phi):
        l0, l2 = s["q"] + 2 * p * F.cos(phi + 2 * 3.141592653589793 / 3), s["q"] + 2 * p * F.cos(phi)
        return F.struct(F.coalesce(l0, s["q"]).alias("l0"), F.coalesce(3 * s["q"] - l2 - l0, s["q"]).alias("l1"), F.coalesce(l2, s["q"]).alias("l2"))

    def spread(s):
        off = s["xy"] * s["xy"] + s["xz"] * s["xz"] + s["yz"] * s["yz"]
        return F.nullif(F.sqrt((s["xx"] * s["xx"] + s["yy"] * s["yy"] + s["zz"] * s["zz"] + 2 * off) / 6), F.lit(0.0))

    def angle(s, p):
        half = G.determinant([s[n] / p for n in G.SYM]) / 2
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3

    centred = lambda q: F.struct(q.alias("q"), *((c - q if n in ("xx", "yy", "zz") else c).alias(n) for n, c in zip(G.SYM, cov)))
    made = _let((cov[0] + cov[3] + cov[5]) / 3, lambda q: _let(centred(q), lambda s: _let(spread(s), lambda p: _let(angle(s, p), lambda phi: roots(s, p, phi)))))
    return cells.withColumn("_e", made).select(*cells.columns, *(F.col("_e")[f"l{k}"].alias(f"l{k}") for k in range(3)))


def with_kind(cells: DataFrame, factor: float = 100.0, rough: float = 0.1, angle_cos: float = 0.17364817766693041) -> DataFrame:
    """Cells with l0, l1, l2 and the class of ``clamped``, without Python. Cells with an eigenvalue <= 0 are dropped.

    |z| of the smallest eigenvalue's direction comes in closed form: its square is a minor over the eigenvalues' differences.
    """
    l0, l1, l2 = (F.col(f"l{k}") for k in range(3))
    out = with_eigenvalues(cells).filter("l0 > 0")
    share = ((F.col("cxx") - l0) * (F.col("cyy") - l0) - F.col("cxy") * F.col("cxy")) / F.nullif((l1 - l0) * (l2 - l0), F.lit(0.0))
    out = out.withColumn("_up", F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))))
    kind = F.when(F.greatest(l0, l2 / factor) > rough, "ROUGH").when(F.col("_up") < angle_cos, "VERTICAL").when(F.col("_up") > 1 - angle_cos, "HORIZONTAL").otherwise("INCLINED")
    return out.withColumn("class", kind).drop("_up")


def student_t(points: DataFrame, size: float, nu: float = 5.0, rounds: int = 10, by: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """Robust cell fits: iteratively reweighted means and scatters of a Student-t law; covariance scaled by nu / (nu - 2)."""
    keys = [*by, *KEY]
    held = binned(points, size).select(*keys, *G.AXES)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields if f.name in keys)
    schema = f"{kinds}, n long, {', '.join(f'{c} double' for c in MEAN + COV)}"

    def run(group):
        x = group[list(G.AXES)].to_numpy(float)
        if len(x) < least:
            return group.iloc[:0][keys].assign(n=0, **{c: 0.0 for c in MEAN + COV})
        weight = np.ones(len(x))
        for _ in range(rounds):
            mean = (weight[:, None] * x).sum(0) / weight.sum()
            off = x - mean
            scatter = (weight[:, None, None] * off[:, :, None] * off[:, None]).sum(0) / len(x)
            scatter += np.eye(3) * 1e-12
            weight = (nu + 3) / (nu + np.einsum("ni,ij,nj->n", off, np.linalg.inv(scatter), off))
        cov = scatter * nu / (nu - 2)
        six = [cov[i, j] for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]
        return group.iloc[:1][keys].assign(n=len(x), **dict(zip(MEAN + COV, [*mean, *six])))

    return held.groupBy(*keys).applyInPandas(run, schema)


def ordered_fold(rows: DataFrame, by: tuple[str, ...], order: str, value: str, start: float, step) -> DataFrame:
    """A fold over each key's values in order, for updates that don't commute (clamped sums, forgetting averages)."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value))))
    return rows.groupBy(*by).agg(held.alias("_v")).select(*by, F.aggregate("_v", F.lit(start), lambda s, x: step(s, x[value])).alias("value"))


def octree_leaves(points: DataFrame, big: float, most: int = 10, depth: int = 6) -> DataFrame:
    """Leaves (level, ix, iy, iz, n) of boxes of side ``big`` split in eight while they hold more than ``most`` points, down to ``depth``.

    Every level's counts are aggregated from the next finer level's, so points are read once; a leaf is a box that
    needs no split though its parent does.
    """
    fine = big / 2**depth
    keys = [F.floor(F.col(a) / fine).cast("long").alias(f"i{a}") for a in G.AXES]
    level = points.select(*keys).groupBy(*KEY).agg(F.count("*").alias("n"))
    levels = [level]
    for _ in range(depth):
        level = level.select(*(F.floor(F.col(k) / 2).cast("long").alias(k) for k in KEY), "n").groupBy(*KEY).agg(F.sum("n").alias("n"))
        levels.append(level)
    out = levels[-1].filter(F.col("n") <= most).select(F.lit(0).alias("level"), *KEY, "n")
    for k in range(1, depth + 1):
        parent = levels[depth - k + 1].filter(F.col("n") > most).select(*(F.col(c).alias("p" + c) for c in KEY))
        child = levels[depth - k].select("*", *(F.floor(F.col(c) / 2).cast("long").alias("p" + c) for c in KEY))
        child = child.join(parent, ["p" + c for c in KEY], "left_semi")
        out = out.union((child if k == depth else child.filter(F.col("n") <= most)).select(F.lit(k).alias("level"), *KEY, "n"))
    return out


def normality(points: DataFrame, size: float, by: tuple[str, ...] = (), least: int = 8) -> DataFrame:
    """Dornik-Hansen omnibus test of each cell: statistic ep and p-value (chi-square with six degrees, in closed form)."""
    keys = [*by, *KEY]
    held = binned(points, size).select(*keys, *G.AXES)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields if f.name in keys)

    def run(group):
        x = group[list(G.AXES)].to_numpy(float)
        n = len(x)
        if n < least:
            return group.iloc[:0][keys].assign(n=0, ep=0.0, p=0.0)
        off = x - x.mean(0)
        s = off.T @ off / n
        v = np.diag(1 / np.sqrt(np.diag(s)))
        values, h = np.linalg.eigh(v @ s @ v)
        r = off @ v @ h @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12))) @ h.T
        skew, kurt = (r**3).mean(0), (r**4).mean(0)
        beta = 3 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
        w2 = -1 + np.sqrt(2 * (beta - 1))
        delta = 1 / np.sqrt(np.log(np.sqrt(w2)))
        y = skew * np.sqrt((w2 - 1) / 2 * (n + 1) * (n + 3) / (6 * (n - 2)))
        z1 = delta * np.log(y + np.sqrt(y**2 + 1))
        d = (n - 3) * (n + 1) * (n**2 + 15 * n - 4)
        a = (n - 2) * (n + 5) * (n + 7) * (n**2 + 27 * n - 70) / (6 * d)
        c = (n - 7) * (n + 5) * (n + 7) * (n**2 + 2 * n - 5) / (6 * d)
        k = (n + 5) * (n + 7) * (n**3 + 37 * n**2 + 11 * n - 313) / (12 * d)
        alpha = a + skew**2 * c
        chi = np.maximum((kurt - 1 - skew**2) * 2 * k, 1e-12)
        z2 = (np.cbrt(chi / (2 * alpha)) - 1 + 1 / (9 * alpha)) * np.sqrt(9 * alpha)
        ep = float((z1**2 + z2**2).sum())
        t = ep / 2
        return group.iloc[:1][keys].assign(n=n, ep=ep, p=float(np.exp(-t) * (1 + t + t * t / 2)))

    return held.groupBy(*keys).applyInPandas(run, f"{kinds}, n long, ep double, p double")
