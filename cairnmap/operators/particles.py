"""Particle filters as tables: motion, weights, normalisation, moments and systematic resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .cells import COV, KEY, MEAN, columns
from .lineage import cut

#: Map cells that are broadcast at most.
FEW = 1 << 18


def uniform_grid(spark, lows: tuple[float, float, float], highs: tuple[float, float, float], steps: tuple[int, int, int]) -> DataFrame:
    """Particles on a grid over x, y and heading, equal weights; ids count heading fastest."""
    total = steps[0] * steps[1] * steps[2]
    out, left = spark.range(total).withColumnRenamed("id", "pid"), F.col("pid")
    for name, low, high, n, every in zip(("x", "y", "a"), lows, highs, steps, (steps[1] * steps[2], steps[2], 1)):
        out = out.withColumn(name, low + F.floor(left / every) % n * ((high - low) / n))
    return out.withColumn("p", F.lit(1.0 / total)).withColumn("lik", F.lit(1.0))


def normal_cloud(spark, n: int, mean: tuple[float, float, float], std: tuple[float, float, float], seed: int = 1) -> DataFrame:
    out = spark.range(n).withColumnRenamed("id", "pid")
    for k, (name, m, s) in enumerate(zip(("x", "y", "a"), mean, std)):
        out = out.withColumn(name, m + s * F.randn(seed + k))
    return out.withColumn("p", F.lit(1.0 / n)).withColumn("lik", F.lit(1.0))


def predict(particles: DataFrame, dx: float, dy: float, da: float, seed: int | None = None) -> DataFrame:
    """Particles moved by an odometry step; with a seed, with noise of 0.1 of the motion + 0.005 (0.001 for the heading)."""
    step = [F.lit(dx), F.lit(dy), F.lit(da)]
    if seed is not None:
        spread = [0.1 * abs(dx) + 0.005, 0.1 * abs(dy) + 0.005, 0.1 * abs(da) + 0.001]
        step = [s + w * F.randn(seed + k) for k, (s, w) in enumerate(zip(step, spread))]
    x, y, a = G.compose2(F.col("x"), F.col("y"), F.col("a"), *step)
    return particles.withColumns({"x": x, "y": y, "a": a})


def weigh(particles: DataFrame, scan: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """lik = 1 + sum over scan cells of 0.1 + 0.9 exp(-0.05 l / 2), l the Mahalanobis form of the two cells' means and summed covariances.

    Every particle moves every scan cell's mean (a scan is small against the particles and is broadcast), then one equality join with the map, which is
    broadcast up to ``FEW`` cells; covariances are turned for the pairs that met. Particles are dealt by id over many tasks, and a particle's
    pairs stay in its own, so nothing but particles is moved where the map is broadcast.
    """
    from .grasp import dealt

    scan = F.broadcast(scan.select(*(F.col(c).alias("s" + c) for c in MEAN + COV)))
    cells = cut(cells.select(*KEY, *MEAN, *COV))
    cells = F.broadcast(cells) if cells.count() <= FEW else cells
    own = dealt(particles, "pid")
    turned = own.select("pid", "x", "y", F.cos("a").alias("_c"), F.sin("a").alias("_s"))
    c, s, zero, one = F.col("_c"), F.col("_s"), F.lit(0.0), F.lit(1.0)
    t = [c, -s, zero, F.col("x"), s, c, zero, F.col("y"), zero, zero, one, zero]
    mean = G.transform_point(t, *(F.col("s" + m) for m in MEAN))
    moved = turned.crossJoin(scan).select("pid", "_c", "_s", *(F.col("s" + k) for k in COV), *(m.alias("t" + a) for m, a in zip(mean, G.AXES)))
    hit = moved.select("*", *G.grid_keys(size, ["t" + a for a in G.AXES])).join(cells, list(KEY))
    hit = hit.withColumns({"t" + n: k for n, k in zip(COV, G.rotate_sym(t, [F.col("s" + k) for k in COV]))})
    hit = hit.withColumns({f"_i{k}": v for k, v in enumerate(G.inverse([F.col("t" + k) + F.col(k) for k in COV]))})
    form = G.quadratic([F.col("t" + a) - F.col("m" + a) for a in G.AXES], [F.col(f"_i{k}") for k in range(6)])
    score = F.when(form.isNotNull() & ~F.isnan(form), 0.1 + 0.9 * F.exp(-0.05 * form / 2)).otherwise(0.0)
    total = hit.groupBy("pid").agg(F.sum(score).alias("s"))
    return own.join(total, "pid", "left").withColumn("lik", 1 + F.coalesce("s", F.lit(0.0))).drop("s")


def normalise(particles: DataFrame) -> DataFrame:
    """p times lik over their sum; uniform where the sum is 0. The sum is one row, joined back."""
    total = particles.agg(F.sum(F.col("p") * F.col("lik")).alias("_t"), F.count("*").alias("_n"))
    made = F.when(F.col("_t") > 0, F.col("p") * F.col("lik") / F.col("_t")).otherwise(1 / F.col("_n"))
    return particles.crossJoin(F.broadcast(total)).withColumn("p", made).drop("_t", "_n")


def moments(particles: DataFrame) -> DataFrame:
    """Weighted mean (circular heading) and covariance of x and y with the factor 1 / (1 - sum of squared weights)."""
    w = F.col("p")
    sums = particles.agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2"), *(F.sum(w * F.col(c)).alias(c) for c in "xy"), F.sum(w * F.sin("a")).alias("s"), F.sum(w * F.cos("a")).alias("c"), F.sum(w * F.col("x") ** 2).alias("xx"), F.sum(w * F.col("y") ** 2).alias("yy"), F.sum(w * F.col("x") * F.col("y")).alias("xy"))
    scale = 1 / (1 - F.col("w2"))
    return sums.select(F.col("x").alias("mean_x"), F.col("y").alias("mean_y"), F.atan2("s", "c").alias("mean_a"), ((F.col("xx") - F.col("x") ** 2) * scale).alias("var_x"), ((F.col("yy") - F.col("y") ** 2) * scale).alias("var_y"), ((F.col("xy") - F.col("x") * F.col("y")) * scale).alias("cov_xy"))


def resample(particles: DataFrame, u: float, chunk: int = 100_000) -> DataFrame:
    """Systematic resampling as set logic: a particle gets ceil(N C - u) - ceil(N C' - u) copies, C and C' the weights' running sums.

    Running sums go by chunks of ids, so no task holds all particles.
    """
    own = particles.withColumn("_c", F.floor(F.col("pid") / chunk))
    per = own.groupBy("_c").agg(F.sum("p").alias("_s"), F.count("*").alias("_k"))
    whole = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
    per = per.select("_c", (F.sum("_s").over(whole) - F.col("_s")).alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("_n"))
    w = Window.partitionBy("_c").orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)
    run = own.withColumn("_in", F.sum("p").over(w)).join(per, "_c").withColumn("_to", F.col("_before") + F.col("_in"))
    up = lambda c: F.ceil(F.round(F.col("_n") * c - u, 9))
    copies = (up(F.col("_to")) - up(F.col("_to") - F.col("p"))).cast("int")
    kept = run.withColumn("copies", copies).filter("copies > 0")
    return kept.select("pid", "x", "y", "a", "copies", (1.0 / F.col("_n")).alias("p"))


def best(particles: DataFrame, n: int) -> DataFrame:
    """Mean pose of the n heaviest particles (ties to smaller ids): a top-k, then one row."""
    top = particles.orderBy(F.col("p").desc(), "pid").limit(n)
    return top.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.atan2(F.avg(F.sin("a")), F.avg(F.cos("a"))).alias("a"))


def needs_resampling(particles: DataFrame, since: int, spread: float = 0.006, most: int = 25) -> DataFrame:
    return particles.agg(F.stddev_pop("p").alias("std")).select("std", ((F.col("std") > spread) | F.lit(since > most)).alias("resample"))


def drawn(rows: DataFrame, mean: tuple[str, str, str], cov: tuple[str, ...], names: tuple[str, str, str], seed: int = 1) -> DataFrame:
    """A normal draw of three variables for each row, from its mean and covariance columns (xx, xy, xz, yy, yz, zz), by the Cholesky factor.

    A direction without spread stays at the mean.
    """
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in cov)
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    out = rows.withColumns({f"_z{k}": F.randn(seed + k) for k in range(3)}).withColumn("_a", root(xx))
    out = out.withColumns({"_b": over(xy, F.col("_a")), "_c": over(xz, F.col("_a"))}).withColumn("_d", root(yy - F.col("_b") * F.col("_b")))
    out = out.withColumn("_e", over(yz - F.col("_b") * F.col("_c"), F.col("_d"))).withColumn("_f", root(zz - F.col("_c") * F.col("_c") - F.col("_e") * F.col("_e")))
    z = [F.col(f"_z{k}") for k in range(3)]
    made = [F.col("_a") * z[0], F.col("_b") * z[0] + F.col("_d") * z[1], F.col("_c") * z[0] + F.col("_e") * z[1] + F.col("_f") * z[2]]
    return out.withColumns({n: F.col(m) + v for n, m, v in zip(names, mean, made)}).drop("_z0", "_z1", "_z2", "_a", "_b", "_c", "_d", "_e", "_f")


def uniform(rows: DataFrame, lows: tuple[float, ...], highs: tuple[float, ...], names: tuple[str, ...], seed: int = 1) -> DataFrame:
    """Uniform draws between bounds in new columns."""
    return rows.withColumns({n: low + (high - low) * F.rand(seed + k) for k, (n, low, high) in enumerate(zip(names, lows, highs))})


def injected(particles: DataFrame, likelihoods: DataFrame) -> DataFrame:
    """Particles with likelihoods (pid, lik) from outside; particles without one keep theirs."""
    return particles.join(likelihoods.select("pid", F.col("lik").alias("_l")), "pid", "left").withColumn("lik", F.coalesce("_l", "lik")).drop("_l")


def resized(particles: DataFrame, n: int) -> DataFrame:
    """The n particles of largest weight, equal weights by id, with weights that sum to 1 again (uniform where all are 0)."""
    kept = particles.orderBy(F.col("p").desc(), "pid").limit(n)
    total = kept.agg(F.sum("p").alias("_t"), F.count("*").alias("_n"))
    return kept.join(F.broadcast(total)).withColumn("p", F.when(F.col("_t") > 0, F.col("p") / F.col("_t")).otherwise(1.0 / F.col("_n"))).drop("_t", "_n")


#: Modulus and constants of the counted draws: the same numbers wherever a row is computed.
DRAW_P, DRAW_A, DRAW_C = 2147483647, 48271, 1013904223


def counted_uniform(number, stream: int):
    """A number in (0, 1) from an integer column and a stream, by two squarings modulo a prime: no state, so a lost task draws the same again."""
    x = F.pmod(number, F.lit(DRAW_P)) * DRAW_A + F.lit(stream * DRAW_C % DRAW_P)
    for _ in range(2):
        x = F.pmod(x, F.lit(DRAW_P))
        x = F.pmod(x * x, F.lit(DRAW_P)) + F.lit((stream + 1) * DRAW_A % DRAW_P)
    return (F.pmod(x, F.lit(DRAW_P)) + 0.5) / DRAW_P


def counted_normal(number, stream: int):
    """A normal draw from an integer column and a stream (two uniform draws)."""
    return F.sqrt(-2 * F.log(counted_uniform(number, 2 * stream))) * F.cos(2 * 3.141592653589793 * counted_uniform(number, 2 * stream + 1))


def quaternion_product(a: list, b: list) -> list:
    """qx, qy, qz, qw of a then, in its frame, b."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return [aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz]


def rotated(q: list, v: list) -> list:
    """A vector turned by a unit quaternion."""
    x, y, z, w = q
    t = [2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])]
    return [v[0] + w * t[0] + y * t[2] - z * t[1], v[1] + w * t[1] + z * t[0] - x * t[2], v[2] + w * t[2] + x * t[1] - y * t[0]]


def predict6(particles: DataFrame, motion: tuple[float, ...], cov: list[list[float]], step: int = 0) -> DataFrame:
    """Particles (pid, x, y, z, qx, qy, qz, qw) moved by a six-degree motion (tx, ty, tz, qx, qy, qz, qw) in their own frames and then by
    noise of full covariance over (tx, ty, tz, roll, pitch, yaw), drawn for each particle and ``step``.

    The noise is a lower Cholesky factor times counted normal draws, so reruns agree; a direction without spread stays still. Quaternions are
    normalised. Null poses stay null.
    """
    import numpy as np

    c = np.array(cov, float)
    values, vectors = np.linalg.eigh(c)
    if values[0] < -1e-9 * max(abs(values[-1]), 1e-300):
        raise ValueError("the covariance has a negative direction")
    # the lower factor of a semi-definite matrix, from its square root's orthogonal decomposition
    lower = np.linalg.qr((vectors * np.sqrt(np.maximum(values, 0))).T)[1].T
    lower = lower * np.where(np.diag(lower) < 0, -1.0, 1.0)
    rows = particles.withColumns({f"_z{k}": counted_normal(F.col("pid"), 8 * step + k) for k in range(6)})
    noise = [sum((float(lower[i, k]) * F.col(f"_z{k}") for k in range(i + 1)), F.lit(0.0)) for i in range(6)]
    rows = rows.withColumns({f"_n{i}": n for i, n in enumerate(noise)})
    size = float(np.linalg.norm(motion[3:]))
    turn = [F.lit(float(v) / size) for v in motion[3:]]
    own = [F.col(q) for q in ("qx", "qy", "qz", "qw")]
    length = F.sqrt(sum((q * q for q in own), F.lit(0.0)))
    rows = rows.withColumns({f"_q{k}": q / length for k, q in enumerate(own)})
    q = [F.col(f"_q{k}") for k in range(4)]
    rows = rows.withColumns({f"_m{k}": v for k, v in enumerate(quaternion_product(q, turn))})
    far = rotated(q, [F.lit(float(v)) for v in motion[:3]])
    m = [F.col(f"_m{k}") for k in range(4)]
    shaken = rotated(m, [F.col(f"_n{i}") for i in range(3)])
    made = quaternion_product(m, G.rpy_quaternion(*(F.col(f"_n{i}") for i in range(3, 6))))
    out = {a: F.col(a) + f + s for a, f, s in zip("xyz", far, shaken)} | dict(zip(("qx", "qy", "qz", "qw"), made))
    return rows.withColumns(out).drop(*(f"_{n}{k}" for n, k in [("z", k) for k in range(6)] + [("n", k) for k in range(6)] + [("q", k) for k in range(4)] + [("m", k) for k in range(4)]))
