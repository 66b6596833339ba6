"""Column expressions for points, poses, symmetric 3x3 matrices and Gaussian cells. All stay inside code generation.

A symmetric matrix is six columns named xx, xy, xz, yy, yz, zz with a prefix; a rigid transform is a row-major list of
16 numbers or columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
SYM = ("xx", "xy", "xz", "yy", "yz", "zz")


def grid_key(value: Column | str, size: float, centre: float = 0.0) -> Column:
    """Index of the cell centred on centre + k * size that holds a coordinate: half-open, unbounded."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor((value - F.lit(centre)) / F.lit(size) + F.lit(0.5)).cast("int")


def grid_keys(size: float, names: Sequence[str] = AXES) -> list[Column]:
    return [grid_key(n, size).alias(f"i{a}") for n, a in zip(names, AXES)]


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return norm(*(p - q for p, q in zip(a, b)))


def transform_point(t: Sequence, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(t[4 * r] * x + t[4 * r + 1] * y + t[4 * r + 2] * z + t[4 * r + 3] for r in range(3))


def rotate_sym(t: Sequence, c: Sequence[Column]) -> list[Column]:
    """R C R' of a symmetric C, for the rotation part of a transform."""
    full = [[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]]
    out = []
    for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)):
        out.append(sum((t[4 * i + a] * t[4 * j + b] * full[a][b] for a in range(3) for b in range(3)), F.lit(0.0)))
    return out


def determinant(c: Sequence[Column]) -> Column:
    xx, xy, xz, yy, yz, zz = c
    return xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)


def inverse(c: Sequence[Column]) -> list[Column]:
    """Inverse by cofactors; null where singular."""
    xx, xy, xz, yy, yz, zz = c
    det = determinant(c)
    det = F.when(F.abs(det) > 0, det)
    return [(yy * zz - yz * yz) / det, (xz * yz - xy * zz) / det, (xy * yz - xz * yy) / det, (xx * zz - xz * xz) / det, (xy * xz - xx * yz) / det, (xx * yy - xy * xy) / det]


def quadratic(d: Sequence[Column], m: Sequence[Column]) -> Column:
    """d' M d of a symmetric M."""
    x, y, z = d
    xx, xy, xz, yy, yz, zz = m
    return x * x * xx + y * y * yy + z * z * zz + 2 * (x * y * xy + x * z * xz + y * z * yz)


def mahalanobis(point: Sequence[Column], mean: Sequence[Column], cov: Sequence[Column]) -> Column:
    return quadratic([p - m for p, m in zip(point, mean)], inverse(cov))


def likelihood(point: Sequence[Column], mean: Sequence[Column], cov: Sequence[Column]) -> Column:
    """exp(-d/2) of the squared Mahalanobis distance; -1 where the cell has no usable Gaussian."""
    value = F.exp(-0.5 * mahalanobis(point, mean, cov))
    return F.when(value.isNull() | F.isnan(value), -1.0).otherwise(value)


def wrap_angle(a: Column) -> Column:
    return F.atan2(F.sin(a), F.cos(a))


def eigenvalues(c: Sequence[Column]) -> list[Column]:
    """Eigenvalues of a symmetric 3x3 matrix, ascending, by the trigonometric form."""
    xx, xy, xz, yy, yz, zz = c
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    safe = F.when(p > 0, p)
    b = [(xx - q) / safe, xy / safe, xz / safe, (yy - q) / safe, yz / safe, (zz - q) / safe]
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), determinant(b) / 2))
    phi = F.acos(r) / 3
    top = q + 2 * p * F.cos(phi)
    low = q + 2 * p * F.cos(phi + 2 * 3.141592653589793 / 3)
    middle = 3 * q - top - low
    return [F.coalesce(v, q) for v in (low, middle, top)]


def quaternion_matrix(qx: Column, qy: Column, qz: Column, qw: Column) -> list[Column]:
    """Row-major 3x3 of a quaternion, normalised."""
    n = F.sqrt(qx * qx + qy * qy + qz * qz + qw * qw)
    x, y, z, w = qx / n, qy / n, qz / n, qw / n
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


def rpy_quaternion(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """qx, qy, qz, qw of Rz(yaw) Ry(pitch) Rx(roll)."""
    cr, sr, cp, sp, cy, sy = (f(a / 2) for a in (roll, pitch, yaw) for f in (F.cos, F.sin))
    return [sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy]


def compose2(x: Column, y: Column, a: Column, dx: Column, dy: Column, da: Column) -> tuple[Column, Column, Column]:
    """A planar pose moved by a difference given in its own frame."""
    return x + dx * F.cos(a) - dy * F.sin(a), y + dx * F.sin(a) + dy * F.cos(a), wrap_angle(a + da)


def difference2(x1: Column, y1: Column, a1: Column, x2: Column, y2: Column, a2: Column) -> tuple[Column, Column, Column]:
    """The second planar pose seen from the first."""
    dx, dy = x2 - x1, y2 - y1
    return dx * F.cos(a1) + dy * F.sin(a1), -dx * F.sin(a1) + dy * F.cos(a1), wrap_angle(a2 - a1)


def occupancy_probability(evidence: Column) -> Column:
    return 1 - 1 / (1 + F.exp(evidence))


def project(fx: float, fy: float, cx: float, cy: float, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return fx * x / z + cx, fy * y / z + cy


def back_project(fx: float, fy: float, cx: float, cy: float, u: Column, v: Column, d: Column) -> tuple[Column, Column, Column]:
    return (u - cx) * d / fx, (v - cy) * d / fy, d


def two_state_power(leave: Column, enter: Column, steps: int) -> tuple[Column, Column]:
    """P[free -> free], P[occupied -> occupied] of a two-state chain after 2 ** steps moves, in closed form."""
    total = leave + enter
    decay = F.pow(1 - total, F.lit(float(2**steps)))
    free = (enter + leave * decay) / total
    occupied = (leave + enter * decay) / total
    return occupied, free


def ball_volume(n: int, r: Column) -> Column:
    """Volume of the n-ball by the usual recursion over dimensions."""
    value = F.lit(1.0) if n % 2 == 0 else 2 * r
    for k in range(2 if n % 2 == 0 else 3, n + 1, 2):
        value = value * 2 * 3.141592653589793 / k * r * r
    return value


def ball_area(n: int, r: Column) -> Column:
    return ball_volume(n, r) * n / r
