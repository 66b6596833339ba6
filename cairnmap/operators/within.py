"""Numbers of points within a radius, without the pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .grasp import dealt

#: Rows of a tile in one group at most; larger tiles are split.
CROWD = 1 << 20
#: Pairs that a task measures at a time.
HELD = 1 << 16


def _pairs(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For ranges [first, last), in parts of some ``HELD`` members: the ranges' slice, each member's range within it and each member's place."""
    size = np.maximum(last - first, 0)
    until = np.cumsum(size)
    start = 0
    while start < len(size):
        done = until[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(until, done + HELD, "right")))
        own, n = size[start:stop], until[stop - 1] - done
        if n:
            yield slice(start, stop), np.repeat(np.arange(len(own)), own), np.arange(n) + np.repeat(first[start:stop] - until[start:stop] + own + done, own)
        start = stop


def _met(asked: np.ndarray, places: np.ndarray, first: np.ndarray, last: np.ndarray, radius: float) -> np.ndarray:
    """For each point asked (n x 3), how many of the places (3 x n) [first, last) lie within the radius."""
    out = np.zeros(len(asked), np.int64)
    for rows, of, at in _pairs(first, last):
        q = asked[rows]
        dx, dy, dz = (q[:, k][of] - places[k][at] for k in range(3))
        out[rows] = np.bincount(of[np.sqrt(dx * dx + dy * dy + dz * dz) <= radius], minlength=len(q))
    return out


def counts_within(asked: np.ndarray, places: np.ndarray, radius: float) -> np.ndarray:
    """How many places lie within the radius of each point asked (n x 3 arrays of finite numbers).

    Places are sorted by columns over x and y and along z in them. Of a column, those so near in z that they are within reach from anywhere in it
    are counted by their ranks, and only those near the ball's surface are measured; columns are the narrower the more places a ball holds.
    """
    out = np.zeros(len(asked), np.int64)
    if not len(asked) or not len(places):
        return out
    if len(asked) * len(places) <= HELD * 16:
        return _met(asked, places.T, out, out + len(places), radius)
    low, high = places.min(0), places.max(0)
    slack = 16 * np.finfo(float).eps * max(np.abs(places).max(), np.abs(asked).max())
    near, far = radius * (1 - 1e-9) - slack, radius * (1 + 1e-9) + slack
    box = np.floor((places - low) / radius)
    held = np.unique((box[:, 0] * (box[:, 1].max() + 1) + box[:, 1]) * (box[:, 2].max() + 1) + box[:, 2], return_counts=True)[1]
    m = int(np.clip((0.06 * 4.2 * (held @ held) / len(places)) ** (1 / 3), 1, 16))
    side = radius / m
    column = np.floor((places[:, :2] - low[:2]) / side).astype(np.int64)
    nx, ny = column.max(0) + 1
    depth = (high[2] - low[2]) + 4 * far
    fraction = lambda z: np.clip((z - low[2] + 2 * far) / depth, 0, 1 - 1e-9)
    rank = column[:, 0] * ny + column[:, 1] + fraction(places[:, 2])
    order = np.argsort(rank, kind="stable")
    places, rank = np.ascontiguousarray(places[order].T), rank[order]
    slip = depth * (nx * ny + 1) * 4 * np.finfo(float).eps + slack
    at = np.floor((asked[:, :2] - low[:2]) / side).astype(np.int64)
    line = np.lexsort((asked[:, 2], at[:, 1], at[:, 0]))
    asked, at, total = asked[line], at[line], out.copy()
    for i in range(-m - 1, m + 2):
        for j in range(-m - 1, m + 2):
            c = at + (i, j)
            gap, reach = [], []
            for k in (0, 1):
                from_ = asked[:, k] - low[k] - c[:, k] * side
                gap.append(np.maximum(0, np.maximum(-from_, from_ - side)))
                reach.append(np.maximum(np.abs(from_), np.abs(from_ - side)))
            open_ = far * far - np.maximum(gap[0] - slack, 0) ** 2 - np.maximum(gap[1] - slack, 0) ** 2
            rows = np.nonzero((c[:, 0] >= 0) & (c[:, 0] < nx) & (c[:, 1] >= 0) & (c[:, 1] < ny) & (open_ >= 0))[0]
            if not len(rows):
                continue
            base, z, outer = (c[rows, 0] * ny + c[rows, 1]).astype(float), asked[rows, 2], np.sqrt(open_[rows]) + slip
            inner = near * near * (near > 0) - (reach[0][rows] + slack) ** 2 - (reach[1][rows] + slack) ** 2
            inner = np.where(inner > 0, np.sqrt(np.maximum(inner, 0)), 0) - slip
            full = inner > 0
            a, d = np.searchsorted(rank, base + fraction(z - outer)), np.searchsorted(rank, base + fraction(z + outer), "right")
            b, e = d.copy(), d.copy()
            b[full] = np.searchsorted(rank, base[full] + fraction(z[full] - inner[full]))
            e[full] = np.searchsorted(rank, base[full] + fraction(z[full] + inner[full]), "right")
            total[rows] += e - b + _met(asked[rows], places, a, b, radius) + _met(asked[rows], places, e, d, radius)
    out[line] = total
    return out


def _same(asked: np.ndarray, ids: np.ndarray, places: np.ndarray, names: np.ndarray, radius: float) -> np.ndarray:
    """How many places within the radius bear the same id as each point asked."""
    order = np.argsort(names, kind="stable")
    names = names[order]
    return _met(asked, places[order].T, np.searchsorted(names, ids), np.searchsorted(names, ids, "right"), radius)


def neighbour_counts(points: DataFrame, point_id: str, radius: float, by: tuple[str, ...] = (), itself: bool = True) -> DataFrame:
    """point_id, near: how many points of one key lie within a radius of each point, with or without those of its own id; 0 for none.

    A point goes to the tiles (8 radii wide) that its ball touches and is asked about in its own. Tiles with more than ``CROWD`` rows are
    split into groups of some rows against some rows. Rows with a null in their key or without finite coordinates don't count.
    """
    side, kinds = 8 * radius, dict(points.dtypes)
    own = points.select(*by, point_id, *(F.col(a).cast("double").alias(a) for a in G.AXES)).dropna(subset=[*by, *G.AXES])
    own = own.filter(" and ".join(f"abs({a}) < double('inf')" for a in G.AXES))
    keys = ["_k" + a for a in G.AXES]
    tile = lambda c: F.floor(c / side).cast("long")
    home = F.lit(True)
    for a, k in zip(G.AXES, keys):
        pad = F.least(F.lit(side), radius * (1 + 1e-6) + F.abs(a) * 1e-15)
        own = own.withColumn(k, F.explode(F.sequence(tile(F.col(a) - pad), tile(F.col(a) + pad))))
        home = home & (F.col(k) == tile(F.col(a)))
    full = own.groupBy(*by, *keys).count().filter(F.col("count") > CROWD).withColumn("_n", F.ceil(F.col("count") / CROWD).cast("int")).drop("count")
    own = own.withColumn("_own", home).join(F.broadcast(full), [*by, *keys], "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    own = own.withColumn("_h", F.pmod(F.xxhash64(point_id, *G.AXES), F.col("_n")).cast("int"))
    parts = F.sequence(F.lit(0), F.col("_n") - 1)
    met = F.transform(parts, lambda i: F.struct(i.alias("_a"), F.col("_h").alias("_b"), (F.col("_own") & (i == F.col("_h"))).alias("_ask"), F.lit(True).alias("_met")))
    asks = F.transform(F.filter(parts, lambda i: F.col("_own") & (i != F.col("_h"))), lambda i: F.struct(F.col("_h").alias("_a"), i.alias("_b"), F.lit(True).alias("_ask"), F.lit(False).alias("_met")))
    groups = [*by, *keys, "_a", "_b"]
    rows = own.select(*by, *keys, point_id, *G.AXES, F.inline(F.concat(met, asks)))

    def run(table: pa.Table) -> pa.Table:
        at = np.column_stack([table[a].to_numpy() for a in G.AXES])
        ask, met = table["_ask"].to_numpy(), table["_met"].to_numpy()
        near = counts_within(at[ask], at[met], radius)
        if not itself:
            names = table[point_id].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            near = near - _same(at[ask], names[ask], at[met], names[met], radius)
        return pa.table({point_id: table[point_id].filter(pa.array(ask)), "near": near})

    found = dealt(rows, *groups).groupBy(*groups).applyInArrow(run, f"`{point_id}` {kinds[point_id]}, near long")
    return found.groupBy(point_id).agg(F.sum("near").alias("near"))
