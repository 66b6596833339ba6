"""Convex hulls in any few dimensions, point by point, with conflict lists."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np

#: Simplices whose matrices are held at once.
PART = 1 << 14


class Hull:
    """Simplices (facets x vertices, places in the points given), outward unit normals and offsets (n . x <= offset)."""

    def __init__(self, vertices: np.ndarray, normals: np.ndarray, offsets: np.ndarray, points: np.ndarray, inner: np.ndarray):
        self.vertices, self.normals, self.offsets, self.points, self.inner = vertices, normals, offsets, points, inner

    def _rounded(self, places: np.ndarray | slice, digits: int) -> np.ndarray:
        return np.round(np.column_stack((self.normals[places], self.offsets[places])), digits) + 0.0

    def different(self, digits: int = 6) -> np.ndarray:
        """Places of simplices on different facet planes, one for each. Planes are told apart by a hash; only those that share one are compared."""
        n, d = self.normals.shape
        factor = np.random.default_rng(2).integers(1, 1 << 62, d + 1, dtype=np.uint64) | np.uint64(1)
        mark = np.empty(n, np.uint64)
        for k in range(0, n, PART):
            mark[k : k + PART] = (self._rounded(slice(k, k + PART), digits).view(np.uint64) * factor).sum(1, dtype=np.uint64)
        order = np.argsort(mark, kind="stable")
        mark = mark[order]
        again = np.append(False, mark[1:] == mark[:-1])
        several = again | np.append(again[1:], False)
        shared, single = order[several], order[~several]
        first = np.unique(self._rounded(shared, digits), axis=0, return_index=True)[1]
        return np.sort(np.append(single, shared[first]))

    def planes(self, digits: int = 6) -> int:
        """Number of different facet planes: simplices of one flat facet count once."""
        return len(self.different(digits))

    def _crowded(self, gap: float) -> np.ndarray:
        """Whether a corner other than a simplex's own lies within ``gap`` of its plane. From such a corner a path over edges climbs to the simplex,
        so one of them is a neighbour of the simplex's corners: stars are looked at, corner by corner, for some corners at a time."""
        n, d = self.vertices.shape
        found, stars = np.zeros(n, bool), np.zeros(len(self.points), np.int64)
        for k in range(0, n, PART):
            stars += np.bincount(self.vertices[k : k + PART].reshape(-1), minlength=len(stars))
        run = np.cumsum(stars) // (PART * 64)
        for first, last in ((r[0], r[-1]) for r in np.split(np.arange(len(run)), np.flatnonzero(np.diff(run)) + 1)):
            own, of = [], []
            for k in range(0, n, PART):
                part = self.vertices[k : k + PART]
                row, column = np.nonzero((part >= first) & (part <= last))
                own.append(row + k)
                of.append(part[row, column])
            own, of = np.concatenate(own), np.concatenate(of)
            order = np.argsort(of, kind="stable")
            for star in np.split(own[order], np.flatnonzero(np.diff(of[order])) + 1):
                near = np.unique(self.vertices[star])
                found[star] |= (self.points[near] @ self.normals[star].T - self.offsets[star] > -gap).sum(0) > d
        return found

    def touching(self, digits: int = 7, gap: float = 1e-7, held: int = 1 << 22):
        """Facets (places of simplices, one for each plane) and the points within ``gap`` of their planes, in parts: places, facets' numbers, points.
        Planes with their own corners only are not measured against the others; ``held`` distances at a time."""
        places, d = self.different(digits), self.vertices.shape[1]
        crowded = self._crowded(gap)[places]
        inside = np.ones(len(self.points), bool)
        inside[self.vertices.reshape(-1)] = False
        for several, measured in ((False, np.flatnonzero(inside)), (True, np.arange(len(inside)))):
            numbers = np.flatnonzero(crowded == several)
            for k in range(0, 0 if several else len(numbers), PART):
                part = numbers[k : k + PART]
                yield np.repeat(places[part], d), np.repeat(part, d), self.vertices[places[part]].reshape(-1)
            size = max(held // max(len(measured), 1), 1)
            for k in range(0, len(numbers) if len(measured) else 0, size):
                part = numbers[k : k + size]
                at = places[part]
                point, facet = np.nonzero(np.abs(self.points[measured] @ self.normals[at].T - self.offsets[at]) < gap)
                yield at[facet], part[facet], measured[point]

    def _parts(self):
        return (self.points[self.vertices[k : k + PART]] for k in range(0, len(self.vertices), PART))

    def volume(self) -> float:
        d = self.points.shape[1]
        return sum(float(np.abs(np.linalg.det(own - self.inner)).sum()) for own in self._parts()) / factorial(d)

    def area(self) -> float:
        d, whole = self.points.shape[1], 0.0
        for own in self._parts():
            edges = own[:, 1:] - own[:, :1]
            whole += float(np.sqrt(np.maximum(np.linalg.det(edges @ edges.transpose(0, 2, 1)), 0)).sum())
        return whole / factorial(d - 1)


def _planes(points: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals and offsets of simplices (m x d x d): with the inner point as origin a plane is n . x = 1, so it faces outward."""
    n = np.linalg.solve(points - inner, np.ones((len(points), points.shape[1], 1)))[:, :, 0]
    size = np.linalg.norm(n, axis=1)
    n /= size[:, None]
    return n, 1 / size + n @ inner


def _first(points: np.ndarray, least: float) -> list[int] | None:
    """d + 1 points that span the space, each the farthest from the flat of those before; None for flat points."""
    own = [int(np.lexsort(points.T[::-1])[0])]
    rest, basis = points - points[own[0]], []
    for _ in range(points.shape[1]):
        far = np.linalg.norm(rest, axis=1)
        top = int(far.argmax())
        if far[top] <= least:
            return None
        own.append(top)
        basis.append(rest[top] / far[top])
        rest = rest - np.outer(rest @ basis[-1], basis[-1])
    return own


def convex_hull(points: np.ndarray, tolerance: float = 1e-10) -> Hull | None:
    """The hull of points (n x d), or None where they lie in a flat or hold anything but finite numbers.

    Every point outside the hull so far is in the conflict list of one facet that it sees. Of a facet's list the farthest point is added (the
    lexically last among equals, so that always a corner is added): the facets it sees, found from that one across ridges, go, new ones join it to
    the ridges around them, and the lists of those that went are dealt to the new ones. Points within ``tolerance`` times the extent of a facet
    count as inside. A step costs what it changes, not the whole hull; new facets take the places of those that went, and the arrays grow where they lie.
    """
    points = np.asarray(points, float)
    if not len(points) or not np.isfinite(points).all():
        return None
    n, d = points.shape
    least = tolerance * max(float(np.ptp(points, axis=0).max()), 1e-300)
    own = _first(points, least)
    if own is None:
        return None
    inner = points[own].mean(0)
    order = np.empty(n, np.int64)
    order[np.lexsort(points.T[::-1])] = np.arange(n)
    weight = np.random.default_rng(1).integers(1, 1 << 62, n, dtype=np.uint64)
    vertices = np.array([[*c] for c in combinations(own, d)], np.int32)
    across = np.array([[d - own.index(i) for i in c] for c in vertices.tolist()], np.int32)  # the facet without a vertex is on its other side
    normals, offsets = (a.copy() for a in _planes(points[vertices], inner))
    alive = np.ones(len(vertices), bool)
    used, free = len(vertices), np.zeros(0, np.int64)
    above = points @ normals.T - offsets
    sees = np.where(above.max(1) > least, above.argmax(1), -1)
    sees[own] = -1
    waiting = np.flatnonzero(sees >= 0)
    while len(waiting):
        facet = sees[waiting[0]]
        mine = waiting[sees[waiting] == facet]
        height = points[mine] @ normals[facet] - offsets[facet]
        top = mine[height >= height.max() - least * 1e-3]
        apex = int(top[order[top].argmax()])
        gone = front = np.array([facet])
        alive[facet] = False
        while len(front):  # facets that the apex sees, ring by ring
            front = np.unique(across[front])
            front = front[alive[front]]
            front = front[normals[front] @ points[apex] - offsets[front] > least]
            alive[front] = False
            gone = np.append(gone, front)
        at, side = np.nonzero(alive[across[gone]])
        beyond = across[gone[at], side]
        corners = vertices[gone[at]]
        ridges = corners[np.arange(d) != side[:, None]].reshape(-1, d - 1)
        key = weight[ridges].sum(1, dtype=np.uint64)
        turn = np.argsort(key)
        ridges, beyond, key = np.sort(ridges[turn], axis=1), beyond[turn], key[turn]
        m = len(ridges)
        lost = waiting[~alive[sees[waiting]]]
        lost = lost[lost != apex]
        sees[apex] = -1
        free = np.append(free, gone)
        number, free = np.append(free[:m], np.arange(used, used + max(m - len(free), 0))), free[m:]
        used = max(used, int(number.max()) + 1)
        if used > len(alive):
            grow = used + used // 4
            for a in (vertices, across, normals, offsets, alive):
                a.resize((grow, *a.shape[1:]), refcheck=False)
        vertices[number] = np.column_stack((ridges, np.full(m, apex, np.int32)))
        new_normals, new_offsets = _planes(points[vertices[number]], inner)
        normals[number], offsets[number], alive[number] = new_normals, new_offsets, True
        across[number, -1] = beyond
        slot = (vertices[beyond][:, :, None] == ridges[:, None]).any(2).argmin(1)
        across[beyond, slot] = number
        pair = np.argsort((key[:, None] - weight[ridges]).reshape(-1), kind="stable").reshape(-1, 2)  # two new facets meet where a ridge drops a vertex
        row, column = np.divmod(pair, d - 1)
        one, two = number[row[:, 0]], number[row[:, 1]]
        across[one, column[:, 0]], across[two, column[:, 1]] = two, one
        if len(lost):
            above = points[lost] @ new_normals.T - new_offsets
            sees[lost] = np.where(above.max(1) > least, number[above.argmax(1)], -1)
        waiting = waiting[sees[waiting] >= 0]
    del across
    keep = np.flatnonzero(alive[:used])
    for a in (vertices, normals, offsets):  # one at a time
        a[: len(keep)] = a[keep]
        a.resize((len(keep), *a.shape[1:]), refcheck=False)
    return Hull(vertices, normals, offsets, points, inner)
