"""Nearest neighbours by score-aware anisotropic quantisation, four-bit table scans and error bounds (operator 9).

A vector, less the sample's mean, is the nearest of ``COARSE`` centres plus a rest, so that codes spend their bits inside clusters. The rest is cut
to pairs of components, each pair coded by one of 16 centres: 4 bits. Centres and codes minimise a loss in which the error's part parallel to the
vector weighs ``eta`` times the rest, which keeps large inner products accurate. Centres are fitted on at most ``SAMPLE`` vectors,
picked by a hash of the id; the index has the codes of every row, and how far the row lies from what its codes stand for. A query's inner
products with all centres make a table; the sum of a row's entries gives the query's distance from what the codes stand for. The row's own
distance differs from it by at most the row's error, so every row that this bound doesn't rule out is measured exactly, in double
precision, on the original vectors: no near row is missed, however coarse the codes are for the data.

Defined results: see ``vectors.valid``; zero vectors take no part, rows with the query's own id are no candidates; a repeated row counts as often as it
is there, and a repeated query row has a list of its own each time; only vectors of the query's length are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import by_length, matrices, searched, valid, windows

SAMPLE, ETA, WINDOW = 8192, 2.6, 8192
CENTRES, COARSE = 16, 64


def _parts(vectors: np.ndarray) -> np.ndarray:
    """n x pairs x 2; an odd last component gets a zero beside it."""
    if vectors.shape[1] % 2:
        vectors = np.hstack((vectors, np.zeros((len(vectors), 1))))
    return vectors.reshape(len(vectors), -1, 2)


def _units(parts: np.ndarray) -> np.ndarray:
    norm = np.sqrt((parts**2).sum((1, 2), keepdims=True))
    return parts / np.where(norm > 0, norm, 1)


def assign(vectors: np.ndarray, units: np.ndarray, centres: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes (n x pairs): nearest centres first, then pair by pair the choice with the least anisotropic loss along ``units``."""
    parts = _parts(vectors)
    n_pairs = parts.shape[1]
    codes = np.empty((len(parts), n_pairs), np.uint8)
    for s in range(n_pairs):
        codes[:, s] = ((parts[:, s, None] - centres[s][None]) ** 2).sum(2).argmin(1)
    along = np.stack([((parts[:, s] - centres[s][codes[:, s]]) * units[:, s]).sum(1) for s in range(n_pairs)], 1)
    total = along.sum(1)
    for _ in range(sweeps):
        for s in range(n_pairs):
            off = parts[:, s, None] - centres[s][None]
            parallel = (off * units[:, s, None]).sum(2)
            rest = (total - along[:, s])[:, None]
            codes[:, s] = ((off**2).sum(2) + (eta - 1) * (rest + parallel) ** 2).argmin(1)
            own = np.take_along_axis(parallel, codes[:, s, None].astype(np.int64), 1)[:, 0]
            total = rest[:, 0] + own
            along[:, s] = own
    return codes


def nearest_centre(vectors: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    return ((coarse**2).sum(1) - 2 * vectors @ coarse.T).argmin(1)


def fit(sample: np.ndarray, eta: float = ETA, rounds: int = 8, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Coarse centres by k-means, and the rests' centres (pairs x 16 x 2): k-means to start from, then rounds of anisotropic codes and least squares."""
    draw = np.random.default_rng(seed)
    coarse = sample[draw.permutation(len(sample))[:COARSE]].astype(float)
    for _ in range(10):
        own = nearest_centre(sample, coarse)
        counts = np.bincount(own, minlength=len(coarse))
        sums = np.zeros_like(coarse)
        np.add.at(sums, own, sample)
        coarse = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], coarse)
    rest_of = sample - coarse[nearest_centre(sample, coarse)]
    parts, units = _parts(rest_of), _units(_parts(sample))
    n_pairs = parts.shape[1]
    centres = np.stack([parts[draw.permutation(len(parts))[np.arange(CENTRES) % len(parts)], s] for s in range(n_pairs)])
    for turn in range(rounds):
        weight = 1.0 if turn < rounds // 2 else eta
        codes = assign(rest_of, units, centres, weight, 0 if weight == 1 else 1)
        along = np.stack([((parts[:, s] - centres[s][codes[:, s]]) * units[:, s]).sum(1) for s in range(n_pairs)], 1)
        for s in range(n_pairs):
            rest = along.sum(1) - along[:, s]
            for c in range(CENTRES):
                own = codes[:, s] == c
                if own.any():
                    x, u = parts[own, s], units[own, s]
                    left = own.sum() * np.eye(2) + (weight - 1) * u.T @ u
                    centres[s, c] = np.linalg.solve(left, x.sum(0) + (weight - 1) * ((rest[own] + (x * u).sum(1))[:, None] * u).sum(0))
    return coarse, centres


def decoded(codes: np.ndarray, centres: np.ndarray, width: int) -> np.ndarray:
    """The rests (n x width) that codes (n x pairs) stand for."""
    return centres[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)[:, :width]


def build(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The index (id, size, base, off, codes: a byte for the coarse centre, then two codes to a byte, and v) of every valid row, stored,
    and mean, coarse centres and centres for each length of vectors. With c the coarse centre and r the coded rest, ``base`` is
    r . r + 2 c . r and ``off`` the distance of the row from mean + c + r."""
    vectors = valid(rows, id_col, vector_col, zero=False)
    picked = [np.array(r["v"]) for r in vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]

    def fitted(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean = sample.mean(0)
        return mean, *fit(sample - mean)

    centres = {n: fitted(np.array([picked[i] for i in own])) for n, own in by_length(picked).items()}
    rest = [r["n"] for r in vectors.select(F.size("v").alias("n")).distinct().collect() if r["n"] not in centres]
    for n in rest:  # lengths too rare for the sample
        own = vectors.filter(F.size("v") == n).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        centres[n] = fitted(np.array([r["v"] for r in own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for window in windows(batches, WINDOW):
            for ids, v in matrices(window):
                mean, coarse, fine = centres[v.shape[1]]
                moved = v - mean
                own = nearest_centre(moved, coarse)
                codes = assign(moved - coarse[own], _units(_parts(moved)), fine, ETA)
                made = decoded(codes, fine, v.shape[1])
                base, off = (made * (made + 2 * coarse[own])).sum(1), np.sqrt(((moved - coarse[own] - made) ** 2).sum(1))
                if codes.shape[1] % 2:
                    codes = np.hstack((codes, np.zeros((len(codes), 1), np.uint8)))
                packed = np.hstack((own.astype(np.uint8)[:, None], codes[:, ::2] | codes[:, 1::2] << 4))
                columns = [pa.array(ids), pa.array(np.full(len(ids), v.shape[1], np.int32)), pa.array(base), pa.array(off)]
                yield pa.record_batch([*columns, pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(list(v), pa.list_(pa.float64()))], names=["id", "size", "base", "off", "codes", "v"])

    return stored(vectors.mapInArrow(run, "id long, size int, base double, off double, codes binary, v array<double>"), "ann"), centres


def tables(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """queries x bytes x 256: what a byte of two codes adds to the inner product."""
    one = np.einsum("qsd,scd->qsc", _parts(queries), centres)
    if one.shape[1] % 2:
        one = np.concatenate((one, np.zeros((len(one), 1, CENTRES))), 1)
    return (one[:, ::2, None, :] + one[:, 1::2, :, None]).reshape(len(one), -1, CENTRES * CENTRES)


def kth(values: np.ndarray, k: int) -> float:
    """The k-th smallest value; infinite where there are fewer, or where it is no number."""
    value = np.partition(values, k - 1)[k - 1] if len(values) >= k else np.inf
    return np.inf if np.isnan(value) else float(value)


class _List:
    """A query's k nearest so far, by distance and then id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    def last(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else np.inf

    def add(self, query: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, np.sqrt(((v - query) ** 2).sum(1)))), np.concatenate((self.ids, ids))
        top = np.lexsort((ids, scores))[: self.k]
        self.scores, self.ids = scores[top], ids[top]


def measured(held: _List, query: np.ndarray, moved_query: np.ndarray, ids: np.ndarray, v: np.ndarray, moved: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, slack: np.ndarray) -> None:
    """Brings a query's list up to date with every row whose lower bound doesn't exceed the k-th best; ``low`` is infinite for rows that are no candidates."""
    limit = min(held.last(), kth(high, held.k))
    near = np.flatnonzero(~(low > limit) & ~np.isposinf(low))
    if len(near) * 8 > len(low):  # codes too coarse for these rows: narrower bounds by inner products first
        flat = np.sqrt(np.maximum(norms + moved_query @ moved_query - 2 * (moved @ moved_query), 0))
        error = 1e-6 * np.sqrt(norms + moved_query @ moved_query) + slack
        limit = min(limit, kth(np.where(low < np.inf, flat + error, np.inf), held.k))
        near = near[~(flat[near] - error[near] > limit)]
    if len(near) > 4 * held.k:
        first = near[np.argpartition(high[near], held.k)[: held.k]]
        held.add(query, ids[first], v[first])
        near = np.setdiff1d(near[~(low[near] > held.last())], first)
    if len(near):
        held.add(query, ids[near], v[near])


def nearest(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row where ``is_query`` holds, by Euclidean distance."""
    index, centres = build(rows, id_col, vector_col)

    def scan(numbers: np.ndarray, query_ids: np.ndarray, queries: list[np.ndarray]):
        lengths = {n: (own, np.array([queries[i] for i in own])) for n, own in by_length(queries).items()}
        shared = rows.sparkSession.sparkContext.broadcast((numbers, query_ids, lengths, centres))

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, query_ids, lengths, centres = shared.value
            best = {n: [_List(k) for _ in own] for n, (own, _) in lengths.items()}
            for window in windows(batches, WINDOW):
                all_ids, sizes, bases, offs = (window.column(c).to_numpy() for c in range(4))
                lists = window.column(5)
                for n, (own, q) in lengths.items():
                    at = np.flatnonzero(sizes == n)
                    if not len(at):
                        continue
                    v = lists.values.to_numpy()[lists.offsets.to_numpy()[at][:, None] + np.arange(n)]
                    ids, base, off = all_ids[at], bases[at], offs[at]
                    codes = np.frombuffer(b"".join(window.column(4).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1).astype(np.int64)
                    flat = codes[:, 1:] + np.arange(codes.shape[1] - 1) * CENTRES * CENTRES
                    mean, coarse, fine = centres[n]
                    moved = v - mean
                    norms = (moved**2).sum(1)
                    for a in range(0, len(q), 64):
                        some = q[a : a + 64] - mean
                        far = ((some[:, None] - coarse[None]) ** 2).sum(2)
                        for j, table in enumerate(tables(some, fine)):
                            squared = far[j][codes[:, 0]] + base - 2 * table.reshape(-1)[flat].sum(1)
                            # rounding: of the squares by their terms, of the shift by the mean's size
                            slack = 1e-14 * (np.sqrt(norms) + np.sqrt(some[j] @ some[j]) + np.sqrt(mean @ mean)) + 1e-9 * off
                            error = 1e-12 * (norms + some[j] @ some[j] + far[j][codes[:, 0]] + np.abs(base))
                            low = np.sqrt(np.maximum(squared - error, 0)) - off - slack
                            high = np.sqrt(np.maximum(squared + error, 0)) + off + slack
                            same = ids == query_ids[own[a + j]]
                            low[same] = high[same] = np.inf
                            measured(best[n][a + j], q[a + j], some[j], ids, v, moved, norms, low, high, slack)
            for n, (own, _) in lengths.items():
                for j, held in enumerate(best[n]):
                    size = len(held.ids)
                    yield pa.record_batch([pa.array(np.full(size, numbers[own[j]])), pa.array(np.full(size, query_ids[own[j]])), pa.array(held.ids), pa.array(held.scores)], names=["no", "query_id", "vec_id", "score"])

        return index.select("id", "size", "base", "off", "codes", "v").mapInArrow(found, "no long, query_id long, vec_id long, score double"), shared

    return searched(index.filter(is_query(F.col("id"))).select("id", "v"), k, F.col("score").asc(), "query_id long, rank int, vec_id long, score double", scan)
