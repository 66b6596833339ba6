"""Exact top-k inner products with block-at-a-time pruning (operator 1).

Components become integers, floor(scale * x); they play the part of term impacts. A window of candidates is cut to document-range blocks of ``BLOCK`` vectors; of each block the
forward index (its integer vectors) and every term's largest and smallest impact are kept. For a query the sum of
the best each term can add bounds a block's scores; the query's blocks are read in the order of these bounds, and
reading ends when the next bound is below the query's k-th score so far. Queries that want one block at the same stage
share its reading; stages double, so a window's blocks are read in few products.

Defined results: see ``vectors.valid``; rows with the query's own id are no candidates; a repeated row counts as often
as it is there, and a repeated query row has a list of its own each time; only vectors of the query's length are compared; a score beyond 63 bits raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import by_length, emit, matrices, searched, top_rows, valid, windows

BLOCK, WINDOW = 64, 16_384
_NONE = -(1 << 62)


def search_window(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, best: np.ndarray, best_ids: np.ndarray) -> int:
    """Bring the best lists (queries x k, scores descending) up to date with a window; returns the number of (query, block) pairs read."""
    k = best.shape[1]
    order = np.lexsort((np.abs(vectors).max(1), vectors.argmax(1)))  # neighbours alike, so bounds are tighter
    ids, vectors = ids[order], vectors[order]
    cuts = np.arange(0, len(ids), BLOCK)
    top, low = np.maximum.reduceat(vectors, cuts, axis=0), np.minimum.reduceat(vectors, cuts, axis=0)
    bounds = np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ low.T
    turns = np.argsort(-bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, turns, 1)
    begin, read, active = 0, 0, np.arange(len(queries))
    while begin < len(cuts) and len(active):
        end = min(len(cuts), max(1, 2 * begin))
        wanted = bounds[active, begin:end] >= best[active, -1:]
        who, stage = np.nonzero(wanted)
        if not len(who):
            break
        read += len(who)
        who, block = active[who], turns[active[who], begin + stage]
        by_block = np.argsort(block, kind="stable")
        for own in np.split(by_block, np.flatnonzero(np.diff(block[by_block])) + 1):
            q, b = who[own], block[own[0]]
            own_ids = ids[cuts[b] : cuts[b] + BLOCK]
            scores = (queries[q] @ vectors[cuts[b] : cuts[b] + BLOCK].T).astype(np.int64)
            scores[own_ids[None] == query_ids[q][:, None]] = _NONE
            keep = np.flatnonzero(scores.max(1) >= best[q, -1])
            if len(keep):
                q = q[keep]
                all_ids = np.hstack((best_ids[q], np.broadcast_to(own_ids, (len(q), len(own_ids)))))
                best[q], best_ids[q] = top_rows(np.hstack((best[q], scores[keep])), all_ids, k)
        active = active[bounds[active, end - 1] >= best[active, -1]]
        begin = end
    return read


def exact_top_k(rows: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` (column function of the id) holds, the k best others."""
    candidates = valid(rows, id_col, vector_col)

    def scan(numbers: np.ndarray, query_ids: np.ndarray, queries: list[np.ndarray]):
        whole = [np.floor(scale * q) for q in queries]
        shared = rows.sparkSession.sparkContext.broadcast((numbers, query_ids, {n: (own, np.array([whole[i] for i in own])) for n, own in by_length(whole).items()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, query_ids, lengths = shared.value
            best = {n: (np.full((len(own), k), _NONE), np.full((len(own), k), np.iinfo(np.int64).max)) for n, (own, _) in lengths.items()}
            for window in windows(batches, WINDOW):
                for ids, vectors in matrices(window):
                    n = vectors.shape[1]
                    if n in lengths:
                        own, q = lengths[n]
                        vectors = np.floor(scale * vectors)
                        most = n * np.abs(vectors).max() * np.abs(q).max()
                        if most >= 2**62:
                            raise OverflowError("a score may pass 63 bits")
                        kind = np.float64 if most < 2**53 else np.int64  # exact in either
                        search_window(q.astype(kind), query_ids[own], ids, vectors.astype(kind), *best[n])
            for n, (own, _) in lengths.items():
                scores, ids = best[n]
                yield emit(numbers[own], query_ids[own], ids, scores, scores > _NONE)

        return candidates.mapInArrow(run, "no long, query_id long, vec_id long, score long"), shared

    return searched(candidates.filter(is_query(F.col("id"))), k, F.col("score").desc(), "query_id long, rank int, vec_id long, score long", scan)
