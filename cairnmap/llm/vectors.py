"""What the two vector searches share: valid rows, chunks of queries, and top lists.

The query set grows with the table, so queries go out in chunks of at most ``QUERY_CHUNK`` rows, a broadcast of bounded
size, with one pass over the candidates each; every task returns its own best list for each query row, and the lists are
merged by query row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

QUERY_CHUNK = 1 << 16


def valid(rows: DataFrame, id_col: str, vector_col: str, zero: bool = True) -> DataFrame:
    """id, v (array of double) of the rows that take part: an id, and a vector of finite components (not all zero, unless ``zero``)."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    out = out.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    return out if zero else out.filter(F.exists(v, lambda x: x != 0))


def searched(queries: DataFrame, k: int, best_first: Column, schema: str, scan: Callable) -> DataFrame:
    """query_id, rank, vec_id, score: the first k of each query row over what ``scan`` finds.

    ``scan(numbers, ids, vectors)`` takes at most about ``QUERY_CHUNK`` query rows and returns a frame (no, query_id, vec_id, score) and its
    broadcast. Query rows are numbered, so rows that share an id have a list each. With several chunks each one's lists are stored and its
    broadcast released before the next chunk is fetched: the driver holds one chunk.
    """
    session, n = queries.sparkSession, max(1, -(-queries.count() // QUERY_CHUNK))
    parts, first = [], 0
    for c in range(n):
        own = queries if n == 1 else queries.filter(F.pmod(F.xxhash64("id", "v"), F.lit(n)) == c)
        rows = own.toArrow()
        if not rows.num_rows:
            continue
        offsets, flat = rows["v"].combine_chunks().offsets.to_numpy(), rows["v"].combine_chunks().values.to_numpy()
        vectors = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        found, shared = scan(np.arange(first, first + rows.num_rows), rows["id"].to_numpy().astype(np.int64), vectors)
        first += rows.num_rows
        rank = F.row_number().over(Window.partitionBy("no").orderBy(best_first, "vec_id"))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if n > 1:
            found = stored(found, "lists")
            shared.unpersist()
        parts.append(found)
    if not parts:
        return session.createDataFrame([], schema)
    return reduce(DataFrame.union, parts)


def by_length(vectors: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Places of the vectors of each length: only vectors of one length are compared."""
    sizes = np.array([len(v) for v in vectors])
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch (id, v), one matrix for each length, ascending by id."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    sizes = np.diff(offsets)
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        own = own[np.argsort(ids[own], kind="stable")]
        yield ids[own], flat[offsets[own][:, None] + np.arange(n)]


def windows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def emit(numbers: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
    own, queries = (np.broadcast_to(x[:, None], ids.shape)[there] for x in (numbers, query_ids))
    return pa.record_batch([pa.array(own), pa.array(queries), pa.array(ids[there]), pa.array(scores[there])], names=["no", "query_id", "vec_id", "score"])
