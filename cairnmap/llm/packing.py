"""Bulk best-fit packing of token sequences (operator 8).

Documents are cut to pieces of at most ``capacity`` tokens (only the first piece of a longer document may be shorter)
and ranked within their length by salted row numbers, so that no length, how common it may be, meets in one task.
Pieces of one length are interchangeable, and so are sequences with equal gaps; a round of matching therefore works on
runs: all pieces of the longest length left look up the successor gap (the smallest that holds them), the i-th piece takes
the i-th sequence of that gap's run, the gaps are updated, and the sweep goes on until the length is used up; pieces without a
successor open new sequences. Lengths go from long to short, which makes the result that of best-fit decreasing.

This departs from sweeps of all documents against all gaps in distributed rounds: the rounds see a histogram of at most ``capacity``
lengths and the runs of open gaps, a state whose size depends on the capacity and not on the number of documents, and run in
one place; as Spark jobs over the same runs they took some 2.7 s each, more than 40 of them (README), for what the driver does at once. Distributed are the
histogram, the ranks and each piece's search for its move (ranks of one length -> sequences and offset).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy
from .tokens import encoder, vocabulary

#: Rows of one length that one salt numbers; more rows get more salts.
SALT_ROWS = 50_000


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = 2048, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, unless left out, ids (little-endian unsigned 32-bit) of every piece.

    A null text is an empty one: one piece with the end id alone. Null ids and repeated rows are rows of their own; no rows give none. A text
    is encoded whole, so its ids are in one task's memory at once. Other columns are not read.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary(vocab))
        for batch in batches:
            out = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(coder.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    own = ids[start : start + capacity if k else first].tobytes()
                    for column, x in zip(out, (doc, k, start, len(own) // 4, zlib.crc32(own), own)):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan_moves(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rounds over a histogram of lengths: (length, first rank, first sequence, pieces per sequence, offset), by length and rank.

    With one piece per sequence, rank r goes to sequence ``first + r - rank``; with k, to ``first + (r - rank) // k``.
    """
    moves, gaps, runs, opened = [], [], {}, 0

    def free(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in runs:
                runs[gap] = deque()
                insort(gaps, gap)
            own = runs[gap]
            if own and own[-1][0] + own[-1][1] == first:
                own[-1][1] += n
            else:
                own.append([first, n])

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                break
            gap = gaps[at]
            run = runs[gap][0]
            n = min(left, run[1])
            moves.append((length, rank, run[0], 1, capacity - gap))
            rank, left, first = rank + n, left - n, run[0]
            run[0], run[1] = run[0] + n, run[1] - n
            if not run[1]:
                runs[gap].popleft()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            free(gap - length, first, n)
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            moves.append((length, rank, opened, each, 0))
            free(capacity - each * length, opened, full)
            free(capacity - rest * length, opened + full, 1 if rest else 0)
            opened += full + (rest > 0)
    return moves


def best_fit(pieces: DataFrame, capacity: int = 2048, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with sequence_id and offset. Lengths are between 1 and the capacity; others (and nulls) raise an error.

    ``pieces`` is read three times: give a stored frame. Equal pieces are told apart by ``order`` and, where that ties,
    arbitrarily, which changes neither the number of sequences nor their fill. An empty frame gives an empty one.
    """
    own = [c for c in pieces.columns]
    checked = F.when(F.col(length_col).between(1, capacity), F.col(length_col).cast("long")).otherwise(F.raise_error(F.lit("a length is null or outside 1..capacity")).cast("long"))
    rows = pieces.select("*", checked.alias("_len"))
    total = pieces.count()
    salts = -(-total // SALT_ROWS)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(max(1, salts))))
    held = rows.groupBy("_len", "_salt").agg(F.count("*").alias("_n"))
    counts = {r["_len"]: r["n"] for r in held.groupBy("_len").agg(F.sum("_n").alias("n")).collect()}
    moves = plan_moves(counts, capacity)
    table = np.array(moves, np.int64).reshape(-1, 5)
    order_key = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order_key]
    lengths = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    before = held.select("_len", "_salt", (F.sum("_n").over(Window.partitionBy("_len").orderBy("_salt")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_len", "_salt").orderBy(*order)) - 1
    ranked = rows.withColumn("_row", within).join(before, ["_len", "_salt"]).select(*own, "_len", (F.col("_before") + F.col("_row")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (len(own), len(own) + 1))
            at = np.zeros(len(length), np.int64)
            for one in np.unique(length):  # the last move of the length that begins at the rank or before
                mine = np.flatnonzero(length == one)
                a, b = lengths[one], lengths[one + 1]
                at[mine] = a + np.searchsorted(table[a:b, 1], rank[mine], side="right") - 1
            move, step = table[at], rank - table[at, 1]
            sequence, offset = move[:, 2] + step // move[:, 3], move[:, 4] + step % move[:, 3] * length
            yield pa.record_batch([*batch.columns[: len(own)], pa.array(sequence), pa.array(offset)], names=[*own, "sequence_id", "offset"])

    return ranked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab: str = "byte_bpe_50k.json", capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and place. A null text counts as empty: the end id alone."""
    return best_fit(stored(token_pieces(docs, vocab=vocab, capacity=capacity, with_ids=with_ids), "pieces"), capacity)


def sequences(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """sequence_id, n_tokens, ids: the packed sequences themselves, from a frame with ids. A sequence has at most ``capacity`` pieces; an empty
    frame has none. Pieces without ids (null) add nothing."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"]))).alias("hexed")).select("sequence_id", "n_tokens", F.unhex("hexed").alias("ids"))
