"""Product codes of vectors by grouped-bound Lloyd rounds (operator 12).

Components become integers, vectors are cut into equal parts, and every part position has a codebook. The entries of a
codebook are clustered into groups once. Each part of each vector keeps its entry and, for every group, one lower bound of
its distance to the group's entries other than its own. When entries move, a group's bound falls by the group's largest
move; only groups whose bound then no longer exceeds the exact distance to the own entry are scanned. Bounds are whole
numbers of 1/16 units, rounded down, moves are rounded up, and the comparison is between integers, so a skipped group can
hold neither a nearer entry nor an equally near one: ties are settled by scanning, to the lower index.

The rows with their codes and bounds go from round to round as Parquet in the shared folder. What is
gathered from them is a sum and a count for each entry, summed in the tasks first; the codebooks' size is set by the
parameters and the vectors' length.

Defined results: rows whose vector is null or empty, or holds null or non-finite components are left out, as are vectors
of another length than the first's (smallest id, among lengths that the parts divide). A null id is kept and comes last
among the starting entries; repeated rows count as often as they are there; with fewer rows than entries the codebooks
are as long as there are rows. No rows give an empty result. Integers beyond 31 bits, or distances beyond 62, raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import measured, stored, tidy

#: Lower bounds are kept in units of 1 / FINE.
FINE = 16
#: Rows of one vectorised step.
ROWS = 8192
#: A label of more than one in HOT rows gets its total by a broadcast of at most HOT rows.
HOT = 64


@dataclass
class Books:
    """entries: parts x entries x width; group: parts x entries; moved: parts x groups, the bounds' fall since the last round (None: no bounds yet)."""

    entries: np.ndarray
    group: np.ndarray
    moved: np.ndarray | None


def grouped(entries: np.ndarray, size: int = 8, rounds: int = 5) -> np.ndarray:
    """The group of every entry: a few rounds of means over the entries of each part. Any grouping gives the same codes."""
    parts, k, _ = entries.shape
    out = np.zeros((parts, k), np.int64)
    for p in range(parts):
        own = entries[p].astype(float)
        centres = own[:: max(1, size)].copy()
        for _ in range(rounds):
            out[p] = ((own[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            for g in np.unique(out[p]):
                centres[g] = own[out[p] == g].mean(0)
    return out


def replaced(books: Books, sums: np.ndarray, counts: np.ndarray) -> Books:
    """The codebooks of componentwise floored means, unused entries as they were, and how far each group's entries moved at most."""
    used = counts > 0
    new = np.where(used[..., None], np.floor_divide(sums, np.maximum(counts, 1)[..., None]), books.entries)
    far = np.sqrt(((new - books.entries).astype(float) ** 2).sum(2))
    moved = np.zeros((len(new), books.group.max() + 1), np.int64)
    for p in range(len(new)):
        np.maximum.at(moved[p], books.group[p], np.ceil(far[p] * FINE + 1e-6).astype(np.int64))
    return Books(new, books.group, moved)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x[:, None] - entries[None]) ** 2).sum(2)


def _floor_root(squares: np.ndarray) -> np.ndarray:
    """Whole lower bounds of FINE * sqrt(squares)."""
    return np.maximum(np.floor(np.sqrt(squares.astype(float)) * FINE * (1 - 1e-12)), 0).astype(np.int64)


def assigned(x: np.ndarray, books: Books, code: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes (rows x parts), bounds (rows x parts x groups), squared distances (rows x parts) of integer vectors, and the number of
    (row, part, group) scans. With codes and bounds of the round before only groups whose bound fails are scanned."""
    parts, k, width = books.entries.shape
    n, groups = len(x), books.group.max() + 1
    new, low, best, scans = np.zeros((n, parts), np.int64), np.zeros((n, parts, groups), np.int64), np.zeros((n, parts), np.int64), 0
    far = np.iinfo(np.int64).max
    for p in range(parts):
        own, entries, group = x[:, p * width : (p + 1) * width], books.entries[p], books.group[p]
        if code is None:
            held, distance, lower, scan = np.full(n, -1), np.full(n, far), np.zeros((n, groups), np.int64), np.ones((n, groups), bool)
        else:
            held = code[:, p]
            distance = ((own - entries[held]) ** 2).sum(1)
            lower = np.maximum(bounds[:, p] - books.moved[p], 0)
            scan = lower <= np.ceil(np.sqrt(distance.astype(float)) * FINE * (1 + 1e-12)).astype(np.int64)[:, None]
        held = held.copy()
        for g in range(groups):
            members = np.flatnonzero(group == g)
            rows = np.flatnonzero(scan[:, g])
            scans += len(rows)
            if not len(members):
                lower[:, g] = 1 << 30
                continue
            if not len(rows):
                continue
            squares = _squares(own[rows], entries[members])
            # the two nearest of the group: the second is the bound if the first becomes the row's own
            at = squares.argmin(1)
            near = squares[np.arange(len(rows)), at]
            entry = members[at]
            squares[np.arange(len(rows)), at] = far
            second = squares.min(1)
            was = held[rows]
            better = (near < distance[rows]) | (near == distance[rows]) & ((entry < was) | (was < 0))
            same = entry == was
            took = better & ~same
            # an entry that loses its row bounds its own group from now on
            lost = np.flatnonzero(took & (was >= 0))
            lost_rows = rows[lost]
            lost_group, lost_low = group[was[lost]], _floor_root(distance[lost_rows])
            lower[rows, g] = np.minimum(_floor_root(np.where(took | same, second, near)), 1 << 30)
            lower[lost_rows, lost_group] = np.minimum(lower[lost_rows, lost_group], lost_low)
            held[rows[took]], distance[rows[took]] = entry[took], near[took]
        new[:, p], low[:, p], best[:, p] = held, lower, distance
    return new, low, best, scans


def _ints(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), values.reshape(-1).astype(np.int32))


def _round(state: DataFrame, books: Books, name: str) -> tuple[DataFrame, int]:
    """State rows (id, label, x, code, low, error) assigned to the books, stored, and the number of group scans."""
    shared = state.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, parts = shared.value, len(shared.value.entries)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                x = _ints(batch)
                if len(x) and x.shape[1] * (2 * int(np.abs(x).max()) + 2) ** 2 >= 2**62:
                    raise OverflowError("a squared distance may pass 62 bits")
                if books.moved is None:
                    code = bounds = None
                else:
                    code = batch.column("code").flatten().to_numpy(zero_copy_only=False).reshape(len(x), parts).astype(np.int64)
                    bounds = batch.column("low").flatten().to_numpy(zero_copy_only=False).reshape(len(x), parts, -1).astype(np.int64)
                code, low, squares, scans = assigned(x, books, code, bounds)
                counts = np.zeros(len(x), np.int64)
                counts[0] = scans
                yield pa.record_batch([batch.column("id"), batch.column("label"), batch.column("x"), _lists(code), _lists(low.reshape(len(x), -1)), pa.array(squares.sum(1)), pa.array(counts)], names=["id", "label", "x", "code", "low", "error", "scans"])

    made = state.mapInArrow(tidy(run), f"id long, label {dict(state.dtypes)['label']}, x array<int>, code array<int>, low array<int>, error long, scans long")
    kept, seen = measured(made, name, scans=F.sum("scans"))
    shared.unpersist()
    return kept.drop("scans"), int(seen["scans"] or 0)


def _moments(state: DataFrame, parts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of every entry's parts: one row an entry from each task, added up by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = counts = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = _ints(batch), batch.column("code").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, parts)
            width = x.shape[1] // parts
            if sums is None:
                sums, counts = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
            for p in range(parts):
                np.add.at(sums, p * k + code[:, p], x[:, p * width : (p + 1) * width])
                counts += np.bincount(p * k + code[:, p], minlength=parts * k)
        if sums is not None:
            used = np.flatnonzero(counts)
            at = np.repeat(used, width)
            yield pa.record_batch([pa.array(at), pa.array(np.tile(np.arange(width), len(used))), pa.array(sums[used].reshape(-1)), pa.array(counts[at])], names=["entry", "place", "total", "n"])

    own = state.select("x", "code").mapInArrow(run, "entry long, place long, total long, n long")
    rows = own.groupBy("entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    width = rows["place"].to_numpy().max() + 1
    sums, counts = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
    sums[rows["entry"].to_numpy(), rows["place"].to_numpy()] = rows["total"].to_numpy()
    counts[rows["entry"].to_numpy()] = rows["n"].to_numpy()
    return sums.reshape(parts, k, width), counts.reshape(parts, k)


def _with_label_error(rows: DataFrame) -> DataFrame:
    """Rows with their label's summed error. Labels that hold more than one in ``HOT`` rows, at most ``HOT`` of them, are joined by broadcast;
    the others by sorting."""
    totals = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-totals")
    whole = totals.agg(F.sum("n").alias("all"))
    hot = totals.crossJoin(F.broadcast(whole)).filter(F.col("n") * HOT > F.col("all")).select(F.col("label").alias("_label"), F.col("label_error").alias("_hot"))
    marked = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    rest = marked.filter("_hot is null").drop("_hot")
    others = totals.select(F.col("label").alias("_label"), "label_error")
    return marked.filter("_hot is not null").withColumnRenamed("_hot", "label_error").unionByName(rest.join(others, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"))


def product_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, parts: int = 16, k: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray | None, list[int]]:
    """id, label, code (array of entry numbers), error of every kept row; the codebooks (parts x entries x width); group scans of each assignment."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = kept.filter(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & finite)
    first = kept.select("id", F.size("v").alias("length")).orderBy(F.col("id").asc_nulls_last(), "length").limit(1).collect()
    if not first:
        none = kept.select("id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
        return none.filter("false"), None, []
    length = first[0]["length"]
    beyond = F.raise_error(F.lit("a component's integer is beyond 31 bits")).cast("double")
    whole = F.transform(v, lambda x: F.when(F.abs(x) * scale < 2**31 - 1, F.floor(x * scale)).otherwise(beyond).cast("int"))
    kept = kept.filter(F.size(v) == length).select("id", "label", whole.alias("x"))
    seeds = kept.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(k).collect()
    entries = np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    books, k = Books(entries, grouped(entries), None), len(seeds)
    state, scans = _round(kept, books, "codes")
    counted = [scans]
    for _ in range(rounds):
        books = replaced(books, *_moments(state, parts, k))
        state, scans = _round(state, books, "codes")
        counted.append(scans)
    return state.select("id", "label", "code", "error"), books.entries, counted


def coded_vectors(rows: DataFrame, **options) -> DataFrame:
    """vec_id, code (two hex digits an entry), error, label_error, codebooks_sha256 of every kept row."""
    coded, entries, _ = product_codes(rows, **options)
    digest = hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest() if entries is not None else None
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    made = _with_label_error(coded) if entries is not None else coded.withColumn("label_error", F.lit(None).cast("long"))
    return made.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
