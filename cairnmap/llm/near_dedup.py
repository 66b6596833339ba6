"""MinHash near-duplicate detection with sequential Bayesian verification (operator 10).

Steps

1. One pass over the texts gives every row its shingle-set size, a 128-bit key of the set (the *node*) and a MinHash
   signature. Rows with equal sets share a node, so thousands of exact copies cost one node. A node's *vertex* sorts by its
   smallest id, so a component's smallest vertex names the component and no group of rows is gathered for it.
2. Signatures are banded; a bucket holds the nodes that agree on a band. Each bucket is first compared with one pivot
   only (its smallest node), never pairwise.
3. A candidate pair is read batch by batch: after n signature values of which m agree, the posterior of the
   similarity under a uniform prior is Beta(m + 1, n - m + 1); the pair is dropped as soon as the chance that the
   similarity reaches the threshold falls below ``miss``. Survivors are confirmed on their full sets.
4. Confirmed links give components. Where a bucket still spans several components, the nodes outside its largest
   component are compared with all its nodes: in small buckets by a join (at most ``SMALL`` nodes each), in large
   ones block against block of signatures inside tasks, and only pairs that pass step 3 leave the task.
   So every candidate pair is either tested or already inside one component; no cap drops any.

Defined results: a null or wordless text has an empty set, links with nothing and is its own component; rows with a
null id get their size, no component and ``kept`` null, and link nothing; rows that share an id each go by their own text, so one id
may have several components; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import measured, steps, stored, tidy, utf8
from .components import connected_components
from .shingles import minhash, shingle_sets

#: Largest bucket whose nodes are paired by a join; beyond it, blocks of this many signatures meet inside tasks.
SMALL, BLOCK = 48, 256
#: Signature values that one verification step reads.
BATCH = 25
#: Column that ``drop_near_duplicates`` adds for the time being.
ROW = "_dedup_row"


def banding(percent: int) -> tuple[int, int]:
    """Rows and bands for a threshold; a pair at the threshold shares no band with a chance below 1e-6."""
    rows = 5 if percent >= 85 else 4 if percent >= 80 else 3 if percent >= 65 else 2
    bands = 1
    while (1 - (percent / 100) ** rows) ** bands > 1e-6:
        bands += 1
    return rows, bands


@lru_cache(maxsize=8)
def least_matches(n_hashes: int, percent: int, miss: float) -> tuple[tuple[int, int], ...]:
    """For each batch end n: the fewest agreeing values with which P(similarity >= threshold | data) >= miss.

    For a Beta(m + 1, n - m + 1) posterior that probability is P(Binomial(n + 1, threshold) <= m).
    """
    t, out = percent / 100, []
    for n in [*range(BATCH, n_hashes, BATCH), n_hashes]:
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def bayes_keep(left: np.ndarray, right: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Which rows of two aligned signature matrices survive the sequential test."""
    alive, agreed, begin = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in least_matches(left.shape[1], percent, miss):
        agreed[alive] += (left[alive, begin:n] == right[alive, begin:n]).sum(1)
        alive = alive[agreed[alive] >= least]
        begin = n
    keep = np.zeros(len(left), bool)
    keep[alive] = True
    return keep


_SIGN = -(1 << 63)


def _eight(number) -> Column:
    """A long as 8 bytes that sort like the number."""
    return F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(_SIGN))), 16, "0"))


def _number(eight) -> Column:
    return F.conv(F.hex(eight), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))


def _signatures(docs: DataFrame, width: int, n_hashes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            for a, b in steps(at):
                sets, begin = shingle_sets(data, at[a : b + 1], width)
                sig = minhash(sets, begin, n_hashes)
                sizes = np.diff(begin)
                nodes = [_node(sets[x:y]) if y > x else None for x, y in zip(begin[:-1], begin[1:])]
                yield pa.record_batch(
                    [*(batch.column(k).slice(a, b - a) for k in (0, 1)), pa.array(sizes), pa.array(nodes, pa.binary()), pa.array([s.tobytes() if n else None for s, n in zip(sig, sizes)], pa.binary())],
                    names=["id", "row", "n_shingles", "node", "sig"],
                )

    return docs.mapInArrow(tidy(run), "id long, row long, n_shingles long, node binary, sig binary")


def _node(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _vertex(id, row, node) -> Column:
    """16 bytes that sort by id: the id, then the row's number where rows have one, else the set's hash."""
    return F.concat(_eight(id), F.coalesce(_eight(row), F.substring(node, 1, 8)))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """docs: id, row, text. The set of each row with its vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(k).to_pylist() for k in (0, 1))
            data, at = utf8(batch.column(2))
            for a, b in steps(at):
                sets, begin = shingle_sets(data, at[a : b + 1], width)
                own, vertices = [], []
                for k, (x, y) in enumerate(zip(begin[:-1], begin[1:]), a):
                    if y > x:
                        own.append(sets[x:y].tobytes())
                        tail = _node(sets[x:y])[:8] if rows[k] is None else (rows[k] + (1 << 63)).to_bytes(8, "big")
                        vertices.append((ids[k] + (1 << 63)).to_bytes(8, "big") + tail)
                yield pa.record_batch([pa.array(vertices, pa.binary()), pa.array(own, pa.binary())], names=["v", "set"])

    return docs.mapInArrow(tidy(run), "v binary, set binary")


def _bayes(pairs: DataFrame, n_hashes: int, percent: int, miss: float) -> DataFrame:
    """pairs: a, b, sig_a, sig_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, n_hashes) for k in (2, 3))
                keep = pa.array(bayes_keep(left, right, percent, miss))
                yield pa.record_batch([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def _sets_of(vertices: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The full sets of some vertices, made anew from their texts. ``vertices`` is stored, so a small one is known to be
    small when the join is planned, and the texts then aren't dealt anew."""
    ids = vertices.select(_number(F.substring("v", 1, 8)).alias("vid")).distinct()
    made = _sets(docs.join(ids, docs["id"] == ids["vid"], "left_semi").select("id", "row", "text"), width)
    return made.join(vertices, "v", "left_semi").dropDuplicates(["v"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold, in integers."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _exact(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of vertices whose full sets reach the threshold. ``pairs`` is stored."""
    vertices = stored(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "vertices")
    sets = stored(_sets_of(vertices, docs, width), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3))
            keep = pa.array([similar(*(np.frombuffer(s.as_buffer(), np.uint64) for s in pair), percent) for pair in pairs], pa.bool_())
            yield pa.record_batch([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    left, right = (sets.select(F.col("v").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def _large(members: DataFrame, n_hashes: int, rows: int, percent: int, miss: float) -> DataFrame:
    """members: key, band, v, lab, sig, set, size, main, odd (vertices outside the largest component). Block meets block."""
    block = lambda count: F.pmod(F.xxhash64("v"), F.ceil(F.col(count) / BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(count) / BLOCK) - 1))
    left = members.select("key", block("size").alias("i"), every("odd").alias("j"), "v", "lab", "sig", "set", "band")
    right = members.filter(F.col("lab") != F.col("main")).select("key", every("size").alias("i"), block("odd").alias("j"), "v", "lab", "sig", "set")
    left, right = left.toDF("key", "i", "j", "v", "lab", "sig", "set", "band"), right.toDF("key2", "i2", "j2", "v2", "lab2", "sig2", "set2")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a_v, b_v = left["v"].to_pylist(), right["v2"].to_pylist()
        a_lab, b_lab = (np.array(c.to_pylist(), object) for c in (left["lab"], right["lab2"]))
        a_sig, b_sig = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, n_hashes) for c in (left["sig"], right["sig2"]))
        a_set, b_set = ([np.frombuffer(x, np.uint64) for x in c.to_pylist()] for c in (left["set"], right["set2"]))
        band = left["band"][0].as_py() if left.num_rows else 0
        out_a, out_b = [], []
        for k in range(len(b_v)):
            near = np.flatnonzero(a_lab != b_lab[k])
            near = near[bayes_keep(a_sig[near], np.broadcast_to(b_sig[k], (len(near), n_hashes)), percent, miss)]
            same = a_sig[near] == b_sig[k]
            first = same.reshape(len(near), n_hashes // rows, rows).all(2).argmax(1)
            near, agreed = near[first == band], same[first == band].sum(1)
            done = set()
            for i in near[np.argsort(-agreed, kind="stable")]:
                if a_lab[i] not in done and similar(a_set[i], b_set[k], percent):
                    done.add(a_lab[i])
                    out_a.append(min(a_v[i], b_v[k]))
                    out_b.append(max(a_v[i], b_v[k]))
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return left.groupBy("key", "i", "j").cogroup(right.groupBy("key2", "i2", "j2")).applyInArrow(run, "a binary, b binary").distinct()


def _labelled(docs: DataFrame, width: int, percent: int, miss: float) -> DataFrame:
    """docs: id, row (a unique number, or null), text. id, row, n_shingles, own, label of every row: its vertex and the smallest
    vertex of its component, null without an id or a set."""
    rows, bands = banding(percent)
    n_hashes = rows * bands
    sigs, seen = measured(_signatures(docs, width, n_hashes), "signatures", n=F.count(F.lit(1)))
    # salts of a node's rows: copies of one text, however many, are spread over about the square root of all rows
    sigs = sigs.withColumn("salt", F.pmod(F.xxhash64("id", "row"), F.lit(max(1, round(seen["n"] ** 0.5)))))
    known = sigs.filter("node is not null and id is not null")
    own = _vertex(F.col("id"), F.col("row"), F.col("node"))
    reps = stored(known.groupBy("node").agg(F.min(own).alias("v"), F.any_value("sig").alias("sig"), F.collect_set("salt").alias("salts"), F.count(F.lit(1)).alias("copies")), "nodes")

    keys = F.array(*[F.xxhash64(F.lit(b), F.col("sig").substr(4 * rows * b + 1, 4 * rows)) for b in range(bands)])
    banded = reps.select("v", F.posexplode(keys).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("v").alias("pivot")).filter("size > 1")
    buckets = stored(banded.join(shared, "key"), "buckets")

    sig = {k: reps.select(F.col("v").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab"}
    tested = lambda pairs: _bayes(pairs.join(sig["a"], "a").join(sig["b"], "b").select("a", "b", "sig_a", "sig_b"), n_hashes, percent, miss)
    stars = buckets.filter("v != pivot").select(F.col("pivot").alias("a"), F.col("v").alias("b")).distinct()
    labels = connected_components(_exact(stored(tested(stars), "tested"), docs, width, percent))

    labelled = buckets.filter("size > 2").join(labels.withColumnRenamed("node", "v"), "v", "left").select("key", "band", "v", "size", F.coalesce("label", "v").alias("lab"))
    spans = labelled.groupBy("key", "lab").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("n", "lab")).alias("top"))
    spans = spans.filter("comps > 1").select("key", F.col("top.lab").alias("main"), F.col("top.n").alias("inside"))
    members, seen = measured(labelled.join(spans, "key").withColumn("odd", F.col("size") - F.col("inside")).drop("inside"), "members", large=F.count_if(F.col("size") > SMALL))
    small, large = members.filter(F.col("size") <= SMALL), members.filter(F.col("size") > SMALL)
    odd = small.filter("lab != main").select("key", F.col("v").alias("v2"), F.col("lab").alias("l2"))
    joined = small.join(odd, "key").filter("lab != l2").select(F.least("v", "v2").alias("a"), F.greatest("v", "v2").alias("b")).distinct()
    later, met = measured(tested(joined.join(stars, ["a", "b"], "left_anti")), "tested", n=F.count(F.lit(1)))
    more = [_exact(later, docs, width, percent)] if met["n"] else []
    if seen["large"]:
        vertices = stored(large.select("v").distinct(), "vertices")
        whole = large.join(reps.select("v", "sig"), "v").join(_sets_of(vertices, docs, width), "v")
        more.append(_large(whole, n_hashes, rows, percent, miss))
    for found in more[1:]:
        more[0] = more[0].union(found)
    if more:
        labels = connected_components(labels.select(F.col("label").alias("a"), F.col("node").alias("b")).union(more[0]))

    # only nodes with copies or links have rows whose label isn't their own vertex
    changed = reps.select("node", "v", "salts", "copies").join(labels.withColumnRenamed("node", "v"), "v", "left").filter("copies > 1 or label is not null")
    changed = changed.select("node", F.explode("salts").alias("salt"), F.coalesce("label", "v").alias("label"))
    member = known.join(changed, ["node", "salt"], "left").select("id", "row", "n_shingles", own.alias("own"), F.coalesce("label", own).alias("label"))
    none = F.lit(None).cast("binary")
    return member.union(sigs.filter("node is null or id is null").select("id", "row", "n_shingles", none, none))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; see the module's text for the method and the defined results."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("long").alias("row"), F.col(text_col).alias("text"))
    component = F.coalesce(_number(F.substring("label", 1, 8)), F.col("id"))
    return _labelled(rows, width, percent, miss).select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """The documents without all but the first row of each group (the smallest id, then any one of its rows).

    Rows are told apart by a number of their own, so rows that share an id go or stay each by its text; rows without an id or
    without words stay.
    """
    keyed = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    rows = keyed.select(F.col("doc_id").cast("long").alias("id"), F.col(ROW).alias("row"), "text")
    gone = stored(_labelled(rows, width, percent, miss).filter("own != label").select(F.col("row").alias(ROW)), "gone")
    return keyed.join(gone, ROW, "left_anti").select(*docs.columns)
