"""Cross-entropy difference between matched token n-gram models (operator 5).

A target and a background model of the same form share one vocabulary (that of the tokenizer file) and count token
pairs exactly: P(w | h) = A * min(1, pairs(h, w) / followed(h)) + (1 - A) * (tokens(w) + 1) / (all + V),
and only the second term, whole, where h was never followed. A text's score is the mean over its tokens of the target loss less the background
loss, in nats: the lower, the more the text is like the target.

Every text is coded once, in chunks of about ``CHUNK`` tokens. The pair table is as large as the corpus makes it, so it stays
distributed: each chunk sends its distinct pairs with their counts, both models' totals of a pair are summed where it arrives, and
go back to the chunks that hold it, which are then scored one by one. A pair occurs once per chunk, so a very common one is
no more than a row from each. Only the counts by token, whose number the vocabulary sets, are gathered on the driver.

Defined results: null and empty texts have no tokens and score 0; rows come back as they are, null and repeated ids
included; an empty target gives every token the uniform unigram share; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, stored
from .tokens import encoder, vocabulary

A = 0.7
#: Tokens and texts of one chunk: what a scoring task holds at once, unless one text is longer.
CHUNK = 1 << 20
#: Id that stands before a text's first token.
_START = (1 << 31) - 1


def release_encoder() -> None:
    """Give back what the worker's encoder and its memo hold; stages after the coding don't need them."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        give_back()


def pair_keys(ids: np.ndarray) -> np.ndarray:
    """Each token with the one before it, as one number."""
    return np.concatenate(([_START], ids[:-1])).astype(np.int64) << 32 | ids.astype(np.int64)


def coded(rows: DataFrame, vocab: str) -> DataFrame:
    """chunk, doc_id, ids (packed as the vocabulary's size asks) of all rows (id, text), stored; a chunk's rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary(vocab))
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            first, made = 0, []
            for k, text in enumerate(batch.column(1)):
                ids = coder.ids(text.as_py() or "")
                if held and held + len(ids) + 1 > CHUNK:
                    yield packed(chunk, batch, first, made)
                    chunk, held, first, made = chunk + 1, 0, k, []
                held += len(ids) + 1
                made.append(ids.astype(coder.kind).tobytes())
            yield packed(chunk, batch, first, made)

    def packed(chunk: int, batch: pa.RecordBatch, first: int, made: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(made), chunk)), batch.column(0).slice(first, len(made)), pa.array(made, pa.binary())], names=["chunk", "doc_id", "ids"])

    return stored(rows.mapInArrow(run, "chunk long, doc_id long, ids binary"), "coded")


def chunk_pairs(texts: DataFrame, kind: np.dtype) -> DataFrame:
    """chunk, pair, n: the distinct pairs of each chunk (or of about ``CHUNK`` tokens of it) and how often they occur there."""

    def summed(chunk: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
        for a in range(0, len(pairs), 100_000):
            own = pairs[a : a + 100_000]
            yield pa.record_batch([pa.array(np.full(len(own), chunk)), pa.array(own), pa.array(n[a : a + 100_000])], names=["chunk", "pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        chunk, held, size = -1, [], 0
        for batch in batches:
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != chunk or size >= CHUNK:
                    yield from summed(chunk, held)
                    chunk, held, size = own, [], 0
                if len(ids := np.frombuffer(ids.as_py(), kind)):
                    held.append(pair_keys(ids))
                    size += len(ids)
        yield from summed(chunk, held)

    return texts.select("chunk", "ids").mapInArrow(run, "chunk long, pair long, n long")


def token_counts(texts: DataFrame, kind: np.dtype, size: int) -> pa.Table:
    """key, n: tokens by 2 * id and followed tokens by 2 * id + 1; -1: texts that have tokens. At most 2 * V + 1 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        n = np.zeros(2 * size + 1, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                if len(ids := np.frombuffer(ids.as_py(), kind)):
                    np.add.at(n, 2 * ids.astype(np.int64), 1)
                    np.add.at(n, 2 * ids[:-1].astype(np.int64) + 1, 1)
                    n[-1] += 1
        there = np.flatnonzero(n)
        yield pa.record_batch([pa.array(np.where(there == 2 * size, -1, there)), pa.array(n[there])], names=["key", "n"])

    return texts.select("ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()


class Counts:
    """One model's counts by token, filled from (key, n) rows."""

    def __init__(self, rows: pa.Table, size: int):
        key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
        self.tokens, self.followed = np.zeros(size), np.zeros(size + 1)
        token, chained = (key >= 0) & (key % 2 == 0), (key >= 0) & (key % 2 == 1)
        self.tokens[key[token] // 2] = n[token]
        self.followed[key[chained] // 2] = n[chained]
        self.followed[-1] = n[key == -1].sum()
        self.share = (self.tokens + 1) / (self.tokens.sum() + size)

    def losses(self, ids: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Of each token, where ``pairs`` counts it with the one before it."""
        seen = np.concatenate((self.followed[-1:], self.followed[ids[:-1]]))
        own = self.share[ids]
        with np.errstate(divide="ignore", invalid="ignore"):
            paired = A * np.minimum(1, pairs / seen) + (1 - A) * own
        return -np.log(np.where(seen > 0, paired, own))


def _scored(far: DataFrame, near: DataFrame, vocab: str) -> DataFrame:
    """The difference of coded rows ``far`` against the target of coded rows ``near``, whose chunks say nothing."""
    coder = encoder(vocabulary(vocab))
    kind, size = coder.kind, coder.library.get_vocab_size()
    shared = far.sparkSession.sparkContext.broadcast([Counts(token_counts(rows, kind, size), size) for rows in (near, far)])
    by_target = chunk_pairs(near.withColumn("chunk", F.lit(0).cast("long")), kind).groupBy("pair").agg(F.sum("n").alias("n"))
    both = chunk_pairs(far, kind).union(by_target.select(F.lit(None).cast("long").alias("chunk"), "pair", "n"))
    same, total = Window.partitionBy("pair"), lambda of: F.sum(F.when(of, F.col("n")).otherwise(0))
    totals = both.select("chunk", "pair", total(F.col("chunk").isNull()).over(same).alias("near"), total(F.col("chunk").isNotNull()).over(same).alias("far")).filter("chunk is not null")

    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        release_encoder()
        models = shared.value
        pairs = counts["pair"].to_numpy()
        order = np.argsort(pairs)
        pairs, own = pairs[order], [counts[k].to_numpy()[order] for k in ("near", "far")]
        n, losses = np.zeros(rows.num_rows, np.int64), np.zeros((2, rows.num_rows))
        for k, ids in enumerate(rows["ids"]):
            ids = np.frombuffer(ids.as_py(), kind)
            if len(ids):
                n[k], at = len(ids), np.searchsorted(pairs, pair_keys(ids))
                losses[:, k] = [model.losses(ids, x[at]).mean() for model, x in zip(models, own)]
        return pa.table({"doc_id": rows["doc_id"], "n_tokens": n, "target_loss": losses[0], "background_loss": losses[1], "score": losses[0] - losses[1]})

    return far.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, vocab: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row; ``target``'s texts make the target model, all rows the background."""
    far, near = (coded(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), vocab) for rows in (docs, target))
    return _scored(far, near, vocab)


def quality_scores(docs: DataFrame, labels: DataFrame, vocab: str = "byte_bpe_50k.json") -> DataFrame:
    """The difference against a target of all documents labelled as of high quality; the label ids are joined by sorting at any size."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    far = coded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), vocab)
    return _scored(far, stored(far.join(good.hint("merge"), "doc_id", "left_semi").select("chunk", "doc_id", "ids"), "target"), vocab)
