"""Convolutional text classifier for toxicity, trained in numpy (operator 6).

A word's vector is the sum of hashed embeddings of the word and of its first 4 to 8 bytes, so inflected forms share
most of it. Filters of several widths slide over a text's word vectors; of each filter the two largest responses in
the whole text are kept (max pooling; the second tells a habit from an accident) and a linear layer scores them.

Training reads labels of at most ``MAX_TOXIC`` + ``MAX_CLEAN`` rows, chosen by a hash of the id among the rows that the
caller doesn't hold out: a bound on the learning sample only. Every text is scored, and whole. A fifth of the sample
isn't trained on; there the decision's offset is set, and a threshold for each language.

Defined results: null and empty texts are scored like any text, from the filters' biases; rows with a null id are
scored and count as not held out; several labels of one id count as toxic if one does; without labels of both
kinds every score is 0. Other columns are not read, and language only picks the threshold of ``flagged``.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, tidy, utf8
from .shingles import mix, words

MAX_TOXIC, MAX_CLEAN = 2000, 4000
BUCKETS, DIM, FILTERS, KEPT = 1 << 18, 16, 8, 2
WIDTHS = (1, 2, 3)
#: Zero vectors behind each row: every width has ``KEPT`` windows inside the row, however short.
PAD = KEPT + max(WIDTHS) - 1
DROPPED = 0.3
CLEAN_WEIGHT = 5
#: Batches that training reads at least, however small the sample.
LEAST_STEPS = 300
#: Toxic documents at which a threshold set aside from training weighs as much as the one it would replace.
SHRINK = 20
PREFIXES = (4, 5, 6, 7, 8)
_LETTERS = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows: the row of each word, its place among the distinct words, and the distinct words' buckets."""
    _, _, row, hashed, heads = words(data, offsets, _LETTERS, PREFIXES)
    _, first, place = np.unique(hashed, return_index=True, return_inverse=True)
    buckets = np.column_stack([hashed[first], *(mix(h[first] + np.uint64(k + 1)) for k, h in enumerate(heads))])
    return row, place, (buckets >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    offset: float

    def pooled(self, vectors: np.ndarray, begin: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest responses of each row and filter, and where they are. Only windows inside a row and its padding count."""
        n, tops, places = len(begin), [], []
        ends = np.append(begin[1:], len(vectors))
        for width, kernel, bias in zip(WIDTHS, self.filters, self.biases):
            made = vectors @ kernel[0]
            for k in range(1, width):
                made[:-k] += vectors[k:] @ kernel[k]
                made[ends - k] = -np.inf
            made += bias
            columns = np.arange(FILTERS)
            for _ in range(KEPT):
                top = np.maximum.reduceat(made, begin, axis=0)
                where = np.zeros((n, FILTERS), np.int64)
                t, f = np.nonzero(made == top[row])
                where[row[t], f] = t
                made[where, columns] = -np.inf
                tops.append(top)
                places.append(where)
        return np.stack(tops, 1), np.stack(places, 1)  # rows x (widths * KEPT) x FILTERS

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, place, buckets = features(data, offsets)
        vectors, begin, rows = padded(place, row, n, np.vstack((self.embedding[buckets].sum(1, dtype=np.float32), np.zeros((1, DIM), np.float32))))
        tops, _ = self.pooled(vectors, begin, rows)
        return np.maximum(tops, 0).reshape(n, -1) @ self.out + self.offset


def padded(place: np.ndarray, row: np.ndarray, n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word vectors of all rows with ``PAD`` zero vectors behind each row, where each row begins, and each vector's row."""
    counts = np.bincount(row, minlength=n) + PAD
    begin = np.cumsum(counts) - counts
    rows = np.repeat(np.arange(n), counts)
    at = np.full(len(rows), len(table) - 1)
    at[np.arange(len(place)) + PAD * row] = place
    return table[at], begin, rows


def train(texts: list[str], labels: np.ndarray, epochs: int = 10, seed: int = 3) -> Model:
    """Adagrad on the balanced logistic loss over whole texts, in batches of similar length.

    Each time a batch is read, ``DROPPED`` of its distinct words are left out, so that words which stand beside
    stronger ones are learnt too.
    """
    draw = np.random.default_rng(seed)
    small = lambda *shape: (draw.standard_normal(shape) * 0.1).astype(np.float32)
    model = Model(small(BUCKETS, DIM) * np.float32(0.1), [small(w, DIM, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], small(len(WIDTHS) * KEPT * FILTERS), 0.0)
    sums = [np.full(BUCKETS, 1e-3, np.float32), [np.full_like(k, 1e-3) for k in model.filters], [np.full_like(b, 1e-3) for b in model.biases], np.full_like(model.out, 1e-3), 1e-3]
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    size = 32
    order = np.argsort([len(t) for t in texts], kind="stable")
    batches = []
    for a in range(0, len(order), size):
        own = order[a : a + size]
        data, offsets = utf8(pa.array([texts[i] for i in own], pa.large_string()))
        batches.append((own, *features(data, offsets)))
    rounds = max(epochs, -(-LEAST_STEPS // max(1, len(batches))))
    for epoch in range(rounds):
        rate = 0.15 / (1 + 0.3 * epoch * epochs / rounds)
        for b in draw.permutation(len(batches)):
            own, row, place, buckets = batches[b]
            n = len(own)
            kept = draw.random(len(buckets)) >= DROPPED
            vectors, begin, rows = padded(place, row, n, np.vstack((model.embedding[buckets].sum(1) * kept[:, None], np.zeros((1, DIM), np.float32))))
            tops, where = model.pooled(vectors, begin, rows)
            active = np.maximum(tops, 0)
            flat = active.reshape(n, -1)
            logit = flat @ model.out + model.offset
            slope = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[own]) * weight[own] / n).astype(np.float32)
            g_out, g_offset = flat.T @ slope + 1e-4 * model.out, float(slope.sum())
            g_top = (slope[:, None] * model.out).reshape(active.shape) * (tops > 0)
            g_vectors = np.zeros_like(vectors)
            for w, width in enumerate(WIDTHS):
                g, at = (x[:, w * KEPT : (w + 1) * KEPT].reshape(-1, FILTERS) for x in (g_top, where))
                g_kernel = np.zeros_like(model.filters[w])
                for k in range(width):
                    to = np.minimum(at + k, len(vectors) - 1)
                    g_kernel[k] = np.einsum("pfd,pf->df", vectors[to], g)
                    np.add.at(g_vectors, to.reshape(-1), (g[:, :, None] * model.filters[w][k].T[None]).reshape(-1, DIM))
                sums[1][w] += g_kernel**2
                model.filters[w] -= rate * g_kernel / np.sqrt(sums[1][w])
                sums[2][w] += (g_bias := g.sum(0)) ** 2
                model.biases[w] -= rate * g_bias / np.sqrt(sums[2][w])
            sums[3] += g_out**2
            model.out -= rate * g_out / np.sqrt(sums[3])
            sums[4] += g_offset**2
            model.offset -= rate * g_offset / np.sqrt(sums[4])
            hit = np.flatnonzero(np.abs(g_vectors).sum(1))
            at = np.arange(len(rows)) - PAD * rows
            ends = begin + np.bincount(row, minlength=n) + PAD
            hit = hit[hit < ends[rows[hit]] - PAD]
            hit = hit[kept[place[at[hit]]]]
            if len(hit):
                to = buckets[place[at[hit]]]
                g = np.repeat(g_vectors[hit][:, None], to.shape[1], 1).reshape(-1, DIM)
                to, back = np.unique(to.reshape(-1), return_inverse=True)
                total = np.zeros((len(to), DIM), np.float32)
                np.add.at(total, back, g)
                sums[0][to] += (total**2).mean(1)
                model.embedding[to] -= rate * total / np.sqrt(sums[0][to])[:, None]
    model.embedding[sums[0] <= np.float32(1e-3)] = 0  # unseen words say nothing
    return model


def threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the span of logits with the most toxic rows caught less ``CLEAN_WEIGHT`` times the clean rows flagged, as shares."""
    order = np.sort(np.unique(scores))
    cuts = np.concatenate((order[:1] - 1, (order[1:] + order[:-1]) / 2, order[-1:] + 1))
    caught = np.array([(scores[labels == 1] >= c).mean() - CLEAN_WEIGHT * (scores[labels == 0] >= c).mean() for c in cuts])
    best = np.flatnonzero(caught >= caught.max() - 1e-12)
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def learn(docs: DataFrame, labels: DataFrame, held_out) -> bytes | None:
    """A model and its thresholds by language, packed, from a bounded sample of the labelled rows that aren't held out.

    The sample is learnt in one task, which holds its whole texts (``MAX_TOXIC`` + ``MAX_CLEAN`` of them), so a lost executor costs a repetition and the driver only
    passes on the packed model, whose size is set by ``BUCKETS`` and ``DIM``.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    by_hash = [known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for kind, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    picked = F.broadcast(by_hash[0].union(by_hash[1]))  # at most MAX_TOXIC + MAX_CLEAN ids
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang")).join(picked, "doc_id")
    sample = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"), F.max("toxic").alias("toxic")).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["doc_id"])
        learnt = _learn(rows)
        if learnt:
            learnt[0].embedding = learnt[0].embedding.astype(np.float16)
            yield pa.record_batch([pa.array([zlib.compress(pickle.dumps(learnt), 1)], pa.binary())], names=["model"])

    made = sample.mapInArrow(tidy(run), "model binary").collect()
    return bytes(made[0]["model"]) if made else None


@lru_cache(maxsize=1)
def _unpacked(packed: bytes) -> tuple[Model, dict[str, float]]:
    return pickle.loads(zlib.decompress(packed))


def _learn(rows: list[dict]) -> tuple[Model, dict[str, float]] | None:
    kinds = np.array([r["toxic"] for r in rows])
    if len(set(kinds.tolist())) < 2:
        return None
    aside = np.array([hash_of(r["doc_id"]) % 5 == 0 for r in rows])
    if len(set(kinds[aside].tolist())) < 2 or len(set(kinds[~aside].tolist())) < 2:
        aside = np.zeros(len(rows), bool)
    model = train([r["text"] for r, a in zip(rows, aside) if not a], kinds[~aside])
    judge = aside if aside.any() else ~aside
    data, offsets = utf8(pa.array([r["text"] for r, a in zip(rows, judge) if a], pa.large_string()))
    logits = np.concatenate([model.logits(data, offsets[a : b + 1]) for a, b in steps(offsets)])
    truth, langs = kinds[judge], np.array([r["lang"] for r, a in zip(rows, judge) if a])
    cut = threshold(logits, truth) * truth.sum() / (truth.sum() + SHRINK)
    model.offset -= cut
    by_lang = {"": 0.0}
    for lang in set(langs.tolist()):
        own = langs == lang
        if len(set(truth[own].tolist())) == 2:
            n = int(truth[own].sum())
            by_lang[lang] = threshold(logits[own] - cut, truth[own]) * n / (n + SHRINK)
    return model, by_lang


def hash_of(doc_id: int) -> int:
    return int(mix(np.array([doc_id], np.int64).view(np.uint64))[0] >> np.uint64(32))


def _judged(packed: bytes, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with text and lang, their logits, and whether these reach the language's threshold."""
    model, by_lang = _unpacked(packed)
    data, offsets = utf8(batch.column("text"))
    for a, b in steps(offsets):
        part, logits = batch.slice(a, b - a), model.logits(data, offsets[a : b + 1])
        yield part, logits, logits >= np.array([by_lang.get(x or "", 0.0) for x in part.column("lang").to_pylist()])


def score(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """doc_id, lang, score, flagged of every row. ``held_out``: column function of the id, true where labels mustn't be read."""
    learnt = learn(docs, labels, held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    if learnt is None:
        return rows.select("doc_id", "lang", F.lit(0.0).alias("score"), F.lit(False).alias("flagged"))
    shared = docs.sparkSession.sparkContext.broadcast(learnt)
    del learnt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, logits, flagged in _judged(shared.value, batch):
                yield pa.record_batch([part.column(0), part.column(1), pa.array(1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -700, 700)))), pa.array(flagged)], names=["doc_id", "lang", "score", "flagged"])

    return rows.mapInArrow(tidy(run), "doc_id long, lang string, score double, flagged boolean")


def fifth(doc_id):
    """Whether crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, flagged of every row."""
    made = score(docs, labels, fifth)
    return made.select("doc_id", fifth(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "flagged")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows below their language's threshold, each by its own text whatever its id; labels of the held-out fifth are not read. Null texts are
    empty ones; an empty table stays empty, and without labels of both kinds nothing goes."""
    learnt = learn(docs, labels, fifth)
    if learnt is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(learnt)
    del learnt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, flagged in _judged(shared.value, batch):
                yield part.filter(pa.array(~flagged))

    return docs.mapInArrow(tidy(run), docs.schema)
