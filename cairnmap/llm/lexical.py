"""Ranked lexical search over impact-ordered postings, score at a time (operator 11).

One pass over the documents counts terms: it stores a document's length and the frequencies of the terms that the
queries hold, and sums the corpus statistics. Integer weights of terms and integer impacts of postings follow from these. Documents are
searched in blocks: a block's postings are ordered by term and falling impact, so a term is a run of groups of equal
impact. A query takes the groups of its terms in falling order of impact over all terms, in growing steps that end at group
borders, adding impacts to the documents' sums. What a document can still gain is at most the sum of its terms' next impacts; once
no document outside the candidates can reach the k-th sum, which starts at the k-th score of the blocks before, the step loop stops. Candidates' scores are then completed from the
groups not taken, so every returned score is exact. Blocks' lists are merged by query, in two levels.

Queries go out in chunks of at most ``CHUNK_BYTES`` of text, a broadcast of bounded size; each chunk reads the documents once.

Defined results: a null text has no term, a document without terms never ranks, a query without terms has no rows. Rows are documents
of their own, whatever their id: repeated rows rank beside each other, a null id comes last among equal scores. Repeated or
null item ids are queries of their own. A term of any length is one term; long texts are counted piece by piece.
No documents or no queries give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import measured, stored, tidy

#: Bytes of query text (and 64 for each query) that go out at once.
CHUNK_BYTES = 16 << 20
#: Documents and postings of one block.
BLOCK_ROWS, BLOCK_POSTINGS = 16_384, 4 << 20
#: Bytes of a text that are cut to terms at once.
PIECE = 1 << 20
_NO_ID = np.iinfo(np.int64).max
_SCHEMA = "item_id long, rank int, doc_id long, score long"
#: Bytes that are no part of a term become spaces; A to Z become small; bytes of characters beyond ASCII stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists of bounded size; no term is cut."""
    start = 0
    while start < len(text):
        piece = text[start : start + PIECE].translate(_FOLD)
        end = start + len(piece)
        if end < len(text) and (tail := piece.rfind(b" ")) >= 0:
            piece, end = piece[:tail], start + tail + 1
        elif end < len(text):  # a term longer than a piece
            rest = text[end:].translate(_FOLD)
            cut = rest.find(b" ")
            piece, end = piece + (rest if cut < 0 else rest[:cut]), len(text) if cut < 0 else end + cut
        yield piece.split()
        start = end


def term_counts(text: bytes | None) -> tuple[Counter, int]:
    """The frequency of every term, and the number of terms with repeats."""
    counts, n = Counter(), 0
    for terms in term_pieces(text or b""):
        counts.update(terms)
        n += len(terms)
    return counts, n


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    return 100 - 75 + (75 * n * documents) // max(total, 1)


class Block:
    """The postings of some documents: by term, runs of groups of equal impact in falling order."""

    def __init__(self, ids: np.ndarray, documents: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        order = np.lexsort((documents, -impacts, terms))
        self.ids, self.documents, self.impacts = ids, documents[order], impacts[order]
        terms = terms[order]
        self.terms, self.starts = np.unique(terms, return_index=True)
        self.ends = np.append(self.starts[1:], len(terms))

    def runs(self, terms: np.ndarray, times: np.ndarray) -> list[tuple[int, int, int]]:
        """(first, end, times) of the terms that this block holds."""
        at = np.searchsorted(self.terms, terms)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == terms[there]
        return list(zip(self.starts[at[there]].tolist(), self.ends[at[there]].tolist(), times[there].tolist()))


def _first(block: Block, found: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, equal scores by id."""
    if len(found) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        found, scores = found[keep], scores[keep]
    order = np.lexsort((block.ids[found], -scores))[:k]
    return found[order], scores[order]


def search_block(block: Block, terms: np.ndarray, times: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The block's k best documents (numbers within the block) of score above 0 with exact scores, as far as these reach ``least`` (below it
    some may be missing); and the number of postings taken before the stop."""
    runs = block.runs(terms, times)
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    at = np.concatenate([np.arange(a, b) for a, b, _ in runs])
    own = np.repeat(np.arange(len(runs)), [b - a for a, b, _ in runs])
    impacts = block.impacts[at] * np.repeat([t for _, _, t in runs], [b - a for a, b, _ in runs])
    order = np.argsort(-impacts, kind="stable")
    falling = impacts[order]
    sums = np.zeros(len(block.ids), np.int64)
    taken, n = 0, len(order)
    heads = np.cumsum([0, *(b - a for a, b, _ in runs)])  # each term's first place in ``impacts``
    while taken < n:
        end = min(n, max(4 * k, 2 * taken))
        end = int(np.searchsorted(-falling, -falling[end - 1], side="right"))  # whole groups of equal impact
        step = order[taken:end]
        np.add.at(sums, block.documents[at[step]], impacts[step])
        taken = end
        if taken == n:
            break
        gone = np.bincount(own[order[:taken]], minlength=len(runs))
        following = heads[:-1] + gone
        gain = int(impacts[following[following < heads[1:]]].sum())
        bar = max(least, int(np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) >= k else 0)
        if bar > gain:  # a document of which nothing is taken yet can't reach the bar
            open_ = np.flatnonzero(sums + gain >= bar)
            if len(open_) <= 4 * k:
                break
    if taken == n:
        found = np.flatnonzero(sums > 0)
        return *_first(block, found, sums[found], k), taken
    rest = order[taken:]
    documents = block.documents[at[rest]]
    place = np.full(len(sums), -1)
    place[open_] = np.arange(len(open_))
    mine = place[documents] >= 0
    scores = sums[open_]
    np.add.at(scores, place[documents[mine]], impacts[rest[mine]])
    return *_first(block, open_[scores > 0], scores[scores > 0], k), taken


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, postings = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        postings += len(batch.column("terms").flatten())
        if rows >= BLOCK_ROWS or postings >= BLOCK_POSTINGS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, postings = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _chunk(docs: DataFrame, items: pa.Table, k: int, id_col: str, text_col: str) -> DataFrame:
    """no, item_id, rank, doc_id, score of one chunk of queries, stored."""
    session = docs.sparkSession
    counted = [term_counts(t) for t in items["text"].to_pylist()]
    names = {t: i for i, t in enumerate(sorted({t for c, _ in counted for t in c}))}
    shared = session.sparkContext.broadcast(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for batch in batches:
            lengths, cuts, terms, times = [], [0], [], []
            for text in batch.column(1):
                counts, n = term_counts(text.as_py())
                lengths.append(n)
                for term, c in counts.items():
                    if (number := names.get(term)) is not None:
                        terms.append(number)
                        times.append(c)
                cuts.append(len(terms))
            own = pa.array(cuts, pa.int32())
            yield pa.record_batch([batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(own, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(own, pa.array(times, pa.int64()))], names=["id", "n", "terms", "times"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    index, seen = measured(rows.mapInArrow(tidy(count), "id long, n long, terms array<int>, times array<long>"), "postings", documents=F.count_if(F.col("n") > 0), total=F.sum("n"))
    documents, total = int(seen["documents"] or 0), int(seen["total"] or 0)
    holding = index.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row for each term of the chunk at most
    weights = np.zeros(len(names), np.int64)
    for term, n in zip(holding["term"].to_pylist(), holding["count"].to_pylist()):
        weights[term] = weight(documents, n)
    queries = [(np.array([names[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c, _ in counted]
    sent = session.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, id), the first k so far
        for block in _windows(batches):
            ids, n = block["id"].fill_null(_NO_ID).to_numpy(), block["n"].to_numpy()
            sizes = block["terms"].combine_chunks().value_lengths().to_numpy()
            terms = block["terms"].combine_chunks().flatten().to_numpy()
            times = block["times"].combine_chunks().flatten().to_numpy()
            places = np.repeat(np.arange(len(ids)), sizes)
            norm = length_norm(n, documents, total)
            impacts = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * norm[places]))
            made = Block(ids, places, terms, impacts)
            for q, (own, repeats) in enumerate(queries):
                least = -best[q][k - 1][0] if len(best[q]) >= k else 0
                found, scores, _ = search_block(made, own, repeats, k, least)
                if len(found):
                    best[q] = sorted([*best[q], *zip((-scores).tolist(), ids[found].tolist())])[:k]
        out = [(q, i, -s) for q, own in enumerate(best) for s, i in own]
        if out:
            numbers, ids, scores = (np.array(x, np.int64) for x in zip(*out))
            yield pa.record_batch([pa.array(numbers), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], names=["no", "doc_id", "score"])

    found = index.mapInArrow(tidy(run), "no long, doc_id long, score long").withColumn("part", F.spark_partition_id() % 32)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for by in (("no", "part"), ("no",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    numbers = session.createDataFrame(pa.table({"no": pa.array(range(items.num_rows), pa.int64()), "item_id": items["id"]}))
    ranked = stored(found.join(F.broadcast(numbers), "no").select("item_id", "rank", "doc_id", "score"), "ranked")
    shared.unpersist()
    sent.unpersist()
    return ranked


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for every item."""
    own = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("binary").alias("text"))
    size = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    n, parts = max(1, -(-size // CHUNK_BYTES)), []
    for c in range(n):
        chunk = (own if n == 1 else own.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == c)).toArrow()
        if chunk.num_rows:
            parts.append(_chunk(docs, chunk.sort_by("id"), k, id_col, text_col))
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], _SCHEMA)
