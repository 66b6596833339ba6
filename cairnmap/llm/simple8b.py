"""Word-aligned Simple-8b coding of token ids and a file format of coded segments (operator 4).

Every 64-bit word has a 4-bit selector on top and up to 60 bits of payload: as many ids as the selector says, each in
the same number of bits, lowest bits first. Selector 1 stands for 120 zeros. A value over 60 bits is an escape: its
word has selector 0 and the value goes to a list of whole words behind the coded ones. Ids are coded in blocks of
``BLOCK``; words never span blocks and each block's first word is listed, so any block can be decoded alone, and a
whole segment in one vectorised step.

A segment is one row of the file: the documents in order, the ids of each, the coded words and the block offsets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps, stored, utf8
from .tokens import encoder, vocabulary

BLOCK = 1024
#: Selectors of the format: (selector, values in a word, bits of each); fixed values of Simple-8b.
LAYOUT = ((1, 120, 0), (2, 60, 1), (3, 30, 2), (4, 20, 3), (5, 15, 4), (6, 12, 5), (7, 10, 6), (8, 8, 7), (9, 7, 8), (10, 6, 10), (11, 5, 12), (12, 4, 15), (13, 3, 20), (14, 2, 30), (15, 1, 60))
_COUNT = np.zeros(16, np.int64)
_BITS = np.zeros(16, np.uint64)
for _s, _n, _b in LAYOUT:
    _COUNT[_s], _BITS[_s] = _n, _b
_COUNT[0] = 1
#: Ids after which a segment ends; one document's ids are never parted, so a longer one is a segment of its own.
SEGMENT = 1 << 18


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, and escaped values of unsigned 64-bit integers."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    blocks = -(-n // BLOCK)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    bits = np.frexp(flat.astype(np.float64))[1].astype(np.uint8)  # one more than log2, rounded up near powers of two
    bits[(bits > 0) & (flat < (np.uint64(1) << (np.maximum(bits, 1) - 1).astype(np.uint64)))] -= 1
    grid = bits.reshape(blocks, BLOCK)
    most = {1: grid}
    reach = (grid <= 60).view(np.uint8).copy()
    choice = reach * np.uint8(15)
    for selector, count, width in reversed(LAYOUT[:-1]):
        half = max(k for k in most if 2 * k >= count and k < count)
        most[count] = most[half].copy()
        np.maximum(most[half][:, : BLOCK - (count - half)], most[half][:, count - half :], out=most[count][:, : BLOCK - (count - half)])
        fits = most[count] <= width
        if not fits.any():  # more values in fewer bits can't fit either
            break
        np.putmask(reach, fits, count)
        np.putmask(choice, fits, selector)
    np.putmask(reach, reach == 0, 1)
    step, at, firsts = reach.reshape(-1).tolist(), [], []
    for block in range(blocks):
        firsts.append(len(at))
        i, end = block * BLOCK, min(n, (block + 1) * BLOCK)
        while i < end:
            at.append(i)
            i += step[i]
    at = np.array(at, np.int64)
    chosen = choice.reshape(-1)[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    ends = np.minimum((at // BLOCK + 1) * BLOCK, n)
    for selector, count, width in LAYOUT[1:]:
        own = np.flatnonzero(chosen == selector)
        if len(own):
            left, space = at[own], ends[own]
            made = words[own]
            full = int(np.minimum(space - left, count).min())
            for k in range(count):
                if k < full:
                    made |= flat[left + k] << np.uint64(k * width)
                else:  # the last words of blocks
                    inside = np.flatnonzero(left + k < space)
                    made[inside] |= flat[left[inside] + k] << np.uint64(k * width)
            words[own] = made
    escaped = np.flatnonzero(chosen == 0)
    return words, np.array(firsts, np.uint32), flat[at[escaped]]


def decode(words: np.ndarray, n: int, firsts: np.ndarray, escaped: np.ndarray, block: int | None = None) -> np.ndarray:
    """All ``n`` values, or those of one block."""
    if block is not None:
        before = int((words[: firsts[block]] >> np.uint64(60) == 0).sum()) if len(escaped) else 0
        end = firsts[block + 1] if block + 1 < len(firsts) else len(words)
        return decode(words[firsts[block] : end], min(BLOCK, n - block * BLOCK), np.zeros(1, np.uint32), escaped[before:])
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNT[selector]
    begin = np.cumsum(count) - count
    in_block = np.searchsorted(firsts, np.arange(len(words)), side="right") - 1
    begin += in_block * BLOCK - begin[firsts[in_block]]  # a block's last word may be part full
    end = np.minimum((in_block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    payload = words & np.uint64((1 << 60) - 1)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == 0:
            out[begin[own]] = escaped[: len(own)]
        elif s > 1:
            mask, width = np.uint64((1 << int(_BITS[s])) - 1), _BITS[s]
            for k in range(_COUNT[s]):
                to = begin[own] + k
                ok = to < end[own]
                out[to[ok]] = (payload[own[ok]] >> (np.uint64(k) * width)) & mask
    return out


SCHEMA = "part int, seq int, ids_before long, n_ids long, n_docs long, doc_ids binary, doc_null binary, doc_sizes binary, words binary, blocks binary, escaped binary"


def _coded(values: np.ndarray) -> bytes:
    """A short list of its own: lengths of its three parts, then the parts."""
    words, firsts, escaped = encode(values)
    return np.array([len(values), len(words), len(firsts)], "<u8").tobytes() + words.tobytes() + firsts.tobytes() + escaped.tobytes()


def _uncoded(data: bytes) -> np.ndarray:
    n, n_words, n_firsts = np.frombuffer(data, "<u8", 3).tolist()
    a, b = 24 + 8 * n_words, 24 + 8 * n_words + 4 * n_firsts
    return decode(np.frombuffer(data[24:a], "<u8"), n, np.frombuffer(data[a:b], "<u4"), np.frombuffer(data[b:], "<u8"))


def write_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Coded segments of all texts in ascending id order (nulls first; equal ids by a hash of the text).

    Rows are dealt by ranges of the id, so a file holds a run of documents and the files follow each other. A null
    text counts as empty: the end id alone. The frame is to be written as it is; ``part`` is its place in the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq, before = encoder(vocabulary(vocab)), TaskContext.get().partitionId(), 0, 0
        ids, held, sizes, parts = [], 0, [], []

        def segment() -> pa.RecordBatch:
            values = np.concatenate(parts)
            words, firsts, escaped = encode(values)
            known = np.array([i if i is not None else 0 for i in ids], np.int64)
            order = np.concatenate((known[:1], known[1:] - known[:-1]))
            zigzag = (order << 1 ^ order >> 63).view(np.uint64)
            null = np.packbits([i is None for i in ids]).tobytes() if None in ids else None
            row = {"part": part, "seq": seq, "ids_before": before, "n_ids": len(values), "n_docs": len(ids), "doc_ids": _coded(zigzag), "doc_null": null, "doc_sizes": _coded(np.array(sizes)), "words": words.tobytes(), "blocks": firsts.tobytes(), "escaped": escaped.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), *((k, pa.binary()) for k in ("doc_ids", "doc_null", "doc_sizes", "words", "blocks", "escaped"))]))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                made = np.append(coder.ids(text.as_py() or ""), np.uint32(end_id))
                if held and held + len(made) > SEGMENT:
                    yield segment()
                    seq, before = seq + 1, before + held
                    ids, held, sizes, parts = [], 0, [], []
                ids.append(doc)
                sizes.append(len(made))
                parts.append(made)
                held += len(made)
        if ids:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    return rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text").mapInArrow(run, SCHEMA)


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit) of every document in the coded files."""
    return _documents(files, "doc_id long, start long, n_tokens long, ids binary", True)


def id_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded ids."""
    return _documents(files, "doc_id long, start long, n_tokens long, ids_crc32 long", False)


def _documents(files: DataFrame, schema: str, whole: bool) -> DataFrame:
    from pyspark.sql import Window

    name = schema.rsplit(" ", 2)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_docs"]
                zigzag = _uncoded(row["doc_ids"])
                ids = np.cumsum((zigzag >> np.uint64(1)).view(np.int64) ^ -(zigzag & np.uint64(1)).view(np.int64))
                null = np.unpackbits(np.frombuffer(row["doc_null"], np.uint8))[:n].astype(bool) if row["doc_null"] else np.zeros(n, bool)
                ends = np.cumsum(_uncoded(row["doc_sizes"]).view(np.int64))
                begins = np.concatenate(([0], ends[:-1]))
                values = decode(np.frombuffer(row["words"], "<u8"), row["n_ids"], np.frombuffer(row["blocks"], "<u4"), np.frombuffer(row["escaped"], "<u8")).astype("<u4")
                own = [values[a:b].tobytes() for a, b in zip(begins, ends)]
                last = pa.array(own, pa.binary()) if whole else pa.array([zlib.crc32(x) for x in own], pa.int64())
                yield pa.record_batch([pa.array(ids, mask=null), pa.array(begins + row["start"]), pa.array(ends - begins), last], names=["doc_id", "start", "n_tokens", name])

    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    placed = files.join(before, "part").withColumn("start", F.col("part_start") + F.col("ids_before"))
    return placed.select("start", "n_ids", "n_docs", "doc_ids", "doc_null", "doc_sizes", "words", "blocks", "escaped").mapInArrow(run, schema)


def coded_round_trip(docs: DataFrame, vocab: str = "byte_bpe_50k.json") -> DataFrame:
    """Write the ids of all documents in the file format to the shared folder and read the digests back from the files."""
    return id_digests(stored(write_ids(docs, vocab=vocab), "ids"))
