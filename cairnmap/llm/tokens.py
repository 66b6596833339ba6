"""Token counts by heap-and-linked-list merging (operator 2) and token ids of whole texts (used by operators 4 and 8)."""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's memo of pieces; it starts anew when full, which changes no result.
MEMO = 600_000


def vocabulary(name_or_path: str) -> str:
    """A vocabulary file: a path as it is, or a file of the public tokenizers by name."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class MergeCounter:
    """Counts a text's tokens under a byte-pair vocabulary with an end-of-word suffix, without making any ids.

    Normalising and splitting follow the vocabulary file; every word is then merged with a heap of adjacent pairs over
    a doubly linked list, lowest rank first and leftmost among equals. Its count is its symbols less its merges.
    """

    def __init__(self, path: str):
        model = json.load(open(path))["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.library = _library(path)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        from tokenizers.pre_tokenizers import ByteLevel

        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letter = {byte: letters.pre_tokenize_str(chr(byte))[0][0] for byte in range(128)}
        self.inner = {c: vocab[c] for c in ByteLevel.alphabet()}
        self.last = {c: vocab[c + suffix] for c in ByteLevel.alphabet()}
        special = [t["content"] for t in json.load(open(path))["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words, self.pieces = _Pieces(self.merged), _Pieces(self.piece)
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

    def merged(self, word: str) -> int:
        """Tokens of one word given in byte letters."""
        symbols = [self.inner[c] for c in word]
        symbols[-1] = self.last[word[-1]]
        n = len(symbols)
        if n == 1:
            return 1
        merges, after, before = self.merges, list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # rank of the pair that begins here, -1: none
        heap = []
        for i in range(n - 1):
            found = merges.get(symbols[i] << 32 | symbols[i + 1])
            if found:
                pair[i] = found[0]
                heap.append(found[0] << 32 | i)
        heapify(heap)
        left = n
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            if pair[i] != top >> 32:
                continue
            j = after[i]
            symbols[i] = merges[symbols[i] << 32 | symbols[j]][1]
            left -= 1
            pair[j] = -1
            k = after[i] = after[j]
            pair[i] = -1
            if k < n:
                before[k] = i
                found = merges.get(symbols[i] << 32 | symbols[k])
                if found:
                    pair[i] = found[0]
                    heappush(heap, found[0] << 32 | i)
            h = before[i]
            if h >= 0:
                found = merges.get(symbols[h] << 32 | symbols[i])
                pair[h] = found[0] if found else -1
                if found:
                    heappush(heap, found[0] << 32 | h)
        return left

    def _split(self, text: str) -> int:
        made = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return sum(self.words[w] for w, _ in made)

    def piece(self, piece: str) -> int:
        """Tokens of a run without white space."""
        if not piece.isascii():
            return self._split(piece)
        piece = piece.lower()
        if piece.isalpha():
            return self.words[piece]
        return sum(self.words[w if w.isprintable() else "".join(map(self.letter.get, w.encode()))] for w in self.ascii.findall(piece))

    def _plain(self, text: str) -> int:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split only
            return self._split(text)
        return sum(map(self.pieces.__getitem__, text.split()))

    def count(self, text: str) -> int:
        if self.special and (found := self.special.findall(text)):
            return len(found) + sum(map(self._plain, self.special.split(text)))
        return self._plain(text)


@lru_cache(maxsize=2)
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, in one narrow pass.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids are returned as they come. A word of
    any length is merged whole. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(vocabulary(vocab))
        for batch in batches:
            counts = [counter.count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), batch.column(2)], names=["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    made = rows.mapInArrow(run, "doc_id long, n_tokens long, n_bytes long")
    return made.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


class _Pieces(dict):
    """Memo of a function of short strings, bounded by ``MEMO`` entries; longer strings are computed each time."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece):
        made = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = made
        return made


#: White space after a space keeps the two in one run of the splitting pattern; such texts are encoded as a whole.
_ASCII_RUNS = ("  ", " \n", " \t", " \r", " \x0b", " \x0c")
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Encoder:
    """Ids of whole texts under a byte-level vocabulary file of the tokenizers library.

    Where the same ranks lie beside the .json, the faster of the two public libraries merges; both split and merge
    alike on every Unicode code point (tested), and special strings are set apart first, as the .json asks for. The
    splitting pattern never joins a space that is followed by a non-space to what stands before it, so a text is the
    concatenation of its pieces from such spaces on, and the ids of pieces are kept in a bounded memo.
    """

    def __init__(self, path: str):
        self.library = _library(path)
        added = json.load(open(path))["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        self.cutter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if added else None
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype("=u2" if self.code == "H" else "=u4")
        ranks = re.sub(r"\.json$", ".tiktoken", path)
        self.merge = lambda text: self.library.encode(text, add_special_tokens=False).ids
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.merge = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.first = _Pieces(lambda piece: self._pack(self.merge(piece)) if piece else b"")
        self.rest = _Pieces(lambda piece: self._pack(self.merge(" " + piece)))

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _plain(self, text: str) -> bytes:
        if any(run in text for run in _ASCII_RUNS) or text.endswith(" ") or not text.isascii() and _WIDE_SPACE.search(text):
            return self._pack(self.merge(text))
        pieces = text.split(" ")
        head = self.first[pieces[0]]
        pieces[0] = ""
        return head + b"".join(map(self.rest.__getitem__, pieces[1:]))

    def ids(self, text: str) -> np.ndarray:
        if self.cutter and any(s in text for s in self.special):
            made = b"".join(self._pack([self.special[p]]) if p in self.special else self._plain(p) for p in self.cutter.split(text) if p)
        else:
            made = self._plain(text)
        return np.frombuffer(made, self.kind).astype(np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
