"""Words, word hashes and sets of word shingles, vectorised over the bytes of whole batches.

Words are the runs matched by ``[^\\x20\\x09-\\x0D]+`` after A-Z have been lower-cased (other letters stay as they are).
A word's 64-bit hash is a polynomial over its bytes, taken from prefix sums, then mixed; a shingle's hash mixes the
hashes of its words in order.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
SEPARATORS = (9, 10, 11, 12, 13, 32)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20011).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_PLACE = np.random.default_rng(20021).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    def up(base: int) -> np.ndarray:
        out = np.ones(1 << bits, np.uint64)
        for k in range(bits):
            out[1 << k : 2 << k] = out[: 1 << k] * np.uint64(pow(base, 1 << k, 1 << 64))
        return out

    return up(_BASE), up(pow(_BASE, -1, 1 << 64))


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = _IS_WORD, heads: tuple[int, ...] = ()) -> tuple:
    """Start, end, row and hash of every word of the rows ``offsets`` delimits in ``data``; with ``heads``, a list follows
    that has, for each of these lengths, the hash of that many first bytes (0 where a word is shorter)."""
    low, high = int(offsets[0]), int(offsets[-1])
    data, at = data[low:high], offsets - low
    inside = letters[data]
    if not inside.any():
        none, no_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return (none, none, none, no_hash, [no_hash for _ in heads]) if heads else (none, none, none, no_hash)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(max(20, int(len(data) - 1).bit_length()))
    sums = np.cumsum(_BYTE[data] * up[: len(data)])
    total = sums[end - 1] - np.where(start > 0, sums[start - 1], np.uint64(0))
    hashed = mix(total * down[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(at, start, side="right") - 1
    if not heads:
        return start + low, end + low, row, hashed
    before, made = np.where(start > 0, sums[start - 1], np.uint64(0)), []
    for n in heads:
        to = np.minimum(start + n, len(data)) - 1
        made.append(np.where(end - start >= n, mix((sums[to] - before) * down[start]), np.uint64(0)))
    return start + low, end + low, row, hashed, made


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after the other, and the offsets of the rows among them.

    A row with fewer words than ``width`` has its whole word sequence as its only shingle; one without words has none.
    """
    rows = len(offsets) - 1
    _, _, row, hashed = words(data, offsets)
    n_words = np.bincount(row, minlength=rows)
    begin = np.concatenate(([0], np.cumsum(n_words)))
    whole = np.zeros(max(0, len(hashed) - width + 1), np.uint64)
    for k in range(width):
        whole += hashed[k : k + len(whole)] * _PLACE[k]
    whole = mix(whole + np.uint64(width))
    out, sizes = [], np.zeros(rows + 1, np.int64)
    for r in range(rows):
        n = n_words[r]
        if n >= width:
            own = whole[begin[r] : begin[r + 1] - width + 1].copy()
            own.sort()
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            own = own[keep]
        elif n:
            own = mix((hashed[begin[r] : begin[r + 1]] * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            continue
        out.append(own)
        sizes[r + 1] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


@lru_cache(maxsize=4)
def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, dtype=np.uint64)


def minhash(sets: np.ndarray, offsets: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """``n`` 32-bit minima for every row (rows x n); a row with an empty set gets the largest value everywhere."""
    rows = len(offsets) - 1
    out = np.full((rows, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        begin = offsets[:-1][full]
        for k, (a, b) in enumerate(zip(*_functions(n, seed))):
            out[full, k] = np.minimum.reduceat((sets * a + b) >> np.uint64(32), begin).astype(np.uint32)
    return out
