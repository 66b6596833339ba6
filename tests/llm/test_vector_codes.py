"""Product codes against plain Lloyd rounds."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from cairnmap.llm import vector_codes as V


def plain(rows, parts=16, k=64, rounds=2):
    """rows: (id, label, vector); every part against every entry."""
    whole = sorted((math.inf if i is None else i, [math.floor(256 * float(np.float32(x))) for x in v], i, label) for i, label, v in rows)
    width = len(whole[0][1]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(x, p) for _, x, _, _ in whole[:k]] for p in range(parts)]
    d = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    nearest = lambda x, p: min((d(cut(x, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        held = [[nearest(x, p)[1] for p in range(parts)] for _, x, _, _ in whole]
        books = [[[math.floor(sum(c) / len(own)) for c in zip(*own)] if (own := [cut(x, p) for (_, x, _, _), h in zip(whole, held) if h[p] == e]) else c for e, c in enumerate(books[p])] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(v) for p in books for c in p for v in c).encode()).hexdigest()
    out = [(i, label, "".join(f"{nearest(x, p)[1]:02x}" for p in range(parts)), sum(nearest(x, p)[0] for p in range(parts))) for _, x, i, label in whole]
    totals = {}
    for _, label, _, error in out:
        totals[label] = totals.get(label, 0) + error
    return sorted(((i, code, error, totals[label], digest) for i, label, code, error in out), key=str)


def found(spark, rows, extra=False):
    made = spark.createDataFrame([(i, label, None if v is None else [None if x is None else float(x) for x in v]) for i, label, v in rows], "vec_id long, label int, embedding array<float>")
    if extra:
        for name in ("id", "x", "code", "low", "error", "n", "_label", "label_error"):
            made = made.withColumn(name, made.vec_id)
    return sorted(map(tuple, V.coded_vectors(made).collect()), key=str)


@pytest.mark.parametrize("seed, spread", [(1, 0.02), (2, 0.5)])
def test_codes_match_plain_rounds(spark, seed, spread):
    """Coarse components make many equal distances; one vector and one label hold a third of the rows."""
    r = np.random.default_rng(seed)
    base = r.normal(0, 1, (9, 32))
    rows = [(int(i), None if i % 5 == 0 else int(i % 3), np.round(base[i % 9] + r.normal(0, spread, 32), 1).tolist()) for i in r.permutation(300)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(150)] + [(7, 2, rows[3][2]), (None, 1, rows[5][2])]
    assert found(spark, rows, extra=True) == plain(rows)


def test_left_out_rows_few_rows_and_none(spark):
    good = [(i, None, [i * 0.25 - j for j in range(16)]) for i in range(5)]
    bad = [(10, 1, None), (11, 1, []), (12, 1, [None] * 16), (13, 1, [float("nan")] * 16), (14, 1, [float("inf")] * 16), (-1, 1, [0.0] * 15), (15, 1, [0.0] * 32)]
    assert found(spark, good + bad) == plain(good)
    assert found(spark, []) == []
    with pytest.raises(Exception, match="31 bits"):
        found(spark, [(1, 1, [1e30] * 16)])


def test_bounds_skip_groups_and_change_no_code():
    r = np.random.default_rng(3)
    centres = r.integers(-600, 600, (64, 8))
    x = (centres[r.integers(0, 64, 4000)] + r.integers(-20, 20, (4000, 8))).astype(np.int64)
    entries = x[:64].reshape(64, 2, 4).transpose(1, 0, 2)
    books = V.Books(entries, V.grouped(entries), None)
    code, low, _, whole = V.assigned(x, books, None, None)
    for _ in range(4):
        sums = np.zeros((2, 64, 4), np.int64)
        counts = np.zeros((2, 64), np.int64)
        for p in range(2):
            np.add.at(sums[p], code[:, p], x[:, p * 4 : p * 4 + 4])
            np.add.at(counts[p], code[:, p], 1)
        books = V.replaced(books, sums, counts)
        code, low, squares, scans = V.assigned(x, books, code, low)
        again, _, want, _ = V.assigned(x, V.Books(books.entries, books.group, None), None, None)
        assert (code == again).all() and (squares == want).all()
        for p in range(2):  # every bound is below the distance to any other entry of its group
            gaps = np.sqrt(((x[:, None, p * 4 : p * 4 + 4] - books.entries[p][None]) ** 2).sum(2)) * V.FINE
            gaps[np.arange(len(x)), code[:, p]] = np.inf
            for g in range(low.shape[2]):
                if (books.group[p] == g).any():
                    assert (low[:, p, g] <= gaps[:, books.group[p] == g].min(1) + 1e-6).all()
    assert scans < 0.5 * whole
