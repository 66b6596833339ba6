"""Ranked search against a plain scan of all documents."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from cairnmap.llm import lexical as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def plain(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    held = [b for _, b in bags if b]
    n, total = len(held), sum(b.total() for b in held)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in b for b in held) + 1))) for b in held for t in b}
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 25 + (75 * b.total() * n) // max(total, 1)
            s = sum(w.get(t, 0) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms(text))
            if s > 0:
                scored.append((-s, math.inf if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as item_id", "1 as n", "'x' as id", "0 as score")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "item_id as doc_id", "2 as no", "3 as rank")
    return sorted(map(tuple, L.ranked_documents(d, i).collect()), key=str)


def corpus(seed, n=400):
    r = np.random.default_rng(seed)
    words = ["the", "Of", "é", "naïve", "x1", "Straße", "İstanbul", "zebra", "日本", *(f"w{i}" for i in range(60))]
    p = 1 / np.arange(1, len(words) + 1)
    texts = [", ".join(r.choice(words, r.integers(0, 40), p=p / p.sum())) for _ in range(n)]
    docs = [(int(i), t) for i, t in zip(r.permutation(n), texts)]
    docs += [(5000 + i, texts[3]) for i in range(130)]  # copies: equal scores
    docs += [(7, texts[5]), (None, texts[6]), (None, None), (9001, None), (9002, ""), (9003, " \x00\t!_~\x7f"), (9004, "w" * 3_000_000 + " zebra"), (9005, "the " * 400_000)]
    items = [(int(i), texts[i * 7 % n]) for i in range(20)] + [(3, "zebra zebra"), (None, "w59 the"), (50, None), (51, "unknown"), (52, "")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_ranks_match_a_plain_scan(spark, monkeypatch, small):
    """Once with several chunks of queries."""
    docs, items = corpus(1)
    if small:
        monkeypatch.setattr(L, "CHUNK_BYTES", 1200)
    assert found(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(2, 20)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_pieces_cut_no_term(monkeypatch):
    r = np.random.default_rng(4)
    text = "".join(r.choice(list("abéZ9 .\n_"), 3000)).encode()
    want = terms(text.decode())
    for size in (1, 2, 5, 64, 4096):
        monkeypatch.setattr(L, "PIECE", size)
        assert [t.decode() for piece in L.term_pieces(text) for t in piece] == want


def test_search_stops_early_and_stays_exact():
    """Impacts fall steeply, so few groups decide; the last block's bar cuts later ones."""
    r = np.random.default_rng(5)
    n, k, shares = 5000, 10, []
    documents, numbers = np.nonzero(r.random((n, 12)) < 0.3)
    impacts = (1000 * r.pareto(1.2, len(documents)) + 1).astype(np.int64)
    block = L.Block(np.arange(n), documents, numbers, impacts)
    for _ in range(30):
        own = r.choice(14, 5, replace=False)
        times = r.integers(1, 3, 5)
        scores = np.zeros(n, np.int64)
        for t, c in zip(own, times):
            np.add.at(scores, documents[numbers == t], c * impacts[numbers == t])
        want = np.lexsort((np.arange(n), -scores))[:k]
        for least in (0, int(scores[want[4]])):
            got, points, taken = L.search_block(block, own, times, k, least)
            sure = scores[want] >= max(least, 1)
            assert got[: sure.sum()].tolist() == want[sure].tolist() and (points == scores[got]).all()
            shares.append(taken / np.isin(numbers, own).sum())
    assert np.mean(shares) < 0.4
