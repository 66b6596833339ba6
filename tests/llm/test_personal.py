"""Personal data: patterns against plain regular expressions, the tagger's gradients and held-out disguises, whole tables."""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pytest

from cairnmap.llm import personal as P
from cairnmap.llm import tagger as T

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [int(d) * (1 + (len(digits) - 1 - i) % 2) for i, d in enumerate(digits)]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if n == 1), "card": 12 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def card(r, n=16):
    digits = "4" + "".join(map(str, r.integers(0, 10, n - 2)))
    return digits + next(c for c in "0123456789" if plain_luhn(digits + c))


def some(r, kind):
    i = lambda n: int(r.integers(n))
    return {"email": f"{'abcdefgh'[i(8)]}{'xyz'[i(3)]}n.{i(99)}@mail{i(9)}.example.com", "ip": ".".join(str(i(256)) for _ in range(4)), "card": card(r), "phone": f"+{1 + i(9)} ({i(900) + 100}) {i(900) + 100}-{i(9000) + 1000}"}[kind]


def prose(r, n):
    return " ".join(r.choice(["then", "ofé", "was", "on", "Rear", "ñina", "at", "dot", "und."], n))


def corpus(seed, n=240):
    r = np.random.default_rng(seed)
    rows = []
    for d in range(n):
        text = prose(r, 30)
        if d % 2:
            text += " " + some(r, P.KINDS[d // 2 % 4]) + " " + prose(r, 20)
        elif d % 8 == 0:
            text += f" {int(r.integers(1900, 2100))} and {int(r.integers(99))}.{int(r.integers(99))} " + prose(r, 9) + f" key={r.bytes(12).hex()}"
        rows.append((d, text))
    return rows


def test_base_spans_equal_the_patterns():
    r = np.random.default_rng(1)
    for _ in range(4000):
        text = "".join(r.choice(list("1234567890..--  @@++()aZé%_"), int(r.integers(0, 40))))
        assert P.base_spans(text) == plain(text), text
    for _ in range(500):
        text = "".join(some(r, k) + r.choice([" ", "", ".", "-", "x", ", "]) for k in r.choice(P.KINDS, 4))
        assert P.base_spans(text) == plain(text), text
    assert P.base_spans("") == [] and len(P.base_spans("1" * 200_000 + "." + "9" * 200_000 + "a" * 200_000 + "@" + "+1" + " " * 200_000)) == 0


def test_gradients():
    m = T.Tagger(5, [(0, 2), (0, 4)], width=3, hidden=4, kind=np.float64)
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, 20, (3, 7)), np.array([[0, 1, 2, 0, 3, 4, 4], [0] * 7, [1, 2, 2, 3, 0, 0, 1]])
    for k in m.p:
        m.p[k] = m.p[k] + r.normal(0, 0.1, m.p[k].shape)
    _, grads = m.loss(ids, tags)
    for k, v in m.p.items():
        for _ in range(5):
            at = tuple(int(r.integers(n)) for n in v.shape) if k != "embedding" else (int(ids.reshape(-1)[r.integers(21)]), int(r.integers(3)))
            was, e = v[at], 1e-5
            v[at] = was + e
            up = m.loss(ids, tags)[0]
            v[at] = was - e
            down = m.loss(ids, tags)[0]
            v[at] = was
            assert abs((up - down) / 2 / e - grads[k][at]) < 1e-6, k


def test_best_path_and_likelihood_against_all_paths():
    m = T.Tagger(3, [(0, 2)], width=2, hidden=2, kind=np.float64)
    r = np.random.default_rng(3)
    m.p["moves"] = r.normal(0, 1, (3, 3))
    ids = r.integers(0, 9, (2, 5))
    e, moves = m.emissions(ids), m.p["moves"] + m.banned
    tags, sure = m.decode(ids)
    for w in range(2):
        paths = list(itertools.product(range(3), repeat=5))
        score = np.array([m.p["start"][p[0]] + sum(e[t, w, p[t]] for t in range(5)) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert tuple(tags[w]) == paths[int(score.argmax())]
        share = np.exp(score - score.max())
        share /= share.sum()
        for t in range(5):
            assert abs(sure[w, t] - sum(s for p, s in zip(paths, share) if p[t] == tags[w, t])) < 1e-9
        one = ids[w : w + 1], tags[w : w + 1]
        assert abs(m.loss(*one)[0] + np.log(share.max())) < 1e-9


def test_windows_cover_every_mark():
    r = np.random.default_rng(5)
    for n in (1, 47, 95, 96, 97, 143, 144, 145, 400):
        for _ in range(20):
            text = "".join(r.choice(list("aaaaaaaaaaaaaaaaaa1@"), n))
            starts = P.marked_windows(text)
            assert all(s == 0 or s + P.WINDOW - P.STRIDE < n for s in starts)
            for at, c in enumerate(text):
                if c != "a":
                    assert any(s <= at < s + P.WINDOW for s in starts)
    assert P.marked_windows("x" * 500 + " (at) ") and not P.marked_windows("flat attic " * 99)


def test_reconciling_joins_cut_pieces_and_keeps_the_heaviest():
    join = P.reconciled(400, [(0, [(90, 96, 0, 0.9), (10, 20, 1, 0.9)]), (48, [(88, 144, 0, 0.8)]), (96, [(96, 160, 0, 0.7)])])
    assert join == [(10, 20, 1, 0.9), (88, 160, 0, 0.7)]
    r = np.random.default_rng(2)
    for _ in range(60):
        spans = [(int(a), int(a + r.integers(1, 9)), int(r.integers(2)), float(np.round(r.random(), 3))) for a in r.integers(1, 30, 6)]
        got = P.reconciled(90, [(0, spans)])
        apart = lambda own: all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(own, 2))
        heaviest = max(sum(p * (b - a) for a, b, _, p in own) for n in range(7) for own in itertools.combinations(spans, n) if apart(own))
        assert apart(got) and abs(sum(p * (b - a) for a, b, _, p in got) - heaviest) < 1e-9


@pytest.fixture(scope="module")
def model():
    rows = {}
    for _, text in corpus(7, 800):
        for kind, part, spans in P.sample_windows(text):
            rows[part] = (kind, part, spans)
    made = T.Tagger(P.TAGS, P._BANNED)
    losses = made.train(P.batches_of(list(rows.values())))
    assert np.mean(losses[-10:]) < 0.1 * np.mean(losses[:3])
    return made


def test_held_out_disguises_are_found_and_clean_texts_left_alone(model):
    r = np.random.default_rng(123)
    hit = dict.fromkeys(range(4), 0)
    for n in range(200):
        k, head = n % 4, prose(r, 40) + " "
        text = head + P._disguised(r, k, some(r, P.KINDS[k]))
        end = len(text)
        text += " " + prose(r, 20)
        base = P.base_spans(text)
        added = P.added_spans(text, base, P.tagged(model, [text])[0])
        hit[k] += any(s == (len(head), k, end) for s in [*base, *added])
    assert min(hit.values()) >= 35, hit
    clean = [prose(r, 60) + f" {int(r.integers(1900, 2100))}, {r.bytes(16).hex()} x{int(r.integers(10**12))} " + prose(r, 20) for _ in range(200)]
    wrong = sum(bool(P.added_spans(t, P.base_spans(t), f)) for t, f in zip(clean, P.tagged(model, clean)))
    assert wrong <= 2


def test_query_against_plain_patterns(spark):
    """Base columns equal the patterns; base spans stay among all spans; nulls, empty, long and repeated rows come back."""
    rows = corpus(11) + [(None, None), (1000, None), (1001, ""), (3, corpus(11)[3][1]), (1002, "é " * 100_000 + "+1 (499) 555-6503 7" + " ü" * 100_000 + " 10.0.0.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as n_email", "'a' as spans", "1 as kind", "'b' as part").repartition(3)
    got = sorted(((*r,) for r in P.personal_data(docs).collect()), key=str)
    assert len(got) == len(rows)
    want = []
    for d, text in rows:
        own = plain(text or "")
        want.append((d, *(sum(k == n for _, k, _ in own) for n in range(4)), hashlib.sha256(P.written(own).encode()).hexdigest(), own))
    for g, w in zip(got, sorted(want, key=str)):
        assert g[:6] == w[:6]
        spans = [s for s in g[6].split(",") if s]
        assert {f"{P.KINDS[k]}:{a}:{b}" for a, k, b in w[6]} <= set(spans) and len(spans) == len(w[6]) + g[7]
    assert P.personal_data(docs.limit(0)).collect() == []
    none = P.personal_data(spark.createDataFrame([(1, "nothing here")], "doc_id long, text string")).first()
    assert none["spans"] == "" and none["n_added"] == 0
