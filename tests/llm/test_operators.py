"""The text and vector operators against brute force, exact round trips and odd rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnmap.llm import ann, exact_topk, licences, lm_scoring, mixing, near_dedup, packing, simple8b, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, id string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, [None, "b", "a"][k % 3], len(t or ""), "x", "y") for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


@pytest.fixture(scope="module")
def texts():
    draw = np.random.default_rng(2)
    bank = ["the", "of", "Réeux", "loser", "x1", "don't", "日本語", "###"] + [f"w{k}" for k in range(300)]
    out = [" ".join(draw.choice(bank, n)) for n in draw.integers(1, 200, 40)]
    long = " ".join(draw.choice(bank, 400))
    near = long.split()
    near[7] = "changed"
    return [*out, None, "", "  \n", "a", "a b", out[0], out[0], long, " ".join(near), "a<|endoftext|>b <|startoftext|>", "y" * 5000, "tab\t two  spaces \x1c end "]


def test_simple8b_round_trip():
    draw = np.random.default_rng(1)
    for n in (0, 1, 1023, 1024, 1025, 4000):
        for v in (np.zeros(n, np.uint64), draw.integers(0, 50257, n).astype(np.uint64), draw.integers(0, 2**64, n, dtype=np.uint64)):
            words, firsts, escaped = simple8b.encode(v)
            assert (simple8b.decode(words, n, firsts, escaped) == v).all()
            for b in range(len(firsts)):
                assert (simple8b.decode(words, n, firsts, escaped, b) == v[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()


def _ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(frame(spark, texts)).collect()}
    for k, x in enumerate(texts):
        assert got[k] == (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids))


def test_coded_files(spark, texts):
    want, start = {}, 0
    for k, own in enumerate(_ids(texts)):
        want[k] = (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    got = {r[0]: tuple(r)[1:] for r in simple8b.coded_round_trip(frame(spark, texts)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    assert got == want


def test_packing(spark, texts):
    rows = packing.pack_documents(frame(spark, [*texts, "word " * 6000]), capacity=256).collect()
    ids = _ids([*texts, "word " * 6000])
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"] and (r["piece"] == 0 or r["length"] == 256)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1].tolist()] and ends[-1] <= 256


def test_moves_are_best_fit():
    draw = np.random.default_rng(5)
    for _ in range(50):
        lengths = draw.integers(1, 101, draw.integers(0, 300)).tolist()
        gaps, opened = [], 0
        for n in sorted(lengths, reverse=True):
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - n)
            else:
                opened += 1
                gaps.append(100 - n)
        moves = packing.plan_moves(Counter(lengths), 100)
        used, counts = set(), Counter(lengths)
        for n, total in counts.items():
            own = [m for m in moves if m[0] == n]
            for rank in range(total):
                m = [x for x in own if x[1] <= rank][-1]
                used.add(m[2] + (rank - m[1]) // m[3])
        assert len(used) == opened


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def _components(texts, width, percent):
    sets = []
    for t in texts:
        w = _words(t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(len(s), find(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, texts, width, percent):
    draw = np.random.default_rng(9)
    base = [f"v{k}" for k in draw.integers(0, 50, 150)]
    near = []
    for _ in range(70):  # one large group, so that both ways of the second step run
        own = list(base)
        for at in draw.integers(0, 150, draw.integers(0, 8)):
            own[at] = f"z{draw.integers(0, 99)}"
        near.append(" ".join(own))
    rows = [*texts, *near]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows), width=width, percent=percent).collect()}
    assert [got[k] for k in range(len(rows))] == _components(rows, width, percent)


def test_near_duplicates_odd_rows(spark):
    rows = frame(spark, ["a b c d", "a b c d", "q r s t"], [None, 5, 5])
    got = sorted(((r["doc_id"] or -1), r["component_id"]) for r in near_dedup.near_duplicates(rows).collect())
    assert got == [(-1, None), (5, 5), (5, 5)]
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_mixing(spark, texts):
    rows = [*texts * 5]
    got = mixing.mixed_counts(frame(spark, rows)).collect()
    sizes = {k: len(_words(t)) for k, t in enumerate(rows)}
    assert all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r["source_size"], r["target"]] += r["taken"]
        target[r["source_size"], r["target"]] = r["target"]
    assert all(abs(taken[k] - target[k]) <= 1 for k in taken)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_split_tree(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 37), (2, 0), (3, 411)], "ord int, n long")
    leaves = mixing.split_tree(quotas, 3).collect()
    own, shards = Counter(), Counter()
    for r in leaves:
        own[r["ord"]] += r["n"]
        shards[r["shard"]] += r["n"]
        assert r["n"] >= 0
    assert own == Counter({0: 1000, 1: 37, 3: 411}) and max(shards.values()) - min(shards.values()) <= 3


def _vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(k, draw.normal(0, 0.2, 16).tolist()) for k in range(600)] + [(k, [0.5] * 16) for k in range(600, 640)]
    rows += [(700, None), (701, [float("nan")] * 16), (702, [None] * 16), (703, [0.0] * 16), (None, [1.0] * 16)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_exact_top_k(spark):
    rows, df = _vectors(spark)
    v = {i: np.floor(1024 * np.array(x)) for i, x in rows[:640]} | {703: np.zeros(16)}
    got = {}
    for r in exact_topk.exact_top_k(df, lambda i: i % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in range(0, 700, 100):
        if q in v:
            assert got[q] == sorted(((i, int(v[q] @ x)) for i, x in v.items() if i != q), key=lambda p: (-p[1], p[0]))[:10]


def test_ann_recall(spark):
    """Of clustered vectors, each query's candidates for exact ranking are a 250th part of all rows."""
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 1, (300, 32))
    x = (centres[draw.integers(0, 300, 50_000)] + draw.normal(0, 0.15, (50_000, 32))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))})).repartition(4)
    got = {}
    for r in ann.nearest(df, lambda i: i % 1000 == 0).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits, y = 0, x.astype(float)
    for q in range(0, len(x), 1000):
        far = np.sqrt(((y - y[q]) ** 2).sum(1))
        far[q] = np.inf
        hits += len(set(np.argsort(far)[:10].tolist()) & set(got[q]))
        assert all(abs(far[i] - d) < 1e-9 for i, d in got[q].items())
    assert hits >= 0.95 * 10 * 50


def test_ann_finds_the_nearest_inside_tight_far_and_uneven_groups(spark):
    """Rows that share their codes with thousands of others, lie far from the origin, or differ in size by orders of magnitude."""
    draw = np.random.default_rng(6)
    tight = draw.normal(0, 1, (90, 12))[draw.integers(0, 90, 18_000)] + draw.normal(0, 1e-4, (18_000, 12))
    far = 1e5 + draw.normal(0, 1, (6000, 12))
    uneven = draw.normal(0, 1, (6000, 12)) * 10.0 ** draw.uniform(-4, 3, (6000, 1))
    for x in (tight, far, uneven):
        df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64()))})).repartition(4)
        got = {}
        for r in ann.nearest(df, lambda i: i % 600 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        for q in range(0, len(x), 600):
            distance = np.sqrt(((x - x[q]) ** 2).sum(1))
            distance[q] = np.inf
            assert got[q] == np.lexsort((np.arange(len(x)), distance))[:10].tolist()


def test_repeated_queries_have_a_list_each(spark):
    rows = [(k, [float(k), 1.0]) for k in range(1, 30)] + [(100, [3.0, 1.0]), (100, [9.0, 1.0]), (100, [9.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    is_query = lambda i: i == 100
    for made in (exact_topk.exact_top_k(df, is_query), ann.nearest(df, is_query)):
        got = made.collect()
        assert sorted(r["rank"] for r in got) == sorted([*range(1, 11)] * 3)
    assert sorted(r["vec_id"] for r in got if r["rank"] == 1) == [3, 9, 9]
    assert exact_topk.exact_top_k(df.limit(0), is_query).count() == 0 and ann.nearest(df.limit(0), is_query).count() == 0


def test_licences(spark):
    rows = ["Foo.\nReleased under the MIT License.", "no licence", None, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "Licensed under CC BY-NC 4.0.\nplain"]
    got = {r["doc_id"]: r["licences"] for r in licences.scan_licences(frame(spark, rows)).collect()}
    assert got[0] == "MIT" and got[1] == "" and got[2] == "" and got[3] == "GPL-3.0" and got[4] == "CC-BY-NC-4.0"
    for s in licences.SENTENCES.values():
        assert any(t in s for t in licences.TRIGGERS), s


MIT = """MIT License

Copyright (c) 2024 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD2 = """Copyright (c) 2024, Some One

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """/* Copyright (C) 2024 Some One
 *
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version {} of the License, or
 * (at your option) any later version.
 */"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""


def test_whole_licence_texts(spark):
    flat = GPL.format(3).replace("\n *", "").partition("One ")[2]
    rows = [MIT, BSD2, BSD3, GPL.format(2), GPL.format(3), flat, MPL, MIT.replace("\n", "\r\n"), "We are not licensed under the\nMIT License yet", "x" + "\n " * 50_000 + "license" + "#" * 50_000]
    got = {r["doc_id"]: r for r in licences.scan_licences(frame(spark, rows)).collect()}
    assert [got[k]["licences"] for k in range(8)] == ["MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "GPL-3.0", "MPL-2.0", "MIT"]
    assert got[0]["sentences"] == "mit-grant,mit-notice,mit-warranty,mit-liability" and got[8]["n_known"] == got[9]["n_known"] == 0


def test_lm_scores_tell_domains_apart(spark):
    draw = np.random.default_rng(1)
    a, b = (["%s%d" % (c, k) for k in range(30)] for c in ("red", "blue"))
    rows = [" ".join(draw.choice(a if k % 2 else b, 40)) for k in range(60)]
    docs = frame(spark, [*rows, None, ""])
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(docs, docs.filter("doc_id < 30 and doc_id % 2 = 1")).collect()}
    assert max(got[k]["score"] for k in range(31, 60, 2)) < min(got[k]["score"] for k in range(30, 60, 2))
    assert got[60]["n_tokens"] == 0 and got[61]["score"] == 0


def test_lm_scores_count_pairs_exactly(spark, texts, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK", 500, raising=False)
    draw = np.random.default_rng(6)
    wide = ["".join(chr(c) for c in draw.integers(33, 0x3000, 6000)) for _ in range(40)]  # pairs enough to share hashed buckets
    rows = [*texts, *wide]
    ids = [x[:-1] for x in _ids(rows)]
    docs = frame(spark, rows, [None, 7, 7, *range(3, len(rows))])
    got = lm_scoring.cross_entropy_difference(docs, docs.filter("doc_id % 3 = 0")).collect()
    size = lm_scoring.encoder(tokens.vocabulary("byte_bpe_50k.json")).library.get_vocab_size()

    def losses(own):
        pairs, alone, followed = Counter(), Counter(), Counter()
        for x in own:
            pairs.update(zip([None, *x], x))
            alone.update(x)
            followed.update([None, *x][: len(x)])
        share = lambda w: (alone[w] + 1) / (alone.total() + size)
        p = lambda h, w: 0.7 * pairs[h, w] / followed[h] + 0.3 * share(w) if followed[h] else share(w)
        return [float(np.mean([-np.log(p(h, w)) for h, w in zip([None, *x], x)])) if x else 0.0 for x in ids]

    near, far = losses([x for k, x in enumerate(ids) if k > 2 and k % 3 == 0]), losses(ids)
    key = lambda r: tuple(round(v, 6) for v in r)
    want = Counter(key((-1 if k == 0 else 7 if k < 3 else k, len(x), near[k], far[k])) for k, x in enumerate(ids))
    assert Counter(key((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["target_loss"], r["background_loss"])) for r in got) == want


def test_toxicity_held_out(spark):
    draw = np.random.default_rng(3)
    rows, kinds = [], []
    for k in range(400):
        own = [f"w{x}" for x in draw.integers(0, 400, 60)]
        if k % 4 == 0:
            own[10] = own[30] = ["idiot", "scum,", "Moron"][k % 3]
        rows.append(" ".join(own))
        kinds.append(int(k % 4 == 0))
    labels = spark.createDataFrame([(k, 1, t) for k, t in enumerate(kinds)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame(spark, [*rows, None, ""]), labels).collect()}
    aside = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] == (k in aside) for k in range(400))
    assert np.mean([got[k]["predicted"] == kinds[k] for k in aside]) > 0.9
    assert 0 <= got[400]["score"] <= 1 and len(got) == 402
    assert toxicity.toxicity(frame(spark, ["x"]), labels.limit(0)).first()["score"] == 0.0


def test_toxicity_of_a_text_alone():
    draw = np.random.default_rng(7)
    small = lambda *shape: draw.normal(0, 1, shape).astype(np.float32)
    shapes = [(w, toxicity.DIM, toxicity.FILTERS) for w in toxicity.WIDTHS]
    model = toxicity.Model(small(toxicity.BUCKETS, toxicity.DIM), [small(*x) for x in shapes], [small(toxicity.FILTERS) for _ in shapes], small(len(shapes) * toxicity.KEPT * toxicity.FILTERS), 0.0)

    def logits(texts):
        return model.logits(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))

    texts = ["", "a", "a b", "a b c", "", "idiot", "some words more", "idiot scum", "a b c d e f"]
    alone = [logits([x])[0] for x in texts]
    assert np.allclose(logits(texts), alone, atol=1e-3) and np.allclose(logits(texts[::-1]), alone[::-1], atol=1e-3)


ISC = """ISC License

Copyright (c) 2024, Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
LGPL = """ This library is free software; you can redistribute it and/or
 modify it under the terms of the GNU Lesser General Public
 License as published by the Free Software Foundation; either
 version 2.1 of the License, or (at your option) any later version."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""


def test_more_licence_texts(spark):
    rows = [ISC, LGPL, UNLICENSE, "# SPDX-License-Identifier: GPL-2.0-only\nx", "// SPDX-License-Identifier: BSL-1.0\nint x;", BSD3 + "\n" + BSD2, None, ""]
    got = {r["doc_id"]: r["licences"] for r in licences.scan_licences(frame(spark, rows)).collect()}
    assert [got[k] for k in range(8)] == ["ISC", "LGPL-2.1", "Unlicense", "GPL-2.0", "BSL-1.0", "BSD-3-Clause,BSD-2-Clause", "", ""]
    again = licences.scan_licences(frame(spark, [ISC, ISC], [None, None])).collect()
    assert [(r["doc_id"], r["licences"]) for r in again] == [(None, "ISC")] * 2 and licences.scan_licences(frame(spark, [])).count() == 0


def test_whole_licence_texts(spark):
    """Texts of this machine: a third clause that names another holder, bodies without their appendix, expressions."""
    import os

    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts here")
    body = lambda name: open(f"{folder}/{name}", errors="replace").read()
    apache = body("Apache-2.0")
    texts = {"BSD-3-Clause": body("BSD"), "LGPL-3.0": body("LGPL-3"), "CC0-1.0": body("CC0-1.0"), "Apache-2.0": apache[: apache.index("APPENDIX")], "MIT,Apache-2.0": "// SPDX-License-Identifier: (MIT OR Apache-2.0)\n"}
    for who in ("the author", "the copyright holders", "the organization"):
        texts[f"BSD-3-Clause {who}"] = body("BSD").replace("the University", who)
    texts["BSD-2-Clause"] = body("BSD")[: body("BSD").index("3. Neither")] + body("BSD")[body("BSD").index("THIS SOFTWARE") :]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts.values())], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.scan_licences(rows).collect()}
    assert got == {k: name.split(" ")[0] for k, name in enumerate(texts)}
