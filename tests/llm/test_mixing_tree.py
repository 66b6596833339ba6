"""The mix against an independent water-fill, and the splitting tree's law and effect."""

from __future__ import annotations

import numpy as np

from cairnmap.llm import mixing

WEIGHTS = (3, 1, 2)


def filled(sizes, share=1.5, most=2.0):
    """Targets by bisection of the level: each source gets level times weight, its cap at most."""
    w = np.array([WEIGHTS[k % 3] for k in range(len(sizes))], float)
    caps, want = most * np.array(sizes, float), share * sum(sizes)
    low, high = 0.0, float(caps.max() + 1)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if np.minimum(level * w, caps).sum() < want else (low, level)
    return np.minimum(high * w, caps)


def corpus(spark, seed, n=900):
    """A hot source, small ones that stop at their caps, the null source, null ids, repeated rows, clashing names."""
    r = np.random.default_rng(seed)
    names = ["a", "b", "c", "d", "e", None]
    rows = []
    for k in range(n):
        source = names[int(r.choice(6, p=[0.5, 0.2, 0.02, 0.18, 0.06, 0.04]))]
        rows.append((k, source, " ".join("w" * int(r.integers(1, 5)) for _ in range(int(r.integers(0, 60))))))
    rows += [(None, "a", "x y"), rows[3], rows[3], (n, "f", None), (n + 1, "g", ""), (n + 2, None, "long " * 30_000)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as row", "3 as shard", "'p' as parts", "4 as n")


def test_targets_equal_a_plain_water_fill(spark):
    rows, docs = corpus(spark, 1)
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(order, filled([sizes[s] for s in order])))
    got = mixing.mixed_counts(docs).collect()
    by = {}
    for r in got:
        by.setdefault((r["source_size"], round(r["target"], 3)), []).append(r)
    assert sorted(by) == sorted({(sizes[s], round(want[s], 3)) for s in order})
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    taken = {}
    for r in got:
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
    assert all(abs(taken[sizes[s]] - want[s]) <= 1 for s in order if sizes[s])


def test_parts_come_from_the_tree(spark, monkeypatch):
    """Shards hold equal numbers of blocks, parts of a pass don't overlap, another seed deals other shards but no other target."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 64)
    _, docs = corpus(spark, 2)
    got = mixing.mixed_counts(docs).collect()
    again, other = (mixing.mixed_counts(docs.repartition(5), seed=s).collect() for s in (11, 12))
    tidy = lambda rows: sorted((str(r["doc_id"]), r["size"], r["taken"], str(r["parts"])) for r in rows if r["doc_id"] not in (3, None))
    assert tidy(got) == tidy(again) and tidy(got) != tidy(other)
    assert sorted((str(r["doc_id"]), r["size"], r["target"]) for r in got) == sorted((str(r["doc_id"]), r["size"], r["target"]) for r in other)
    words = {}
    for r in got:
        assert r["taken"] == sum(p["n_words"] for p in r["parts"])
        for n in {p["pass"] for p in r["parts"]}:
            spans = sorted((p["first"], p["first"] + p["n_words"]) for p in r["parts"] if p["pass"] == n)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= r["size"]
        for p in r["parts"]:
            words[p["shard"]] = words.get(p["shard"], 0) + p["n_words"]
    assert sorted(words) == list(range(8)) and max(words.values()) < 1.15 * min(words.values())


def test_the_law_of_a_split(spark):
    """400 sources of ten blocks each: halves are exact, a source's share varies as ten draws without return."""
    leaves = mixing.split_tree(spark.range(400).selectExpr("cast(id as int) as ord", "10L as n"), 1).collect()
    left = np.array([r["n"] for r in leaves if r["shard"] == 0])
    assert left.sum() == 2000 and len(left) == 400 and left.min() >= 0 and left.max() <= 10
    assert abs(left.var() - 10 * 0.25 * 3990 / 3999) < 0.5
    assert {(r["shard"], r["ord"]): r["n"] for r in leaves if r["shard"] == 1} == {(1, k): 10 - n for k, n in enumerate(left)}


def test_empty_table(spark):
    assert mixing.mixed_counts(corpus(spark, 3, 5)[1].limit(0)).collect() == []
