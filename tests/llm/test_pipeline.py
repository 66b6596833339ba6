"""The pipeline's stages on a small corpus: each stage's decisions, by brute force on its own input."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from cairnmap.llm import mixing
from cairnmap.llm.near_dedup import drop_near_duplicates
from cairnmap.llm.toxicity import drop_toxic

from .test_operators import DOCS, _components, _ids, _words


def test_stages(spark, tmp_path):
    draw = np.random.default_rng(8)
    texts, kinds = [], []
    for k in range(480):
        own = [f"w{x}" for x in draw.integers(0, 300, 50)]
        if k % 4 == 0:
            own[5] = own[25] = own[35] = "idiot"
        texts.append(" ".join(own))
        kinds.append(int(k % 4 == 0))
    texts += [texts[1], texts[1] + " end", texts[2], "", None]
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), "n", "i") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, t) for k, t in enumerate(kinds)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)

    def stage(k, docs):
        name, run = corpus_pipeline.STAGES[k]
        run(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    clean = stage(0, docs)
    assert clean.columns == docs.columns
    kept = {r["doc_id"] for r in clean.collect()}
    bad = {k for k, t in enumerate(kinds) if t}
    assert len(bad & kept) <= 0.2 * len(bad) and len(set(range(len(texts))) - bad - kept) <= 0.1 * len(texts)

    single = stage(1, clean)
    ordered = sorted((r["doc_id"], r["text"]) for r in clean.collect()) if None not in kept else []
    groups = _components([t for _, t in ordered], 5, 80)
    assert sorted(r["doc_id"] for r in single.collect()) == [ordered[k][0] for k, (_, g) in enumerate(groups) if g == k]

    mixed = stage(2, single)
    want = {r["doc_id"]: r["taken"] for r in mixing.mixed_counts(single).collect()}
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(_words(r["text"]))
    assert got == {k: n for k, n in want.items() if n}

    packed = stage(3, mixed).collect()
    assert sum(r["length"] for r in packed) == sum(map(len, _ids([r["text"] for r in mixed.collect()])))
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and corpus_pipeline.run(spark, sf).count() == len(packed)


def test_mixing_keeps_null_and_repeated_ids(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(10 + 40 * k)) for k in range(12)]
    ids = [None, None, 5, 5, 5, *range(6, 13)]
    rows = [(i, t, "en", f"s{k % 2}", len(t), "n", "i") for k, (i, t) in enumerate(zip(ids, texts))]
    docs = spark.createDataFrame([*rows, rows[2], rows[2], (None, None, None, None, None, None, None)], DOCS)
    taken, got = {}, {}
    for r in mixing.mixed_counts(docs).collect():
        taken[r["doc_id"], r["size"]] = taken.get((r["doc_id"], r["size"]), 0) + r["taken"]
    sizes = {t.split("x")[0]: len(t.split()) for t in texts}
    for r in mixing.mixed_documents(docs).collect():
        assert {w.split("x")[0] for w in r["text"].split()} == {r["text"].split("x")[0].strip()}
        key = r["doc_id"], sizes[r["text"].split("x")[0].strip()]
        got[key] = got.get(key, 0) + len(r["text"].split())
    assert got == {k: n for k, n in taken.items() if n}


def test_toxicity_drops_each_row_by_its_text(spark):
    draw = np.random.default_rng(8)
    rows = []
    for k in range(480):
        own = [f"w{x}" for x in draw.integers(0, 300, 50)]
        if k % 4 == 0:
            own[5] = own[25] = own[35] = "idiot"
        rows.append(" ".join(own))
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(480)], "doc_id long, quality int, toxic int")
    odd = [(None, rows[4]), (None, rows[1]), (900, rows[8]), (900, rows[2]), (900, rows[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "n", "i") for i, t in [*enumerate(rows), *odd]], DOCS)
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in drop_toxic(docs, labels).filter("doc_id is null or doc_id = 900").collect())
    assert kept == sorted([(-1, rows[1]), (900, rows[2]), (900, rows[2])])


def test_near_copies_go_row_by_row(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(5, "completely different text here now"), (5, long), (3, long), (3, long), (None, long), (None, None), (7, ""), (7, ""), (9, long + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "n", "i") for i, t in rows], DOCS)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in drop_near_duplicates(docs).collect() if r["text"])
    assert kept == [("3", long), ("5", rows[0][1]), ("None", long)] and drop_near_duplicates(docs).count() == 6
    assert drop_near_duplicates(docs.limit(0)).count() == 0
