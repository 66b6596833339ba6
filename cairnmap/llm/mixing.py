"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 7). DataFrame functions only.

A source's documents, in the order of a hash of id and text, form one stream of words, cut to blocks of ``BLOCK_WORDS`` words. A source
whose target is q words gives whole passes over its stream and, for the rest, the first blocks of a permutation of
its block numbers (an affine map modulo their number), so blocks drawn in one pass are disjoint; the last block
drawn is cut, and the words taken are the target's, rounded.

The blocks drawn (the quotas) are dealt to output shards by a binary tree: a node passes half of its blocks, to the block, to its
left child, and how many come from each source is drawn from the multivariate hypergeometric law, source by source, by
inverting the cumulative hypergeometric law at a hash of (seed, level, node, source). A leaf's quotas are ranges of
each source's draws. Within a shard spans are ordered by a hash, their place.

Stream positions are prefix sums over (source, chunk) totals and then within chunks of about ``CHUNK_ROWS`` rows, so a
source of any share is spread over tasks. The tree's state is one row per node with one entry per source: it grows
with sources times shards, not with rows.

Defined results: a null text has size 0 and gives nothing; null ids are kept; the null source is a source of its own, last in order;
repeated rows are rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, measured, stored

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, CHUNK_ROWS, SHARD_WORDS = 1024, 2000, 1 << 22
#: Levels of the splitting tree at least: a small mix is dealt to eight shards.
LEAST_LEVELS = 3
#: Multipliers of the block permutation: primes, of which one at least is coprime to any number of blocks below their product.
STRIDES = (1_000_003, 1_000_033)
#: Columns that ``mixed_documents`` adds for the time being: the row's key and its run.
ROW, RUN = "_mix_row", "_mix_run"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, ord, source_size, target. ``weights`` repeat over the sources by code point, null last.

    Targets share ``share`` times all words by weight; what would pass ``most`` times a source's size is reshared by
    weight among the others. The level at which that settles is read off the sources sorted by size over weight.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("ord") % len(weights)) + 1).cast("int"))
    rows = total.withColumn("ord", F.row_number().over(by_name) - 1).withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("w"))
    filled = Window.orderBy("ratio", "ord").rowsBetween(Window.unboundedPreceding, 0)
    all_words, all_weight = F.sum("source_size").over(everything) * share, F.sum("w").over(everything)
    # the level if this source and all with smaller ratios stop at their caps
    level = (all_words - F.sum("cap").over(filled)) / F.nullif(all_weight - F.sum("w").over(filled), F.lit(0.0))
    rows = rows.withColumn("level", level).withColumn("all_words", all_words).withColumn("all_weight", all_weight)
    after = Window.orderBy("ratio", "ord")
    open_level = F.coalesce(F.lag("level").over(after), F.col("all_words") / F.col("all_weight"))
    rows = rows.withColumn("open_level", open_level).withColumn("stops", F.col("ratio") <= F.col("open_level"))
    settled = F.min(F.when(~F.col("stops"), F.struct("ratio", "open_level"))).over(everything)["open_level"]
    return rows.withColumn("settled", settled).select("source", "ord", "source_size", F.when(F.col("stops") | F.col("settled").isNull(), F.col("cap")).otherwise(F.least(F.col("settled") * F.col("w"), F.col("cap"))).alias("target"))


def _hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL of one draw: how many of ``drawn`` out of ``total`` items are among the ``marked`` ones, at a given quantile.

    Weights follow the ratio of neighbouring probabilities over the part of the support within eight standard
    deviations (and two more) of the mean.
    """
    n, k, m = (f"cast({x} as double)" for x in (total, drawn, marked))
    mean = f"({k} * {m} / {n})"
    spread = f"sqrt(greatest(0D, {k} * ({m} / {n}) * (({n} - {m}) / {n}) * (({n} - {k}) / greatest(1D, {n} - 1))))"
    low, high = f"greatest(0L, {drawn} - ({total} - {marked}))", f"least({marked}, {drawn})"
    span = f"named_struct('a', greatest({low}, cast(floor({mean} - 8 * {spread}) as bigint) - 2), 'b', least({high}, cast(ceil({mean} + 8 * {spread}) as bigint) + 2))"
    ratio = f"(({m} - i) * ({k} - i) / ((i + 1D) * ({n} - {m} - {k} + i + 1D)))"
    weight = f"aggregate(sequence(r.a, r.b), named_struct('w', 1D, 't', 0D), (z, i) -> named_struct('w', z.w * {ratio}, 't', z.t + z.w), z -> z.t)"
    found = f"aggregate(sequence(r.a, r.b), named_struct('w', 1D, 'c', 0D, 'x', -1L), (z, i) -> named_struct('w', z.w * {ratio}, 'c', z.c + z.w, 'x', if(z.x < 0 and z.c + z.w >= {uniform} * t, i, z.x)), z -> if(z.x < 0, r.b, z.x))"
    return f"if({total} = 0 or {drawn} = 0, 0L, transform(array({span}), r -> transform(array({weight}), t -> {found})[0])[0])"


def split_tree(quotas: DataFrame, levels: int, seed: int = 11) -> DataFrame:
    """quotas: ord, n (blocks). Returns shard, ord, n: the leaves of a tree of ``levels`` levels; every node's halves differ by one block at most."""
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("ord", F.col("n").cast("long").alias("n")))).alias("own")).select(F.lit(0).cast("long").alias("node"), "own")
    for level in range(levels):
        uniform = f"(cast(pmod(xxhash64({seed}, {level}, node, x.ord), 9007199254740992L) as double) / 9007199254740992D)"
        draw = _hypergeometric("s.total", "x.n", "s.half", uniform)
        step = f"transform(array({draw}), y -> named_struct('total', s.total - x.n, 'half', s.half - y, 'out', concat(s.out, array(y))))[0]"
        total = "aggregate(own, 0L, (s, x) -> s + x.n)"
        left = f"aggregate(own, named_struct('total', {total}, 'half', {total} div 2, 'out', cast(array() as array<bigint>)), (s, x) -> {step}, s -> s.out)"
        nodes = nodes.select("node", "own", F.expr(left).alias("left"))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.expr("transform(own, (x, i) -> named_struct('ord', x.ord, 'n', left[i]))").alias("own")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("transform(own, (x, i) -> named_struct('ord', x.ord, 'n', x.n - left[i]))").alias("own")),
        )
        nodes = nodes.select(F.explode(halves).alias("h")).select("h.node", "h.own")
        if level % 4 == 3:
            nodes = cut(nodes.repartition("node"))
    return nodes.select(F.col("node").alias("shard"), F.explode("own").alias("x")).select("shard", "x.ord", "x.n")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents' rows (row, doc_id, size, source_size, target) and the mix (row, doc_id, shard, place, pass, first, n_words).

    A span is ``n_words`` words of the row's text from word ``first`` on; spans sorted by shard and place are the mix.
    ``row_col``: a stored unique key of the rows to be ``row``; else one is made.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    order = F.xxhash64(F.lit(seed), "doc_id", "text").alias("order")
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), order)
    rows, seen = measured(rows, "sizes", n=F.count(F.lit(1)))
    targets = source_targets(rows, weights, share, most)
    quota, blocks = F.round("target").cast("long"), F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long")
    sources = targets.withColumn("quota", quota).withColumn("blocks", blocks)
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    # of each source: the permutation's two numbers, the words its last block lacks, and where that block is in the permutation
    stride = F.when(F.col("blocks") % STRIDES[0] == 0, STRIDES[1]).otherwise(STRIDES[0]).cast("long")
    turn = lambda b: F.pmod(b * F.col("stride") + F.col("shift"), F.greatest(F.col("blocks"), F.lit(1)))
    sources = sources.withColumn("stride", stride).withColumn("shift", F.pmod(F.xxhash64(F.lit(seed), "ord"), F.greatest(F.col("blocks"), F.lit(1))))
    sources = cut(sources.withColumn("short", F.col("blocks") * BLOCK_WORDS - F.col("source_size")).withColumn("last_turn", turn(F.col("blocks") - 1)))

    chunks = max(1, -(-seen["n"] // CHUNK_ROWS))
    rows = rows.withColumn("chunk", F.pmod(F.col("order"), F.lit(chunks)))
    per_chunk = rows.groupBy("source", "chunk").agg(F.sum("size").alias("n"))
    before = per_chunk.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    within = Window.partitionBy("source", "chunk").orderBy("order", "doc_id", "size", "row")
    placed = rows.withColumn("inner", F.sum("size").over(within) - F.col("size"))
    same = lambda other: placed["source"].eqNullSafe(other["source"])
    placed = placed.join(before, same(before) & (placed["chunk"] == before["chunk"])).drop(before["source"]).drop(before["chunk"])
    placed = placed.withColumn("start", F.col("before") + F.col("inner")).select("row", "doc_id", "source", "size", "start")
    placed = placed.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    placed = stored(placed, "placed")

    # pieces of documents by block, and how many words of each the last, partial pass takes
    touched = F.sequence(F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS))
    pieces = placed.filter("size > 0").withColumn("block", F.explode(touched))
    low = F.greatest("start", F.col("block") * BLOCK_WORDS)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    pieces = pieces.withColumn("low", low).withColumn("high", high).withColumn("turn", turn(F.col("block")))
    earlier = F.col("turn") * BLOCK_WORDS - F.when(F.col("turn") > F.col("last_turn"), F.col("short")).otherwise(0)
    until = F.col("block") * BLOCK_WORDS + F.greatest(F.lit(0), F.col("rest") - earlier)
    pieces = pieces.withColumn("until", F.least("high", until)).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    pieces = pieces.withColumn("end", F.when(F.col("pass") < F.col("passes"), F.col("high")).otherwise(F.col("until"))).filter("end > low")
    pieces = pieces.withColumn("draw", F.col("pass") * F.col("blocks") + F.col("turn"))

    # blocks drawn by source: whole passes, and those of the partial one (where the short block may be among them)
    whole = F.ceil(F.col("rest") / BLOCK_WORDS).cast("long")
    with_short = F.ceil((F.col("rest") + F.col("short")) / BLOCK_WORDS).cast("long")
    partial = F.when(F.col("rest") == 0, 0).when(F.col("last_turn") < whole, with_short).otherwise(whole)
    quotas = sources.filter("quota > 0").select("ord", (F.col("passes") * F.col("blocks") + F.least(F.col("blocks"), partial)).alias("n"))
    words = sources.agg(F.sum("quota")).first()[0] or 0
    levels = max(LEAST_LEVELS, (-(-words // SHARD_WORDS) - 1).bit_length())
    leaves = split_tree(quotas, levels, seed)
    leaves = leaves.withColumn("first_draw", F.sum("n").over(Window.partitionBy("ord").orderBy("shard")) - F.col("n")).filter("n > 0")
    # a leaf's range of draws is found by an equality on (source, group of draws) and a range check
    group = max(1, SHARD_WORDS // BLOCK_WORDS // 8)
    leaves = leaves.withColumn("grp", F.explode(F.sequence(F.floor(F.col("first_draw") / group), F.floor((F.col("first_draw") + F.col("n") - 1) / group))))
    leaves = leaves.select(F.col("ord").alias("leaf_ord"), "grp", "shard", "first_draw", F.col("n").alias("leaf_n"))
    dealt = pieces.withColumn("of", F.floor(F.col("draw") / group)).join(leaves, (F.col("ord") == F.col("leaf_ord")) & (F.col("of") == F.col("grp")) & F.col("draw").between(F.col("first_draw"), F.col("first_draw") + F.col("leaf_n") - 1))
    spans = dealt.select("row", "doc_id", "shard", F.xxhash64(F.lit(seed), "ord", "pass", "low").alias("place"), "pass", (F.col("low") - F.col("start")).alias("first"), (F.col("end") - F.col("low")).alias("n_words"))
    return placed.select("row", "doc_id", "size", "source_size", "target"), spans


def mixed_counts(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken, parts of every row: ``parts`` are the row's spans of the mix (shard, place, pass, first,
    n_words), sorted, and ``taken`` their words. The mix is all parts by shard and place; a row without parts has an empty array."""
    rows, spans = mix(docs, seed=seed)
    own = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("shard", "place", "pass", "first", "n_words"))).alias("parts"))
    none = F.array().cast("array<struct<shard:bigint,place:bigint,pass:bigint,first:bigint,n_words:bigint>>")
    joined = rows.join(own, "row", "left").withColumn("parts", F.coalesce("parts", none))
    return joined.select("doc_id", "size", "source_size", "target", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n_words"]).alias("taken"), "parts")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of documents: one row for every run of words taken in one pass, whole texts where all is taken.

    Runs of a row that follow each other in a pass are joined again, so a document is cut only where the target cuts it. A run goes to the
    shard and place of its first span; every output partition is in the order of shards and places.
    """
    keyed = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    rows, spans = mix(keyed, row_col=ROW)
    ordered = Window.partitionBy("row", "pass").orderBy("first")
    new = (F.col("first") != F.coalesce(F.lag(F.col("first") + F.col("n_words")).over(ordered), F.lit(-1))).cast("int")
    runs = spans.withColumn("new", new).withColumn("run", F.sum("new").over(ordered))
    runs = runs.groupBy("row", "pass", "run").agg(F.min(F.struct("first", "shard", "place")).alias("at"), F.sum("n_words").alias("n_words"))
    runs = runs.join(rows.select("row", "size"), "row")
    runs = runs.select(F.col("row").alias(ROW), F.struct("at.first", "n_words", "size", "at.shard", "at.place").alias(RUN))
    first, n_words = F.col(f"{RUN}.first"), F.col(f"{RUN}.n_words")
    cut_text = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), (first + 1).cast("int"), n_words.cast("int")), "")
    joined = keyed.join(runs, ROW).sortWithinPartitions(f"{RUN}.shard", f"{RUN}.place", ROW, f"{RUN}.first").withColumn("text", F.when(n_words == F.col(f"{RUN}.size"), F.col("text")).otherwise(cut_text))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast("long"))
    return joined.select(*docs.columns)
