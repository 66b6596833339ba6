"""Connected components by alternating large-star and small-star rounds on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import measured

def _kept(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The stored edges, their number and a digest of them."""
    return measured(edges, "edges", n=F.count(F.lit(1)), digest=F.bit_xor(F.xxhash64("a", "b")))


def _with_least(edges: DataFrame, key: str, other: str, salts: int) -> DataFrame:
    """edges with ``m``, the smallest ``other`` of their ``key``. A key's edges are dealt by key and salt, so that a hub of
    any size is spread; its minimum goes to those salts only that it has."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(salts)))
    least = salted.groupBy(key).agg(F.min(other).alias("m"), F.collect_set("salt").alias("salts"))
    return salted.join(least.select(key, "m", F.explode("salts").alias("salt")), [key, "salt"]).drop("salt")


def _large_star(edges: DataFrame, salts: int) -> DataFrame:
    """Each node's larger neighbours are attached to the smallest node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, "a", "b", salts).filter("b > a").select(F.least("a", "m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame, salts: int) -> DataFrame:
    """edges have a < b: each node and its smaller neighbours are attached to the smallest of them."""
    moved = _with_least(edges, "b", "a", salts)
    return moved.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("e")).select("e.a", "e.b").filter("a < b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b of any ordered type. Returns node, label (smallest node of the component) of every linked node.

    A round is one job that writes its edges to the shared folder, so a lost executor costs part of a round; rounds go
    on until one changes no edge, told by the number and a digest of the edges. Salts grow with the square root of the
    edges, so a hub's share of a task does too. Self-links and nulls are ignored.
    """
    first = links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, now = _kept(first)
    while now["n"]:
        salts, before = max(1, round(now["n"] ** 0.5)), now
        edges, now = _kept(_small_star(_large_star(edges, salts), salts))
        if now == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
