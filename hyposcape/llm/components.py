"""Connected components of a link table by alternating star operations, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame) -> DataFrame:
    """Large star: every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.where("b > a").join(common.dealt(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """Small star (a > b): u and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(common.dealt(least), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a long, b long) -> (node, root): root is the smallest node reachable; nodes without links are absent.

    Nulls and self links are ignored, repeated links count once, an empty table gives an empty one. Each round is two
    shuffles by node with sums combined before the shuffle; a node with very many links is a skewed join that adaptive
    execution splits. Rounds end when a round changes nothing (counted by a checksum); ``max_rounds`` only guards against
    a fault and raises, it never returns a partial answer. Each round's links are a scratch table, the previous is deleted.
    """
    edges = common.scratch(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    for _ in range(max_rounds):
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        new = common.scratch(_small_stars(_stars(edges)), "links")
        common.delete(edges)
        edges = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
