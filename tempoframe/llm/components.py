"""Connected components of a large edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoframe.llm.shared import staged


def _least(pairs: DataFrame) -> DataFrame:
    """u, m: the least of u and its partners v; counted before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = staged(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = _least(edges)
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label for each node of ``edges`` (a, b long); label is the least node that can be reached.

    Each round is a written table, so that a lost executor costs one step. Self-links are ignored.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _print(now)
    while seen[0]:
        now = staged(_small_star(staged(_large_star(now))))
        if (new := _print(now)) == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
