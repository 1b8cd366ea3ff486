"""Connected components of a graph of 64-bit nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.session import cut, dropped


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(a long, b long)``; the root is the least node of its component.

    Each round ties every node to the least of its neighbourhood (Kiveris et al., 2014). A node
    with very many neighbours is a key of joins and of sums with map-side combining only, so no
    task has to hold its neighbourhood. Each round's edges are written out, which cuts lineage.
    The loop ends when a round changes nothing; the limit of rounds is far above the
    logarithm-squared bound, and passing it is an error, not a wrong result.
    """
    oriented = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = cut(oriented(edges), "edges"), None
    for _ in range(rounds):
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (told["n"], told["h"]) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = (told["n"], told["h"])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = oriented(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b")))
        last, now = now, cut(oriented(small), "edges")
        dropped(last)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
