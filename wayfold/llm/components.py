"""Connected components by alternating large-star and small-star steps.

Each step is two aggregations with partial sums and two joins; the edge table is cut into the
shared folder after it, so that plans stay short and executors may be lost.  No node's neighbours
are ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, discard


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst") % 1_000_003), F.sum(F.xxhash64("dst", "src") % 999_983)).first())


def components(links: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links(src, dst)`` that is not its own."""
    edges = cut(links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "links")
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    for _ in range(most_steps):
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # Minima are cut so that both sides of the joins are plain exchanges, which a hot node may be split in.
        low = cut(both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")), "low")
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        large = cut(large, "large-star")
        least = cut(large.groupBy("src").agg(F.min("dst").alias("m")), "low")
        small = large.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        after = cut(small.unionByName(least.select("src", F.col("m").alias("dst"))).distinct(), "small-star")
        discard(low, large, least, edges)
        edges, now = after, _state(after)
        if now == before:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {most_steps} steps")
