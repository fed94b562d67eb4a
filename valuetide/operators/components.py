"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuetide.session import cut_lineage


def _least(links: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself, beside each link; a node's links are joined, never gathered."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node with a link; root is the smallest node that links reach.

    ``links``: a, b (of one orderable type; self links and repeats are harmless). Alternates two
    steps until nothing changes: larger neighbours move to a node's smallest one, then smaller
    ones do. Each round is written, so plans stay short and a lost executor costs one round.
    """
    now = cut_lineage(links.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct())
    known = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        now = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == known:
            break
        known = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
