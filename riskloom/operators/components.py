"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import cut_lineage


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): each node of ``edges`` with the least node it is connected to.

    A node's neighbours are never gathered: each step takes their minimum, which
    combines before the shuffle, and joins it back. Rounds grow with the logarithm
    of the longest path. Each one is checkpointed, so a lost executor repeats one
    round at most.
    """
    a, b = F.col(left), F.col(right)
    current = cut_lineage(edges.filter(a != b).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).distinct())
    print_before = None
    while True:  # a round that changes nothing comes: minima only fall
        current = cut_lineage(_small_star(_large_star(current)))
        print_now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if print_now == print_before:
            break
        print_before = print_now
    roots = current.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    return current.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's greater neighbours to the least node around it."""
    both = edges.select("v", "m").union(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
    least = both.groupBy("v").agg(F.min("m").alias("least")).select("v", F.least("v", "least").alias("least"))
    moved = both.join(least, "v").filter(F.col("m") > F.col("v"))
    return moved.select(F.col("m").alias("v"), F.col("least").alias("m")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them."""
    least = edges.groupBy("v").agg(F.min("m").alias("least"))
    moved = edges.join(least, "v").select(F.col("m").alias("v"), F.col("least").alias("m"))
    own = least.select("v", F.col("least").alias("m"))
    return moved.filter(F.col("v") != F.col("m")).union(own).distinct()
