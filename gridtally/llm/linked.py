"""Connected components of a table of links, with Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle

MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; a component is named by its smallest node.

    Alternating star steps: each node hands its larger neighbours (then its smaller ones) to the
    smallest node it knows, until nothing changes. Links stay a table of at most the given length;
    every round is written to the shared folder, which ends its lineage. Rounds grow with the
    logarithm of the longest chain. Self links and null ends do not count.
    """
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
    edges = settle(edges.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        # Large star: larger neighbours of x go to the least of x and its neighbours.
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"))
        large = both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = settle(large.where(F.col("v") != F.col("u")).distinct())
        # Small star: smaller neighbours of x, and x, go to the least of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where(F.col("u") != F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = settle(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct())
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("u").alias("node")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
