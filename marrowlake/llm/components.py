"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowlake.runtime import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # each neighbour larger than the node goes to the smallest of its neighbourhood
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); component is its smallest node.

    Large-star and small-star rounds alternate until the edge set stays as it is. The minimum of each
    neighbourhood is a pre-aggregated groupBy and is joined back, so a hub is split by the skew join
    and never collected. The lineage is cut every round. Self loops and repeated edges are
    harmless, null ends are dropped, no edges give no rows. Raises if most_rounds do not suffice.
    """
    now = cut(edges.select("a", "b").filter("a is not null and b is not null and a <> b").distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    mark = None
    for _ in range(most_rounds):
        now = cut(_small_star(_large_star(now)))
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (new := (seen["n"], seen["h"])) == mark:
            roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        mark = new
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
