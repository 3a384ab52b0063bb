"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import staged


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of a node is tied to its smallest neighbour. Small: every smaller one, and the node itself."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = staged(near.groupBy(F.col("u").alias("u_")).agg(F.least(F.min("v"), F.col("u_")).alias("m")), "least-neighbours")
    tied = near.join(least, F.col("u") == F.col("u_"))
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u_").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, component (its smallest node) for all nodes of links (a, b); nodes without links are left out.

    Each round is written to the shared folder, so no plan grows with the rounds and a lost executor
    repeats one round at most. Stars end as soon as a round changes nothing.
    """
    now = staged(links.select("a", "b").filter("a <> b").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        now = staged(_star(staged(_star(now, True), "large-star"), False), "small-star")
        # sums of hashes tell whether the set of links has changed
        got = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if got == seen:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = got
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
