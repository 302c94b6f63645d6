"""Connected components of an edge list, by alternating large-star and small-star rounds on DataFrames.

Every round is two aggregations and two joins over the edges and is written to the shared checkpoint folder;
only the number of changed edges comes to the driver. The number of rounds grows with the logarithm of the
largest component's diameter. Nodes with a large share of all edges are joined by a broadcast (common.hot_join), so
that the hub of a large component fills no task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join

#: Edges of one partition between rounds, on average: small graphs are few files.
PART_EDGES = 50_000


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Links each node's larger (large) or smaller-or-own (small) neighbours to the smallest of its neighbourhood; total: about the number of edges."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        out = hot_join(near.where("b > a"), least, ["a"], "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        out = hot_join(near, least, ["a"], "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge in edges(a, b): root is the smallest node that it reaches.

    Edges with a null end and loops count for nothing; repeated edges count once; no edges give no rows.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not seen["n"] or (seen["n"], seen["h"]) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = (seen["n"], seen["h"])
        now = cut(_star(_star(now, True, seen["n"]), False, seen["n"]).coalesce(1 + seen["n"] // PART_EDGES))
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")
