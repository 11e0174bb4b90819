"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import materialize

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any order, of long nodes; gives (node, component), the least node reachable.

    Each step only takes a node's least neighbour (a partial aggregate) and joins it back. The least
    neighbours are written first, so the join deals both of its sides itself and can split the edges of
    a node that very many share. Every round is written to the shared folder.
    """
    links = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(ROUNDS):
        # large star: the larger neighbours of a node move to the least of its neighbours and itself
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = materialize(large.distinct())
        # small star: the smaller neighbours of a node, and the node, move to the least of them
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        links = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components don't settle in {ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
