"""Connected components of a graph given as rows, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; the smallest node names it.

    Alternates two steps until nothing changes: every node ties its larger neighbours to the
    smallest node it sees, then every node ties its smaller neighbours to the smallest.  Rounds
    grow with the logarithm of the number of nodes.  Hubs are aggregated before the shuffle.
    """
    pairs = checkpointed(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(low, "a").filter("b > a AND b <> m")
            .select(F.col("m").alias("a"), "b").distinct()
        )
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        linked = large.join(small, "b")
        pairs = checkpointed(
            linked.select(F.col("m").alias("a"), "b")
            .unionByName(linked.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
            .distinct()
        )
        now = pairs.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    nodes = pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = pairs.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(roots)
