"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.sources.session import Scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every endpoint of ``edges(a, b)``; component = smallest id.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014): each step hands a node's
    neighbours to the smallest of them, so even a long chain collapses in a
    logarithmic number of rounds. Neighbourhoods are only ever reduced with
    ``min``, which combines map-side, so a hub is no hot group.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tables = Scratch(edges.sparkSession, "components")
    pairs = tables.put("pairs", pairs)
    mark = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(roots, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(roots, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = tables.put("pairs", linked.unionByName(roots.withColumnRenamed("m", "b")).distinct())
        # Both steps keep the components, so an unchanged edge set is a fixed point.
        seen = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            break
        mark = seen
    stars = pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
