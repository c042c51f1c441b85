"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sequence import _materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b): root is the smallest node
    that links reach.

    Each round hangs every node and its smallest neighbour's others onto that
    neighbour, first upwards, then downwards, which halves the depth: the number
    of rounds grows with the logarithm of the longest chain.  Every step is an
    aggregate and a join on the links; a node with many neighbours is reduced to
    its smallest one map-side."""
    from_to = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    from_to = _materialise(from_to)
    before = None
    while True:
        both = from_to.select(F.col("hi").alias("n"), F.col("lo").alias("o")).union(from_to.select("lo", "hi"))
        least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        up = both.join(least, "n").where("o > n").select(F.col("o").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = up.groupBy("hi").agg(F.min("lo").alias("m"))
        down = up.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        from_to = _materialise(down.union(least).distinct())
        state = tuple(from_to.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state == before:
            return from_to.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(from_to.select("lo", "lo")).distinct()
        before = state
