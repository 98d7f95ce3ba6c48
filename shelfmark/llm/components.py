"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of an edge.

    ``edges`` has columns ``a`` and ``b`` of any orderable type.  Each round hangs the
    larger neighbours of every node on the smallest one, then the smaller ones; it
    ends when a round changes nothing.  Neighbours are never gathered: a round is a
    minimum per node and a join.
    """
    current = stored(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    # Two tables of distinct edges are taken as equal if count and two sums of hashes agree.
    state = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).head()
    before = state(current)
    if before[0] == 0:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = stored(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        now = state(after)
        if now == before:
            break
        current, before = after, now
    roots = after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
