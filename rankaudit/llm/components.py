"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankaudit.llm.store import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges`` (a, b longs).

    Alternating large-star and small-star rounds: each replaces a node's edges by
    edges to the smallest node among itself and its neighbours, so a hub's edges
    spread over its neighbours instead of meeting in one group, until every edge
    leads from a node to its component's smallest id.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "edges")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = written(small, "edges")
        state = small.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return small.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                small.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        edges, before = small, state
