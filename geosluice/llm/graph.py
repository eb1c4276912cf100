"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_least


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b), component being its smallest node.

    In a round each edge meets the smallest neighbour of its upper end twice (with_least),
    that of a hub by broadcast, so a hub's edges are no large group.  Rounds end when all
    components are stars about their smallest node, after about log(longest path) of them."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        rows, upper = e.agg(F.count("*"), F.count_distinct("a")).first()
        if rows == upper and e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, ["a"], "b", "m").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = cut(large.where("a <> b").distinct(), "large")
        low = with_least(large, ["a"], "b", "m")
        small = low.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b")))
        e = cut(small.where("a <> b").distinct(), "small")
