"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appwatch.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for every node of ``edges`` (a, b).

    Large-star and small-star steps in turn: each hangs neighbours below the smallest one they see.
    A step is one minimum per node, combined before the shuffle, and one join, so a node with very
    many neighbours is never gathered. Every step is written to the shared folder. A graph without
    edges has no rows; loops and repeated edges do no harm.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    while True:
        starred = _star(_star(edges, large=True), large=False)
        starred = stored(starred, "edges")
        if starred.exceptAll(edges).isEmpty() and edges.exceptAll(starred).isEmpty():
            break
        edges = starred
    below = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return below.unionByName(roots)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b) after one step."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return moved.where("a > b").distinct()
