"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is an aggregation (combined before the shuffle) and a join back on the same key, which adaptive
execution splits where a key is hot; its edges are written to the shared folder. Nothing reaches the driver but a
count and a checksum that tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with b < a. Large star links the larger neighbours of each node to its least; small star the others."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = both.join(least, "a")
    if large:
        return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that is reachable, for every node of an edge (a, b). Loops and repeats are fine."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = written(edges, "edges"), None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == before:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        before = seen
        step = _star(edges, large=True).filter("a <> b").distinct()
        edges = written(_star(step, large=False).filter("a <> b").distinct(), "edges")
