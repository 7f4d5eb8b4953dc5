"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import stored


def _pairs(a, b):
    return F.explode(F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))).alias("e")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("x").alias("v"), F.lit(1).alias("up")), F.struct(F.col("y").alias("v"), F.lit(0).alias("up")))).alias("e"))
    per = ends.groupBy("e.v").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return per.filter("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest reachable node) of every node with an edge to another.

    Every step keeps one edge at most for each it had, and the shared folder holds its result.  A
    node's smallest neighbour is an aggregate joined back, so a node with very many
    edges is summed map-side and its join can be split.
    """
    now = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    now = stored(now.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    while not _stars(now):
        # large star: a node's larger neighbours go to its smallest neighbour (or itself)
        both = now.select(_pairs("x", "y")).select("e.*")
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        moved = large.join(least, "x")
        small = moved.filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y")))
        now = stored(small.distinct(), "edges")
    return now.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(
        now.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    )



