"""Connected components of an edge list by alternating star contractions.

Each round every node points itself and its neighbours at the least neighbour: large stars first, then small
ones. Rounds grow with the logarithm of the longest path. Minima are pre-aggregated and joined back, so a
node with a great many neighbours is never gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.functions.session import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: longs) that isn't itself the least of its component.

    Self loops and repeated edges are allowed; edges with a null are ignored."""
    now = cut(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct())
    while True:
        now = cut(_small(_large(now)).distinct())
        # done when all edges are stars around roots: no node points twice, none that is pointed at points further
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(now.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1 and out > 0").limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
