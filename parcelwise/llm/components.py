"""Connected components by large-star and small-star steps on an edge table.

Each step replaces a vertex's edges by edges to its smallest neighbour. Only minima per
vertex are computed (combined before the shuffle), never a vertex's list of neighbours, so a
hub may have any number of edges. Every step's edges are written to the shared folder, which
cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.sources.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(vertex, component) for every vertex with an edge; the component is its least vertex."""
    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)
    now = scratch.table(edges.where("a <> b").select("a", "b").distinct(), "edges")
    last, seen = None, state(now)
    while seen != last:
        step = scratch.table(_small_star(_large_star(now)).where("a <> b").distinct(), "edges")
        last, seen = seen, state(step)
        scratch.drop(now)
        now = step
    vertices = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return vertices.union(now.select(F.col("b"), F.col("b")).distinct())
