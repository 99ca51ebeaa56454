"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Steps


def _are_stars(e: DataFrame) -> bool:
    """Whether every node of the edges (u, v), u > v, has either one smaller neighbour or only larger ones: then each part hangs on its least node."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or low > 0 and high > 0").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node long, component long`` (the least node reachable) for every node of an edge.

    Each round hangs every node's larger neighbours on the least one it knows (large star), then
    the same towards smaller ones (small star); it ends when all edges go to the least node of their part. A node with very
    many neighbours costs one partial minimum per task and a join that adaptive execution can
    split, as nothing after the join needs a node's rows together. Self-loops and repeated
    edges do no harm; without edges the result is empty.
    """
    steps = Steps(edges.sparkSession)
    e = steps.keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _are_stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
        last, e = e, steps.keep(small.where("u <> v").distinct())
        steps.drop(last)
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def joined_components(parts: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The components (``node, component``) after ``edges`` are added to those of ``parts``. Only the edges are worked on, between the components
    that they join; ``parts`` is looked up once."""
    def of(side: str) -> DataFrame:
        return parts.select(F.col("node").alias(side), F.col("component").alias(f"_of_{side}"))

    between = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).join(of("a"), "a", "left").join(of("b"), "b", "left")
    heads = connected_components(between.select(F.coalesce("_of_a", "a").alias("a"), F.coalesce("_of_b", "b").alias("b")))
    moved = parts.join(heads.select(F.col("node").alias("component"), F.col("component").alias("_head")), "component", "left")
    return moved.select("node", F.coalesce("_head", "component").alias("component")).union(heads.join(parts.select("node"), "node", "left_anti"))
