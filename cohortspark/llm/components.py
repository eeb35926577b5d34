"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over undirected edges held once each as (a, b) with a > b.

    Large: every node hands its least neighbour to its larger neighbours. Small: every node
    hands its least neighbour to its smaller ones. Components never change.
    """
    if small:
        both = edges
    else:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = both.join(least, "a")
    if small:
        moved = joined.select(F.col("b").alias("x"), F.col("m").alias("y"))
        moved = moved.unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    else:
        moved = joined.filter("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    return moved.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link; the root is the component's least node.

    Links need not be distinct; those of a node with itself and those with a null end count
    for nothing. Every round is a written table; the number of rounds grows with the logarithm of
    the longest chain. A node of very many links is joined by its key on both sides, which
    adaptive execution splits.
    """
    edges = stage(
        links.select(F.greatest(links[a], links[b]).alias("a"), F.least(links[a], links[b]).alias("b"))
        .filter("a <> b").distinct()
    )
    previous = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == previous or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        previous = state
        edges = stage(_star(_star(edges, small=False), small=True))
