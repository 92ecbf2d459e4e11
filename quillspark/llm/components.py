"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v, some repeated, no more than came (small: and one for each node). large: each node's larger neighbours get its least neighbour; small: its smaller ones and itself do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v")


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge at most to a smaller one, and those smaller ones have none: all components are stars around their least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 OR ups = 1 AND least = 0").isEmpty()


def components(edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """(node, root) of each node in an edge; root: the least node of its component. edges: columns a, b of one type.

    Each round writes its edges to the shared folder; the rounds are logarithmic in the longest path, and there is none where
    the edges are such stars already. Nothing but one row at most comes to the driver. Self-loops and repeated edges do no harm.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    for _ in range(most):
        if _settled(now):
            break
        large = cut(_star(now, True), name)  # written, else the plan of a round holds this step several times
        now = cut(_star(large, False).distinct(), name)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
