"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step is a distributed aggregation. A node that a third of all edges lead to is no hot group:
the large step only needs the least neighbour of each node (a partial aggregate) and a join, which the
adaptive planner splits when a key is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlode.plans.session import stage


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): for each node with an edge, the least node it is linked to.

    edges has columns a and b of one orderable type. Rows with a null or two equal ends link nothing.
    The steps end when nothing changes; not ending within max_rounds is an error, never a cut-off.
    """
    e = edges.select("a", "b").where("a <> b")
    e = stage(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if _is_star_forest(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b"))).distinct()
        # large star: the larger neighbours of each node move to its least neighbour
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours of each node, and itself, move to the least of them
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = stage(e)
    raise RuntimeError("components did not settle")


def _is_star_forest(e: DataFrame) -> bool:
    """Whether each node has at most one smaller neighbour and then is nobody's smaller neighbour itself."""
    ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select(F.col("b"), F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()
