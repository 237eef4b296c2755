"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.llm._util import assign, cut, with_part


def components(edges: DataFrame) -> DataFrame:
    """edges: u long, v long. Returns id, component (the smallest id reachable) for every id in an edge with another id.

    Each round is two aggregations and joins of edges; the edge table never grows, nothing goes
    to the driver but one count, and each round ends in a checkpoint. Edges that are stars
    already (each node points to one other, which points to none) take no round at all. A node
    may have a third of all edges: what is known of it goes to (partition, node) first and then
    to the edges, so that no task gets more of them than a partition had. Rounds go on until
    nothing is left to do; their number grows with the logarithm of the longest path.
    """
    e = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while _unsettled(e):
        e = cut(_small(cut(_large(e))))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _unsettled(e: DataFrame) -> int:
    """Nodes that point to more than one other, or point and are pointed to."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("to")), F.struct(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("to")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("to").alias("to")).filter("out > 1 or (out = 1 and to = 1)").count()


def _large(e: DataFrame) -> DataFrame:
    """Each neighbour larger than the node goes to the smallest of node and neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return assign(with_part(both).filter("v > u"), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Node and smaller neighbours go to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = assign(with_part(e), low, ["u"]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
