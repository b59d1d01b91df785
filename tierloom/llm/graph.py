"""Connected components of a link table, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.storage import written


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each linked node reaches.

    ``links`` has two columns of longs, ``a`` and ``b``. Nodes without a
    link to another node do not appear; null ends, repeated links and links
    of a node to itself count for nothing.

    Every round first hangs each node's larger neighbours on the smallest
    node that it knows, then hangs all smaller neighbours on that node
    (large star, small star). Rounds grow with the logarithm of a
    component's size; the end is a star per component. Minima are combined
    before the shuffle, so a node with a third of all links costs one row
    per task there; the join back to its links is left to Spark's skew join.
    Each round's edges are written to the shared folder.
    """
    up = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = written(links.where("a != b").select(*up).distinct(), "component_edges")
    before = None
    while True:
        size = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum")).first()
        if not size["n"] or size == before:
            break
        before = size
        edges = written(_small_star(_large_star(edges)), "component_edges")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
