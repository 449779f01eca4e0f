"""Connected components of an edge table by repeated contraction, with tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.sources.folders import stored


def _hop(pointers: DataFrame) -> DataFrame:
    """Each node points to where its parent points (a parent without a row of its own is a root)."""
    above = pointers.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return pointers.join(above, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"))


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """node, root for every node that occurs in `edges` (columns a, b of one ordered type).

    Each round points every node to its smallest neighbour (or itself), shortens the pointers twice,
    and replaces the ends of all edges by their pointers. Edges that became loops go; rounds end when
    none is left. Pointers only fall, so roots are consistent, and paths shrink by a factor each round.
    Nothing but the count of edges reaches the driver. Tables between rounds go below `folder`, if one is given.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mapping = stored(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), folder)
    left = stored(both.filter("a != b").distinct(), folder)
    while left.take(1):
        nearest = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        pointers = stored(nearest.select("node", F.least("node", "least").alias("parent")), folder)
        pointers = stored(_hop(_hop(pointers)), folder)
        to = pointers.select(F.col("node").alias("root"), "parent")
        mapping = stored(
            mapping.join(to, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), folder)
        ends_a = pointers.select(F.col("node").alias("a"), F.col("parent").alias("new_a"))
        ends_b = pointers.select(F.col("node").alias("b"), F.col("parent").alias("new_b"))
        left = stored(
            left.join(ends_a, "a").join(ends_b, "b")
            .select(F.col("new_a").alias("a"), F.col("new_b").alias("b")).filter("a != b").distinct(), folder)
    return mapping
