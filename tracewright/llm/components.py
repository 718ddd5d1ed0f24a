"""Connected components of a table of links, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import forget, store


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node it reaches. No links, no rows.

    Each round points every node's larger neighbours at its smallest one (large star), then its smaller ones (small
    star), until each link leads from a node to its root. Rounds grow with the logarithm of the longest path. Neighbours
    are never gathered, only their minimum is; the joins that bring it back may split keys with many links.
    """
    spark = links.sparkSession
    a, b = F.col("a"), F.col("b")
    edges, path = store(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        larger = edges.select(b.alias("a"), a.alias("b")).join(least, "a")
        large = larger.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct(a, F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select("e.*").where(a != b).distinct()
        after, new_path = store(small, "links")
        forget(spark, path)
        # done when no root of a link is itself the larger end of a link
        roots = after.select(b.alias("a")).distinct()
        done = after.join(roots, "a", "left_semi").limit(1).count() == 0
        edges, path = after, new_path
        if done and edges.groupBy("a").count().where("count > 1").limit(1).count() == 0:
            break
    nodes = edges.select(a.alias("node"), b.alias("root"))
    return nodes.unionByName(edges.select(b.alias("node"), b.alias("root")).distinct())
