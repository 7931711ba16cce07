"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.tables import durable


def components(links: DataFrame) -> DataFrame:
    """(node, class_id) of the nodes of `links` (a, b); class_id is the least node that is connected.

    Each round links the neighbours of a node to the least of them, first the larger ones and then the
    smaller ones, until every node hangs on the least of its class. Rounds grow with the logarithm of a
    class's size, and no class is ever gathered in one place.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").unionByName(down.withColumnRenamed("least", "b")).distinct()
        edges = durable(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("class_id")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("class_id")).distinct())
        mark = now
