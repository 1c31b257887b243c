"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(links: DataFrame, both: bool) -> DataFrame:
    """One step over links (a, b) with a > b. Large star (``both``): every larger neighbour of a node is hung on the
    least of its neighbourhood; small star: every smaller one, and the node itself."""
    view = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else links
    # written: a join against the grouped plan itself would keep its partitioning, and a hub could not be split
    least = materialize(view.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low")))
    met = view.join(least, "a")
    if both:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return out.filter("a > b").distinct()


def smallest_reachable(links: DataFrame) -> DataFrame:
    """node, component: for every node of the links (a, b) the smallest node it reaches.

    Ends when no node is both hung on another and hung upon, and none hangs twice: then every link points at the root.
    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest chain.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    while True:
        links = materialize(_star(_star(links, True), False))
        twice = links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
        chained = links.select(F.col("b").alias("a")).join(links.select("a"), "a", "left_semi").limit(1)
        if twice.isEmpty() and chained.isEmpty():
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
