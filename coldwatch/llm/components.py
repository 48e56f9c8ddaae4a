"""Connected components of a table of links, by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldwatch.session import freeze


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of it and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.where("a <> b").unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """id, component for every id in ``links`` (a, b): the smallest id that it reaches.

    Each round writes the links once and counts them; the count and a sum of hashes tell when they
    no longer change. The number of rounds grows with the logarithm of a component's length.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        edges = freeze(edges, label)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        edges = _small_star(_large_star(edges))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
