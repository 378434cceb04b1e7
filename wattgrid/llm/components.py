"""Connected components of links held as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattgrid.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) of every node of ``links`` (a, b: long).

    Alternates two steps until nothing changes: every node ties its larger neighbours to the
    smallest one, then its smaller neighbours. Each step is one minimum per node and one join, so no
    component is ever in one place; the rounds grow with the logarithm of its width.
    """
    edges = checkpointed(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = checkpointed(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        tied = low.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("a", F.col("m").alias("b")))
        edges = checkpointed(tied.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
