"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release


def _is_stars(links: DataFrame) -> bool:
    """Whether each v has one u, and no u is a v."""
    ends = links.select(F.col("v").alias("x"), F.lit(1).alias("v"), F.lit(0).alias("u")).union(links.select("u", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("v").alias("v"), F.max("u").alias("u")).filter("v + u > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of ``links`` (a, b): the smallest id that links reach.

    Alternates large and small stars until all links are stars, about log2(longest path)
    rounds. Neighbours are never gathered: a round is two grouped minima, which combine
    before the shuffle, and two joins.
    """
    now = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while not _is_stars(now):
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # written before the join, so that Spark can split the neighbours of a hub
        least = checkpointed(both.groupBy("v").agg(F.least("v", F.min("u")).alias("m")))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.filter("m < v").select("v", F.col("m").alias("u"))).distinct()
        large = checkpointed(large)
        least = checkpointed(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(least, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u")
        now = checkpointed(small.filter("v <> u").distinct())
        release(now.sparkSession)
    return now.select(F.col("v").alias("id"), F.col("u").alias("component")).union(now.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
