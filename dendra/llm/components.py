"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendra.llm.common import remove, save, scratch


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component): the least id reachable, for every id that is not its component's least itself.

    Every step is a grouped minimum and an equi-join, so a node with very many edges is split by the engine like any
    skewed key; edges stay at most as many as given. Each round is written to the shared folder."""
    spark = edges.sparkSession
    path = scratch(spark, "components")
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), path)
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        following = scratch(spark, "components")
        now = save(small, following)
        remove(spark, path)
        path = following
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == new:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = new
