"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import with_group, written


def _to_group(links: DataFrame, least: DataFrame, label: str) -> DataFrame:
    """links with the least neighbour m of their u; a node that holds a large part of the links is split over tasks."""
    return with_group(links, written(least, label), "u", "n", F.hash("v")).drop("n")


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) for every node of links (u, v): root is the least node that it is connected to.

    Alternating large and small stars: the rounds grow with the logarithm of the longest path. Each
    round is written to the shared folder, which cuts the lineage.
    """
    now = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _to_group(both, least, label).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, label)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _to_group(large, least, label).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = written(small, label)
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        mark = seen
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
