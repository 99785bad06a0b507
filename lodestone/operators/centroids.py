"""Mean directions of groups of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def centroids(chunks: DataFrame, group: str) -> DataFrame:
    """Mean vector of each group, made of length one (8 decimals)."""
    each = chunks.filter(F.col("embedding").isNotNull()).select(F.col(group).alias("grp"), F.posexplode("embedding").alias("pos", "x"))
    means = each.groupBy("grp", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vectors = means.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return vectors.withColumn("norm", norm).select("grp", F.transform("v", lambda x: F.round(F.when(F.col("norm") < 1e-12, x).otherwise(x / F.col("norm")), 8)).alias("centroid"))
