"""Reading of exported CSV tables and writing of results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_silver_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A UTF-8 CSV table with a header (a byte-order mark is dropped) and quoted text over several lines.

    All columns are read as text; the wanted ones are cast, and what cannot be cast is null. Columns that the
    file lacks are null.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    names = {c.lstrip("﻿").strip('"'): c for c in raw.columns}
    text = StructType([StructField(n, StringType()) for n in names])
    raw = raw.toDF(*text.fieldNames())
    return raw.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def materialize(df: DataFrame, path: str, violations=None) -> DataFrame:
    """Write df beside its place, check it, then put it in place of what is there; a failed check leaves the old table.

    violations: table -> DataFrame of what is wrong with it (empty when right).
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    aside, old = (f"{path.rstrip('/')}-{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.parquet(aside)
    fresh = spark.read.schema(df.schema).parquet(aside)
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if violations is not None and not violations(fresh).isEmpty():
        fs.delete(jvm.org.apache.hadoop.fs.Path(aside), True)
        raise ValueError(f"checks of {path} failed; the table is as it was")
    there = fs.exists(place)
    if there:
        fs.rename(place, jvm.org.apache.hadoop.fs.Path(old))
    fs.rename(jvm.org.apache.hadoop.fs.Path(aside), place)
    if there:
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)
    return spark.read.schema(df.schema).parquet(path)


def append_missing(fresh: DataFrame, path: str, key: str) -> None:
    """Append rows whose key is not in the table yet; may be run again after a failure."""
    spark = fresh.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)


def write_metrics_csv(metrics: DataFrame, path: str, top: DataFrame, key: str = "node") -> None:
    """Node metrics as CSV with in_top_n; top has the keys of the chosen nodes."""
    flagged = metrics.join(top.select(key).distinct().withColumn("_top", F.lit(True)), key, "left").withColumn("in_top_n", F.coalesce("_top", F.lit(False))).drop("_top")
    flagged.write.mode("overwrite").option("header", True).csv(path)


def write_edges_csv(edges: DataFrame, path: str) -> None:
    """Edges as CSV, provenance flattened with semicolons."""
    edges.withColumn("via", F.concat_ws(";", "via")).write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
