"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of its own where that is unset and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read back: iterations start from a table, not from their whole lineage."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task in steps whose number of tasks follows the rows.
TASK_ROWS = 1_000_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: TASK_ROWS each at most, and as many as there are cores from a tenth of that on."""
    return max(1, -(-rows // TASK_ROWS), min(spark.sparkContext.defaultParallelism, -(-rows * 10 // TASK_ROWS)))


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """df written in buckets by a key and read back: joins on the key leave it where it lies."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
