"""Shared helpers of the training-data operators: shared storage, hot-key joins, Arrow text access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of the rows; by counting, at most 1 / HOT_SHARE keys can.
HOT_SHARE = 0.001
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a folder of its own where unset on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python some hundreds at a time: a worker's memory then follows its longest text, not ten thousand."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, null as empty, under names that no extra column can clash with."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column) -> DataFrame:
    """Left-join rows with their group's columns, where one key may hold a third of all rows.

    Keys with at least HOT_SHARE of the rows number at most 1 / HOT_SHARE, a bound that does not
    depend on the data, so those are broadcast. Their rows then take part in the shuffled join under
    a spread-out key that matches nothing; every other key holds less than HOT_SHARE of the rows.
    groups must be cheap to read (written) and unique by key; size names its count of rows.
    """
    others = [c for c in groups.columns if c != key]
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(2.0, total * HOT_SHARE)
    packed = groups.select(F.col(key).alias("_group_key"), F.struct(*others).alias("_group"))
    hot = groups.filter(F.col(size) >= least).select(F.col(key).alias("_hot_key"), F.struct(*others).alias("_hot"))
    cold = packed.filter(F.col(f"_group.{size}") < least)
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    marked = marked.withColumn("_join_key", F.when(F.col("_hot_key").isNull(), F.col(key)).otherwise(F.concat(F.lit("~").cast(rows.schema[key].dataType), spread.cast("string").cast(rows.schema[key].dataType))))
    joined = marked.join(cold, F.col("_join_key") == F.col("_group_key"), "left")
    return joined.select(*(F.col(c) for c in rows.columns), *(F.coalesce(F.col(f"_hot.{c}"), F.col(f"_group.{c}")).alias(c) for c in others))


def slices(batches, column: str = "text", most: int = 1 << 20):
    """Cut Arrow record batches into pieces of about `most` bytes of the text column (a longer text stays whole)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def offsets(array) -> np.ndarray:
    """Byte offsets of an Arrow string or binary array's values in its data buffer, one more than values."""
    wide = str(array.type).startswith("large")
    return np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def raw_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """The values' bytes end to end, and their offsets from 0. Null counts as empty."""
    at = offsets(array)
    data = array.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]
