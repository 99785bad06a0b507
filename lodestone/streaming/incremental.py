"""Append-only jobs over tables that grow: what is new is worked on once, and a failed run may be started again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lodestone.sources.tables import append_missing


def run_available(spark: SparkSession, source: str, schema: StructType, work: Callable[[DataFrame], DataFrame], out: str, key: str, checkpoint: str) -> int:
    """Work on the files that came since the last run, append rows with new keys to `out`, and stop; the number of batches.

    The checkpoint remembers the files; the anti-join on the key makes a batch that is tried again harmless.
    """
    batches = 0

    def each(df: DataFrame, _: int) -> None:
        nonlocal batches
        batches += 1
        append_missing(work(df), out, key)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return batches
