"""Dense numbers for rows in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import written


def add_surrogate_key(df: DataFrame, order: list, name: str = "row_id") -> DataFrame:
    """Dense numbers from 1 in the order of the columns (names, or expressions such as F.desc).

    Rows are dealt into ranges; each range is numbered on its own and moved by the rows before it. The
    table of ranges has one row for each partition.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy("_part").orderBy(*order)
    return dealt.withColumn("_r", F.row_number().over(w)).join(F.broadcast(before), "_part").withColumn(name, F.col("_r") + F.col("_before")).drop("_part", "_r", "_before")
