"""The vectors of a table that can be compared, and their Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): rows whose vector is not null, not empty and has neither null nor non-finite entries.

    Vectors of different lengths have no common measure: those of the most common length stay (of equally
    common lengths the greatest).
    """
    x = F.col(vector_col)
    whole = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.filter(whole).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("n")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("vector") == (most.n if most else 0))


def matrix(column) -> np.ndarray:
    """An Arrow list column of one length (chunked or not) as float64 rows."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
