"""Broadcast a join side only after its size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS, SMALL_BYTES = 10_000, 16 << 20


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """``df`` as a broadcast of known rows when it has at most ``rows`` of about ``size`` bytes, else ``df`` as it is.

    For narrow lookup tables. Beyond the bound the join is a shuffle join, where AQE
    splits partitions with a very common key.
    """
    found = df.limit(rows + 1).collect()
    if len(found) > rows or sum(len(str(row)) for row in found) > size:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))
