"""Shuffles cut by rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task is to sort or hash at once.
ROWS = 1 << 19


def parts_for(df: DataFrame, rows: int) -> int:
    """Partitions for ``rows`` rows: at least one per core, otherwise of about ``ROWS`` rows each."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))


def spread(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in just ``parts`` partitions.

    Left to itself Spark merges partitions up to 64 MB as they lie compressed in the shuffle. Narrow rows of sorted keys take some 6 bytes there and 200 when sorted,
    so that a task would get ten million of them.
    """
    return df.repartition(parts, *keys)
