"""Ranks and selections that no single task or window has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "ranked") -> DataFrame:
    """Adds ``rank`` (from 0) and ``members`` of each group's rows in order; rows with a null in ``group`` go.

    Rows are dealt out by ranges of (group, order) and numbered where they lie; one row per group and range then says how many rows
    stand before it. A group with most of the rows is spread over many ranges and no window ever holds it.
    """
    rows = materialize(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("at__", F.monotonically_increasing_id()), name)
    lies = F.shiftright("at__", 33)
    spans = rows.groupBy(*group, lies.alias("in__")).agg(F.min("at__").alias("first__"), F.count("*").alias("n__"))
    upto = Window.partitionBy(*group).orderBy("in__")
    spans = spans.withColumn("before__", F.sum("n__").over(upto) - F.col("n__")).withColumn("members", F.sum("n__").over(Window.partitionBy(*group)))
    out = rows.withColumn("in__", lies).join(spans, [*group, "in__"])
    return out.select(*[rows[c] for c in df.columns], (F.col("at__") - F.col("first__") + F.col("before__")).alias("rank"), "members")


def nth_largest(df: DataFrame, column: str, n: int, buckets: int = 4096) -> tuple[int | None, int]:
    """(value of the n-th largest of a whole-number column, how many are larger); (None, count) where there are fewer.

    Each pass counts the rows of ``buckets`` equal ranges, combined map-side, and goes on in the range that holds the n-th.
    """
    low, high, count = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < 1 or count < n:
        return None, count
    above = 0
    while True:
        width = max(1, -(-(high - low + 1) // buckets))
        place = F.expr(f"cast((cast(`{column}` as decimal(38,0)) - {low}) div {width} as bigint)")
        here = df.where(F.col(column).between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"))
        for b, k in sorted(((r["b"], r["n"]) for r in here.collect()), reverse=True):  # a row per bucket at most
            if above + k >= n:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            above += k
        if width == 1:
            return low, above


def top(df: DataFrame, column: str, n: int, tie: str) -> Column | None:
    """A test for the n rows with the largest ``column`` (of equal ones the smallest ``tie``); None where all are. Only the ties at the edge are sorted."""
    value, above = nth_largest(df, column, n)
    if value is None:
        return F.lit(False) if n < 1 else None
    ties = df.where(F.col(column) == value).orderBy(tie).limit(n - above).agg(F.max(tie)).first()[0]
    return (F.col(column) > value) | ((F.col(column) == value) & (F.col(tie) <= F.lit(ties)))
