"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import new_path

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage: lost executors re-read files instead of recomputing the stages before.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replaced(docs: DataFrame, *results: str) -> list:
    """The columns of the struct ``row`` but those that an operator's results replace."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns if c not in results]


def hide(docs: DataFrame, *results: str) -> DataFrame:
    """A stage's documents with columns renamed that are named like an operator's results."""
    for c in results:
        docs = docs.withColumnRenamed(c, f"own__{c}")
    return docs


def bring_back(docs: DataFrame, *results: str) -> list:
    """The documents' own columns after ``hide``."""
    return [F.col(f"own__{c}").alias(c) if c in results else F.col(c) for c in docs.columns]


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of at most ``size`` bytes, unless the session asks for less: texts can be long, rows of numbers are not."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    asked = str(spark.conf.get(key)).rstrip("b")
    if not asked.isdigit() or int(asked) > size:
        spark.conf.set(key, str(size))


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(a long, b long) -> (node, root): root is the smallest node of the component; nodes without an edge are absent.

    Alternates large-star and small-star steps, which halve the depth of chains and keep the number of
    edges bounded; each round is written to the shared folder. Minima are combined map-side and the
    joins back to a hub's edges are splittable, so a hub costs no single task. The number of rounds grows with the
    logarithm of the longest chain; after ``max_rounds`` the run fails rather than give half a result.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, name)
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("s"))
        e = materialize(small.select("s.u", "s.v").where("u != v").distinct(), name)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == tuple(now):
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``rank`` (from 0) and ``members`` of each group's rows in order; group columns are never null.

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


@F.pandas_udf(T.BinaryType())
def pack(texts: pd.Series) -> pd.Series:
    """UTF-8 bytes of a text, compressed: what crosses the network is a third of the text."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pd.Series([squeeze(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=object)


def unpack_one(packed: bytes) -> bytes:
    return zstandard.decompress(packed)
