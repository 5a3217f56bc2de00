"""Retention and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from ..sources.spread import parts_for, spread
from .projections import ACTIVE
from .ranks import top


def retention_plan(settled: DataFrame, at: Column, max_age: Column, max_retained: int) -> DataFrame:
    """(instance_id, settled_at, ordinal): rows to retire: all of at least ``max_age``, then the oldest until ``max_retained`` remain.

    The ordinal from which on rows are kept is found by counting ranges of ordinals, so neither the kept rows nor the others are ever sorted or joined.
    """
    aged = F.col("settled_at") <= at - max_age
    kept = top(settled.where(~aged), "ordinal", max_retained, "instance_id")
    gone = aged if kept is None else aged | ~kept
    return settled.where(gone).withColumn("reason", F.when(aged, "age").otherwise("count"))


#: What keeps an instance from being purged, in the order in which it is reported: fixed values.
BLOCKERS = ("ActiveInstance", "PendingInboxDelivery", "ClaimedOutboxDispatch", "PendingOutboxDispatch", "PoisonedOutboxDispatch")


def maintenance_blockers(requested: DataFrame, projections: DataFrame, heads: DataFrame, inbox: DataFrame, outbox: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Per requested instance: exists, and the first blocker in a fixed order (None: none). ``targets``: events to definitions by instance, whose deliveries count as well.

    All tables meet by instance, in as many partitions as their rows ask for.
    """
    n = parts_for(projections, sum(t.count() for t in (requested, projections, inbox, outbox)))
    by = lambda df, c="instance_id": spread(df, n, c)
    received = inbox.where("state = 'Received'").select("instance_id")
    if targets is not None:
        received = received.union(targets.where("state = 'Received'").select("instance_id"))
    want = by(requested.select("instance_id")).distinct()
    p = by(projections.select("instance_id", "status"))
    h = by(heads.select(F.col("stream_id").alias("instance_id"))).distinct().withColumn("has_head", F.lit(True))
    i = by(received).distinct().withColumn("pending_inbox", F.lit(True))
    s = F.col("state")
    o = by(outbox.select("instance_id", "state")).groupBy("instance_id").agg(F.bool_or(s == "Claimed").alias("claimed"), F.bool_or(s.isin("Pending", "Retryable")).alias("pending"), F.bool_or(s == "Poisoned").alias("poisoned"))
    out = want.join(p, "instance_id", "left").join(h, "instance_id", "left").join(i, "instance_id", "left").join(o, "instance_id", "left")
    tests = (F.col("status").isin(*ACTIVE), F.col("pending_inbox"), F.col("claimed"), F.col("pending"), F.col("poisoned"))
    blocker = None
    for name, test in zip(BLOCKERS, tests, strict=True):
        blocker = F.when(test, name) if blocker is None else blocker.when(test, name)
    return out.select("instance_id", "status", (F.col("status").isNotNull() | F.col("has_head").isNotNull()).alias("exists"), blocker.otherwise("None").alias("blocker"))


def archive_instances(requested: DataFrame, projections: DataFrame, at: Column) -> DataFrame:
    out = requested.select("instance_id").distinct().join(projections.select("instance_id", "status"), "instance_id", "left")
    result = F.when(F.col("status").isNull(), "NotFound").when(F.col("status").isin(*ACTIVE), "Rejected").otherwise("Archived")
    return out.select("instance_id", result.alias("result"), F.when(result == "Archived", at).alias("archived_at"))


def purge_instances(blockers: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(disposition per instance, tables without the purged ones); tables: name -> (frame, its instance column)."""
    result = F.when(~F.col("exists"), "NotFound").when(F.col("blocker") != "None", "Rejected").otherwise("Purged")
    report = materialize(blockers.select("instance_id", result.alias("result"), "blocker"), "purge-report")  # once for all tables
    gone, n_gone = report.where("result = 'Purged'").select("instance_id"), report.count()

    def kept(t: DataFrame, c: str) -> DataFrame:
        n = parts_for(t, t.count() + n_gone)
        return spread(t, n, c).join(spread(gone.withColumnRenamed("instance_id", c), n, c), c, "left_anti")

    return report, {n: kept(t, c) for n, (t, c) in tables.items()}
