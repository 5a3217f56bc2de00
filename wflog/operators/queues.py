"""Work queues: outbox, timers and retries. A claim is a function from a table to (claimed rows, new table); one writer owns the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import backoff_seconds


def claimable(at: Column) -> Column:
    free = F.col("claimed_until").isNull() | (F.col("claimed_until") <= at)
    return F.col("state").isin("Pending", "Retryable") | ((F.col("state") == "Claimed") & free)


def claim_outbox(outbox: DataFrame, at: Column, lease: Column, limit: int, include=None, exclude=None, host: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` claimable records by id become Claimed, one attempt up, leased; ready notices only for their own host."""
    test = claimable(at)
    if include is not None:
        test = test & F.col("kind").isin(*include)
    elif exclude is not None:
        test = test & ~F.col("kind").isin(*exclude)
    mine = F.col("recipient_host_id").isNull() | (F.col("recipient_host_id") == F.lit(host))
    test = test & ((F.col("kind") != "dag-run-ready-v1") | F.coalesce(mine, F.lit(False)))
    got = outbox.where(test).orderBy("outbox_record_id").limit(limit)
    claimed = got.withColumn("state", F.lit("Claimed")).withColumn("dispatch_attempt", F.col("dispatch_attempt") + 1).withColumn("claimed_until", at + lease)
    rest = outbox.join(got.select("outbox_record_id"), "outbox_record_id", "left_anti")
    return claimed, rest.select(claimed.columns).unionByName(claimed)


def apply_dispatch_results(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """results (outbox_record_id, result, code): unknown ids create nothing, poisoned records never change."""
    out = outbox.join(results, "outbox_record_id", "left")
    live = F.col("state") != "Poisoned"
    detailed = F.col("code").isNotNull()
    new = (
        F.when(live & (F.col("result") == "Success"), "Dispatched")
        .when(live & (F.col("result") == "RetryableFailure"), "Retryable")
        .when(live & (F.col("result") == "PermanentFailure") & (~detailed | (F.col("state") == "Claimed")), "Poisoned")
    )
    out = out.withColumn("_new", new)
    return out.select(
        *[c for c in outbox.columns if c not in ("state", "claimed_until", "poison_code")],
        F.coalesce("_new", "state").alias("state"),
        F.when(F.col("_new").isNull(), F.col("claimed_until")).alias("claimed_until"),
        F.coalesce(F.when(F.col("_new") == "Poisoned", F.col("code")), F.col("poison_code") if "poison_code" in outbox.columns else F.lit(None)).alias("poison_code"),
    )


def release_outbox(outbox: DataFrame, ids: DataFrame, key: tuple[str, ...] = ("outbox_record_id",)) -> DataFrame:
    """Claimed records among ``ids`` become Retryable, without a lease. ``key``: the columns that tell records apart, more than the id where ids repeat."""
    hit = ids.select(*key).distinct().withColumn("_hit", F.lit(True))
    out = outbox.join(hit, list(key), "left")
    back = F.col("_hit").isNotNull() & (F.col("state") == "Claimed")
    return out.withColumn("claimed_until", F.when(~back, F.col("claimed_until"))).withColumn("state", F.when(back, "Retryable").otherwise(F.col("state"))).drop("_hit")


def dispatch_summary(results: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("result") == s)
    return results.groupBy("kind").agg(F.count("*").alias("claimed"), F.count("result").alias("attempted"), n("Success").alias("success"), n("RetryableFailure").alias("retryable"), n("PermanentFailure").alias("permanent"))


def coalesce_continuations(signals: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(record id, payload json with instance_id, occurred_at, not_before) -> (one row per due instance, the other records with their new state).

    Without a readable instance and time a signal is Poisoned, for it can never advance anything; one that is not due yet goes back as Retryable.
    """
    shape = "instance_id long, occurred_at timestamp_ntz, not_before timestamp_ntz"
    p = signals.withColumn("p", F.from_json("payload", shape))
    good = F.col("p.instance_id").isNotNull() & F.col("p.occurred_at").isNotNull() & (F.col("p.not_before").isNotNull() | F.get_json_object("payload", "$.not_before").isNull())
    early = F.coalesce(F.col("p.not_before") > at, F.lit(False))
    due = p.where(good & ~early)
    lag = F.greatest(F.lit(0), F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("p.occurred_at").cast("timestamp")))
    out = due.groupBy(F.col("p.instance_id").alias("instance_id")).agg(F.count("*").alias("n"), F.max(lag).alias("lag_micros"), F.sort_array(F.collect_list("outbox_record_id")).alias("records"))
    return out, p.where(~good | early).select("outbox_record_id", F.when(good, "Retryable").otherwise("Poisoned").alias("state"))


def failure_backoff(attempts: DataFrame, most: int = 5) -> DataFrame:
    """(stream_id, version, step_path, failed): the attempt number at one position, its delay in seconds, park at ``most``.

    A success or another position starts the count anew.
    """
    w = Window.partitionBy("stream_id").orderBy("version")
    new = ~F.col("failed") | ~F.col("step_path").eqNullSafe(F.lag("step_path").over(w)) | ~F.coalesce(F.lag("failed").over(w), F.lit(False))
    runs = attempts.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy("stream_id", "run").orderBy("version"))
    failed = runs.withColumn("attempt", n).where("failed")
    return failed.select("stream_id", "version", "attempt", backoff_seconds(F.col("attempt")).alias("delay_s"), (F.col("attempt") >= most).alias("park"))


def claim_timers(timers: DataFrame, due: Column, at: Column, lease: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    free = ~F.col("claimed") | F.col("claimed_until").isNull() | (F.col("claimed_until") <= at)
    got = timers.where((F.col("fire_at") <= due) & free).orderBy("fire_at", "timer_id").limit(limit)
    claimed = got.withColumn("claimed", F.lit(True)).withColumn("claimed_until", at + lease)
    return claimed, timers.join(got.select("timer_id"), "timer_id", "left_anti").unionByName(claimed)


def maintain_timers(timers: DataFrame, ops: DataFrame) -> DataFrame:
    """ops (timer_id, seq, op, and the timer's columns that an upsert sets) in order: upsert writes a timer and resets its claim, complete deletes it, release unclaims it.

    The last upsert or complete of a timer decides whether it is there and what it holds; a release has no timer come back.
    """
    claim = ("claimed", "claimed_until")
    given = [c for c in timers.columns if c in ops.columns and c not in ("timer_id", *claim)]
    decides = F.col("op").isin("upsert", "complete")
    last = ops.groupBy("timer_id").agg(F.max_by(F.when(decides, F.struct("op", *given)), F.when(decides, F.col("seq"))).alias("_set"), F.bool_or(F.col("op") == "release").alias("_freed"))
    out = timers.withColumn("_there", F.lit(True)).join(last, "timer_id", "full_outer")
    written = F.coalesce(F.col("_set.op") == "upsert", F.lit(False))
    out = out.where(written | (F.col("_there").isNotNull() & F.col("_set").isNull()))
    free = written | F.coalesce("_freed", F.lit(False))
    return out.select(
        "timer_id", *[(F.when(written, F.col(f"_set.{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c)) for c in timers.columns if c not in ("timer_id", *claim)],
        F.when(free, F.lit(False)).otherwise(F.col("claimed")).alias("claimed"),
        F.when(~free, F.col("claimed_until")).alias("claimed_until"),
    )


def wait_outcomes(waits: DataFrame, closers: DataFrame) -> DataFrame:
    """waits (stream_id, wait_id, version), closers (stream_id, wait_id, version, kind match or timeout): the first closer after the wait decides."""
    c = closers.select("stream_id", "wait_id", F.col("version").alias("closed_at"), "kind")
    first = waits.join(c, ["stream_id", "wait_id"], "left").where(F.col("closed_at").isNull() | (F.col("closed_at") > F.col("version")))
    hit = first.groupBy("stream_id", "wait_id", "version").agg(F.min_by("kind", "closed_at").alias("kind"))
    out = waits.join(hit, ["stream_id", "wait_id", "version"], "left")
    return out.select("stream_id", "wait_id", "version", F.when(F.col("kind") == "match", "matched").when(F.col("kind") == "timeout", "timed_out").otherwise("open").alias("outcome"))


def deadline_breaches(projections: DataFrame, at: Column, limit: Column) -> DataFrame:
    """Nonterminal instances past their deadline at ``at`` and terminal ones that ended after it."""
    terminal = F.col("status").isin("Completed", "Failed", "TimedOut", "Cancelled", "Terminated")
    deadline = F.col("created_at") + limit
    return projections.where(F.when(terminal, F.col("updated_at") > deadline).otherwise(deadline <= at))
