"""Resource pools: snapshots, accounting, audit of the recorded grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pool_snapshots(pools: DataFrame, tickets: DataFrame, waiters: DataFrame) -> DataFrame:
    """Per pool: capacity, available, held tickets, queued waiters (once per pool that they need), expired tickets."""
    t = tickets.groupBy("pool").agg(F.sum("units").alias("reserved"), F.count("*").alias("held"), F.count_if("review_marked").alias("expired"))
    q = waiters.groupBy("pool").agg(F.countDistinct("waiter_id").alias("queued"))
    out = pools.join(t, "pool", "left").join(q, "pool", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("pool", "capacity", F.greatest(F.lit(0), F.col("capacity") - F.coalesce("reserved", F.lit(0))).cast("long").alias("available"), zero("held"), zero("queued"), zero("expired"))


def pool_management(pools: DataFrame, tickets: DataFrame, waiters: DataFrame) -> DataFrame:
    """Per pool: reserved units, resize debt, queued waiters, oldest review deadline among marked tickets."""
    t = tickets.groupBy("pool").agg(F.sum("units").alias("reserved"), F.min(F.when(F.col("review_marked"), F.col("review_deadline"))).alias("oldest_review"))
    q = waiters.groupBy("pool").agg(F.countDistinct("waiter_id").alias("queued"))
    out = pools.join(t, "pool", "left").join(q, "pool", "left")
    reserved = F.coalesce("reserved", F.lit(0)).cast("long")
    return out.select("pool", reserved.alias("reserved"), F.greatest(F.lit(0), reserved - F.col("capacity")).cast("long").alias("debt"), F.coalesce("queued", F.lit(0)).alias("queued"), "oldest_review")


def audit_pool_log(records: DataFrame, capacities: DataFrame) -> DataFrame:
    """Recorded acquires and releases (pool, seq, holder, op, units) held against the pools' capacities: used units after each, and a result.

    acquire: Rejected (unknown pool), Repeated (the holder has units already; nothing changes), Overcommitted or Granted.
    release: Released, or NotHeld. A holder has what it acquired first since its last release. Windows in the order of the log, by holder and by pool.
    """
    mine = Window.partitionBy("pool", "holder").orderBy("seq")
    acquire = F.col("op") == "acquire"
    rows = records.join(capacities.select("pool", "capacity"), "pool", "left").withColumn("has", F.lag("op").over(mine).eqNullSafe(F.lit("acquire")))
    rows = rows.withColumn("held", F.last(F.when(acquire & ~F.col("has"), F.col("units")), ignorenulls=True).over(mine.rowsBetween(Window.unboundedPreceding, -1)))
    unknown = F.col("capacity").isNull()
    delta = F.when(unknown, 0).when(acquire & ~F.col("has"), F.col("units")).when(~acquire & F.col("has"), -F.col("held")).otherwise(0)
    rows = rows.withColumn("used", F.sum(delta).over(Window.partitionBy("pool").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    result = (
        F.when(acquire, F.when(unknown, "Rejected").when(F.col("has"), "Repeated").when(F.col("used") > F.col("capacity"), "Overcommitted").otherwise("Granted"))
        .when(F.col("has") & ~unknown, "Released").otherwise("NotHeld")
    )
    return rows.select("pool", "seq", "holder", "used", result.alias("result"))


def mark_ticket_review(tickets: DataFrame, at: Column) -> DataFrame:
    """Tickets past their review deadline are marked; they still count as held. ``newly`` tells which were marked now."""
    newly = (F.col("review_deadline") <= at) & ~F.coalesce("review_marked", F.lit(False))
    return tickets.withColumn("newly", F.coalesce(newly, F.lit(False))).withColumn("review_marked", F.col("review_marked") | F.col("newly"))


def apply_resizes(operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(operation_id, seq, pool, capacity) in order -> (operations with result and what is on record; the last capacity per pool).

    An operation is Applied; with the same id, pool and capacity it is Applied again without effect (``replay``), with others it is a Conflict.
    """
    w = Window.partitionBy("operation_id").orderBy("seq")
    out = operations.withColumn("recorded_pool", F.first("pool").over(w)).withColumn("recorded_capacity", F.first("capacity").over(w)).withColumn("replay", F.row_number().over(w) > 1)
    same = (F.col("pool") == F.col("recorded_pool")) & (F.col("capacity") == F.col("recorded_capacity"))
    out = out.withColumn("result", F.when(same, "Applied").otherwise("Conflict"))
    return out, out.where("not replay").groupBy("pool").agg(F.max_by("capacity", "seq").alias("capacity"))


def classify_stop_confirmations(confirmations: DataFrame, holders: DataFrame, released: DataFrame) -> DataFrame:
    """(confirmation_id, seq, token): AlreadyConfirmed, ConfirmationConflict, Released or TokenNotFound.

    holders (token) are held now, released (token, confirmation_id or null) were before; earlier rows of the batch count as well. A token that was released
    without a confirmation isn't found, whoever holds it now.
    """
    past = released.where("confirmation_id is not null").select("confirmation_id", F.lit(-1).cast("long").alias("seq"), "token", F.lit(False).alias("new"))
    rows = past.unionByName(confirmations.select("confirmation_id", "seq", "token", F.lit(True).alias("new")))
    rows = rows.join(holders.select("token").distinct().withColumn("held", F.lit(True)), "token", "left")
    rows = rows.join(released.groupBy("token").agg(F.max("confirmation_id").alias("was")).withColumn("gone", F.lit(True)), "token", "left")
    rows = rows.withColumn("held", F.when(F.col("gone").isNull(), F.col("held")))
    w = Window.partitionBy("confirmation_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    effective = F.when(~F.col("new") | F.col("held").isNotNull(), F.col("token"))
    rows = rows.withColumn("bound", F.first(effective, ignorenulls=True).over(w))
    byt = Window.partitionBy("token").orderBy("seq", "confirmation_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("freed", F.coalesce(F.max(F.col("new") & F.col("held").isNotNull() & F.col("bound").isNull()).over(byt), F.lit(False)))
    result = (
        F.when(F.col("bound").isNotNull(), F.when(F.col("bound") == F.col("token"), "AlreadyConfirmed").otherwise("ConfirmationConflict"))
        .when(F.col("freed") | F.col("was").isNotNull(), "AlreadyConfirmed")
        .when(F.col("held").isNotNull(), "Released")
        .otherwise("TokenNotFound")
    )
    return rows.where("new").select("confirmation_id", "seq", "token", result.alias("result"))


ENVELOPE = (
    "obligations array<struct<kind: string, token: string, phase: string, holder_key: string, "
    "lease_tickets: array<struct<ticket_id: string, pool: string, units: bigint, generation: bigint, review_marked: boolean>>>>"
)
#: Phases of an obligation that are a lease's status as they stand; others count as Queued: fixed values.
LEASE_STATUS = ("Queued", "PendingCommit", "Held", "ReviewMarked", "AmbiguousHeld", "Quarantined", "Released", "CancelledBeforeGrant", "LeaseLost")
#: Status of a lease -> state of its tickets in gauges; others have none: fixed values.
TICKET_STATES = (("PendingCommit", "pending_commit"), ("Held", "held"), ("ReviewMarked", "review_marked"), ("AmbiguousHeld", "ambiguous_held"), ("Quarantined", "quarantined"))


def outstanding_leases(envelopes: DataFrame, tickets: DataFrame) -> DataFrame:
    """(instance_id, updated_at, envelope json) -> open resource obligations with their tickets as an array sorted by pool and generation.

    A ticket is marked for review if the obligation or the pool's ticket says so; a quarantined lease is so since its instance's last update.
    """
    o = envelopes.select("instance_id", "updated_at", F.explode(F.from_json("envelope", ENVELOPE)["obligations"]).alias("o")).select("instance_id", "updated_at", "o.*")
    o = o.where((F.col("kind") == "Resource") & F.col("token").isNotNull() & ~F.coalesce(F.col("phase").isin("Released", "CancelledBeforeGrant"), F.lit(False)))
    marked = tickets.where("review_marked").groupBy("instance_id", "holder_key").agg(F.collect_set("ticket_id").alias("marked"))
    status = F.when(F.col("phase").isin(*LEASE_STATUS), F.col("phase")).otherwise("Queued")
    own = F.transform(
        F.coalesce("lease_tickets", F.array()),
        lambda t: F.struct(
            t["pool"].alias("pool"), t["generation"].alias("generation"), t["ticket_id"].alias("ticket_id"), t["units"].alias("units"),
            (F.coalesce(t["review_marked"], F.lit(False)) | F.coalesce(F.array_contains("marked", t["ticket_id"]), F.lit(False))).alias("review_marked"),
        ),
    )
    out = o.join(marked, ["instance_id", "holder_key"], "left").withColumn("status", status)
    return out.select("instance_id", "holder_key", "token", "status", F.array_sort(own).alias("tickets"), F.when(F.col("status") == "Quarantined", F.col("updated_at")).alias("quarantined_at"))


def lease_gauges(leases: DataFrame) -> DataFrame:
    """Rows of ``outstanding_leases`` -> by pool and state of the lease: tickets, units, oldest quarantine."""
    state = F.lit(None).cast("string")
    for status, name in TICKET_STATES:
        state = F.when(F.col("status") == status, name).otherwise(state)
    t = leases.withColumn("state", state).where("state is not null").select("state", "quarantined_at", F.explode("tickets").alias("t"))
    return t.groupBy(F.col("t.pool").alias("pool"), "state").agg(F.count("*").alias("n"), F.sum("t.units").alias("units"), F.min("quarantined_at").alias("oldest"))


def pool_states(tickets: DataFrame, leases: DataFrame) -> DataFrame:
    """(pool, state, n, units): the pools' tickets, held or marked for review; what ``lease_gauges`` tells of a pool and state stands in their place."""
    state = F.when(F.col("review_marked"), "review_marked").otherwise("held")
    own = tickets.groupBy(F.col("pool").cast("string").alias("pool"), state.alias("state")).agg(F.count("*").alias("n"), F.sum("units").alias("units"))
    return own.join(leases, ["pool", "state"], "left_anti").unionByName(leases.select("pool", "state", "n", "units"))


def release_evidence(evidence: DataFrame) -> DataFrame:
    """The newest evidence per (instance_id, holder_key)."""
    w = Window.partitionBy("instance_id", "holder_key").orderBy(F.desc("seq"))
    return evidence.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
