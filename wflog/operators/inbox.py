"""Inbound events: acceptance, routing, exactly-once matching and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import backoff_seconds, route_key
from .log import TERMINAL
from .ranks import ranked


def classify_acceptance(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(event_id, acceptance_sequence, envelope_fingerprint) -> result Accepted, Duplicate or Conflict, in acceptance order."""
    rows = events.select("event_id", "acceptance_sequence", "envelope_fingerprint", F.lit(True).alias("new"))
    if stored is not None:
        rows = rows.unionByName(stored.select("event_id", F.lit(-1).cast("long").alias("acceptance_sequence"), "envelope_fingerprint", F.lit(False).alias("new")))
    w = Window.partitionBy("event_id").orderBy("acceptance_sequence")
    rows = rows.withColumn("first", F.first("envelope_fingerprint").over(w)).withColumn("rn", F.row_number().over(w))
    result = F.when(F.col("rn") == 1, "Accepted").when(F.col("envelope_fingerprint") == F.col("first"), "Duplicate").otherwise("Conflict")
    return rows.where("new").select("event_id", "acceptance_sequence", result.alias("result"))


def check_direct_targets(events: DataFrame, projections: DataFrame) -> DataFrame:
    out = events.join(projections.select("instance_id", F.col("status").alias("target_status")), "instance_id", "left")
    check = F.when(F.col("target_status").isNull(), "DirectInstanceNotFound").when(F.col("target_status").isin(*TERMINAL), "DirectInstanceTerminal").otherwise("Ok")
    return out.withColumn("check", check)


def definition_fanout(events: DataFrame, projections: DataFrame, max_targets: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(targets (event_id, instance_id), events with result): one row per nonterminal instance of the definition.

    Definitions are counted before anything is multiplied, so an event over the limit never explodes.
    """
    live = projections.where(~F.col("status").isin(*TERMINAL))
    counts = live.groupBy("definition_id").agg(F.count("*").alias("n"))
    judged = events.join(counts, "definition_id", "left").withColumn("n_targets", F.coalesce("n", F.lit(0))).drop("n")
    judged = judged.withColumn("result", F.when(F.col("n_targets") > max_targets, "FanoutLimitExceeded").otherwise("Accepted"))
    small = counts.where(F.col("n") <= max_targets).select("definition_id")
    targets = judged.where("result = 'Accepted'").select("event_id", "acceptance_sequence", "definition_id").join(live.join(small, "definition_id", "left_semi").select("definition_id", "instance_id"), "definition_id")
    return targets, judged


def _route(kind: str, instance: Column, definition: Column, version: Column, name: Column, correlation: Column) -> Column:
    owners = {"direct": [instance], "correlation": [definition], "target": [instance, definition]}[kind]
    return route_key(kind, owners, version, name, correlation)


def wait_routes(waits: DataFrame) -> DataFrame:
    """Each wait with its route keys: direct, correlation and fan-out target; all of them hold the correlation."""
    c = [F.col(x) for x in ("instance_id", "definition_id", "event_contract_version", "event_name", "correlation_id")]
    return waits.withColumn("route_key", F.explode(F.array(*[_route(k, *c) for k in ("direct", "correlation", "target")])))


def event_route(kind: Column, instance: Column, definition: Column, version: Column, name: Column, correlation: Column) -> Column:
    """The key under which an event waits; an event to a definition has one per target."""
    c = (instance, definition, version, name, correlation)
    return F.when(kind == "direct", _route("direct", *c)).when(kind == "correlation", _route("correlation", *c)).otherwise(_route("target", *c))


def match_pending_events(waits: DataFrame, pending: DataFrame) -> DataFrame:
    """For each wait the first Received event on any of its routes, by (acceptance_sequence, event_id, instance_id).

    The first event of a route is found before the join, so a frequent route costs its waits one row each.
    """
    order = F.struct("acceptance_sequence", "event_id", F.col("instance_id").alias("event_instance"))
    first = pending.where("state = 'Received'").groupBy("route_key").agg(F.min(order).alias("e"))
    hits = wait_routes(waits).join(first, "route_key").groupBy("wait_id").agg(F.min("e").alias("e"))
    return hits.select("wait_id", "e.acceptance_sequence", "e.event_id")


def resolve_correlation(events: DataFrame, waits: DataFrame) -> DataFrame:
    """buffered without, deliver with one and ambiguous with more than one waiting instance."""
    key = ["definition_id", "event_name", "event_contract_version", "correlation_id"]
    owners = waits.groupBy(*key).agg(F.countDistinct("instance_id").alias("n"), F.min("instance_id").alias("target"))
    out = events.join(owners, key, "left")
    result = F.when(F.coalesce("n", F.lit(0)) == 0, "buffered").when(F.col("n") == 1, "deliver").otherwise("ambiguous")
    return out.withColumn("result", result).withColumn("target", F.when(F.col("n") == 1, F.col("target")))


def pick_wait(waits: DataFrame) -> DataFrame:
    """Among an instance's waits equal in name, version and correlation the lowest (wait_sequence, fiber_id or '', wait_id)."""
    key = ["instance_id", "event_name", "event_contract_version", "correlation_id"]
    w = Window.partitionBy(*key).orderBy("wait_sequence", F.coalesce("fiber_id", F.lit("")), "wait_id")
    return waits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def deliver_exactly_once(events: DataFrame, waits: DataFrame, key: list[str], most: int = 5_000_000) -> DataFrame:
    """The k-th event of a key meets its k-th wait: both queues are first in, first out.

    Keys are numbered by windows where each has ``most`` rows at most, counted before; otherwise by ranges, which deal a hot key out over many tasks.
    """
    sides = (events, ["acceptance_sequence", "event_id"]), (waits.select(*key, "registered_at", "wait_id"), ["registered_at", "wait_id"])
    largest = max(df.groupBy(*key).count().agg(F.max("count")).first()[0] or 0 for df, _ in sides)
    if largest <= most:
        e, w = (df.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))) for df, order in sides)
    else:
        e, w = (ranked(df, key, order).withColumnRenamed("rank", "k").drop("members") for df, order in sides)
    return e.join(w.drop("registered_at"), [*key, "k"])


def list_received(inbox: DataFrame, targets: DataFrame, after: int, limit: int) -> DataFrame:
    """A page of Received records after a sequence: inbox without fan-out roots, and fan-out targets."""
    c = ["acceptance_sequence", "event_id", "instance_id"]
    rows = inbox.where("state = 'Received' and route_kind is distinct from 'definition-fanout'").select(*c).unionByName(targets.where("state = 'Received'").select(*c))
    return rows.where(F.col("acceptance_sequence") > after).orderBy(*c).limit(limit)


def list_handoff_retries(inbox: DataFrame, targets: DataFrame, at: Column, limit: int) -> DataFrame:
    """The first Received records, of the inbox and of fan-out targets, whose handoff failed and may be tried again."""
    c = ["event_id", "instance_id", "acceptance_sequence", "state", "handoff_failure_count", "handoff_retry_not_before"]
    due = inbox.select(*c).unionByName(targets.select(*c)).where((F.col("state") == "Received") & (F.col("handoff_failure_count") > 0) & (F.col("handoff_retry_not_before") <= at))
    return due.orderBy("handoff_retry_not_before", "acceptance_sequence", "event_id", "instance_id").limit(limit)


def record_handoff_failure(inbox: DataFrame, failures: DataFrame, at: Column, most: int) -> DataFrame:
    """failures (acceptance_sequence, expected_count, code): count up, poison at ``most``, else set the retry time; guarded by state and count."""
    f = failures.select("acceptance_sequence", "expected_count", "code")
    out = inbox.join(f, "acceptance_sequence", "left")
    hit = (F.col("state") == "Received") & (F.col("handoff_failure_count") == F.col("expected_count"))
    hit = F.coalesce(hit, F.lit(False))
    n = F.col("handoff_failure_count") + 1
    dead = hit & (n >= most)
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff_seconds(n).cast("decimal(18,6)"))
    return out.select(
        *[c for c in inbox.columns if c not in ("state", "handoff_failure_count", "handoff_retry_not_before", "poison_code")],
        F.when(dead, "Poisoned").otherwise(F.col("state")).alias("state"),
        F.when(hit, n).otherwise(F.col("handoff_failure_count")).alias("handoff_failure_count"),
        F.when(dead, None).when(hit, at + wait).otherwise(F.col("handoff_retry_not_before")).alias("handoff_retry_not_before"),
        F.when(dead, F.col("code")).otherwise(F.col("poison_code") if "poison_code" in inbox.columns else F.lit(None)).alias("poison_code"),
        hit.alias("applied"),
    )


def transition_inbox(inbox: DataFrame, changes: DataFrame, key: tuple[str, ...] = ("acceptance_sequence",)) -> DataFrame:
    """changes (key, expected or null, new_state): compare and set; ``applied`` tells which took effect. Fan-out targets have their instance in the ``key``."""
    out = inbox.join(changes, list(key), "left")
    hit = F.col("new_state").isNotNull() & (F.col("expected").isNull() | (F.col("expected") == F.col("state")))
    return out.withColumn("applied", hit).withColumn("state", F.when(hit, F.col("new_state")).otherwise(F.col("state"))).drop("expected", "new_state")


def start_or_deliver(requests: DataFrame, starts: DataFrame, intents: DataFrame) -> DataFrame:
    """requests (key, seq, definition_id, definition_version, fingerprint) -> DeliverDirect, IntentCreated, IntentJoined or StartConflict.

    A request is a conflict when it differs from what its key was started with, or when the key's stored intent is poisoned or of another kind. Without
    either, the key's first request creates the intent that the others are compared with. Requests that hold against a started key go direct to its instance.
    """
    what = ["definition_id", "definition_version", "fingerprint"]
    row = F.struct(*what)
    known = intents.select("key", row.alias("intended"), F.col("state").alias("intent_state"))
    begun = starts.select("key", row.alias("begun"), F.col("instance_id").alias("started_id"))
    first = requests.groupBy("key").agg(F.min(F.struct("seq", *what)).alias("f")).select("key", F.col("f.seq").alias("first_seq"), F.struct(*[F.col(f"f.{c}").alias(c) for c in what]).alias("first"))
    rows = requests.join(begun, "key", "left").join(known, "key", "left").join(first, "key")
    differs = lambda c: ~row.eqNullSafe(F.col(c))
    conflict = (
        (F.col("begun").isNotNull() & differs("begun"))
        | (F.col("intended").isNotNull() & (differs("intended") | (F.col("intent_state") == "Poisoned")))
        | (F.col("begun").isNull() & F.col("intended").isNull() & differs("first"))
    )
    created = F.col("intended").isNull() & (F.col("seq") == F.col("first_seq"))
    result = F.when(conflict, "StartConflict").when(F.col("begun").isNotNull(), "DeliverDirect").when(created, "IntentCreated").otherwise("IntentJoined")
    return rows.select("key", "seq", result.alias("result"), F.when(~conflict, F.col("started_id")).alias("started_id"))


def materialize_starts(intents: DataFrame, events: DataFrame, started: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending intents of started keys become Materialized; their unassigned Received start-or-deliver events get the instance and a direct route."""
    s = started.select("key", F.col("instance_id").alias("new_id"))
    i = intents.join(s, "key", "left")
    done = F.col("new_id").isNotNull() & (F.col("state") == "Pending")
    i = i.withColumn("instance_id", F.when(done, F.col("new_id")).otherwise(F.col("instance_id"))).withColumn("state", F.when(done, "Materialized").otherwise(F.col("state"))).drop("new_id")
    e = events.join(s, "key", "left")
    mine = F.col("new_id").isNotNull() & F.col("instance_id").isNull() & (F.col("state") == "Received") & (F.col("route_kind") == "start-or-deliver")
    key = route_key("direct", [F.col("new_id")], F.col("event_contract_version"), F.col("event_name"), F.col("correlation_id"))
    e = e.withColumn("route_key", F.when(mine, key).otherwise(F.col("route_key"))).withColumn("instance_id", F.when(mine, F.col("new_id")).otherwise(F.col("instance_id"))).drop("new_id")
    return i, e


def _poisoned(rows: DataFrame, hit: Column, code: str) -> DataFrame:
    """Rows with a new state and code where hit; a code stored earlier stays."""
    stored = F.col("poison_code") if "poison_code" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("poison_code", F.when(hit, F.lit(code)).otherwise(stored)).withColumn("state", F.when(hit, "Poisoned").otherwise(F.col("state")))


def poison_start_keys(intents: DataFrame, inbox: DataFrame, keys: DataFrame, code: str, expected: str = "Received") -> tuple[DataFrame, DataFrame]:
    """Pending intents of the given start keys become Poisoned, and so do all events of these intents in the expected state."""
    bad = keys.select("key").distinct().join(intents.where("state = 'Pending'").select("key").distinct(), "key", "left_semi").withColumn("_bad", F.lit(True))
    i = intents.join(bad, "key", "left")
    e = inbox.join(bad, "key", "left")
    hit = F.col("_bad").isNotNull()
    return _poisoned(i, hit & (F.col("state") == "Pending"), code).drop("_bad"), _poisoned(e, hit & (F.col("state") == expected), code).drop("_bad")


def poison_targets(inbox: DataFrame, instances: DataFrame, code: str) -> DataFrame:
    """All Received direct events of the given instances become Poisoned."""
    bad = instances.select("instance_id").distinct().withColumn("_bad", F.lit(True))
    out = inbox.join(bad, "instance_id", "left")
    hit = F.col("_bad").isNotNull() & (F.col("state") == "Received") & (F.col("route_kind") == "direct")
    return _poisoned(out, hit, code).drop("_bad")


def classify_direct_delivery(events: DataFrame, projections: DataFrame, waits: DataFrame) -> DataFrame:
    """Delivery without buffering: Duplicate or EventConflict against earlier accepted events, InstanceNotFound, InstanceTerminal, NoActiveWait or Accepted.

    Only accepted ids are remembered; a later event of an id is compared with the first that could be accepted.
    """
    key = ["instance_id", "event_name", "event_contract_version", "correlation_id"]
    rows = events.join(projections.select("instance_id", F.col("status").alias("target_status")), "instance_id", "left")
    rows = rows.join(waits.select(*key).distinct().withColumn("waiting", F.lit(True)), key, "left")
    fit = F.col("target_status").isNotNull() & ~F.col("target_status").isin(*TERMINAL) & F.col("waiting").isNotNull()
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    w = Window.partitionBy("instance_id", "event_id").orderBy("acceptance_sequence").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.first(F.when(F.col("fit"), F.col("envelope_fingerprint")), ignorenulls=True).over(w)
    rows = rows.withColumn("earlier", earlier)
    result = (
        F.when(F.col("earlier").isNotNull(), F.when(F.col("earlier") == F.col("envelope_fingerprint"), "Duplicate").otherwise("EventConflict"))
        .when(F.col("target_status").isNull(), "InstanceNotFound")
        .when(F.col("target_status").isin(*TERMINAL), "InstanceTerminal")
        .when(F.col("waiting").isNull(), "NoActiveWait")
        .otherwise("Accepted")
    )
    return rows.withColumn("result", result).drop("fit", "earlier", "waiting", "target_status")
