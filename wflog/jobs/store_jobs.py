"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import store as S
from ..sources.adapters import adapt, cte
from ..sources.scratch import new_path
from .registry import job

E = "event_log"


def typed(spark, d):
    """The log with every payload field: what the given tables lack is derived from the event."""
    e = adapt(spark, d, E)
    text = lambda c: F.col(c).cast("string").alias(c)
    moment = lambda c, name=None: F.col(c).cast("timestamp").alias(name or c)
    number = lambda prefix: F.concat(F.lit(prefix), F.col("event_id").cast("string"))
    ticket = F.struct(number("k").alias("ticket_id"), F.concat(F.lit("p"), (F.col("event_id") % 9).cast("string")).alias("pool_name"), (F.col("event_id") % 6).cast("int").alias("count"), text("stream_id").alias("holder_instance_id"), "holder_key", moment("occurred_at", "acquired_at"), moment("next_eligible_at", "expires_at"),
        "fiber_id", "scope_id", F.col("version").alias("provider_generation"), moment("fire_at", "review_deadline"), (F.col("event_id") % 2 == 0).alias("review_marked"))
    return e.select(
        "stream_id", "version", "event_id", "event_type", "occurred_at", "step_path", "wait_id", "timer_id", "holder_key", "event_name", "correlation_id", "error", "event_contract_version", "fiber_id", "scope_id", "definition_version", "outcome", "reason", "generation", "attempt_count", "position_stream_version", "status",
        text("definition_id"), text("parent_instance_id"), text("root_instance_id"), moment("fire_at"), moment("next_eligible_at"), moment("next_eligible_at", "expires_at"), (F.col("event_id") % 8).cast("int").alias("failed_attempt_count"), (F.col("version") - 1).alias("previous_stream_version"), number("m").alias("matched_event_id"),
        F.lit("wake").alias("wakeup_name"), F.col("version").alias("wait_sequence"), F.encode(number("x"), "utf-8").alias("input_payload"), F.array(ticket, ticket).alias("tickets"), F.array(F.struct(F.lit("p1").alias("pool_name"), (F.col("event_id") % 5).cast("int").alias("count"))).alias("requirements"),
    )


def raw(spark, d):
    """The log as stored rows: a payload per event, some of them damaged or without a field that they must have."""
    e = typed(spark, d)
    e = e.withColumn("step_path", F.when(F.col("event_id") % 229 != 0, F.col("step_path"))).withColumn("tickets", F.when(F.col("event_id") % 4 != 0, F.col("tickets")))
    encoded = S.encode_events(e)
    payload = F.when(F.col("event_id") % 211 == 0, "{broken").when(F.col("event_id") % 223 == 0, "[1]").otherwise(F.col("payload"))
    kind = F.when(F.col("event_id") % 227 == 0, "Unknown").otherwise(F.col("event_type"))
    return encoded.withColumn("payload", payload).withColumn("event_type", kind)


_BAD = "(event_id % 211 = 0 or event_id % 223 = 0 or event_id % 227 = 0 or (event_id % 229 = 0 and event_type in ('StepCompleted', 'StepFailed')) or (event_id % 4 = 0 and event_type in ('ResourcePoolAcquired', 'ResourcePoolReleased')) or (error is null and event_type in ('Parked', 'ContinuationAttemptFailed', 'StepFailed')))"


def _of(kinds: str, value: str, name: str) -> str:
    return f"case when event_type in ({kinds}) then {value} end as {name}"


_FIBER = "'WaitRegistered', 'WaitMatched', 'WaitCancelled', 'TimerScheduled', 'TimerFired', 'TimerCancelled', 'ResumeConsumed', 'ResourcePoolAcquired', 'ResourcePoolQueued', 'ResourcePoolReleased'"
_POOL = "'ResourcePoolAcquired', 'ResourcePoolReleased'"
_FIELDS = ", ".join([
    _of("'WaitRegistered', 'WaitMatched', 'WaitCancelled', 'ResumeConsumed', 'ResourcePoolQueued'", "wait_id", "wait_id"), _of("'TimerScheduled', 'TimerFired', 'TimerCancelled'", "timer_id", "timer_id"),
    _of("'StepCompleted', 'StepFailed'", "step_path", "step_path"), _of("'Parked', 'ContinuationAttemptFailed', 'StepFailed', 'Terminal'", "error", "error"), _of("'ResourcePoolAcquired', 'ResourcePoolQueued', 'ResourcePoolReleased'", "holder_key", "holder_key"),
    _of("'TimerScheduled'", "fire_at", "fire_at"), _of("'WaitRegistered', 'WaitMatched'", "event_name", "event_name"), _of("'WaitRegistered', 'WaitMatched'", "correlation_id", "correlation_id"), _of("'WaitRegistered', 'WaitMatched'", "event_contract_version", "event_contract_version"),
    _of(_FIBER, "fiber_id", "fiber_id"), _of(_FIBER, "scope_id", "scope_id"), _of("'Started'", "definition_id::varchar", "definition_id"), _of("'Started'", "definition_version", "definition_version"), "parent_instance_id::varchar as parent_instance_id", "root_instance_id::varchar as root_instance_id",
    _of("'Completed'", "outcome", "outcome"), _of("'Parked'", "reason", "reason"), _of("'ContinuedAsNew'", "generation", "generation"), _of("'ContinuationAttemptFailed'", "attempt_count", "attempt_count"),
    _of("'Parked', 'ContinuationAttemptFailed'", "position_stream_version", "position_stream_version"), _of("'ContinuationAttemptFailed'", "next_eligible_at", "next_eligible_at"), _of("'Terminal'", "status", "status"), _of("'ResourcePoolQueued'", "next_eligible_at", "expires_at"),
    _of("'Parked'", "cast(event_id % 8 as int)", "failed_attempt_count"), _of("'ContinuedAsNew'", "version - 1", "previous_stream_version"), _of("'WaitMatched'", "'m' || event_id", "matched_event_id"), _of("'TimerScheduled'", "'wake'", "wakeup_name"),
    _of("'WaitRegistered', 'WaitMatched', 'ResourcePoolQueued'", "version", "wait_sequence"), _of("'Started'", "'x' || event_id", "input"), _of(_POOL, "'k' || event_id || '|p' || event_id % 9 || '|' || event_id % 6 || '|' || stream_id || '|' || version || '|' || case when event_id % 2 = 0 then 'true' else 'false' end", "ticket"),
    _of(_POOL, "cast(2 as int)", "n_tickets"), _of(_POOL, "fire_at", "review_deadline"), _of("'ResourcePoolQueued'", "'p1|' || event_id % 5", "requirement"),
])


@job("decode_events", cte(E) + f" select event_id, event_type, {_FIELDS} from event_log where not {_BAD}")
def decode_events(spark, d):
    good, _ = S.decode_events(raw(spark, d))
    ntz = lambda c, name: F.col(c).cast("timestamp_ntz").alias(name)
    plain = ("wait_id", "timer_id", "step_path", "error", "holder_key", "event_name", "correlation_id", "event_contract_version", "fiber_id", "scope_id", "definition_id", "definition_version", "parent_instance_id", "root_instance_id", "outcome", "reason", "generation", "attempt_count", "position_stream_version", "status",
        "failed_attempt_count", "previous_stream_version", "matched_event_id", "wakeup_name", "wait_sequence")
    t, r = F.col("tickets")[0], F.col("requirements")[0]
    ticket = F.when(t.isNotNull(), F.concat_ws("|", t["ticket_id"], t["pool_name"], t["count"].cast("string"), t["holder_instance_id"], t["provider_generation"].cast("string"), t["review_marked"].cast("string")))
    need = F.when(r.isNotNull(), F.concat_ws("|", r["pool_name"], r["count"].cast("string")))
    good = good.withColumn("t_deadline", t["review_deadline"])
    return good.select("event_id", "event_type", *plain, ntz("fire_at", "fire_at"), ntz("next_eligible_at", "next_eligible_at"), ntz("expires_at", "expires_at"), F.decode("input_payload", "utf-8").alias("input"), ticket.alias("ticket"), F.when(F.col("tickets").isNotNull(), F.size("tickets")).alias("n_tickets"), ntz("t_deadline", "review_deadline"), need.alias("requirement"))


@job("decode_events_quarantine", cte(E) + f" select event_id, case when event_id % 227 = 0 then 'Unknown' else event_type end as event_type from event_log where {_BAD}")
def decode_events_quarantine(spark, d):
    return S.decode_events(raw(spark, d))[1].select("event_id", "event_type")


@job("encode_events", cte(E) + """ select event_id, '{' || case when event_type in ('WaitRegistered', 'WaitMatched', 'WaitCancelled', 'ResumeConsumed', 'ResourcePoolQueued') then '"wait_id":"' || wait_id || '"' when event_type in ('TimerScheduled', 'TimerFired', 'TimerCancelled') then '"timer_id":"' || timer_id || '"'
    when event_type in ('StepCompleted', 'StepFailed') then '"step_path":"' || step_path || '"' else '' end || '}' as payload from event_log""")  # fmt: skip
def encode_events(spark, d):
    return S.encode_events(adapt(spark, d, E).select("event_id", "event_type", "wait_id", "timer_id", "step_path")).select("event_id", "payload")


NEW = "select instance_id + case when instance_id % 30 = 0 then 1000000 else 0 end as instance_id, 'Completed' as status, updated_at, cast(null as timestamp{ntz}) as archived_at from {{projections}} where instance_id % 10 = 0"


@job("upsert_projection", cte("projections") + f""", n as ({NEW.format(ntz='').format(projections='projections')}), s as (select instance_id, status, updated_at, archived_at from projections)
    select coalesce(n.instance_id, s.instance_id) as instance_id, coalesce(n.status, s.status) as status, coalesce(n.updated_at, s.updated_at) as updated_at, case when s.instance_id is not null then s.archived_at else n.archived_at end as archived_at from s full join n on n.instance_id = s.instance_id""")  # fmt: skip
def upsert_projection(spark, d):
    p = adapt(spark, d, "projections").select("instance_id", "status", "updated_at", "archived_at")
    return S.upsert_projection(p, spark.sql(NEW.format(ntz="_ntz"), projections=p))


@job("replace_waits", cte("active_waits") + """ select wait_id, instance_id from active_waits where instance_id % 6 <> 0 union all select distinct 'new' || instance_id, instance_id from active_waits where instance_id % 12 = 0""")
def replace_waits(spark, d):
    w = adapt(spark, d, "active_waits").select("wait_id", "instance_id")
    ids = w.where("instance_id % 6 = 0").select("instance_id").distinct()
    new = ids.where("instance_id % 12 = 0").select(F.concat(F.lit("new"), F.col("instance_id").cast("string")).alias("wait_id"), "instance_id")
    return S.replace_waits(w, new, ids)


@job("upsert_checkpoints", cte(E) + " select stream_id as instance_id, max(version) as stream_version, max(event_id) as write_order from event_log group by 1")
def upsert_checkpoints(spark, d):
    e = adapt(spark, d, E)
    return S.upsert_checkpoints(e.select(F.col("stream_id").alias("instance_id"), F.col("version").alias("stream_version"), F.col("event_id").alias("write_order")))


HISTORY = "select cast(event_id % 6000 as string) as history_id, user_id as instance_id, ts as recorded_at, event_type as kind from {events}"


@job("append_history", f"with h as ({HISTORY.format(events='events')}), s as (select * from h where cast(history_id as int) % 3 = 0 qualify row_number() over (partition by history_id order by recorded_at) = 1)" + """,
    f as (select * from h qualify row_number() over (partition by history_id order by recorded_at, instance_id, kind) = 1) select * from s union all select * from f where history_id not in (select history_id from s)""")  # fmt: skip
def append_history(spark, d):
    from pyspark.sql import Window

    h = spark.sql(HISTORY, events=spark.read.parquet(f"{d}/events.parquet"))
    rn = F.row_number().over(Window.partitionBy("history_id").orderBy("recorded_at"))
    stored = h.where("cast(history_id as int) % 3 = 0").withColumn("rn", rn).where("rn = 1").drop("rn")
    return S.append_history(stored, h)


@job("emit_outbox", "select 'm' || event_id as outbox_record_id, user_id as instance_id, event_type as kind, props as payload, 'Pending' as state, 0 as dispatch_attempt, null::timestamp as claimed_until from events where event_type = 'purchase'")
def emit_outbox(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'purchase'")
    return S.emit_outbox(e.select(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("outbox_record_id"), F.col("user_id").alias("instance_id"), F.col("event_type").alias("kind"), F.col("props").alias("payload")))


@job("write_event_log", cte(E) + " select cast(cast(occurred_at as date) as varchar) as occurred_date, count(*) as n, max(event_id) as last_event from event_log group by 1")
def write_event_log(spark, d):
    """The log appended in two commits, read back by its day folders."""
    path = new_path(spark, "event-log")
    e = adapt(spark, d, E)
    for half in (0, 1):
        S.write_event_log(e.where(F.col("event_id") % 2 == half), path)
    return spark.read.parquet(path).groupBy(F.col("occurred_date").cast("string").alias("occurred_date")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@job("read_store", cte("timers") + " select timer_id, cast(instance_id as varchar) as instance_id, fire_at, claimed from timers where fire_at < timestamp '1996-01-01'")
def read_store(spark, d):
    """Timers written as the store keeps them and read with the declared schema; the filter reaches the scan."""
    path = new_path(spark, "store")
    t = adapt(spark, d, "timers")
    t.select("timer_id", F.col("instance_id").cast("string").alias("instance_id"), F.lit(None).cast("string").alias("command_id"), F.col("fire_at").cast("timestamp").alias("fire_at"), F.lit("wake").alias("wakeup_name"), "claimed", F.col("claimed_until").cast("timestamp").alias("claimed_until")).write.parquet(f"{path}/timers.parquet")
    rows = S.read_store(spark, path, "timers").where(F.col("fire_at") < F.lit("1996-01-01").cast("timestamp"))
    return rows.select("timer_id", "instance_id", F.col("fire_at").cast("timestamp_ntz").alias("fire_at"), "claimed")
