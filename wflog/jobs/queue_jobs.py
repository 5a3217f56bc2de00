"""Queries over work queues, timers, retries and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import log, queues as Q, retention as R
from ..sources.adapters import adapt, cte, log_by_stream
from ..sources.scratch import materialize
from .log_jobs import CHECKPOINTS, checkpoints_at
from .registry import job
from .store_jobs import HISTORY

AT, AT_SQL = "timestamp_ntz '1998-06-01 00:00:00'", "timestamp '1998-06-01 00:00:00'"
DAY = "interval '1' day"
_FREE = f"(state in ('Pending', 'Retryable') or (state = 'Claimed' and (claimed_until is null or claimed_until <= {AT_SQL})))"


def at():
    return F.expr(AT)


@job("claim_outbox", cte("outbox") + f""" select outbox_record_id, 'Claimed' as state, dispatch_attempt + 1 as dispatch_attempt, {AT_SQL} + {DAY} as claimed_until from outbox
    where {_FREE} and kind <> 'continue' and (kind <> 'dag-run-ready-v1' or recipient_host_id is null or recipient_host_id = 'host-1') order by outbox_record_id limit 1000""")  # fmt: skip
def claim_outbox(spark, d):
    return Q.claim_outbox(adapt(spark, d, "outbox"), at(), F.expr(DAY), 1000, exclude=["continue"], host="host-1")[0].select("outbox_record_id", "state", "dispatch_attempt", "claimed_until")


@job("claim_outbox_table", cte("outbox") + f""", c as (select outbox_record_id from outbox where {_FREE} and kind in ('continue', 'external') order by 1 limit 1000)
    select case when c.outbox_record_id is null then state else 'Claimed' end as state, sum(dispatch_attempt + case when c.outbox_record_id is null then 0 else 1 end)::bigint as attempts, count(*) as n from outbox o left join c using (outbox_record_id) group by 1""")  # fmt: skip
def claim_outbox_table(spark, d):
    table = Q.claim_outbox(adapt(spark, d, "outbox"), at(), F.expr(DAY), 1000, include=["continue", "external"])[1]
    return table.groupBy("state").agg(F.sum("dispatch_attempt").alias("attempts"), F.count("*").alias("n"))


RESULTS = "select outbox_record_id, kind, rid, case rid % 4 when 0 then 'Success' when 1 then 'RetryableFailure' when 2 then 'PermanentFailure' end as result, case when rid % 8 = 2 then 'E' || cast(rid % 3 as string) end as code from {outbox} where rid % 5 <> 0"


def results(spark, d):
    return spark.sql(RESULTS, outbox=adapt(spark, d, "outbox"))


@job("apply_dispatch_results", cte("outbox") + f""", r as ({RESULTS.format(outbox='outbox')}),
    h as (select o.*, result, code, case when state = 'Poisoned' then null when result = 'Success' then 'Dispatched' when result = 'RetryableFailure' then 'Retryable' when result = 'PermanentFailure' and (code is null or state = 'Claimed') then 'Poisoned' end as new from outbox o left join r using (outbox_record_id))
    select outbox_record_id, coalesce(new, state) as state, case when new is null then claimed_until end as claimed_until, case when new = 'Poisoned' then code end as poison_code from h""")  # fmt: skip
def apply_dispatch_results(spark, d):
    return Q.apply_dispatch_results(adapt(spark, d, "outbox"), results(spark, d).select("outbox_record_id", "result", "code")).select("outbox_record_id", "state", "claimed_until", "poison_code")


@job("release_outbox", cte("outbox") + """ select outbox_record_id, case when rid % 3 = 0 and state = 'Claimed' then 'Retryable' else state end as state, case when rid % 3 = 0 and state = 'Claimed' then null else claimed_until end as claimed_until from outbox""")
def release_outbox(spark, d):
    o = adapt(spark, d, "outbox")
    # ids are cut to nine digits, so from a million orders on several records share one
    return Q.release_outbox(o, o.where("rid % 3 = 0"), ("outbox_record_id", "rid")).select("outbox_record_id", "state", "claimed_until")


@job("dispatch_summary", cte("outbox") + f""", r as ({RESULTS.format(outbox='outbox')})
    select kind, count(*) as claimed, count(result) as attempted, count(*) filter (result = 'Success') as success, count(*) filter (result = 'RetryableFailure') as retryable, count(*) filter (result = 'PermanentFailure') as permanent from r group by kind""")  # fmt: skip
def dispatch_summary(spark, d):
    return Q.dispatch_summary(results(spark, d))


SIGNALS = "select outbox_record_id, rid, instance_id, occurred_at, case when rid % 6 = 0 then occurred_at + interval '300' day end as not_before from {outbox} where kind = 'continue'"


@job("coalesce_continuations", cte("outbox") + f""", s as ({SIGNALS.format(outbox='outbox')}), g as (select * from s where rid % 13 <> 0 and (not_before is null or not_before <= {AT_SQL}))
    select 'due' as part, instance_id, count(*) as n, max(greatest(0, epoch_us({AT_SQL}) - epoch_us(occurred_at))) as lag_micros, string_agg(outbox_record_id, ',' order by outbox_record_id) as records from g group by instance_id
    union all select case when rid % 13 = 0 then 'Poisoned' else 'Retryable' end, null, null, null, outbox_record_id from s where rid % 13 = 0 or not_before > {AT_SQL}""")  # fmt: skip
def coalesce_continuations(spark, d):
    s = spark.sql(SIGNALS, outbox=adapt(spark, d, "outbox"))
    bad = F.when(F.col("rid") % 26 == 0, "{not json").otherwise('{"instance_id": 7}')
    payload = F.when(F.col("rid") % 13 == 0, bad).otherwise(F.to_json(F.struct("instance_id", "occurred_at", "not_before")))
    due, others = Q.coalesce_continuations(s.select("outbox_record_id", payload.alias("payload")), at())
    due = due.select(F.lit("due").alias("part"), "instance_id", "n", "lag_micros", F.array_join("records", ",").alias("records"))
    none = F.lit(None).cast("long")
    return due.unionByName(others.select(F.col("state").alias("part"), none.alias("instance_id"), none.alias("n"), none.alias("lag_micros"), F.col("outbox_record_id").alias("records")))


@job("failure_backoff", cte("event_log") + """, a as (select stream_id, version, 'step-' || (version // 7) as step_path, event_type <> 'StepCompleted' as failed from event_log),
    b as (select *, case when not failed or step_path is distinct from lag(step_path) over w or not coalesce(lag(failed) over w, false) then 1 else 0 end as new from a window w as (partition by stream_id order by version)),
    c as (select *, sum(new) over (partition by stream_id order by version) as run from b), e as (select *, row_number() over (partition by stream_id, run order by version) as attempt from c)
    select stream_id, version, attempt::int as attempt, least(60.0::double, pow(2.0::double, greatest(0, attempt - 1))) as delay_s, attempt >= 5 as park from e where failed""")  # fmt: skip
def failure_backoff(spark, d):
    step = F.concat(F.lit("step-"), F.floor(F.col("version") / 7).cast("string"))
    return Q.failure_backoff(adapt(spark, d, "event_log").select("stream_id", "version", step.alias("step_path"), (F.col("event_type") != "StepCompleted").alias("failed")))


@job("claim_timers", cte("timers") + f""" select timer_id, fire_at, {AT_SQL} + {DAY} as claimed_until from timers where fire_at <= {AT_SQL} and (not claimed or claimed_until is null or claimed_until <= {AT_SQL}) order by fire_at, timer_id limit 700""")
def claim_timers(spark, d):
    return Q.claim_timers(adapt(spark, d, "timers"), at(), at(), F.expr(DAY), 700)[0].select("timer_id", "fire_at", "claimed_until")


TIMER_OPS = """select case when instance_id % 9 = 0 then 'new' || timer_id else timer_id end as timer_id, instance_id * 2 as seq, case instance_id % 3 when 0 then 'upsert' when 1 then 'complete' else 'release' end as op, fire_at + interval '7' day as fire_at, instance_id + 1 as instance_id
from {timers} where instance_id % 4 = 0
union all select case when instance_id % 9 = 0 then 'new' || timer_id else timer_id end as timer_id, instance_id * 2 + 1 as seq, 'release' as op, fire_at, instance_id from {timers} where instance_id % 20 = 0"""


@job("maintain_timers", cte("timers") + f""", o as ({TIMER_OPS.format(timers='timers')}), s as (select * from o where op <> 'release'), f as (select distinct timer_id from o where op = 'release')
    select coalesce(t.timer_id, s.timer_id) as timer_id, case when op = 'upsert' then s.instance_id else t.instance_id end as instance_id, case when op = 'upsert' then s.fire_at else t.fire_at end as fire_at,
      case when op = 'upsert' or f.timer_id is not null then false else claimed end as claimed, case when op = 'upsert' or f.timer_id is not null then null else claimed_until end as claimed_until
    from timers t full join s on s.timer_id = t.timer_id left join f on f.timer_id = coalesce(t.timer_id, s.timer_id) where coalesce(op <> 'complete', true)""")  # fmt: skip
def maintain_timers(spark, d):
    t = adapt(spark, d, "timers")
    return Q.maintain_timers(t, spark.sql(TIMER_OPS, timers=t)).select("timer_id", "instance_id", "fire_at", "claimed", "claimed_until")


@job("wait_outcomes", cte("event_log") + """, w as (select stream_id, wait_id, version from event_log where event_type = 'WaitRegistered'),
    c as (select stream_id, wait_id, version, case when event_type = 'WaitMatched' then 'match' else 'timeout' end as kind from event_log where event_type in ('WaitMatched', 'TimerFired')),
    j as (select w.*, kind, row_number() over (partition by w.stream_id, w.wait_id, w.version order by c.version) as rn from w left join c on c.stream_id = w.stream_id and c.wait_id = w.wait_id and c.version > w.version)
    select stream_id, wait_id, version, case kind when 'match' then 'matched' when 'timeout' then 'timed_out' else 'open' end as outcome from j where rn = 1""")  # fmt: skip
def wait_outcomes(spark, d):
    e = adapt(spark, d, "event_log")
    c = e.where("event_type in ('WaitMatched', 'TimerFired')").select("stream_id", "wait_id", "version", F.when(F.col("event_type") == "WaitMatched", "match").otherwise("timeout").alias("kind"))
    return Q.wait_outcomes(e.where("event_type = 'WaitRegistered'").select("stream_id", "wait_id", "version"), c)


@job("deadline_breaches", cte("projections") + f""" select instance_id, status from projections where case when status in ('Completed', 'Failed', 'TimedOut', 'Cancelled', 'Terminated') then updated_at > created_at + interval '14' day else created_at + interval '14' day <= {AT_SQL} end""")
def deadline_breaches(spark, d):
    return Q.deadline_breaches(adapt(spark, d, "projections"), at(), F.expr("interval '14' day")).select("instance_id", "status")


_SETTLED = "select instance_id, updated_at as settled_at, instance_id as ordinal from {projections} where status in ('Completed', 'Failed')"


@job("retention_plan", cte("projections") + f""", s as ({_SETTLED.format(projections='projections')}), a as (select *, settled_at <= timestamp '2001-09-01' - interval '900' day as aged from s),
    k as (select instance_id from a where not aged order by ordinal desc limit 1500) select instance_id, case when aged then 'age' else 'count' end as reason from a where instance_id not in (select instance_id from k)""")  # fmt: skip
def retention_plan(spark, d):
    s = spark.sql(_SETTLED, projections=adapt(spark, d, "projections"))
    return R.retention_plan(s, F.expr("timestamp_ntz '2001-09-01 00:00:00'"), F.expr("interval '900' day"), 1500).select("instance_id", "reason")


_BLOCK = """
    i as (select distinct instance_id from inbox where state = 'Received'),
    o as (select instance_id, bool_or(state = 'Claimed') as c, bool_or(state in ('Pending', 'Retryable')) as p, bool_or(state = 'Poisoned') as x from outbox group by 1),
    b as (select w.instance_id, p.status, p.status is not null or h.stream_id is not null as "exists",
      case when p.status in ('Pending', 'Running', 'Waiting', 'CancellationRequested') then 'ActiveInstance' when i.instance_id is not null then 'PendingInboxDelivery' when c then 'ClaimedOutboxDispatch' when o.p then 'PendingOutboxDispatch' when x then 'PoisonedOutboxDispatch' else 'None' end as blocker
      from w left join projections p using (instance_id) left join (select distinct stream_id from event_log) h on h.stream_id = w.instance_id left join i using (instance_id) left join o using (instance_id))"""


BLOCK = "w as (select distinct user_id * 5 as instance_id from events union select instance_id from projections)," + _BLOCK


def blockers(spark, d, requested, projections, heads):
    i = adapt(spark, d, "inbox")
    roots = F.col("route_kind") == "definition-fanout"
    return R.maintenance_blockers(requested, projections, heads, i.where(~roots), adapt(spark, d, "outbox"), i.where(roots))


_TABLES = cte("projections", "event_log", "inbox", "outbox", "timers")


@job("maintenance_blockers", _TABLES + ", " + BLOCK + ' select instance_id, status, "exists", blocker from b')
def maintenance_blockers(spark, d):
    p = adapt(spark, d, "projections")
    want = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") * 5).alias("instance_id")).union(p.select("instance_id"))
    return blockers(spark, d, want, p, log.stream_heads(adapt(spark, d, "event_log")))


@job("archive_instances", cte("projections") + f""", r as (select instance_id, case when status in ('Pending', 'Running', 'Waiting', 'CancellationRequested') then 'Rejected' else 'Archived' end as result from projections
    union all select -1 - instance_id, 'NotFound' from projections) select instance_id, result, case when result = 'Archived' then {AT_SQL} end as archived_at from r""")  # fmt: skip
def archive_instances(spark, d):
    p = adapt(spark, d, "projections")
    ids = p.select("instance_id")
    return R.archive_instances(ids.union(ids.select(-1 - F.col("instance_id"))), p, at())


#: Every instance is asked for: streams, projections and, by ids that few streams have, some that aren't there.
_ALL = "w as (select user_id as instance_id from events union select user_id * 5 as instance_id from events union select instance_id from projections)," + _BLOCK
_PURGED = cte("projections", "event_log", "inbox", "outbox", "timers", "active_waits") + f", {CHECKPOINTS}, history as ({HISTORY.format(events='events')}), {_ALL}"


@job("purge_instances", _PURGED + """, g as (select instance_id from b where "exists" and blocker = 'None')
    select 'projections' as tbl, count(*) as n from projections where instance_id not in (select instance_id from g) union all select 'timers', count(*) from timers where instance_id not in (select instance_id from g)
    union all select 'outbox', count(*) from outbox where instance_id not in (select instance_id from g) union all select 'purged', count(*) from g
    union all select 'rejected', count(*) from b where "exists" and blocker <> 'None' union all select 'not_found', count(*) from b where not ("exists")
    union all select 'active_waits', count(*) from active_waits t where not exists (select 1 from g where g.instance_id = t.instance_id)
    union all select 'history', count(*) from history t where not exists (select 1 from g where g.instance_id = t.instance_id)
    union all select 'checkpoints', count(*) from checkpoints t where not exists (select 1 from g where g.instance_id = t.stream_id)
    union all select 'event_log', count(*) from event_log t where not exists (select 1 from g where g.instance_id = t.stream_id)
    union all select 'heads', count(*) from heads t where not exists (select 1 from g where g.instance_id = t.stream_id)""")  # fmt: skip
def purge_instances(spark, d):
    p, e = adapt(spark, d, "projections"), adapt(spark, d, "event_log")
    heads = materialize(log.stream_heads(log_by_stream(spark, d)), "purge-heads")
    streams = heads.select(F.col("stream_id").alias("instance_id"))
    want = streams.union(streams.select(F.col("instance_id") * 5)).union(p.select("instance_id"))
    made = {"projections": p, "history": spark.sql(HISTORY, events=spark.read.parquet(f"{d}/events.parquet"))} | {n: adapt(spark, d, n) for n in ("timers", "outbox", "active_waits")}
    logged = {"event_log": e, "heads": heads, "checkpoints": checkpoints_at(heads)}
    report, tables = R.purge_instances(blockers(spark, d, want, p, heads), {n: (t, "instance_id") for n, t in made.items()} | {n: (t, "stream_id") for n, t in logged.items()})
    names = {"purged": "Purged", "rejected": "Rejected", "not_found": "NotFound"}
    out = report.agg(*[F.count_if(F.col("result") == r).alias(n) for n, r in names.items()]).unpivot([], list(names), "tbl", "n")
    for name, t in tables.items():
        out = out.unionByName(t.agg(F.lit(name).alias("tbl"), F.count("*").alias("n")))
    return out
