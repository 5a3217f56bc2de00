"""Queries over instance projections and waits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import render_tags
from ..operators import log, pools, projections as P
from ..sources.adapters import adapt, cte
from ..sources.scratch import materialize
from .dag_jobs import SUBSCRIPTIONS
from .log_jobs import CHECKPOINTS, checkpoints_at
from .pool_jobs import LEASES, leases, three
from .registry import job

AT = "timestamp_ntz '1998-06-01 00:00:00'"
AT_SQL = "timestamp '1998-06-01 00:00:00'"
PW = ("projections", "active_waits")


def at():
    return F.expr(AT)


@job("get_instances", cte(*PW) + """, w as (select instance_id, string_agg(wait_id, ',' order by registered_at, wait_id) as waits, count(*) as n from active_waits group by instance_id)
    select p.instance_id, p.status, coalesce(w.waits, '') as waits, coalesce(w.n, 0) as n_waits from projections p left join w using (instance_id) where p.instance_id in (select user_id from events)""")  # fmt: skip
def get_instances(spark, d):
    p, w = adapt(spark, d, "projections"), adapt(spark, d, "active_waits")
    out = P.get_instances(p, w, spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("instance_id")))
    return out.select("instance_id", "status", F.array_join("active_waits.wait_id", ",").alias("waits"), F.size("active_waits").cast("long").alias("n_waits"))


@job("find_active_waits", cte(*PW) + " select instance_id, definition_id, status from projections p where exists (select 1 from active_waits w where w.instance_id = p.instance_id and event_name = 'evt-2' and event_contract_version = 1)")
def find_active_waits(spark, d):
    return P.find_active_waits(adapt(spark, d, "projections"), adapt(spark, d, "active_waits"), "evt-2", version=1).select("instance_id", "definition_id", "status")


OPS = "select user_id as instance_id, event_id as seq, case event_type when 'signup' then 'UpsertSummary' when 'error' then 'AppendHistory' when 'click' then 'RemoveActiveWait' else 'UpsertActiveWait' end as op, 'w' || cast(event_id % 4 as string) as wait_id, 'v' || cast(event_id as string) as value from {events}"


@job("apply_projection_ops", f"with o as ({OPS.format(events='events')})" + """, s as (select instance_id, max(seq) as upto from o where op = 'UpsertSummary' group by 1),
    l as (select instance_id, wait_id, value, seq, op from o left join s using (instance_id) where op in ('UpsertActiveWait', 'RemoveActiveWait') and seq > coalesce(upto, -1)
      union all select o.instance_id, k.wait_id, 'own ' || seq, seq, 'UpsertActiveWait' from o join s on s.instance_id = o.instance_id and s.upto = o.seq cross join (select 'own' as wait_id union all select 'w' || x from range(3) t(x)) k where k.wait_id = 'own' or seq % 2 = 0),
    r as (select *, row_number() over (partition by instance_id, wait_id order by seq desc) as rn from l)
    select o.instance_id, 'summary' as part, '' as id, value from o join s on s.instance_id = o.instance_id and s.upto = o.seq
    union all select instance_id, 'wait', wait_id, value from r where rn = 1 and op = 'UpsertActiveWait'
    union all select instance_id, 'history', cast(seq as varchar), value from o where op = 'AppendHistory'""")  # fmt: skip
def apply_projection_ops(spark, d):
    o = spark.sql(OPS, events=spark.read.parquet(f"{d}/events.parquet"))
    wait = lambda name: F.struct(F.lit(name).alias("wait_id"), F.concat(F.lit("own "), F.col("seq").cast("string")).alias("value"))
    own = F.when(F.col("seq") % 2 == 0, F.array(*map(wait, ("own", "w0", "w1", "w2")))).otherwise(F.array(wait("own")))
    s, w, h = P.apply_projection_ops(o.withColumn("waits", own))
    part = lambda f, name, key: f.select("instance_id", F.lit(name).alias("part"), key.alias("id"), "value")
    return part(s, "summary", F.lit("")).unionByName(part(w, "wait", F.col("wait_id"))).unionByName(part(h, "history", F.col("seq").cast("string")))


@job("status_groups", cte("projections") + " select definition_id, definition_version, status, count(*) as n from projections group by all")
def status_groups(spark, d):
    return P.status_groups(adapt(spark, d, "projections"))


@job("stuck_groups", cte("projections") + " select definition_id, count(*) as n from projections where is_stuck group by all")
def stuck_groups(spark, d):
    return P.stuck_groups(adapt(spark, d, "projections"))


@job("active_wait_groups", cte(*PW) + " select p.definition_id, event_name, count(*) as n from active_waits w join projections p using (instance_id) group by all")
def active_wait_groups(spark, d):
    return P.active_wait_groups(adapt(spark, d, "projections"), adapt(spark, d, "active_waits"))


_LATE = f"status in ('Pending', 'Running', 'CancellationRequested') and coalesce(last_active_at, updated_at) <= {AT_SQL} - interval '5' day and not is_stuck"


@job("mark_stuck", cte("projections") + f" select instance_id, is_stuck or ({_LATE}) as is_stuck, case when {_LATE} then coalesce(stuck_detected_at, {AT_SQL}) else stuck_detected_at end as stuck_detected_at from projections")
def mark_stuck(spark, d):
    return P.mark_stuck(adapt(spark, d, "projections"), at(), F.expr("interval '5' day")).select("instance_id", "is_stuck", "stuck_detected_at")


_STATES = ", ".join(f"count(*) filter ({t} and state = '{s}') as {n}_{s.lower()}" for n, t in (("continuation", "kind = 'continue'"), ("external", "kind not in ('continue', 'dag-child-start-v1', 'dag-child-join-v1', 'dag-child-cancel-v1', 'dag-run-ready-v1')")) for s in P.OUTBOX_STATES)


@job("operational_pressure", cte(*PW, "event_log", "outbox") + ", " + CHECKPOINTS + f""" select (select count(*) from projections where status in ('Pending', 'Running', 'Waiting', 'CancellationRequested')) as active,
    (select count(*) from projections where is_stuck) as stuck, (select count(*) from active_waits) as active_waits, (select sum(stream_version)::bigint from heads) as stream_events, (select count(*) from checkpoints) as checkpoints,
    (select max(h.stream_version - coalesce(c.stream_version, 0)) from heads h left join checkpoints c using (stream_id)) as max_lag, o.* from (select {_STATES} from outbox) o""")  # fmt: skip
def operational_pressure(spark, d, outbox=None):
    heads = materialize(log.stream_heads(adapt(spark, d, "event_log")), "heads")
    return P.operational_pressure(adapt(spark, d, "projections"), adapt(spark, d, "active_waits"), heads, checkpoints_at(heads), adapt(spark, d, "outbox") if outbox is None else outbox)


_STUCK_RUNS = f"r.state not in ('Succeeded', 'Failed', 'Cancelled') and last_progress_at <= {AT_SQL} and exists (select 1 from dag_nodes n where n.run_id = r.run_id and n.state = 'Ready')"


@job("mark_stuck_dag_runs", cte("dag_runs", "dag_nodes") + f" select run_id, state, {_STUCK_RUNS} as is_stuck from dag_runs r")
def mark_stuck_dag_runs(spark, d):
    return P.mark_stuck_dag_runs(adapt(spark, d, "dag_runs"), adapt(spark, d, "dag_nodes"), at()).select("run_id", "state", "is_stuck")


_DAG = f"""select 'active' as gauge, count(*) as n from dag_runs where state not in ('Succeeded', 'Failed', 'Cancelled')
    union all select 'stuck', count(*) from dag_runs r where {_STUCK_RUNS}
    union all select 'events', sum(version)::bigint from dag_runs union all select 'checkpoints', count(*) from dag_runs
    union all select 'observers:live', count(*) filter (expires_at > {AT_SQL}) from subs union all select 'observers:expired', count(*) filter (expires_at <= {AT_SQL}) from subs
    union all select 'outbox:' || case when recipient_host_id is null then 'internal' else 'observer' end || ':' || state, count(*) from outbox where kind = 'dag-run-ready-v1' group by 1"""
_SUBS = f"subs as ({SUBSCRIPTIONS.format(dag_runs='dag_runs')})"


@job("dag_pressure", cte("dag_runs", "dag_nodes", "outbox") + f", {_SUBS} {_DAG}")
def dag_pressure(spark, d, outbox=None):
    r = adapt(spark, d, "dag_runs")
    return P.dag_pressure(r, adapt(spark, d, "dag_nodes"), adapt(spark, d, "outbox") if outbox is None else outbox, spark.sql(SUBSCRIPTIONS, dag_runs=r), at(), at())


_LANES = " union all ".join(f"select 'outbox.lanes' as instrument, 'lane={n}, state={s.lower()}' as tags, count(*) filter ({t} and state = '{s}') as value from outbox" for n, t in (("continuation", "kind = 'continue'"), ("external", "kind not in ('continue', 'dag-run-ready-v1')")) for s in P.OUTBOX_STATES)


@job("fleet_gauges", cte(*PW, "outbox", "event_log", "dag_runs", "dag_nodes", "pools", "tickets", "waiters") + f""", {CHECKPOINTS}, {_SUBS}, dag as ({_DAG}), lanes as ({_LANES}),
    q as (select pool, count(distinct waiter_id) as queued from waiters group by 1), k as (select pool, sum(units) as reserved, count(*) filter (review_marked) as expired from tickets group by 1),
    pl as (select pool, coalesce(queued, 0) as queued, greatest(0, coalesce(reserved, 0) - capacity)::bigint as debt, coalesce(expired, 0) as expired from pools left join q using (pool) left join k using (pool)),
    {LEASES}, own as (select cast(pool as varchar) as pool, case when review_marked then 'review_marked' else 'held' end as state, count(*) as n, sum(units)::bigint as units from tickets group by all),
    ls as (select pool, state, n, units from lg union all select * from own where (pool, state) not in (select (pool, state) from lg))
    select 'instances.active' as instrument, 'definition_id=' || definition_id || ', definition_version=' || definition_version || ', status=' || status as tags, count(*) as value from projections
      where status in ('Pending', 'Running', 'Waiting', 'CancellationRequested') group by all
    union all select 'instances.stuck', 'definition_id=' || definition_id, count(*) from projections where is_stuck group by all
    union all select 'waits.active', 'definition_id=' || p.definition_id || ', event_name=' || event_name, count(*) from active_waits join projections p using (instance_id) group by all
    union all select 'outbox.pending', 'state=' || lower(state), count(*) from outbox where not (kind = 'dag-run-ready-v1' and recipient_host_id is not null) group by all
    union all select * from lanes union all select 'dag', 'gauge=' || gauge, n from dag
    union all select 'stream.events', '', (sum(stream_version) + (select sum(version) from dag_runs))::bigint from heads union all select 'checkpoints.count', '', count(*) + (select count(*) from dag_runs) from checkpoints
    union all select 'checkpoints.lag', '', max(h.stream_version - coalesce(c.stream_version, 0)) from heads h left join checkpoints c using (stream_id)
    union all select 'resource_pool.waiters', 'pool=' || pool, queued from pl union all select 'resource_pool.over_capacity_debt', 'pool=' || pool, debt from pl union all select 'resource_pool.reconciliation_due', 'pool=' || pool, expired from pl
    union all select 'resource_pool.tickets', 'pool=' || pool || ', state=' || state, n from ls union all select 'resource_pool.reserved_units', 'pool=' || pool || ', state=' || state, units from ls""")  # fmt: skip
def fleet_gauges(spark, d):
    p, t, w = three(spark, d)
    t, w = materialize(t, "tickets"), materialize(w.select("waiter_id", "pool"), "waiters")  # these and the outbox are read several times
    o = materialize(adapt(spark, d, "outbox").select("kind", "state", "recipient_host_id"), "outbox")
    pool = pools.pool_management(p, t, w).join(pools.pool_snapshots(p, t, w).select("pool", "expired"), "pool").select("pool", "queued", "debt", "expired")
    gauges = pools.lease_gauges(leases(spark, d, t))
    out = P.fleet_gauges(adapt(spark, d, "projections"), adapt(spark, d, "active_waits"), o, operational_pressure(spark, d, o), dag_pressure(spark, d, o), pool, pools.pool_states(t, gauges))
    return out.select("instrument", render_tags(F.col("tags")).alias("tags"), "value")


def _age(c: str) -> str:
    return f"floor((epoch_us({AT_SQL}) - epoch_us({c})) / 1000000.0)::bigint"


@job("instance_ages", cte(*PW) + f""", o as (select instance_id, min(registered_at) as oldest from active_waits group by 1)
    select instance_id, {_age("created_at")} as age_s, {_age("updated_at")} as status_age_s, {_age("last_active_at")} as idle_s, {_age("oldest")} as oldest_wait_s from projections left join o using (instance_id)""")  # fmt: skip
def instance_ages(spark, d):
    return P.instance_ages(adapt(spark, d, "projections"), adapt(spark, d, "active_waits"), at())


@job("blocked_on", cte("active_waits") + f""", a as (select *, {_age("registered_at")} as age_s from active_waits)
    select event_name, count(*) as n, min(registered_at) as oldest_at, round(quantile_cont(age_s, 0.5), 3)::double as p50_s, round(quantile_cont(age_s, 0.95), 3)::double as p95_s from a where age_s > 86400 group by event_name""")  # fmt: skip
def blocked_on(spark, d):
    return P.blocked_on(adapt(spark, d, "active_waits"), at(), 86400)


@job("select_instances", cte("projections") + " select instance_id, status, definition_id from projections where status = 'Waiting' or (definition_id < 4 and definition_version <> 2)")
def select_instances(spark, d):
    spec = ("or", ("status", "=", "Waiting"), ("and", ("definition_id", "<", 4), ("definition_version", "<>", 2)))
    return P.select_instances(adapt(spark, d, "projections"), spec).select("instance_id", "status", "definition_id")


@job("fleet_summary", cte(*PW) + f""", w as (select event_name, count(*) as n, min(registered_at) as o from active_waits group by 1)
    select count(*) filter (status in ('Pending', 'Running', 'Waiting', 'CancellationRequested')) as nonterminal, count(*) filter (is_stuck) as stuck,
      (select {_age("min(created_at)")} from projections where status in ('Pending', 'Running', 'Waiting', 'CancellationRequested')) as oldest_active_s,
      (select {_age("min(o)")} from w) as oldest_wait_s, (select string_agg(event_name || '=' || n, ', ' order by event_name) from w) as waits_by_event from projections""")  # fmt: skip
def fleet_summary(spark, d):
    out = P.fleet_summary(adapt(spark, d, "projections"), adapt(spark, d, "active_waits"), at())
    return out.withColumn("waits_by_event", render_tags(F.expr("transform_values(waits_by_event, (k, v) -> cast(v as string))")))
