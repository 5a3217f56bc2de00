"""The given star-schema tables seen as operational tables.

Each text is written in the SQL that Spark and DuckDB share, so that a query and its oracle start from
the same rows; ``{events}``, ``{orders}`` .. stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .spread import parts_for, spread

TABLES = {
    "event_log": """
select stream_id, version, event_id, occurred_at, step_path, wait_id, timer_id, holder_key, event_name, correlation_id, fire_at, error, duration_ms, event_contract_version, fiber_id, scope_id,
  definition_id, definition_version, parent_instance_id, root_instance_id, outcome, reason, generation, attempt_count, position_stream_version, next_eligible_at,
  case event_id % 4 when 0 then 'Failed' when 1 then 'Cancelled' when 2 then 'Terminated' else 'TimedOut' end as status,
  case when version = 1 then 'Started' when event_id % 97 = 0 then 'ContinuedAsNew' when event_id % 89 = 0 then 'StepFailed'
    when event_id % 83 = 0 then 'WaitCancelled' when event_id % 79 = 0 then 'CancellationRequested' when event_id % 73 = 0 then 'TimerFired'
    when event_id % 71 = 0 then 'ResumeConsumed' when event_id % 67 = 0 then 'ResourcePoolAcquired' when event_id % 61 = 0 then 'ResourcePoolQueued'
    when event_id % 59 = 0 then 'ResourcePoolReleased' when event_id % 53 = 0 then 'Completed' when event_id % 47 = 0 then 'TimerCancelled'
    when event_id % 43 = 0 then 'Parked' when event_id % 41 = 0 then 'Unparked' when event_id % 37 = 0 then 'Terminal' when event_id % 31 = 0 then 'ContinuationAttemptReset'
    when event_id % 29 = 0 then 'ExecutionPositionChanged' when kind = 'signup' then 'WaitRegistered' when kind = 'view' then 'StepCompleted' when kind = 'click' then 'WaitMatched'
    when kind = 'purchase' then 'TimerScheduled' else 'ContinuationAttemptFailed' end as event_type
from (select user_id as stream_id, event_id, ts as occurred_at, event_type as kind, cast(floor(value) as bigint) as duration_ms,
    cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as version,
    'step-' || cast(event_id % 10 as string) as step_path,
    cast(user_id as string) || ':w' || cast(event_id % 4 as string) as wait_id,
    cast(user_id as string) || ':t' || cast(event_id % 3 as string) as timer_id,
    cast(user_id as string) || ':h' || cast(event_id % 2 as string) as holder_key,
    case when event_type = 'click' and event_id % 3 = 0 then null else 'evt-' || cast(event_id % 5 as string) end as event_name,
    case when event_type = 'click' and event_id % 3 = 1 then null else 'c' || cast(user_id % 40 as string) end as correlation_id,
    case when event_type = 'click' and event_id % 2 = 0 then null else cast(1 + event_id % 3 as int) end as event_contract_version,
    case when event_id % 5 < 2 then null else 'f' || cast(event_id % 5 as string) end as fiber_id, case when event_id % 7 < 3 then null else 's' || cast(event_id % 7 as string) end as scope_id,
    user_id % 20 as definition_id, cast(1 + user_id % 3 as int) as definition_version, case when user_id % 4 = 0 then user_id + 1 end as parent_instance_id,
    case when user_id % 4 = 0 then user_id + 2 end as root_instance_id, case when event_id % 3 = 0 then null else 'Done' || cast(event_id % 3 as string) end as outcome,
    case event_id % 3 when 0 then 'RuntimeStateVersion' when 1 then 'VersionBinding' else 'Poison' end as reason,
    cast(event_id % 1000 as int) as generation, cast(1 + event_id % 5 as int) as attempt_count, case when event_id % 4 = 0 then null else event_id % 100 end as position_stream_version,
    ts + (event_id % 60) * interval '1' second as next_eligible_at,
    ts + (event_id % 50) * interval '1' minute as fire_at, case when event_id % 111 = 0 and event_id % 89 <> 0 then null else 'failed ' || cast(event_id % 7 as string) end as error
  from {events}) e""",
    "projections": """
select o_orderkey as instance_id, o_orderkey - o_orderkey % 10 as root_instance_id, o_custkey % 20 as definition_id,
  cast(substring(o_orderpriority, 1, 1) as int) as definition_version,
  case when o_orderkey % 7 = 0 then 'Failed' when o_orderkey % 11 = 0 then 'CancellationRequested' when o_orderkey % 13 = 0 then 'Pending'
    when o_orderstatus = 'F' then 'Completed' when o_orderstatus = 'O' then 'Running' else 'Waiting' end as status,
  o_orderdate as created_at, o_orderdate + (o_orderkey % 30) * interval '1' day as updated_at,
  case when o_orderkey % 5 = 0 then null else o_orderdate + (o_orderkey % 20) * interval '1' day end as last_active_at,
  case when o_orderkey % 17 = 0 then o_orderdate + interval '40' day end as archived_at,
  o_orderkey % 23 = 0 as is_stuck, case when o_orderkey % 23 = 0 then o_orderdate end as stuck_detected_at, o_orderkey % 40 as stream_version,
  case when o_orderkey % 7 = 0 then 'failed ' || cast(o_orderkey % 3 as string) end as error_summary
from {orders}""",
    "active_waits": """
select 'w' || cast(o_orderkey as string) || '-' || cast(n as string) as wait_id, o_orderkey as instance_id, o_custkey % 20 as definition_id,
  'evt-' || cast((o_custkey + n) % 5 as string) as event_name, cast(1 + o_orderkey % 2 as int) as event_contract_version,
  'c' || cast(o_custkey as string) as correlation_id, o_orderdate + n * interval '1' hour as registered_at, o_orderkey % 9 + n as wait_sequence,
  case when o_orderkey % 4 = 0 then null else 'f' || cast(o_orderkey % 3 as string) end as fiber_id
from {orders} cross join (select 0 as n union all select 1 as n) k
where o_orderstatus = 'P' and o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 and (n = 0 or o_orderkey % 3 = 0)""",
    "inbox": """
select event_id as acceptance_sequence, cast(event_id - event_id % 3 as string) as event_id, md5(event_type || cast(event_id % 2 as string)) as envelope_fingerprint,
  case when event_id % 7 = 0 then 'Applied' when event_id % 31 = 0 then 'Poisoned' else 'Received' end as state,
  'evt-' || cast(event_id % 5 as string) as event_name, cast(1 + event_id % 2 as int) as event_contract_version, 'c' || cast(user_id as string) as correlation_id,
  case event_id % 3 when 0 then 'direct' when 1 then 'correlation' else 'definition-fanout' end as route_kind, user_id * 4 as instance_id, user_id % 20 as definition_id,
  ts as occurred_at, cast(event_id % 6 as int) as handoff_failure_count, case when event_id % 6 > 0 then ts + (event_id % 90) * interval '1' minute end as handoff_retry_not_before, props as payload
from {events}""",
    "outbox": """
select 'o' || lpad(cast(rid as string), 9, '0') as outbox_record_id, l_orderkey as instance_id,
  case l_returnflag when 'R' then 'continue' when 'A' then 'workflow-event' else case when rid % 5 = 0 then 'dag-run-ready-v1' else 'external' end end as kind,
  case when rid % 17 = 0 then 'Poisoned' when rid % 19 = 0 then 'Retryable' when l_linestatus = 'O' then 'Pending' else 'Claimed' end as state,
  case when rid % 3 = 0 then null else 'host-' || cast(rid % 4 as string) end as recipient_host_id,
  cast(rid % 4 as int) as dispatch_attempt, case when rid % 17 <> 0 and rid % 19 <> 0 and l_linestatus <> 'O' and rid % 6 <> 0 then l_shipdate end as claimed_until, l_shipdate as occurred_at, rid
from (select l_orderkey, l_returnflag, l_linestatus, l_shipdate, cast(l_orderkey * 1000 + l_linenumber * 100 +
    row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as bigint) as rid
  from {lineitem}) l""",
    "timers": """
select 't' || cast(l_orderkey * 1000 + l_linenumber * 100 + row_number() over (partition by l_orderkey, l_linenumber
    order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as string) as timer_id,
  l_orderkey as instance_id, l_shipdate as fire_at, l_linestatus = 'F' as claimed,
  case when l_linestatus = 'F' and l_linenumber % 2 = 0 then l_shipdate + cast(l_quantity as int) * interval '1' day end as claimed_until
from {lineitem}""",
    "pools": """select s_suppkey as pool, cast(greatest(0, floor(s_acctbal / 4)) as bigint) as capacity, s_suppkey % 8 as partition_id from {supplier}""",
    "tickets": """
select 'k' || cast(l_orderkey * 1000 + l_linenumber * 100 + row_number() over (partition by l_orderkey, l_linenumber
    order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as string) as ticket_id,
  l_suppkey as pool, cast(l_quantity as bigint) as units, l_orderkey as instance_id, 'h' || cast(l_linenumber as string) as holder_key,
  l_shipdate as acquired_at, l_shipdate + l_linenumber * interval '1' day as review_deadline, l_linenumber % 4 = 0 as review_marked
from {lineitem} where l_returnflag = 'N' and l_linestatus = 'O'""",
    "waiters": """
select l_orderkey as waiter_id, l_suppkey as pool, min(l_shipdate) as requested_at, cast(sum(l_quantity) as bigint) as units
from {lineitem} where l_returnflag = 'A' group by l_orderkey, l_suppkey""",
    "dag_runs": """
select o_orderkey as run_id, o_orderkey * 10 as creation_sequence,
  case when o_orderkey % 29 = 0 then 'IntegrityFault' when o_orderkey % 11 = 0 then 'CancellationRequested' when o_orderstatus = 'F' then 'Succeeded' when o_orderkey % 13 = 0 then 'Failed' else 'Running' end as state,
  o_orderdate + (o_orderkey % 30) * interval '1' day as last_progress_at, o_orderdate as created_at, o_orderkey % 9 as version
from {orders}""",
    "dag_nodes": """
select run_id, cast(ordinal as int) as ordinal, 'n' || cast(ordinal as string) as node_id, state, case when state in ('StartAuthorized', 'Succeeded', 'Failed') then 'child-' || cast(run_id * 10 + ordinal as string) end as child_id,
  case when state = 'Succeeded' and ordinal % 5 <> 4 then 'out-' || cast(ordinal as string) end as output, ready_at, ready_at + (run_id % 7) * interval '1' minute as started_at,
  ready_at + (run_id % 7 + run_id % 13 + ordinal) * interval '1' minute as completed_at
from (select run_id, ordinal, case flag when 'AF' then 'Succeeded' when 'RF' then 'Failed' when 'NF' then 'StartAuthorized' else case when ordinal = 0 then 'Ready' else 'Pending' end end as state, ready_at
  from (select l_orderkey as run_id, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as ordinal, min(l_returnflag || l_linestatus) as flag, min(l_shipdate) as ready_at
    from {lineitem} group by l_orderkey, l_linenumber) a) b""",
    "dag_edges": """
select run_id, cast(ordinal as int) as ordinal, cast(floor((ordinal - 1) / 2.0) as int) as dep_ordinal from (select l_orderkey as run_id, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as ordinal from {lineitem} group by l_orderkey, l_linenumber) a where ordinal > 0
union all
select run_id, cast(ordinal as int) as ordinal, cast(ordinal - 2 as int) as dep_ordinal from (select l_orderkey as run_id, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as ordinal from {lineitem} group by l_orderkey, l_linenumber) a where ordinal > 2 and cast(floor((ordinal - 1) / 2.0) as int) <> ordinal - 2""",
    "attempts": """
select user_id as instance_id, event_id, 'step-' || cast(event_id % 10 as string) as step_path, cast(event_id % 4 as int) as attempt,
  case event_type when 'error' then 'failed' when 'click' then 'timed_out' else 'success' end as result, cast(floor(value * 100) as bigint) as duration_ms, ts as occurred_at, event_type
from {events}""",
}


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An operational table made from the given tables."""
    text = TABLES[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "orders", "lineitem", "supplier") if "{" + t + "}" in text}
    if name in ("dag_nodes", "dag_edges"):  # all their groups and windows are within an order
        lines = used["lineitem"]
        used["lineitem"] = spread(lines, parts_for(lines, lines.count()), "l_orderkey")
    return spark.sql(text, **used)


def log_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``event_log`` in partitions of whole streams, each in order: events are dealt out and sorted as they are given, before the log's many columns are made of them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = spread(events, parts_for(events, events.count()), "user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return spark.sql(TABLES["event_log"], events=events)


def cte(*names: str) -> str:
    """The same tables as common table expressions for DuckDB."""
    return "with " + ",\n".join(f"{n} as ({TABLES[n].format(events='events', orders='orders', lineitem='lineitem', supplier='supplier')})" for n in names)
