"""Queries over DAG runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import child_id, render_tags
from ..operators import dag as D
from ..sources.adapters import adapt, cte
from ..sources.scratch import materialize
from .registry import job

AT, AT_SQL = "timestamp_ntz '1998-06-01 00:00:00'", "timestamp '1998-06-01 00:00:00'"
NE = ("dag_nodes", "dag_edges")
RNE = ("dag_runs", *NE)


def ne(spark, d):
    return adapt(spark, d, "dag_nodes"), adapt(spark, d, "dag_edges")


def stored_ne(spark, d):
    """The graphs as tables, for operators that read them more than once."""
    n, e = ne(spark, d)
    return materialize(n.select("run_id", "ordinal", "node_id", "state"), "dag-nodes"), materialize(e, "dag-edges")


@job("topological_waves", "with recursive " + cte(*NE)[5:] + """, w as (select run_id, ordinal, 0 as wave from dag_nodes n where not exists (select 1 from dag_edges e where e.run_id = n.run_id and e.ordinal = n.ordinal)
      union select e.run_id, e.ordinal, w.wave + 1 from w join dag_edges e on e.run_id = w.run_id and e.dep_ordinal = w.ordinal)
    select run_id, ordinal, max(wave)::int as wave from w group by all""")  # fmt: skip
def topological_waves(spark, d):
    return D.topological_waves(*stored_ne(spark, d))


BROKEN_E = "select run_id, ordinal, dep_ordinal from {dag_edges} union all select run_id, ordinal, dep_ordinal from {dag_edges} where run_id % 31 = 0 union all select run_id, ordinal, ordinal from {dag_edges} where run_id % 37 = 0 union all select run_id, dep_ordinal, ordinal from {dag_edges} where run_id % 41 = 0 union all select run_id, ordinal, cast(99 as int) from {dag_edges} where run_id % 43 = 0"
BROKEN_N = "select run_id, ordinal, case when run_id % 29 = 0 and ordinal = 1 then 'n0' else node_id end as node_id, cast(case when run_id % 47 = 0 and ordinal = 2 then 0 when run_id % 53 = 0 and ordinal = 2 then 2 else 1 end as int) as mapping_count from {dag_nodes}"


@job("validate_dag", cte(*NE) + f""", n as ({BROKEN_N.format(dag_nodes='dag_nodes')}), e as ({BROKEN_E.format(dag_edges='dag_edges')}),
    loops as (select distinct a.run_id from dag_edges a where a.run_id % 41 = 0)
    select run_id, 'NODE-001' as code, max(ordinal) as ordinal from n group by run_id, node_id having count(*) > 1
    union all select distinct run_id, 'DEPENDENCY-001', ordinal from (select run_id, ordinal, dep_ordinal from e group by all having count(*) > 1) x
    union all select distinct run_id, 'DEPENDENCY-002', ordinal from e where ordinal = dep_ordinal
    union all select distinct run_id, 'DEPENDENCY-004', ordinal from e where not exists (select 1 from n where n.run_id = e.run_id and n.ordinal = e.dep_ordinal)
    union all select run_id, 'DEPENDENCY-003', 0 from loops
    union all select run_id, case mapping_count when 0 then 'MAP-001' else 'MAP-002' end, ordinal from n where mapping_count <> 1""")  # fmt: skip
def validate_dag(spark, d):
    n, e = stored_ne(spark, d)
    return D.validate_dag(spark.sql(BROKEN_N, dag_nodes=n), spark.sql(BROKEN_E, dag_edges=e))


@job("ready_nodes", cte(*NE) + """ select run_id, ordinal, node_id from dag_nodes n where state = 'Pending' and not exists (select 1 from dag_edges e left join dag_nodes p on p.run_id = e.run_id and p.ordinal = e.dep_ordinal
    where e.run_id = n.run_id and e.ordinal = n.ordinal and coalesce(p.state <> 'Succeeded', true))""")  # fmt: skip
def ready_nodes(spark, d):
    return D.ready_nodes(*ne(spark, d)).select("run_id", "ordinal", "node_id")


@job("blocked_closure", "with recursive " + cte(*NE)[5:] + """, b as (select run_id, ordinal from dag_nodes where state = 'Failed' union select e.run_id, e.ordinal from b join dag_edges e on e.run_id = b.run_id and e.dep_ordinal = b.ordinal)
    select n.run_id, n.ordinal, case when b.ordinal is not null and state in ('Pending', 'Ready') then 'DependencyBlocked' else state end as state from dag_nodes n left join b on b.run_id = n.run_id and b.ordinal = n.ordinal""")  # fmt: skip
def blocked_closure(spark, d):
    return D.blocked_closure(*stored_ne(spark, d))


_REQ = "q as (select x.run_id, state from (select run_id from dag_runs union select -user_id from events) x left join dag_runs r using (run_id))"
_RES = "case when q.state is null then 'NotFound' when q.state = 'Running' then 'Requested' when q.state = 'CancellationRequested' then 'AlreadyRequested' when q.state = 'IntegrityFault' then 'Faulted' else 'AlreadyTerminal' end"


def barrier(spark, d):
    r, n = adapt(spark, d, "dag_runs"), adapt(spark, d, "dag_nodes")
    q = r.select("run_id").union(spark.read.parquet(f"{d}/events.parquet").select(-F.col("user_id")))
    return D.cancel_barrier(r, n, q, F.expr(AT))


@job("cancel_barrier", cte("dag_runs", "dag_nodes") + f""", {_REQ}, w as (select distinct run_id from dag_nodes where state in ('StartAuthorized', 'CancellationRequested'))
    select q.run_id, {_RES} as result, case when q.state = 'Running' then case when w.run_id is not null then 'CancellationRequested' else 'Cancelled' end else q.state end as state from q left join w using (run_id)""")  # fmt: skip
def cancel_barrier(spark, d):
    return barrier(spark, d)[0]


@job("cancel_barrier_nodes", cte("dag_runs", "dag_nodes") + f""" select n.run_id, ordinal, case when n.state in ('Pending', 'Ready') then 'Cancelled' when n.state = 'StartAuthorized' then 'CancellationRequested' else n.state end as state,
    case when n.state in ('Pending', 'Ready') then {AT_SQL} else completed_at end as completed_at from dag_nodes n join dag_runs r using (run_id) where r.state = 'Running'""")  # fmt: skip
def cancel_barrier_nodes(spark, d):
    return barrier(spark, d)[1].select("run_id", "ordinal", "state", "completed_at")


@job("cancel_barrier_sends", cte("dag_runs", "dag_nodes") + " select n.run_id, ordinal, child_id, 'dag-child-cancel-v1' as kind from dag_nodes n join dag_runs r using (run_id) where r.state = 'Running' and n.state = 'StartAuthorized'")
def cancel_barrier_sends(spark, d):
    return barrier(spark, d)[2]


@job("run_outcome", cte("dag_runs", "dag_nodes") + """, p as (select run_id, bool_or(state in ('Pending', 'Ready', 'StartAuthorized', 'CancellationRequested')) as live, bool_and(state = 'Succeeded') as ok from dag_nodes group by 1)
    select run_id, case when live then 'Nonterminal' when state = 'CancellationRequested' then 'Cancelled' when ok then 'Succeeded' else 'Failed' end as outcome from dag_runs join p using (run_id)""")  # fmt: skip
def run_outcome(spark, d):
    return D.run_outcome(adapt(spark, d, "dag_runs"), adapt(spark, d, "dag_nodes"))


#: A user's events in runs of 14: creation, six admissions and joins in turn, the end; some are put out of place.
RECORDS = """select run_id, cast(p + case when event_id % 211 = 0 then 1 else 0 end as bigint) as stream_version,
  case when p = 1 then 'Created' when event_id % 97 = 0 then 'CancellationRequested' when event_id % 199 = 0 then 'IntegrityFaulted' when p = 14 then 'Terminal' when p % 2 = 0 then 'InputAdmitted' else 'ChildJoined' end as kind,
  case when p > 1 and event_id % 97 = 0 then 'CancellationRequested' when p = 14 then case when lost then 'Failed' else 'Succeeded' end end as state,
  cast(floor((p - 2) / 2.0) as int) as ordinal, case when p % 2 = 0 then 'StartAuthorized' when event_type = 'error' then 'Failed' else 'Succeeded' end as node_state
from (select *, max(case when p > 1 and p % 2 = 1 and event_type = 'error' then 1 else 0 end) over (partition by run_id) = 1 as lost
  from (select cast(user_id * 1000 + floor((rn - 1) / 14.0) as bigint) as run_id, (rn - 1) % 14 + 1 as p, event_id, event_type
    from (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as rn from {events}) x) y) z"""

_OPEN, _LIVE, _ENDED = "('Pending', 'Ready', 'StartAuthorized')", "('Pending', 'Ready', 'StartAuthorized', 'CancellationRequested')", "('Succeeded', 'Failed', 'Cancelled')"


def _had(*groups: str) -> str:
    return ", ".join(f"coalesce(sum({g}) over w, 0) as had_{g}" for g in groups)


@job("fold_dag_runs", f"with rec as ({RECORDS.format(events='events')})" + f""", r as (select *, row_number() over (partition by run_id order by stream_version, kind) as pos,
      case kind when 'Created' then 'Running' when 'CancellationRequested' then state when 'Terminal' then state when 'IntegrityFaulted' then 'IntegrityFault' end as after from rec),
    rb as (select *, last_value(after ignore nulls) over (partition by run_id order by pos rows between unbounded preceding and 1 preceding) as before from r),
    c0 as (select run_id, pos, kind, before, o::int as ordinal, 'Ready' as new, null as child from rb, range(6) x(o) where kind = 'Created'
      union all select run_id, pos, kind, before, ordinal, node_state, 'child-' || ordinal from rb where kind in ('InputAdmitted', 'ChildJoined')),
    c as (select *, lag(new) over n as old, lead(pos) over n as until, last_value(child ignore nulls) over (partition by run_id, ordinal order by pos rows between unbounded preceding and 1 preceding) as old_child from c0 window n as (partition by run_id, ordinal order by pos)),
    cf as (select run_id, pos, case when kind <> 'Created' and old is null then 'node ordinal' when child <> old_child then 'child rewritten'
      when not coalesce(case kind when 'Created' then true when 'InputAdmitted' then before = 'Running' and old = 'Ready' and new = 'StartAuthorized' else old in ('StartAuthorized', 'CancellationRequested') end, false) then 'node transition' end as rule from c),
    low as (select distinct a.run_id, a.pos, 'not the lowest ready node' as rule from c a join c i on i.run_id = a.run_id and i.ordinal < a.ordinal and i.pos < a.pos and (i.until is null or i.until >= a.pos) where a.kind = 'InputAdmitted' and i.new = 'Ready'),
    per as (select run_id, pos, count(*) as n, count(*) filter (new in {_ENDED}) as ended, count(*) filter (old is null) as fresh, sum((new in {_OPEN})::int - coalesce(old in {_OPEN}, false)::int) as open,
      sum((new in {_LIVE})::int - coalesce(old in {_LIVE}, false)::int) as live, sum((new = 'Succeeded')::int - coalesce(old = 'Succeeded', false)::int) as ok from c group by 1, 2),
    s as (select rb.*, coalesce(n, 0) as n, coalesce(ended, 0) as ended, {_had('fresh', 'open', 'live', 'ok')} from rb left join per using (run_id, pos) window w as (partition by run_id order by pos rows between unbounded preceding and 1 preceding)),
    rf as (select run_id, pos, case when stream_version <> pos or (kind = 'Created') <> (pos = 1) then 'version or kind' when before in {_ENDED} then 'terminal barrier'
      when kind = 'ChildJoined' and (ended <> 1 or (before = 'CancellationRequested' and n <> 1)) then 'one child per join' when kind = 'CancellationRequested' and (state <> 'CancellationRequested' or n <> had_open) then 'incomplete cancel barrier'
      when kind = 'Terminal' and (had_live > 0 or state <> case when before = 'CancellationRequested' then 'Cancelled' when had_ok = had_fresh then 'Succeeded' else 'Failed' end) then 'terminal outcome'
      when kind in ('InputAdmitted', 'ChildJoined') and state <> before then 'implicit state change' end as rule from s),
    f as (select run_id, min(struct_pack(pos := pos, rule := rule)) as f from (select * from cf union all select * from low union all select * from rf) where rule is not null group by 1),
    g as (select rb.run_id, max(pos) filter (f is null or pos < f.pos) as version, arg_max(after, pos) filter ((f is null or pos < f.pos) and after is not null) as state, any_value(f.rule) as rule from rb left join f using (run_id) group by 1),
    nd as (select run_id, string_agg(ordinal || ':' || node, ',' order by ordinal) as nodes from (select c.run_id, ordinal, arg_max(new, pos) as node from c left join f using (run_id) where f is null or pos < f.pos group by 1, 2) group by 1)
    select run_id, state, coalesce(version, 0) as version, case when rule is not null then 'DAG_PROTOCOL_INVALID' end as fault, rule, coalesce(nodes, '') as nodes from g left join nd using (run_id)""")  # fmt: skip
def fold_dag_runs(spark, d):
    r = spark.sql(RECORDS, events=spark.read.parquet(f"{d}/events.parquet"))
    change = lambda ordinal, state, child: F.struct(ordinal.alias("ordinal"), state.alias("state"), child.cast("string").alias("child_id"))
    every = F.array(*[change(F.lit(i), F.lit("Ready"), F.lit(None)) for i in range(6)])
    one = F.array(change(F.col("ordinal"), F.col("node_state"), F.concat(F.lit("child-"), F.col("ordinal").cast("string"))))
    changes = F.when(F.col("kind") == "Created", every).when(F.col("kind").isin("InputAdmitted", "ChildJoined"), one)
    return D.fold_dag_runs(r.select("run_id", "stream_version", "kind", "state", changes.alias("changes")))


@job("discover_runs", cte("dag_runs") + " select run_id, creation_sequence, state from dag_runs where state in ('Running', 'CancellationRequested', 'IntegrityFault') and creation_sequence > 5000 order by creation_sequence, run_id limit 1000")
def discover_runs(spark, d):
    return D.discover_runs(adapt(spark, d, "dag_runs"), 5000, 1000).select("run_id", "creation_sequence", "state")


def _child(run: str, ordinal: str) -> str:
    return f"substring(sha256('wflog-dag-child-v1' || chr(10) || {run} || chr(10) || {ordinal} || chr(10)), 1, 32)"


@job("admit_nodes", cte("dag_runs", "dag_nodes") + f""", m as (select n.* from dag_nodes n join dag_runs r using (run_id) where r.state = 'Running'),
    a as (select *, count(*) filter (state in ('StartAuthorized', 'CancellationRequested')) over (partition by run_id) as active, count(*) filter (state = 'Ready') over (partition by run_id order by ordinal) as rank from m)
    select run_id, ordinal, {_child('run_id', 'ordinal')} as child_id from a where state = 'Ready' and rank + active <= 2""")  # fmt: skip
def admit_nodes(spark, d):
    return D.admit_nodes(adapt(spark, d, "dag_runs"), adapt(spark, d, "dag_nodes"), 2)


@job("child_ids", cte("dag_nodes") + f" select run_id, ordinal, {_child('run_id', 'ordinal')} as child_id from dag_nodes")
def child_ids(spark, d):
    return adapt(spark, d, "dag_nodes").select("run_id", "ordinal", child_id(F.col("run_id"), F.col("ordinal")).alias("child_id"))


OPERATIONS = "select 'op' || cast(event_id % 4000 as string) as operation_id, event_id as seq, md5(event_type) as fingerprint from {events}"


@job("operation_receipts", f"with o as ({OPERATIONS.format(events='events')}), b as (select *, first_value(fingerprint) over w as f, row_number() over w as rn from o window w as (partition by operation_id order by seq))" + """
    select operation_id, seq, fingerprint, case when rn = 1 then 'committed' when fingerprint = f then 'repeated' else 'DAG_INTEGRITY_CONFLICT' end as result from b""")  # fmt: skip
def operation_receipts(spark, d):
    return D.operation_receipts(spark.sql(OPERATIONS, events=spark.read.parquet(f"{d}/events.parquet")))


LEASES = """select run_id, seq, at_s, op, owner, cast(sum(case when op = 'acquired' then 1 else 0 end) over (partition by run_id order by seq) + case when seq % 53 = 0 then 1 else 0 end as bigint) as fence
from (select user_id as run_id, event_id as seq, cast(row_number() over (partition by user_id order by event_id) * 2.5 as double) as at_s, case event_type when 'click' then 'released' when 'error' then 'renewed' else 'acquired' end as op,
  'host-' || cast(event_id % 3 as string) as owner from {events}) x"""


@job("audit_run_leases", f"with r as ({LEASES.format(events='events')})" + """, b as (select *, last_value(case when op = 'acquired' then owner end ignore nulls) over w as holder, last_value(case when op = 'acquired' then fence end ignore nulls) over w as high,
      last_value(case when op = 'acquired' then at_s end ignore nulls) over w as began, last_value(case when op in ('acquired', 'renewed') then at_s end ignore nulls) over w as touched,
      last_value(case when op in ('acquired', 'released') then op end ignore nulls) over w as ended from r window w as (partition by run_id order by seq rows between unbounded preceding and 1 preceding)),
    c as (select *, coalesce(ended = 'acquired' and at_s < least(touched + 5, began + 15), false) as runs, holder is not distinct from owner as own from b)
    select run_id, seq, owner, case when op = 'acquired' then case when fence <> coalesce(high, 0) + 1 then 'FenceInvalid' when runs and not own then 'Overlap' else 'Ok' end when runs and own then 'Ok' else 'Stale' end as result from c""")  # fmt: skip
def audit_run_leases(spark, d):
    return D.audit_run_leases(spark.sql(LEASES, events=spark.read.parquet(f"{d}/events.parquet")))


READY_E = "select r.run_id, cast(0 as int) as ordinal, r.ordinal as dep_ordinal from {dag_nodes} r join {dag_nodes} z on z.run_id = r.run_id and z.ordinal = 0 where z.state = 'Ready' and r.ordinal > 0"


GIVING = "select *, ordinal % 3 <> 1 as resultful from {dag_nodes}"


@job("node_inputs", cte("dag_nodes", "dag_runs") + f""", e as ({READY_E.format(dag_nodes='dag_nodes')}), r as (select run_id, ordinal from dag_nodes where state = 'Ready'),
    p as (select e.run_id, e.ordinal, string_agg(node_id || '=' || output, ', ' order by node_id) filter (output is not null and n.ordinal % 3 <> 1) as inputs, bool_or(output is null and n.ordinal % 3 <> 1) as missing from e join dag_nodes n on n.run_id = e.run_id and n.ordinal = e.dep_ordinal group by all)
    select r.run_id, r.ordinal, 'in-' || creation_sequence as input, coalesce(inputs, '') as inputs, case when missing then 'DAG_INPUT_MAPPING_INVALID' end as fault from r left join p using (run_id, ordinal) join dag_runs using (run_id)""")  # fmt: skip
def node_inputs(spark, d):
    n = adapt(spark, d, "dag_nodes")
    runs = adapt(spark, d, "dag_runs").withColumn("input", F.concat(F.lit("in-"), F.col("creation_sequence").cast("string")))
    return D.node_inputs(spark.sql(GIVING, dag_nodes=n), spark.sql(READY_E, dag_nodes=n), runs).withColumn("inputs", render_tags(F.col("inputs")))


@job("node_durations", cte("dag_nodes") + " select run_id, ordinal, state, greatest(0, epoch_us(started_at) - epoch_us(ready_at)) / 1000000.0::double as queue_s, greatest(0, epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0::double as work_s from dag_nodes")
def node_durations(spark, d):
    return D.node_durations(adapt(spark, d, "dag_nodes"))


DETAILS = """select run_id, stream_version, kind, ordinal, state, moment as updated_at, case when v in (2, 3, 4) then child end as child_id, case when v = 3 and state = 'Failed' then case when event_id % 5 = 0 then 'OTHER' else 'CHILD_FAILED' end when v = 4 then case when event_id % 9 = 0 then 'CHILD_FAILED' end end as failure_code,
  ready as ready_at, case when v = 2 and event_id % 13 <> 0 then moment when v = 3 then case when event_id % 17 = 0 then moment else began end end as started_at, case when v = 3 and event_id % 11 <> 0 then moment end as completed_at
from (select *, min(moment) over (partition by run_id, ordinal) as ready, max(case when v = 2 and event_id % 13 <> 0 then moment end) over (partition by run_id, ordinal) as began
  from (select run_id, v as stream_version, v, event_id, cast(0 as int) as ordinal, case v when 1 then 'Created' when 2 then 'InputAdmitted' when 3 then 'ChildJoined' else 'CancellationRequested' end as kind,
    case v when 1 then 'Ready' when 2 then 'StartAuthorized' when 3 then case when event_type = 'error' then 'Failed' else 'Succeeded' end else 'CancellationRequested' end as state,
    case when event_id % 19 = 0 then ts - interval '1' day else ts end as moment, {child} as child
    from (select user_id * 1000 + cast(floor((rn - 1) / 4.0) as bigint) as run_id, (rn - 1) % 4 + 1 as v, event_id, event_type, ts from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from {events}) x) y) z) w"""


@job("record_detail_faults", f"with c as ({DETAILS.format(events='events', child=_child('run_id', '0'))})" + f""", b as (select *, lag(updated_at) over (partition by run_id order by stream_version) as last_at,
      last_value(child_id ignore nulls) over w as oc, last_value(ready_at ignore nulls) over w as ore, last_value(started_at ignore nulls) over w as os, last_value(completed_at ignore nulls) over w as oe from c
      window w as (partition by run_id, ordinal order by stream_version rows between unbounded preceding and 1 preceding))
    select run_id, stream_version, null::int as ordinal, 'time falls' as rule from b where updated_at < last_at
    union all select run_id, stream_version, ordinal, rule from (select *, case when kind <> 'Created' and ((oc is not null and oc is distinct from child_id) or (ore is not null and ore is distinct from ready_at) or (os is not null and os is distinct from started_at) or (oe is not null and oe is distinct from completed_at)) then 'written twice'
      when kind = 'InputAdmitted' and (child_id is distinct from {_child('run_id', 'ordinal')} or started_at is distinct from updated_at or failure_code is not null or completed_at is not null) then 'details of the change'
      when kind = 'ChildJoined' and (completed_at is distinct from updated_at or (state = 'Failed' and coalesce(failure_code not in ('CHILD_FAILED', 'CHILD_TIMED_OUT', 'CHILD_TERMINATED', 'CHILD_CANCELLED'), true)) or (state <> 'Failed' and failure_code is not null)) then 'details of the change'
      when kind = 'CancellationRequested' and (failure_code is not null or completed_at is not null) then 'details of the change' end as rule from b) where rule is not null""")  # fmt: skip
def record_detail_faults(spark, d):
    rows = spark.sql(DETAILS.replace("{child}", "cast(null as string)"), events=spark.read.parquet(f"{d}/events.parquet"))
    named = F.when(F.col("stream_version").isin(2, 3, 4), child_id(F.col("run_id"), F.lit(0)))
    change = F.struct("ordinal", "state", named.alias("child_id"), "failure_code", "ready_at", "started_at", "completed_at")
    return D.record_detail_faults(rows.select("run_id", "stream_version", "kind", "updated_at", F.array(change).alias("changes")))


@job("dag_fingerprint", cte(*NE) + """, x as (select run_id, ordinal, string_agg(dep_ordinal, ',' order by dep_ordinal) as deps from dag_edges group by all),
    p as (select n.run_id, n.ordinal, length(node_id) || ':' || node_id || '[' || coalesce(deps, '') || ']' as part from dag_nodes n left join x using (run_id, ordinal))
    select run_id, upper(sha256(string_agg(part, '|' order by ordinal))) as fingerprint from p group by run_id""")  # fmt: skip
def dag_fingerprint(spark, d):
    return D.dag_fingerprint(*ne(spark, d))


SUBSCRIPTIONS = "select run_id, 's' || cast(run_id as string) || '-' || cast(k as string) as subscription_id, created_at + (run_id % 100) * interval '1' day as expires_at, run_id % 5 + k as seen_version from {dag_runs} cross join (select 0 as k union all select 2 as k) x"


@job("notify_observers", cte("dag_runs", "dag_nodes") + f""", s as ({SUBSCRIPTIONS.format(dag_runs='dag_runs')}),
    n as (select s.run_id, subscription_id, version from s join dag_runs r using (run_id) where expires_at > {AT_SQL} and seen_version < version
      union all select run_id, null, version from dag_runs r where state = 'Running' and exists (select 1 from dag_nodes x where x.run_id = r.run_id and x.state = 'Ready'))
    select run_id, subscription_id, version, 'notice|' || run_id || '|' || coalesce(subscription_id, '*') || '|' || version as notice_id from n""")  # fmt: skip
def notify_observers(spark, d):
    r = adapt(spark, d, "dag_runs")
    return D.notify_observers(r, adapt(spark, d, "dag_nodes"), spark.sql(SUBSCRIPTIONS, dag_runs=r), F.expr(AT))


@job("prune_observers", cte("dag_runs") + f""", s as ({SUBSCRIPTIONS.format(dag_runs='dag_runs')}), r as (select distinct run_id from s where expires_at <= {AT_SQL} order by run_id limit 200)
    select run_id, subscription_id, expires_at <= {AT_SQL} and run_id in (select run_id from r) as removed from s""")  # fmt: skip
def prune_observers(spark, d):
    removed, kept = D.prune_observers(spark.sql(SUBSCRIPTIONS, dag_runs=adapt(spark, d, "dag_runs")), F.expr(AT), 200)
    mark = lambda f, x: f.select("run_id", "subscription_id", F.lit(x).alias("removed"))
    return mark(removed, True).unionByName(mark(kept, False))


@job("run_durations", "with recursive " + cte(*NE)[5:] + """, t as (select run_id, ordinal, (epoch(started_at) - epoch(ready_at))::bigint as q, (epoch(completed_at) - epoch(started_at))::bigint as w from dag_nodes where state in ('Succeeded', 'Failed')),
    p as (select run_id, ordinal, w as len from t union select t.run_id, t.ordinal, p.len + t.w from p join dag_edges e on e.run_id = p.run_id and e.dep_ordinal = p.ordinal join t on t.run_id = e.run_id and t.ordinal = e.ordinal),
    c as (select run_id, max(len) as critical_s from p group by 1)
    select run_id, sum(q)::bigint as queue_s, sum(w)::bigint as work_s, any_value(critical_s) as critical_s from t join c using (run_id) group by run_id""")  # fmt: skip
def run_durations(spark, d):
    return D.run_durations(*ne(spark, d))


CHILDREN = """select child_id, case when run_id % 6 = 0 then 'Completed' when run_id % 6 = 1 then 'Cancelled' when run_id % 6 = 2 then 'TimedOut' when run_id % 6 = 3 then 'Terminated' when run_id % 6 = 4 then 'Failed' else 'Running' end as status,
  case when run_id % 6 = 0 then case when run_id % 5 = 0 then 'out-other' else 'out-' || cast(ordinal as string) end end as output,
  ready_at as created_at, completed_at as updated_at, case when run_id % 6 = 4 then 'load failed' end as error_summary from {dag_nodes} where child_id is not null and ready_at < timestamp '1997-06-01 00:00:00'"""
#: Nodes with the failure codes, blocked and cancelled nodes that a join meets.
JOINED = """select run_id, cast(ordinal as int) as ordinal, node_id, coalesce(child_id, case when run_id % 4 = 0 then 'child-' || cast(run_id * 10 + ordinal as string) end) as child_id,
  case when run_id % 4 = 0 and state = 'Pending' then 'DependencyBlocked' when run_id % 8 = 1 and state = 'Failed' then 'Cancelled' when run_id % 8 = 3 and state = 'StartAuthorized' then 'CancellationRequested' else state end as state,
  case when state = 'Failed' and run_id % 8 <> 1 then case run_id % 6 when 1 then 'CHILD_CANCELLED' when 2 then 'CHILD_TIMED_OUT' when 3 then 'CHILD_FAILED' else 'CHILD_FAILED' end end as failure_code, output, ready_at, completed_at from {dag_nodes}"""
_JOINED = f"x as ({JOINED.format(dag_nodes='dag_nodes')}), c as ({CHILDREN.format(dag_nodes='x')})"


def children(spark, d):
    n = spark.sql(JOINED, dag_nodes=adapt(spark, d, "dag_nodes"))
    return n, spark.sql(CHILDREN, dag_nodes=n)


@job("join_children", cte("dag_runs", "dag_nodes") + f""", {_JOINED}, j as (select n.run_id, n.ordinal, n.state, n.failure_code, n.output, c.output as child_output,
      case c.status when 'Completed' then 'Succeeded' when 'Cancelled' then case when r.state in ('CancellationRequested', 'Cancelled') then 'Cancelled' else 'Failed' end else 'Failed' end as new,
      case c.status when 'Cancelled' then case when r.state not in ('CancellationRequested', 'Cancelled') then 'CHILD_CANCELLED' end when 'TimedOut' then 'CHILD_TIMED_OUT' when 'Terminated' then 'CHILD_TERMINATED' when 'Failed' then 'CHILD_FAILED' end as code
      from x n join c using (child_id) join dag_runs r using (run_id) where c.status <> 'Running'),
    k as (select *, state in ('Succeeded', 'Failed', 'Cancelled', 'DependencyBlocked') as ended from j)
    select run_id, ordinal, case when ended then state else new end as state, case when ended then failure_code else code end as failure_code, case when ended then output else child_output end as output,
      ended and (state <> new or failure_code is distinct from code or output is distinct from child_output) as conflict from k""")  # fmt: skip
def join_children(spark, d):
    n, c = children(spark, d)
    return D.join_children(n, adapt(spark, d, "dag_runs"), c)


@job("reconcile_runs", cte("dag_runs", "dag_nodes") + f""", {_JOINED}, bad as (select run_id from dag_runs where state = 'IntegrityFault'),
    n as (select x.* from x join bad using (run_id)), g as (select run_id, bool_or(state in ('Cancelled', 'CancellationRequested')) as cancelling from n group by 1),
    j as (select n.run_id, n.ordinal, n.state, case when c.child_id is not null then c.status <> 'Running' end as done from n left join c using (child_id) where n.child_id is not null),
    f as (select distinct run_id from j where case when state in ('Succeeded', 'Failed', 'Cancelled') then not coalesce(done, false) else state not in ('StartAuthorized', 'CancellationRequested') end),
    k as (select j.run_id, ordinal, case when coalesce(done, false) then 'join' when cancelling then 'cancel' when done is null then 'start' end as action from j join g using (run_id)
      where state in ('StartAuthorized', 'CancellationRequested') and run_id not in (select run_id from f))
    select 'work' as part, run_id, ordinal, action from k where action is not null
    union all select 'run', run_id, null, case when run_id in (select run_id from f) then 'IntegrityFault' when cancelling then 'CancellationRequested' else 'Running' end from bad left join g using (run_id)""")  # fmt: skip
def reconcile_runs(spark, d):
    n, c = children(spark, d)
    work, runs = D.reconcile_runs(adapt(spark, d, "dag_runs"), n, c)
    return work.select(F.lit("work").alias("part"), "run_id", "ordinal", "action").unionByName(runs.select(F.lit("run").alias("part"), "run_id", F.lit(None).cast("int").alias("ordinal"), F.col("state").alias("action")))


@job("reconstruct_run", cte("dag_nodes") + f", {_JOINED} select n.run_id, n.ordinal, n.node_id, n.state, n.child_id, c.status as child_status, c.created_at, c.updated_at, c.error_summary from x n left join c using (child_id)")
def reconstruct_run(spark, d):
    n = materialize(children(spark, d)[0], "joined-nodes")
    return D.reconstruct_run(n, spark.sql(CHILDREN, dag_nodes=n))
