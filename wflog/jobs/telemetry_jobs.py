"""Queries over telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import render_tags
from ..operators import telemetry as T
from ..sources.adapters import adapt, cte
from .registry import job

A, E = "attempts", "event_log"


def points(spark, d):
    a = adapt(spark, d, A)
    tags = F.create_map(F.lit("type"), F.col("event_type"), F.lit("shard"), (F.col("instance_id") % 5).cast("string"))
    return a.select(F.lit("duration").alias("name"), tags.alias("tags"), F.col("duration_ms").alias("value"), F.col("occurred_at").alias("observed_at"))


@job("metric_series", cte(A) + " select 'duration' as name, 'shard=' || instance_id % 5 || ', type=' || event_type as tags, sum(duration_ms)::bigint as total, count(*) as n, max(occurred_at) as last_at from attempts group by all")
def metric_series(spark, d):
    return T.metric_series(points(spark, d))


@job("latest", cte(A) + " select event_id, occurred_at from attempts order by occurred_at desc, event_id desc limit 50")
def latest(spark, d):
    return T.latest(adapt(spark, d, A), "occurred_at", "event_id").select("event_id", "occurred_at")


@job("bounded_history", cte(A) + " select event_type, event_id from attempts qualify row_number() over (partition by event_type order by occurred_at desc, event_id desc) <= 500")
def bounded_history(spark, d):
    return T.bounded_history(adapt(spark, d, A), "event_type", "occurred_at", "event_id", 500).select("event_type", "event_id")


@job("merge_scopes", cte(A) + " select event_id, 'a=' || instance_id % 3 || ', b=inner, c=' || event_type as properties from attempts")
def merge_scopes(spark, d):
    outer = F.create_map(F.lit("a"), F.lit("outer"), F.lit("b"), F.lit("outer"))
    inner = F.create_map(F.lit("b"), F.lit("inner"), F.lit("a"), (F.col("instance_id") % 3).cast("string"))
    state = F.create_map(F.lit("c"), F.col("event_type"))
    return adapt(spark, d, A).select("event_id", render_tags(T.merge_scopes(outer, inner, state)).alias("properties"))


_SEEN = """case event_type when 'Started' then 'InstanceStarted' when 'ContinuedAsNew' then 'InstanceContinuedAsNew' when 'StepCompleted' then 'StepCompleted' when 'StepFailed' then 'StepFailed'
      when 'WaitRegistered' then 'InstanceSuspended' when 'WaitMatched' then 'InstanceResumed' when 'TimerScheduled' then 'InstanceSuspended' when 'TimerFired' then 'InstanceResumed'
      when 'Parked' then 'InstanceParked' when 'Unparked' then 'InstanceUnparked' when 'Completed' then 'InstanceCompleted' when 'CancellationRequested' then 'InstanceCancellationRequested'
      when 'Terminal' then case status when 'Failed' then 'InstanceFailed' when 'Cancelled' then 'InstanceCancelled' when 'Terminated' then 'InstanceTerminated' end end"""


@job("lifecycle_observations", cte(E) + f" select stream_id, version, occurred_at, event_type, {_SEEN} as observation, case when event_type in ('StepCompleted', 'StepFailed') then step_path end as step_path, case when event_type = 'StepFailed' then 'WorkflowStepFailedEvent' end as error_kind, case when event_type = 'StepFailed' then error end as error_summary from event_log")
def lifecycle_observations(spark, d):
    return T.lifecycle_observations(adapt(spark, d, E))


@job("wait_durations", cte(E) + """, r as (select * from event_log where event_type in ('WaitRegistered', 'WaitMatched')),
    w as (select *, (select max(version) from r x where x.stream_id = r.stream_id and x.wait_id = r.wait_id and x.event_type = 'WaitRegistered' and x.version < r.version) as reg from r where event_type = 'WaitMatched')
    select w.stream_id, w.version, w.wait_id, g.event_name, greatest(0, epoch_us(w.occurred_at) - epoch_us(g.occurred_at)) as micros from w join r g on g.stream_id = w.stream_id and g.version = w.reg""")  # fmt: skip
def wait_durations(spark, d):
    return T.wait_durations(adapt(spark, d, E))


@job("event_counters", cte(E, "inbox") + f""", u as (select event_name, row_number() over w as rn, envelope_fingerprint = first_value(envelope_fingerprint) over w as same from inbox window w as (partition by event_id order by acceptance_sequence))
    select 'events' as counter, event_type as label, count(*) as n from event_log group by all union all select 'steps.completed', step_path, count(*) from event_log where event_type = 'StepCompleted' group by all
    union all select 'steps.failed', step_path || '|WorkflowStepFailedEvent', count(*) from event_log where event_type = 'StepFailed' group by all
    union all select 'lifecycle', {_SEEN}, count(*) from event_log where {_SEEN} is not null group by all
    union all select 'inbox.duplicates', event_name, count(*) from u where rn > 1 and same group by all""")  # fmt: skip
def event_counters(spark, d):
    return T.event_counters(adapt(spark, d, E), adapt(spark, d, "inbox"))


_BOUNDS = "(5), (10), (25), (50), (100), (250), (500), (1000), (2500), (5000), (10000), (30000), (60000)"
_HIST = f"b(le) as (select col0::bigint from (values {_BOUNDS}, (null)) v(col0)), h as (select step_path, le, count(*) filter (le is null or duration_ms <= le) as n from attempts cross join b group by all)"


@job("latency_histogram", cte(A) + f", {_HIST} select step_path, le, n from h")
def latency_histogram(spark, d):
    return T.latency_histogram(adapt(spark, d, A), "step_path", "duration_ms")


@job("histogram_quantile", cte(A) + f""", {_HIST}, x as (select *, coalesce(lag(le) over w, 0) as low, coalesce(lag(n) over w, 0) as below, max(n) over (partition by step_path) * 0.95::double as want from h window w as (partition by step_path order by le nulls last)),
    y as (select step_path, le, case when le is null then low::double else round(low + (le - low) * (want - below) / (n - below), 6) end as quantile, row_number() over (partition by step_path order by le nulls last) as rn from x where n >= want and want > 0)
    select step_path, quantile from y where rn = 1""")  # fmt: skip
def histogram_quantile(spark, d):
    return T.histogram_quantile(T.latency_histogram(adapt(spark, d, A), "step_path", "duration_ms"), "step_path", 0.95)


@job("rate_windows", cte(A) + """, w as (select date_trunc('minute', occurred_at) - k * interval '1' minute as window_start, event_type from attempts cross join (select unnest([0, 1, 2, 3, 4]) as k) x)
    select window_start, event_type, count(*) as n, round(count(*) / 300.0::double, 6) as rate from w group by all""")  # fmt: skip
def rate_windows(spark, d):
    return T.rate_windows(adapt(spark, d, A), ["event_type"])


@job("exact_quantiles", cte(A) + " select event_type, count(*) as n, round(quantile_cont(duration_ms, 0.5), 3)::double as p50, round(quantile_cont(duration_ms, 0.95), 3)::double as p95, round(quantile_cont(duration_ms, 0.99), 3)::double as p99 from attempts group by 1")
def exact_quantiles(spark, d):
    return T.exact_quantiles(adapt(spark, d, A), "event_type", "duration_ms")


@job("approx_quantiles")
def approx_quantiles(spark, d):
    return T.approx_quantiles(adapt(spark, d, A), "event_type", "duration_ms")


@job("throughput_per_minute", cte(E) + " select stream_id, date_trunc('minute', occurred_at) as minute, count(*) as n, count(*) filter (event_type = 'StepCompleted') as completed, count(*) filter (event_type = 'StepFailed') as failed from event_log group by all")
def throughput_per_minute(spark, d):
    return T.throughput_per_minute(adapt(spark, d, E), "stream_id")
