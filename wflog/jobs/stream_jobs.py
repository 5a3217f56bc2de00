"""Streaming jobs worked through once over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.log import NEEDED
from ..sources.adapters import adapt, cte, log_by_stream
from ..sources.scratch import new_path
from ..streaming import streams as S
from .log_jobs import FOLD_SQL, flat
from .registry import job
from .store_jobs import _BAD, raw

E = "event_log"


def live(spark, d, table: str, *columns: str):
    """An adapted table, or some of its columns, as a stream: written once as files, as many as its size asks for, then read as a stream."""
    t = log_by_stream(spark, d) if table == E else adapt(spark, d, table).repartition("acceptance_sequence")
    t = t.select(*columns) if columns else t
    path = new_path(spark, f"live-{table}")
    t.write.parquet(path)
    return spark.readStream.schema(t.schema).parquet(path)


def timed(stream, column: str = "occurred_at"):
    return stream.withColumn("at", F.col(column).cast("timestamp"))


@job("stream_fold", FOLD_SQL)
def stream_fold(spark, d):
    return flat(S.run_available(S.stream_fold(live(spark, d, E, *NEEDED)), "update", ["stream_id"], "fold").drop("fault"))


@job("stream_dedupe", cte("inbox") + """, b as (select *, first_value(envelope_fingerprint) over w as f, row_number() over w as rn from inbox window w as (partition by event_id order by acceptance_sequence))
    select event_id, acceptance_sequence, case when rn = 1 then 'Accepted' when f = envelope_fingerprint then 'Duplicate' else 'Conflict' end as result from b""")  # fmt: skip
def stream_dedupe(spark, d):
    return S.run_available(S.stream_dedupe(timed(live(spark, d, "inbox"))), "append", None, "dedupe")


@job("stream_match_waits")
def stream_match_waits(spark, d):
    rows = timed(live(spark, d, E)).where("event_type in ('WaitRegistered', 'WaitMatched')")
    kind = F.when(F.col("event_type") == "WaitRegistered", "wait").otherwise("event")
    rows = rows.select(F.concat_ws("|", "event_name", "correlation_id").alias("key"), kind.alias("kind"), F.col("event_id").cast("string").alias("id"), "at", F.lit(86_400_000).cast("long").alias("timeout_ms"))
    return S.run_available(S.stream_match_waits(rows), "append", None, "match")


@job("stream_join_waits", cte(E) + """, w as (select wait_id as key, event_id as wait_id, occurred_at as t from event_log where event_type = 'WaitRegistered'), e as (select wait_id as key, event_id, occurred_at as t from event_log where event_type = 'WaitMatched'),
    m as (select least((select max(t) from w), (select max(t) from e)) - interval '10' minute as wm),
    x as (select w.wait_id, w.t, e.event_id from w left join e on e.key = w.key and e.t >= w.t and e.t <= w.t + interval '4' hour)
    select wait_id, event_id from x, m where event_id is not null or t + interval '4' hour < wm""")  # fmt: skip
def stream_join_waits(spark, d):
    rows = timed(live(spark, d, E))
    waits = rows.where("event_type = 'WaitRegistered'").select(F.col("wait_id").alias("key"), F.col("event_id").alias("wait_id"), "at")
    events = timed(live(spark, d, E)).where("event_type = 'WaitMatched'").select(F.col("wait_id").alias("key"), "event_id", "at")
    return S.run_available(S.stream_join_waits(waits, events, "4 hours"), "append", None, "join")


@job("stream_timers", cte(E) + """, t as (select timer_id, version, event_type, epoch_us(occurred_at) // 1000 as ms, epoch_us(fire_at) // 1000 as due_ms from event_log where event_type in ('TimerScheduled', 'TimerFired', 'TimerCancelled')),
    m as (select max(ms) - 600000 as wm from t)
    select timer_id, due_ms from t, m where event_type = 'TimerScheduled' and due_ms <= wm and not exists (select 1 from t x where x.timer_id = t.timer_id and x.version > t.version and x.ms <= t.due_ms)""")  # fmt: skip
def stream_timers(spark, d):
    return S.run_available(S.stream_timers(timed(live(spark, d, E, "timer_id", "version", "event_type", "fire_at", "occurred_at"))), "append", None, "timers")


_DOING = "case when event_type in ('WaitRegistered', 'TimerScheduled', 'Parked', 'ResourcePoolQueued') then 'Waiting' when event_type = 'Completed' then 'Completed' when event_type = 'StepFailed' then 'Failed' when event_type = 'Terminal' then status when event_type = 'CancellationRequested' then 'CancellationRequested' else 'Running' end"


@job("stream_stuck", cte(E) + f""", t as (select stream_id, {_DOING} as doing, epoch_us(occurred_at) // 1000 as ms, lead(epoch_us(occurred_at) // 1000) over (partition by stream_id order by epoch_us(occurred_at) // 1000, version) as nxt from event_log), m as (select max(ms) - 60000 as wm from t)
    select stream_id as instance_id, ms + 7200000 as at_ms, 'stuck' as change from t, m where doing in ('Pending', 'Running', 'CancellationRequested') and ms + 7200000 <= wm and (nxt is null or nxt > wm or nxt > ms + 7200000)
    union all select stream_id, nxt, 'cleared' from t, m where doing in ('Pending', 'Running', 'CancellationRequested') and nxt > ms + 7200000 and nxt <= wm""")  # fmt: skip
def stream_stuck(spark, d):
    rows = timed(live(spark, d, E)).select(F.col("stream_id").alias("instance_id"), "version", "at", F.expr(_DOING).alias("status"))
    return S.run_available(S.stream_stuck(rows, 7_200_000), "append", None, "stuck")


@job("stream_rates", cte(E) + " select time_bucket(interval '5' minute, occurred_at) as window_start, event_type, count(*) as n from event_log group by all")
def stream_rates(spark, d):
    out = S.run_available(S.stream_rates(timed(live(spark, d, E)), ["event_type"]), "update", ["window_start", "event_type"], "rates")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@job("stream_sessions", cte(E) + """, g as (select *, case when occurred_at - lag(occurred_at) over w >= interval '30' minute then 1 else 0 end as new from event_log window w as (partition by stream_id order by occurred_at)),
    s as (select *, sum(new) over (partition by stream_id order by occurred_at) as k from g), m as (select max(occurred_at) - interval '10' minute as wm from event_log)
    select stream_id as instance_id, min(occurred_at) as started_at, max(occurred_at) + interval '30' minute as ended_at, count(*) as n from s group by stream_id, k having max(occurred_at) + interval '30' minute <= (select wm from m)""")  # fmt: skip
def stream_sessions(spark, d):
    rows = timed(live(spark, d, E)).withColumnRenamed("stream_id", "instance_id")
    out = S.run_available(S.stream_sessions(rows), "append", None, "sessions")
    return out.select("instance_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ended_at")], "n")


@job("stream_decode", cte(E) + f" select event_id, case when event_id % 227 = 0 then 'Unknown' else event_type end as event_type, case when {_BAD} then 'bad' else 'good' end as part from event_log")
def stream_decode(spark, d):
    rows, path = raw(spark, d), new_path(spark, "live-raw")
    rows.repartition("event_id").write.parquet(path)
    good, bad = new_path(spark, "good"), new_path(spark, "bad")
    S.stream_decode(spark.readStream.schema(rows.schema).parquet(path), good, bad, new_path(spark, "decode-state")).awaitTermination()
    part = lambda p, name: spark.read.parquet(p).select("event_id", "event_type", F.lit(name).alias("part"))
    return part(good, "good").unionByName(part(bad, "bad"))


@job("stream_projection_sink", cte(E) + " select stream_id as instance_id, max(version) as stream_version, max_by(event_type, version) as status from event_log group by 1")
def stream_projection_sink(spark, d):
    rows = live(spark, d, E).select(F.col("stream_id").alias("instance_id"), F.col("version").alias("stream_version"), F.col("event_type").alias("status"))
    path = new_path(spark, "projection")
    S.stream_projection_sink(rows, path, new_path(spark, "projection-state")).awaitTermination()
    return S.latest_projection(spark, path, rows.schema)
