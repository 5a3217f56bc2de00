"""Management queries, statistics and gauges over instance projections and their waits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("Pending", "Running", "Waiting", "CancellationRequested")
STUCK_CANDIDATES = ("Pending", "Running", "CancellationRequested")
DAG_KINDS = ("dag-child-start-v1", "dag-child-join-v1", "dag-child-cancel-v1", "dag-run-ready-v1")
OUTBOX_STATES = ("Pending", "Retryable", "Claimed", "Poisoned")


def get_instances(projections: DataFrame, waits: DataFrame, ids: DataFrame) -> DataFrame:
    """Projections of the given ids with their waits as an array sorted by (registered_at, wait_id)."""
    wanted = ids.select("instance_id").distinct()
    mine = waits.join(wanted, "instance_id", "left_semi").groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("registered_at", "wait_id", "event_name"))).alias("active_waits"))
    out = projections.join(wanted, "instance_id", "left_semi").join(mine, "instance_id", "left")
    return out.withColumn("active_waits", F.coalesce("active_waits", F.expr("cast(array() as array<struct<registered_at: timestamp_ntz, wait_id: string, event_name: string>>)")))


def find_active_waits(projections: DataFrame, waits: DataFrame, event_name: str, correlation_id: str | None = None, version: int | None = None, definition_id=None) -> DataFrame:
    """Instances that have one wait equal in name, correlation and, if given, contract version."""
    test = F.col("event_name") == event_name
    if correlation_id is not None:
        test = test & (F.col("correlation_id") == correlation_id)
    if version is not None:
        test = test & (F.col("event_contract_version") == version)
    out = projections.join(waits.where(test), "instance_id", "left_semi")
    return out if definition_id is None else out.where(F.col("definition_id") == definition_id)


def apply_projection_ops(ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(instance_id, seq, op, wait_id, value, waits array<struct<wait_id, value>>) in order -> (summaries, waits, history).

    The last UpsertSummary of an instance counts and resets its waits to its own list ``waits``; later wait operations apply on top, the last per wait wins.
    """
    summary = ops.where("op = 'UpsertSummary'").groupBy("instance_id").agg(F.max_by(F.struct("value", "waits"), "seq").alias("s"), F.max("seq").alias("at"))
    own = summary.select("instance_id", F.explode("s.waits").alias("w"), F.col("at").alias("seq")).select("instance_id", "w.wait_id", "w.value", "seq", F.lit("UpsertActiveWait").alias("op"))
    late = ops.where(F.col("op").isin("UpsertActiveWait", "RemoveActiveWait")).join(summary.select("instance_id", "at"), "instance_id", "left").where(F.col("seq") > F.coalesce("at", F.lit(-1)))
    every = late.select("instance_id", "wait_id", "value", "seq", "op").unionByName(own)
    w = Window.partitionBy("instance_id", "wait_id").orderBy(F.desc("seq"))
    waits = every.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 and op = 'UpsertActiveWait'").select("instance_id", "wait_id", "value")
    return summary.select("instance_id", "s.value"), waits, ops.where("op = 'AppendHistory'").select("instance_id", "seq", "value")


def status_groups(projections: DataFrame) -> DataFrame:
    return projections.groupBy("definition_id", "definition_version", "status").agg(F.count("*").alias("n"))


def stuck_groups(projections: DataFrame) -> DataFrame:
    return projections.where("is_stuck").groupBy("definition_id").agg(F.count("*").alias("n"))


def active_wait_groups(projections: DataFrame, waits: DataFrame) -> DataFrame:
    """Waits by definition and event name; waits without an instance are left out."""
    own = projections.select("instance_id", F.col("definition_id"))
    return waits.drop("definition_id").join(own, "instance_id").groupBy("definition_id", "event_name").agg(F.count("*").alias("n"))


def mark_stuck(projections: DataFrame, observed_at: Column, threshold: Column) -> DataFrame:
    """Rows newly past the threshold become stuck; the time of detection is kept once set."""
    late = F.col("status").isin(*STUCK_CANDIDATES) & (F.coalesce("last_active_at", "updated_at") <= observed_at - threshold) & ~F.coalesce("is_stuck", F.lit(False))
    return projections.withColumn("stuck_detected_at", F.when(late, F.coalesce("stuck_detected_at", observed_at)).otherwise(F.col("stuck_detected_at"))).withColumn("is_stuck", late | F.coalesce("is_stuck", F.lit(False)))


def operational_pressure(projections: DataFrame, waits: DataFrame, heads: DataFrame, checkpoints: DataFrame, outbox: DataFrame) -> DataFrame:
    """One row; each table is read once."""
    p = projections.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active"), F.count_if("is_stuck").alias("stuck"))
    w = waits.agg(F.count("*").alias("active_waits"))
    lag = heads.join(checkpoints.select("stream_id", F.col("stream_version").alias("cv")), "stream_id", "left")
    e = lag.agg(F.coalesce(F.sum("stream_version"), F.lit(0)).alias("stream_events"), F.count("cv").alias("checkpoints"), F.coalesce(F.max(F.col("stream_version") - F.coalesce("cv", F.lit(0))), F.lit(0)).alias("max_lag"))
    cont = F.col("kind") == "continue"
    ext = ~F.col("kind").isin("continue", *DAG_KINDS)
    o = outbox.agg(*[F.count_if(t & (F.col("state") == s)).alias(f"{n}_{s.lower()}") for n, t in (("continuation", cont), ("external", ext)) for s in OUTBOX_STATES])
    return p.crossJoin(w).crossJoin(e).crossJoin(o)  # four rows of one


def dag_pressure(runs: DataFrame, nodes: DataFrame, outbox: DataFrame, subscriptions: DataFrame, cutoff: Column, at: Column) -> DataFrame:
    """(gauge, n): active and stuck runs, event and checkpoint totals, live and expired observers, the DAG outbox by lane and state.

    A notice that a run is ready is the observer lane's when it has a recipient; a run has one checkpoint and as many events as its version.
    """
    live = ~F.col("state").isin("Succeeded", "Failed", "Cancelled")
    r = runs.agg(F.count_if(live).alias("active"), F.coalesce(F.sum("version"), F.lit(0)).alias("events"), F.count("*").alias("checkpoints"))
    s = subscriptions.agg(F.count_if(F.col("expires_at") > at).alias("observers:live"), F.count_if(F.col("expires_at") <= at).alias("observers:expired"))
    tall = lambda f: f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("gauge"), F.col(f"`{c}`").cast("long").alias("n")) for c in f.columns])).alias("x")).select("x.*")
    stuck = mark_stuck_dag_runs(runs, nodes, cutoff).where("is_stuck").agg(F.lit("stuck").alias("gauge"), F.count("*").alias("n"))
    lane = F.when((F.col("kind") == "dag-run-ready-v1") & F.col("recipient_host_id").isNotNull(), "observer").otherwise("internal")
    lanes = outbox.where(F.col("kind").isin(*DAG_KINDS)).groupBy(F.concat_ws(":", F.lit("outbox"), lane, F.col("state")).alias("gauge")).agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [tall(r), stuck, tall(s), lanes])


def mark_stuck_dag_runs(runs: DataFrame, nodes: DataFrame, cutoff: Column) -> DataFrame:
    """A run is stuck iff it is not terminal, made no progress since the cutoff and has a ready node."""
    ready = nodes.where("state = 'Ready'").select("run_id").distinct().withColumn("_ready", F.lit(True))
    live = ~F.col("state").isin("Succeeded", "Failed", "Cancelled") & (F.col("last_progress_at") <= cutoff)
    return runs.join(ready, "run_id", "left").withColumn("is_stuck", live & F.col("_ready").isNotNull()).drop("_ready")


def fleet_gauges(projections: DataFrame, waits: DataFrame, outbox: DataFrame, pressure: DataFrame, dag: DataFrame, pools: DataFrame, leases: DataFrame) -> DataFrame:
    """Long table (instrument, tags, value).

    ``pressure``: the row of ``operational_pressure``; ``dag``: ``dag_pressure``; ``pools``: (pool, queued, debt, expired); ``leases``: (pool, state, n, units), see ``pool_states``.
    Totals of events and checkpoints are those of instances and runs together; notices to observers are no pending outbox of the fleet.
    """
    tag = lambda *c: F.create_map(*[x for k in c for x in (F.lit(k), F.col(k).cast("string"))])
    no_tags = F.expr("cast(map() as map<string, string>)")
    row = lambda name, tags, value: F.struct(F.lit(name).alias("instrument"), tags.alias("tags"), value.cast("long").alias("value"))
    unfold = lambda f, rows: f.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    lane = lambda n, s: F.create_map(F.lit("lane"), F.lit(n), F.lit("state"), F.lit(s))
    queues = [row("outbox.lanes", lane(n, s.lower()), F.col(f"{n}_{s.lower()}")) for n in ("continuation", "external") for s in OUTBOX_STATES]
    of_runs = dag.agg(*[F.coalesce(F.sum(F.when(F.col("gauge") == g, F.col("n"))), F.lit(0)).alias(f"run_{g}") for g in ("events", "checkpoints")])
    totals = [row(name, no_tags, c) for name, c in (("stream.events", F.col("stream_events") + F.col("run_events")), ("checkpoints.count", F.col("checkpoints") + F.col("run_checkpoints")), ("checkpoints.lag", F.col("max_lag")))]
    noticed = (F.col("kind") == "dag-run-ready-v1") & F.col("recipient_host_id").isNotNull()
    parts = [
        status_groups(projections.where(F.col("status").isin(*ACTIVE))).select(F.lit("instances.active").alias("instrument"), tag("definition_id", "definition_version", "status").alias("tags"), F.col("n").alias("value")),
        stuck_groups(projections).select(F.lit("instances.stuck").alias("instrument"), tag("definition_id").alias("tags"), F.col("n").alias("value")),
        active_wait_groups(projections, waits).select(F.lit("waits.active").alias("instrument"), tag("definition_id", "event_name").alias("tags"), F.col("n").alias("value")),
        outbox.where(F.col("state").isin(*OUTBOX_STATES) & ~noticed).groupBy(F.lower("state").alias("state")).agg(F.count("*").alias("value")).select(F.lit("outbox.pending").alias("instrument"), tag("state").alias("tags"), "value"),
        unfold(pressure.crossJoin(of_runs), queues + totals),  # rows of one
        dag.select(F.lit("dag").alias("instrument"), tag("gauge").alias("tags"), F.col("n").alias("value")),
        unfold(pools, [row(f"resource_pool.{n}", tag("pool"), F.col(c)) for n, c in (("waiters", "queued"), ("over_capacity_debt", "debt"), ("reconciliation_due", "expired"))]),
        unfold(leases, [row(f"resource_pool.{n}", tag("pool", "state"), F.col(c)) for n, c in (("tickets", "n"), ("reserved_units", "units"))]),
    ]
    return reduce(DataFrame.unionByName, parts)


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def instance_ages(projections: DataFrame, waits: DataFrame, at: Column) -> DataFrame:
    """Ages in seconds at a time: of the instance, since its last update and activity, of its oldest wait."""
    age = lambda c: F.floor((micros(at) - micros(F.col(c))) / 1_000_000).cast("long")
    oldest = waits.groupBy("instance_id").agg(F.min("registered_at").alias("oldest"))
    out = projections.join(oldest, "instance_id", "left")
    return out.select("instance_id", age("created_at").alias("age_s"), age("updated_at").alias("status_age_s"), age("last_active_at").alias("idle_s"), age("oldest").alias("oldest_wait_s"))


def blocked_on(waits: DataFrame, at: Column, threshold_s: int, accuracy: int | None = None) -> DataFrame:
    """Waits older than the threshold by event name: count, oldest, median and 95th percentile of the age in seconds; with ``accuracy`` within 1 / accuracy of the rank, by sketches of bounded size."""
    aged = waits.withColumn("age_s", F.floor((micros(at) - micros(F.col("registered_at"))) / 1_000_000)).where(F.col("age_s") > threshold_s)
    p = lambda q: F.round((F.percentile("age_s", F.lit(q)) if accuracy is None else F.percentile_approx("age_s", q, accuracy)).cast("double"), 3)
    return aged.groupBy("event_name").agg(F.count("*").alias("n"), F.min("registered_at").alias("oldest_at"), p(0.5).alias("p50_s"), p(0.95).alias("p95_s"))


COLUMNS = ("instance_id", "definition_id", "definition_version", "status", "created_at", "updated_at", "last_active_at")
_COMPARE = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b}


def predicate(spec) -> Column:
    """("and"|"or", spec, ..) or (column, "="|"<>"|"<", literal) over metadata columns; anything else is refused."""
    if spec and spec[0] in ("and", "or"):
        parts = [predicate(s) for s in spec[1:]]
        if not parts:
            raise ValueError(f"{spec[0]} of nothing")
        return reduce((lambda a, b: a & b) if spec[0] == "and" else (lambda a, b: a | b), parts)
    column, op, value = spec
    if column not in COLUMNS or op not in _COMPARE:
        raise ValueError(f"not a metadata comparison: {spec!r}")
    return _COMPARE[op](F.col(column), F.lit(value))


def select_instances(projections: DataFrame, spec) -> DataFrame:
    """Instances that satisfy a constrained predicate; count() of the same frame is the count query."""
    return projections.where(predicate(spec))


def fleet_summary(projections: DataFrame, waits: DataFrame, at: Column) -> DataFrame:
    """One row: nonterminal and stuck instances, oldest ages in seconds, waits by event name (map)."""
    age = lambda c: F.floor((micros(at) - micros(c)) / 1_000_000).cast("long")
    active = F.col("status").isin(*ACTIVE)
    p = projections.agg(F.count_if(active).alias("nonterminal"), F.count_if("is_stuck").alias("stuck"), age(F.min(F.when(active, F.col("created_at")))).alias("oldest_active_s"))
    by = waits.groupBy("event_name").agg(F.count("*").alias("n"), F.min("registered_at").alias("oldest"))
    w = by.agg(age(F.min("oldest")).alias("oldest_wait_s"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_name", "n")))).alias("waits_by_event"))
    return p.crossJoin(w)
