"""Telemetry: series, rates, histograms, quantiles, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import render_tags
from .inbox import classify_acceptance

#: Upper bounds of latency buckets in milliseconds: fixed values.
BOUNDS_MS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000)


def metric_series(points: DataFrame) -> DataFrame:
    """(name, tags map, value, observed_at) -> sum, count and last time per series."""
    return points.groupBy("name", render_tags(F.col("tags")).alias("tags")).agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.max("observed_at").alias("last_at"))


def latest(rows: DataFrame, time: str, tie: str, n: int = 50) -> DataFrame:
    return rows.orderBy(F.desc(time), F.desc(tie)).limit(n)


def bounded_history(rows: DataFrame, kind: str, time: str, tie: str, n: int) -> DataFrame:
    """The last ``n`` rows of each kind."""
    w = Window.partitionBy(kind).orderBy(F.desc(time), F.desc(tie))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def merge_scopes(*maps: Column) -> Column:
    """Maps from outer to inner scope; the later key wins."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(_without(out, m), m)
    return out


def _without(outer: Column, inner: Column) -> Column:
    return F.map_filter(outer, lambda k, _: ~F.map_contains_key(inner, k))


#: Kind of event -> what an operator sees: fixed values.
OBSERVATIONS = {
    "Started": "InstanceStarted",
    "ContinuedAsNew": "InstanceContinuedAsNew",
    "StepCompleted": "StepCompleted",
    "StepFailed": "StepFailed",
    "WaitRegistered": "InstanceSuspended",
    "WaitMatched": "InstanceResumed",
    "TimerScheduled": "InstanceSuspended",
    "TimerFired": "InstanceResumed",
    "Parked": "InstanceParked",
    "Unparked": "InstanceUnparked",
    "Completed": "InstanceCompleted",
    "CancellationRequested": "InstanceCancellationRequested",
}
#: The same for a Terminal event by its status: fixed values.
TERMINAL_OBSERVATIONS = {"Failed": "InstanceFailed", "Cancelled": "InstanceCancelled", "Terminated": "InstanceTerminated"}

#: The kind of error of a failed step, the only one that events tell of; what went wrong is its summary: fixed value.
STEP_ERROR = "WorkflowStepFailedEvent"


def _looked_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def lifecycle_name(event_type: Column, status: Column) -> Column:
    """What an operator sees of an event, null for kinds that are none; of a Terminal event its status tells."""
    return F.when(event_type == "Terminal", _looked_up(TERMINAL_OBSERVATIONS, status)).otherwise(_looked_up(OBSERVATIONS, event_type))


def lifecycle_observations(events: DataFrame) -> DataFrame:
    """Events with ``observation`` (null for kinds that are none), the step of step events, the kind and summary of failures."""
    name = lifecycle_name(F.col("event_type"), F.col("status"))
    step = F.col("event_type").isin("StepCompleted", "StepFailed")
    return events.select("stream_id", "version", "occurred_at", "event_type", name.alias("observation"), F.when(step, F.col("step_path")).alias("step_path"), *[F.when(F.col("event_type") == "StepFailed", c).alias(n) for n, c in (("error_kind", F.lit(STEP_ERROR)), ("error_summary", F.col("error")))])


def wait_durations(events: DataFrame) -> DataFrame:
    """Micros from a wait's registration to its match, by event name: a match belongs to the last registration of its wait."""
    w = Window.partitionBy("stream_id", "wait_id").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.where(F.col("event_type").isin("WaitRegistered", "WaitMatched"))
    is_reg = F.col("event_type") == "WaitRegistered"
    rows = rows.withColumn("at", F.last(F.when(is_reg, F.col("occurred_at")), ignorenulls=True).over(w)).withColumn("name", F.last(F.when(is_reg, F.col("event_name")), ignorenulls=True).over(w))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.where(~is_reg & F.col("at").isNotNull()).select("stream_id", "version", "wait_id", F.col("name").alias("event_name"), F.greatest(F.lit(0), us("occurred_at") - us("at")).alias("micros"))


def event_counters(events: DataFrame, inbox: DataFrame | None = None) -> DataFrame:
    """(counter, label, n): events by type, completed steps by path, failed steps by path and kind of error, lifecycle events by name; one pass over the log.

    ``inbox``: accepted envelopes; what repeats an earlier one is counted as a duplicate by its event's name.
    """
    seen = lifecycle_name(F.col("event_type"), F.col("status"))
    labels = F.array(
        F.struct(F.lit("events").alias("counter"), F.col("event_type").alias("label")),
        F.when(F.col("event_type") == "StepCompleted", F.struct(F.lit("steps.completed").alias("counter"), F.col("step_path").alias("label"))),
        F.when(F.col("event_type") == "StepFailed", F.struct(F.lit("steps.failed").alias("counter"), F.concat_ws("|", "step_path", F.lit(STEP_ERROR)).alias("label"))),
        F.when(seen.isNotNull(), F.struct(F.lit("lifecycle").alias("counter"), seen.alias("label"))),
    )
    out = events.select(F.explode(labels).alias("x")).where("x is not null").groupBy("x.counter", "x.label").agg(F.count("*").alias("n"))
    if inbox is None:
        return out
    twice = classify_acceptance(inbox).where("result = 'Duplicate'").join(inbox.select("acceptance_sequence", "event_name"), "acceptance_sequence")
    return out.unionByName(twice.groupBy(F.lit("inbox.duplicates").alias("counter"), F.col("event_name").alias("label")).agg(F.count("*").alias("n")))


def latency_histogram(points: DataFrame, series: str, value: str) -> DataFrame:
    """Cumulative bucket counts (series, le, n); le is the bound in ms, the last bucket has none (null). One pass, one row per series before the buckets unfold."""
    sums = [F.count_if(F.col(value) <= b).alias(f"b{b}") for b in BOUNDS_MS]
    wide = points.groupBy(series).agg(*sums, F.count(value).alias("all"))
    rows = [F.struct(F.lit(b).cast("long").alias("le"), F.col(f"b{b}").alias("n")) for b in BOUNDS_MS] + [F.struct(F.lit(None).cast("long").alias("le"), F.col("all").alias("n"))]
    return wide.select(series, F.explode(F.array(*rows)).alias("b")).select(series, "b.le", "b.n")


def histogram_quantile(buckets: DataFrame, series: str, q: float) -> DataFrame:
    """Quantile per series by linear interpolation in the first bucket that reaches it; in the open bucket its lower bound."""
    w = Window.partitionBy(series).orderBy(F.col("le").asc_nulls_last())
    b = buckets.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0)))
    b = b.withColumn("want", F.max("n").over(Window.partitionBy(series)) * F.lit(q)).where((F.col("n") >= F.col("want")) & (F.col("want") > 0))
    at = F.when(F.col("le").isNull(), F.col("low").cast("double")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (F.col("want") - F.col("below")) / (F.col("n") - F.col("below")))
    return b.groupBy(series).agg(F.min_by(F.round(at, 6), F.coalesce("le", F.lit(2**62))).alias("quantile"))


def rate_windows(events: DataFrame, labels: list[str], time: str = "occurred_at", window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Events per second over sliding windows by labels."""
    w = events.groupBy(F.window(F.col(time).cast("timestamp"), window, slide).alias("w"), *labels).agg(F.count("*").alias("n"))
    seconds = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")).cast("double")
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *labels, "n", F.round(F.col("n") / seconds, 6).alias("rate"))


def approx_quantiles(points: DataFrame, by: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """Quantiles that are values of the group, their rank within 1 / ``accuracy`` of the group's size: sketches of bounded size, merged map-side, whatever the number of different values."""
    p = F.percentile_approx(value, [0.5, 0.95, 0.99], accuracy)
    return points.groupBy(by).agg(F.count("*").alias("n"), p.alias("p")).select(by, "n", *[F.col("p")[i].alias(x) for i, x in enumerate(("p50", "p95", "p99"))])


def exact_quantiles(points: DataFrame, by: str, value: str) -> DataFrame:
    """Exact, interpolated quantiles; every different value of a group is held in one task, see ``approx_quantiles``."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return points.groupBy(by).agg(F.count("*").alias("n"), p.alias("p")).select(by, "n", *[F.round(F.col("p")[i], 3).alias(x) for i, x in enumerate(("p50", "p95", "p99"))])


def throughput_per_minute(events: DataFrame, by: str) -> DataFrame:
    """Events, completed and failed steps per minute."""
    minute = F.date_trunc("minute", F.col("occurred_at")).cast("timestamp_ntz")
    n = lambda k: F.count_if(F.col("event_type") == k)
    return events.groupBy(by, minute.alias("minute")).agg(F.count("*").alias("n"), n("StepCompleted").alias("completed"), n("StepFailed").alias("failed"))
