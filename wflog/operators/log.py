"""Event log and instance state, for all streams at once.

Events are rows (stream_id, version, event_id, event_type, occurred_at, ..) with version 1..n per stream.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds after which no wait, timer or resume of the stream is left.
CLEARS = ("ContinuedAsNew", "StepFailed", "Completed", "Terminal")
#: Kinds after which no ticket is left.
TICKET_CLEARS = ("ContinuedAsNew", "Completed", "Terminal")
TERMINAL = ("Completed", "Failed", "TimedOut", "Cancelled", "Terminated")


def stream_tail(events: DataFrame, after: DataFrame) -> DataFrame:
    """Events with a version above their stream's ``after_version`` (none: 0)."""
    out = events.join(after, "stream_id", "left")
    return out.where(F.col("version") > F.coalesce("after_version", F.lit(0))).drop("after_version")


def stream_heads(events: DataFrame) -> DataFrame:
    return events.groupBy("stream_id").agg(F.max("version").alias("stream_version"))


def append_batches(batches: DataFrame) -> DataFrame:
    """Commit batches (stream_id, seq, expected_version, n_events) judged in order of seq against the stream's head.

    Rows of a stream pass in order through one task as Arrow batches; only the head is carried on, so a long stream needs no more memory than a short one.
    """
    names = ["stream_id", "seq", "accepted", "expected_version", "actual_version", "first_version"]

    def judge(parts):
        stream, head = None, 0
        for part in parts:
            ok, before = [], []
            for s, expected, n in zip(*(part.column(c).to_pylist() for c in ("stream_id", "expected_version", "n_events")), strict=True):
                if s != stream:
                    stream, head = s, 0
                ok.append(expected == head)
                before.append(head)
                head += n if ok[-1] else 0
            first = [h + 1 if good and n else None for good, h, n in zip(ok, before, part.column("n_events").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("stream_id"), part.column("seq"), pa.array(ok), part.column("expected_version"), pa.array(before, pa.int64()), pa.array(first, pa.int64())], names)

    rows = batches.select("stream_id", *[F.col(c).cast("long").alias(c) for c in names[1:2] + names[3:4]], F.col("n_events").cast("long").alias("n_events"))
    kind = batches.schema["stream_id"].dataType.simpleString()
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(judge, f"stream_id {kind}, seq long, accepted boolean, expected_version long, actual_version long, first_version long")


def check_log_integrity(events: DataFrame) -> DataFrame:
    """Faults: (stream_id, version, fault) with fault gap, repeated_version or repeated_event."""
    w = Window.partitionBy("stream_id").orderBy("version")
    step = F.col("version") - F.coalesce(F.lag("version").over(w), F.lit(0))
    kind = F.when(step == 0, "repeated_version").when(step != 1, "gap")
    versions = events.select("stream_id", "version", kind.alias("fault")).where("fault is not null")
    twice = events.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1")
    ids = events.join(twice, "event_id", "left_semi").select("stream_id", "version", F.lit("repeated_event").alias("fault"))
    return versions.unionByName(ids)


#: A folded instance.
FOLD = (
    "stream_id long, status string, stream_version long, created_at timestamp_ntz, updated_at timestamp_ntz, definition_id long, definition_version int, parent_instance_id long, root_instance_id long, last_step_path string, error_summary string, "
    "outcome string, park_reason string, generation int, failure_count int, failure_position long, retry_not_before timestamp_ntz, open_waits array<string>, open_timers array<string>, pending_resumes array<string>, tickets array<string>"
)
_STATE = tuple(x.split()[0] for x in FOLD.split(", ")[1:])
SETS = ("open_waits", "open_timers", "pending_resumes", "tickets")
#: Columns that the fold reads, with the type where a log lacks one.
NEEDED = {
    "stream_id": "long", "version": "long", "event_type": "string", "occurred_at": "timestamp_ntz", "step_path": "string", "wait_id": "string", "timer_id": "string", "holder_key": "string", "error": "string", "status": "string",
    "definition_id": "long", "definition_version": "int", "parent_instance_id": "long", "root_instance_id": "long", "outcome": "string", "reason": "string", "generation": "int", "attempt_count": "int", "position_stream_version": "long", "next_eligible_at": "timestamp_ntz",
}


#: What ``apply_event`` reads of an event besides its kind and time: column -> kinds.
READ_OF = {
    "stream_id": ("Started",), "definition_id": ("Started",), "definition_version": ("Started",), "parent_instance_id": ("Started",), "root_instance_id": ("Started",),
    "step_path": ("StepCompleted", "StepFailed"), "error": ("Parked", "StepFailed", "Terminal"), "reason": ("Parked",), "outcome": ("Completed",), "status": ("Terminal",), "generation": ("ContinuedAsNew",),
    "attempt_count": ("ContinuationAttemptFailed",), "position_stream_version": ("ContinuationAttemptFailed",), "next_eligible_at": ("ContinuationAttemptFailed",),
    "wait_id": ("WaitRegistered", "ResourcePoolQueued", "WaitMatched", "WaitCancelled", "ResumeConsumed"), "timer_id": ("TimerScheduled", "TimerCancelled", "TimerFired"), "holder_key": ("ResourcePoolAcquired", "ResourcePoolReleased"),
}


def needed(events: DataFrame) -> DataFrame:
    return events.select(*[F.col(c) if c in events.columns else F.lit(None).cast(t).alias(c) for c, t in NEEDED.items()])


def new_state() -> dict:
    return {**dict.fromkeys(_STATE), "status": "Pending", "stream_version": 0, "generation": 0, "failure_count": 0, **{c: set() for c in SETS}}


def apply_event(s: dict, e) -> None:
    """One event of the transition table, for live state; ``e`` has the columns of ``NEEDED`` as attributes."""
    kind, before = e.event_type, s["status"]
    waits, timers, resumes, tickets = (s[c] for c in SETS)
    s["created_at"] = e.occurred_at if s["created_at"] is None else s["created_at"]
    s["updated_at"], s["stream_version"] = e.occurred_at, s["stream_version"] + 1
    status = before
    if kind == "Started":
        status = "Running"
        s.update(definition_id=e.definition_id, definition_version=e.definition_version, parent_instance_id=e.parent_instance_id, root_instance_id=e.stream_id if e.root_instance_id is None else e.root_instance_id)
    elif kind == "Parked":
        status, s["park_reason"], s["error_summary"] = "Waiting", e.reason, e.error
    elif kind == "ContinuationAttemptFailed":
        s.update(failure_count=e.attempt_count or 0, failure_position=e.position_stream_version, retry_not_before=e.next_eligible_at)
    elif kind == "StepCompleted":
        status, s["last_step_path"] = ("Waiting" if before == "Waiting" else "Running"), e.step_path
    elif kind == "StepFailed":
        status, s["last_step_path"], s["error_summary"] = "Failed", e.step_path, e.error
    elif kind == "Completed":
        status, s["outcome"] = "Completed", e.outcome
    elif kind == "CancellationRequested":
        status = "CancellationRequested"
    elif kind == "Terminal":
        status, s["error_summary"] = e.status, e.error or s["error_summary"]
    elif kind in ("WaitRegistered", "ResourcePoolQueued"):
        status = "Waiting"
        waits.add(e.wait_id)
    elif kind == "TimerScheduled":
        status = "Waiting"
        timers.add(e.timer_id)
    elif kind == "ResourcePoolAcquired":
        status = "Running"
        tickets.add(e.holder_key)
    elif kind == "ResourcePoolReleased":
        tickets.discard(e.holder_key)
    elif kind == "ResumeConsumed":
        resumes.discard(e.wait_id)
    elif kind == "WaitMatched":
        waits.discard(e.wait_id)
        resumes.add(e.wait_id)
        status = "Waiting" if waits else "Running"
    elif kind in ("WaitCancelled", "TimerCancelled", "TimerFired", "Unparked"):
        if kind == "WaitCancelled":
            waits.discard(e.wait_id)
            resumes.discard(e.wait_id)
        elif kind == "Unparked":
            s["park_reason"] = s["error_summary"] = None
        else:
            timers.discard(e.timer_id)
        status = "Waiting" if waits or timers else "Running"
    elif kind == "ContinuedAsNew":
        status, s["generation"], s["error_summary"], s["outcome"] = "Running", e.generation or 0, None, None
    elif kind not in ("ExecutionPositionChanged", "ContinuationAttemptReset"):
        raise ValueError(f"unknown kind of event: {kind}")
    if kind in ("Unparked", "ContinuedAsNew", "ContinuationAttemptReset"):
        s.update(failure_count=0, failure_position=None, retry_not_before=None)
    if kind in CLEARS and not (kind == "Terminal" and status not in TERMINAL):
        waits.clear()
        timers.clear()
        resumes.clear()
        if kind != "StepFailed":
            tickets.clear()
    sticky = before == "CancellationRequested" and status in ("Running", "Waiting")
    s["status"] = before if sticky else status


#: What an event opens (True) and closes (False): kind -> (set, column of the key, opens).
_MARKS = (
    ("WaitRegistered", "open_waits", "wait_id", True), ("ResourcePoolQueued", "open_waits", "wait_id", True), ("WaitMatched", "open_waits", "wait_id", False), ("WaitCancelled", "open_waits", "wait_id", False),
    ("TimerScheduled", "open_timers", "timer_id", True), ("TimerFired", "open_timers", "timer_id", False), ("TimerCancelled", "open_timers", "timer_id", False),
    ("WaitMatched", "pending_resumes", "wait_id", True), ("WaitCancelled", "pending_resumes", "wait_id", False), ("ResumeConsumed", "pending_resumes", "wait_id", False),
    ("ResourcePoolAcquired", "tickets", "holder_key", True), ("ResourcePoolReleased", "tickets", "holder_key", False),
)
_SOFT_RUNNING = ("Started", "ContinuedAsNew", "ResourcePoolAcquired")
_SOFT_WAITING = ("Parked", "WaitRegistered", "ResourcePoolQueued", "TimerScheduled")
_SOFT_OPEN = ("WaitMatched", "WaitCancelled", "TimerCancelled", "TimerFired", "Unparked")


def _summaries(events: DataFrame) -> DataFrame:
    """Per stream what its events leave behind: the last writer of each field, the last events that decide the status, the last clears.

    Summaries of segments of a stream could be summed up again: everything is a maximum by version, so a long stream is combined map-side.
    """
    kind, v = F.col("event_type"), F.col("version")
    ended = (kind != "Terminal") | F.col("status").isin(*TERMINAL)

    def last(test: Column, *values: Column) -> Column:
        return F.max_by(F.when(test, F.struct(*values)), F.when(test, v))

    def nothing(*names: str) -> list[Column]:
        return [F.lit(None).alias(n) for n in names]

    is_ = lambda *k: kind.isin(*k)
    error = F.when(is_("Parked", "StepFailed", "Terminal"), F.col("error"))
    reset = is_("ContinuationAttemptReset", "Unparked", "ContinuedAsNew")
    hard = is_("StepFailed", "Completed", "CancellationRequested") | (is_("Terminal") & ~F.col("status").isin("Running", "Waiting"))
    hard_status = F.when(is_("StepFailed"), "Failed").when(is_("Terminal"), F.col("status")).otherwise(kind)
    soft = is_(*_SOFT_RUNNING, *_SOFT_WAITING, *_SOFT_OPEN) | (is_("Terminal") & F.col("status").isin("Running", "Waiting"))
    return events.groupBy("stream_id").agg(
        F.count("*").alias("n"), F.min_by("occurred_at", "version").alias("created"), F.max_by("occurred_at", "version").alias("updated"),
        last(is_("Started"), "definition_id", "definition_version", "parent_instance_id", F.coalesce("root_instance_id", "stream_id").alias("root_instance_id")).alias("started"),
        last(is_("StepCompleted", "StepFailed"), "step_path").alias("step"),
        last(is_("Parked", "Unparked", "ContinuedAsNew", "StepFailed") | (is_("Terminal") & F.col("error").isNotNull()), error.alias("x")).alias("error"),
        last(is_("Completed", "ContinuedAsNew"), F.when(is_("Completed"), F.col("outcome")).alias("x")).alias("outcome"),
        last(is_("Parked", "Unparked"), F.when(is_("Parked"), F.col("reason")).alias("x")).alias("park"),
        last(is_("ContinuedAsNew"), "generation").alias("generation"),
        last(is_("ContinuationAttemptFailed") | reset, F.when(reset, 0).otherwise(F.col("attempt_count")).alias("n"), F.when(~reset, F.col("position_stream_version")).alias("position"), F.when(~reset, F.col("next_eligible_at")).alias("retry")).alias("failure"),
        last(hard, v.alias("at"), hard_status.alias("status")).alias("hard"), last(soft, v.alias("at"), "event_type", "status").alias("soft"), F.max(F.when(is_("StepCompleted"), v)).alias("stepped"),
        F.max(F.when(is_(*CLEARS) & ended, v)).alias("cleared"), F.max(F.when(is_(*TICKET_CLEARS) & ended, v)).alias("tickets_cleared"),
    )


def _open_sets(events: DataFrame, start: DataFrame | None, facts: DataFrame) -> DataFrame:
    """Per stream the keys of each set whose last opening nothing closed or cleared; those of ``start`` were opened before all events."""
    mark = lambda k, name, key, opens: F.when(F.col("event_type") == k, F.struct(F.lit(name).alias("set"), F.col(key).alias("key"), F.lit(opens).alias("opens")))
    rows = events.where(F.col("event_type").isin(*{m[0] for m in _MARKS})).select("stream_id", "version", F.explode(F.filter(F.array(*[mark(*m) for m in _MARKS]), lambda m: m.isNotNull())).alias("m"))
    rows = rows.select("stream_id", "version", "m.*").where("key is not null")
    if start is not None:
        member = lambda c: F.transform(c, lambda k: F.struct(F.lit(c).alias("set"), k.alias("key")))
        known = F.explode(F.flatten(F.array(*map(member, SETS)))).alias("m")
        rows = rows.unionByName(start.select("stream_id", F.lit(0).cast("long").alias("version"), known).select("stream_id", "version", "m.*", F.lit(True).alias("opens")))
    per = rows.groupBy("stream_id", "set", "key").agg(F.max(F.when(F.col("opens"), F.col("version"))).alias("opened"), F.max(F.when(~F.col("opens"), F.col("version"))).alias("closed"))
    per = per.join(facts.select("stream_id", "cleared", "tickets_cleared"), "stream_id", "left")
    cleared = F.when(F.col("set") == "tickets", F.col("tickets_cleared")).otherwise(F.col("cleared"))
    still = per.where((F.col("opened") > F.coalesce("closed", F.lit(-1))) & (F.col("opened") > F.coalesce(cleared, F.lit(-1))))
    return still.groupBy("stream_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("set") == c, F.col("key")))).alias(c) for c in SETS])


def _fold(events: DataFrame, start: DataFrame | None) -> DataFrame:
    """Events folded onto ``start`` (rows of the fold, or none), as aggregates over streams and over (stream, key): nothing is replayed one by one.

    The status comes from the last event that sets one whatever was before (failed, completed, cancellation requested, terminal), and, unless
    that asked for cancellation, from the last later one that means running or waiting. Nothing closes or opens a wait or timer after the latter, so what decides it is the sets at the end.
    """
    facts = _summaries(events)
    both = facts.join(_open_sets(events, start, facts), "stream_id", "left")
    empty = F.expr("cast(array() as array<string>)")
    if start is None:
        old = dict.fromkeys(_STATE, F.lit(None)) | {"status": F.lit("Pending"), "stream_version": F.lit(0), "generation": F.lit(0), "failure_count": F.lit(0)}
    else:
        # a checkpoint without a tail keeps its own sets
        both = start.select("stream_id", F.struct(*_STATE).alias("old")).join(both, "stream_id", "full_outer")
        old = {c: F.col(f"old.{c}") for c in _STATE} | {"status": F.coalesce("old.status", F.lit("Pending")), **{c: F.coalesce(f"old.{c}", F.lit(0)) for c in ("stream_version", "generation", "failure_count")}}
    sets = {c: F.coalesce(F.when(F.col("n").isNull(), old[c]).otherwise(F.col(c)) if start is not None else F.col(c), empty) for c in SETS}
    waits, timers = F.size(sets["open_waits"]) > 0, F.size(sets["open_timers"]) > 0
    k = F.col("soft.event_type")
    soft = F.when(k.isin(*_SOFT_RUNNING), "Running").when(k.isin(*_SOFT_WAITING), "Waiting").when(k == "Terminal", F.col("soft.status"))
    soft = soft.when(waits | (timers & (k != "WaitMatched")), "Waiting").otherwise("Running")
    since = F.coalesce("hard.at", F.lit(-1))
    base = F.coalesce("hard.status", old["status"])
    stepped = F.when(base == "Waiting", base).otherwise("Running")
    status = F.when(base == "CancellationRequested", base).when(F.col("soft.at") > since, soft).when(F.col("stepped") > since, stepped).otherwise(base)
    written = lambda fact, field, name: F.when(F.col(fact).isNotNull(), F.col(f"{fact}.{field}")).otherwise(old[name]).alias(name)
    return both.select(
        "stream_id", status.alias("status"), (old["stream_version"] + F.coalesce("n", F.lit(0))).cast("long").alias("stream_version"), F.coalesce(old["created_at"], "created").alias("created_at"), F.coalesce("updated", old["updated_at"]).alias("updated_at"),
        *[written("started", c, c) for c in ("definition_id", "definition_version", "parent_instance_id", "root_instance_id")], written("step", "step_path", "last_step_path"), written("error", "x", "error_summary"), written("outcome", "x", "outcome"), written("park", "x", "park_reason"),
        F.coalesce(written("generation", "generation", "generation"), F.lit(0)).alias("generation"), F.coalesce(written("failure", "n", "failure_count"), F.lit(0)).alias("failure_count"), written("failure", "position", "failure_position"), written("failure", "retry", "retry_not_before"), *[sets[c].alias(c) for c in SETS],
    )


def fold_instances(events: DataFrame) -> DataFrame:
    """All events replayed to one row per stream (``FOLD``)."""
    return _fold(needed(events), None)


def fold_from_checkpoint(checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """The same from checkpoint rows (columns of the fold) and only the events after them."""
    return _fold(needed(stream_tail(events, checkpoints.select("stream_id", F.col("stream_version").alias("after_version")))), checkpoints)


def _last_clear(events: DataFrame, kinds) -> DataFrame:
    ends = F.col("event_type").isin(*kinds) & ((F.col("event_type") != "Terminal") | F.col("status").isin(*TERMINAL))
    return events.where(ends).groupBy("stream_id").agg(F.max("version").alias("cleared"))


def _still_open(events: DataFrame, key: Column, opens, closes, clears=CLEARS) -> DataFrame:
    """(stream_id, key, version): the last opening of each key that nothing closed or cleared afterwards."""
    rows = events.withColumn("_k", key).where(F.col("_k").isNotNull())
    per = rows.groupBy("stream_id", F.col("_k").alias("key")).agg(
        F.max(F.when(F.col("event_type").isin(*opens), F.col("version"))).alias("version"),
        F.max(F.when(F.col("event_type").isin(*closes), F.col("version"))).alias("closed"),
    )
    per = per.join(_last_clear(events, clears), "stream_id", "left")
    return per.where((F.col("version") > F.coalesce("closed", F.lit(0))) & (F.col("version") > F.coalesce("cleared", F.lit(0)))).select("stream_id", "key", "version")


def open_waits(events: DataFrame) -> DataFrame:
    """Waits registered and not matched, cancelled or cleared since; a queued pool request registers its wait too."""
    key = F.when(F.col("event_type").isin("WaitRegistered", "ResourcePoolQueued", "WaitMatched", "WaitCancelled"), F.col("wait_id"))
    return _still_open(events, key, ("WaitRegistered", "ResourcePoolQueued"), ("WaitMatched", "WaitCancelled")).withColumnRenamed("key", "wait_id")


def open_timers(events: DataFrame) -> DataFrame:
    key = F.when(F.col("event_type").isin("TimerScheduled", "TimerFired", "TimerCancelled"), F.col("timer_id"))
    return _still_open(events, key, ("TimerScheduled",), ("TimerFired", "TimerCancelled")).withColumnRenamed("key", "timer_id")


def held_tickets(events: DataFrame) -> DataFrame:
    """Holders whose last acquisition was not released or cleared; a failed step keeps tickets."""
    key = F.when(F.col("event_type").isin("ResourcePoolAcquired", "ResourcePoolReleased"), F.col("holder_key"))
    return _still_open(events, key, ("ResourcePoolAcquired",), ("ResourcePoolReleased",), TICKET_CLEARS).withColumnRenamed("key", "holder_key")


RESUME = ("event_name", "event_contract_version", "correlation_id", "fiber_id", "scope_id")


def pending_resumes(events: DataFrame) -> DataFrame:
    """Matched waits whose resume is not consumed, cancelled or cleared: the last match of each.

    What the match leaves out (name, contract version, correlation, fiber, scope) comes from the wait that it met, if that was still open; a queued pool
    request waits for ``ResourcePoolGranted`` with its holder's key as correlation.
    """
    kind, v = F.col("event_type"), F.col("version")
    for c in RESUME:
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("int" if c == "event_contract_version" else "string"))
    rows = events.where(kind.isin("WaitRegistered", "ResourcePoolQueued", "WaitMatched", "WaitCancelled", "ResumeConsumed"))
    queued = kind == "ResourcePoolQueued"
    met = F.struct(v.alias("version"), F.when(queued, F.lit("ResourcePoolGranted")).otherwise(F.col("event_name")).alias("event_name"), F.when(~queued, F.coalesce("event_contract_version", F.lit(1))).otherwise(F.lit(1)).alias("event_contract_version"),
        F.when(queued, F.col("holder_key")).otherwise(F.col("correlation_id")).alias("correlation_id"), "fiber_id", "scope_id")
    before = Window.partitionBy("stream_id", "wait_id").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("met", F.last(F.when(kind.isin("WaitRegistered", "ResourcePoolQueued"), met), ignorenulls=True).over(before)).withColumn("gone", F.max(F.when(kind.isin("WaitMatched", "WaitCancelled"), v)).over(before))
    matched = kind == "WaitMatched"
    per = rows.groupBy("stream_id", "wait_id").agg(
        F.max(F.when(matched, v)).alias("version"), F.max(F.when(kind.isin("WaitCancelled", "ResumeConsumed"), v)).alias("closed"),
        F.max_by(F.when(matched, F.struct(*RESUME, "met", "gone")), F.when(matched, v)).alias("m"),
    )
    per = per.join(_last_clear(events, CLEARS), "stream_id", "left")
    per = per.where((F.col("version") > F.coalesce("closed", F.lit(0))) & (F.col("version") > F.coalesce("cleared", F.lit(0))))
    live = (F.col("m.met.version") > F.coalesce("m.gone", F.lit(0))) & (F.col("m.met.version") > F.coalesce("cleared", F.lit(0)))
    return per.select("stream_id", "wait_id", "version", *[F.coalesce(F.col(f"m.{c}"), F.when(live, F.col(f"m.met.{c}"))).alias(c) for c in RESUME])


def generations(events: DataFrame, number: Column | None = None) -> DataFrame:
    """Each stream by generation: (stream_id, generation, versions, times, n_events).

    ``number``: the generation that an event carries. Without it a stream is cut at ContinuedAsNew, and the cutting event opens the next generation.
    """
    if number is None:
        w = Window.partitionBy("stream_id").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
        number = F.sum(F.when(F.col("event_type") == "ContinuedAsNew", 1).otherwise(0)).over(w)
    return events.withColumn("generation", number.cast("long")).groupBy("stream_id", "generation").agg(
        F.min("version").alias("first_version"), F.max("version").alias("last_version"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"), F.count("*").alias("n_events")
    )


#: Allowed moves (from, trigger, to) of an instance: fixed values.
TRANSITIONS = (
    ("Pending", "Start", "Running"),
    ("Running", "EnterWait", "Waiting"),
    ("Waiting", "MatchWait", "Running"),
    ("Running", "Complete", "Completed"),
    ("Running", "Fail", "Failed"),
    ("Running", "Cancel", "Cancelled"),
    ("Waiting", "Cancel", "Cancelled"),
    ("Running", "Terminate", "Terminated"),
    ("Waiting", "Terminate", "Terminated"),
    ("Running", "Park", "Waiting"),
    ("Waiting", "Unpark", "Running"),
    ("CancellationRequested", "Cancel", "Cancelled"),
    ("CancellationRequested", "Terminate", "Terminated"),
    ("Running", "Timeout", "TimedOut"),
    ("Waiting", "Timeout", "TimedOut"),
)


def lifecycle_transitions(moves: DataFrame) -> DataFrame:
    """(instance_id, seq, trigger, status) -> consecutive moves with ``allowed``."""
    w = Window.partitionBy("instance_id").orderBy("seq")
    steps = moves.withColumn("from_status", F.lag("status").over(w)).where("from_status is not null").withColumnRenamed("status", "to_status")
    table = moves.sparkSession.createDataFrame(list(TRANSITIONS), "from_status string, trigger string, to_status string").withColumn("allowed", F.lit(True))
    out = steps.join(F.broadcast(table), ["from_status", "trigger", "to_status"], "left")
    return out.withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def checkpoint_lag(heads: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Per stream the events after its checkpoint; without one the whole stream."""
    out = heads.join(checkpoints.select("stream_id", F.col("stream_version").alias("checkpoint_version")), "stream_id", "left")
    return out.withColumn("lag", F.col("stream_version") - F.coalesce("checkpoint_version", F.lit(0)))


def lineage_rollup(projections: DataFrame) -> DataFrame:
    return projections.groupBy(F.coalesce("root_instance_id", "instance_id").alias("root_id"), "status").agg(F.count("*").alias("n"))


def _first_binding(rows: DataFrame, key: list[str], order: list[str], what: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    for c in what:
        rows = rows.withColumn(f"bound_{c}", F.first(c).over(w))
    return rows.withColumn("_rn", F.row_number().over(w))


def start_bindings(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Start requests (key, seq, definition_id, definition_version, fingerprint) -> result new, existing or conflict.

    A stored binding of the key decides; else the earliest request binds and later ones are compared with it.
    """
    what = ["definition_id", "definition_version", "fingerprint"]
    every = stored.select("key", F.lit(-1).cast("long").alias("seq"), *what).unionByName(requests.select("key", "seq", *what))
    every = _first_binding(every, ["key"], ["seq"], what)
    same = F.lit(True)
    for c in what:
        same = same & F.col(c).eqNullSafe(F.col(f"bound_{c}"))
    result = F.when(F.col("_rn") == 1, "new").when(same, "existing").otherwise("conflict")
    return every.where("seq >= 0").select("key", "seq", result.alias("result"))


def verify_checksums(records: DataFrame) -> DataFrame:
    """(owner, version, payload, checksum) -> bad rows with fault checksum or gap; of a version's records the payload decides which is first."""
    w = Window.partitionBy("owner").orderBy("version", "payload")
    gap = F.col("version") != F.lag("version").over(w) + 1
    bad = ~F.sha2("payload", 256).eqNullSafe(F.col("checksum"))
    return records.withColumn("fault", F.when(bad, "checksum").when(gap, "gap")).where("fault is not null").select("owner", "version", "fault")


def definition_bindings(registrations: DataFrame) -> DataFrame:
    """(definition_id, definition_version, seq, fingerprint) -> registered, repeated or conflict (with both fingerprints)."""
    first = registrations.groupBy("definition_id", "definition_version").agg(F.min(F.struct("seq", "fingerprint")).alias("first"))  # combined map-side: a definition may have very many registrations
    rows = registrations.join(first, ["definition_id", "definition_version"])
    result = F.when(F.col("seq") == F.col("first.seq"), "registered").when(F.col("fingerprint") == F.col("first.fingerprint"), "repeated").otherwise("conflict")
    return rows.select("definition_id", "definition_version", "seq", result.alias("result"), F.col("first.fingerprint").alias("existing"), F.col("fingerprint").alias("attempted"))


def unregistered(instances: DataFrame, registrations: DataFrame) -> DataFrame:
    """Instances whose bound definition and version nobody registered: they are to be parked."""
    return instances.join(registrations.select("definition_id", "definition_version").distinct(), ["definition_id", "definition_version"], "left_anti").withColumn("park_reason", F.lit("VersionBinding"))
