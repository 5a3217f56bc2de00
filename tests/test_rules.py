"""Rules, keys and tables against values written out by hand, and streams against their batch twins."""

from __future__ import annotations

import base64
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wflog.functions import canonical_location
from wflog.jobs import queue_jobs
from wflog.operators import dag, fanout, inbox, log, pools, projections, queues, ranks, retention, telemetry
from wflog.sources import spread, store
from wflog.sources.schemas import SCHEMAS
from wflog.streaming import streams

T0 = datetime(2024, 1, 1)


def at(n: float) -> datetime:
    return T0 + timedelta(seconds=n)


def b64(s: str) -> str:
    return base64.b64encode(s.encode()).decode()


EVENT = "event_id string, acceptance_sequence long, state string, route_kind string, instance_id long, definition_id long, event_contract_version int, event_name string, correlation_id string"
WAIT = "wait_id string, instance_id long, definition_id long, event_contract_version int, event_name string, correlation_id string"


def routed(df):
    c = [F.col(x) for x in ("route_kind", "instance_id", "definition_id", "event_contract_version", "event_name", "correlation_id")]
    return df.withColumn("route_key", inbox.event_route(*c))


def test_route_keys_hold_all_parts(spark):
    rows = [(str(i), i, "Received", k, 7, 9, 2, "paid", "order-é") for i, k in enumerate(("direct", "correlation", "definition-fanout"))]
    got = [r.route_key for r in routed(spark.createDataFrame(rows, EVENT)).orderBy("event_id").collect()]
    tail = f"2|{b64('paid')}|{b64('order-é')}"
    assert got == [f"direct|7|{tail}", f"correlation|9|{tail}", f"definition-fanout-target|7|9|{tail}"]


@pytest.mark.parametrize("kind", ["direct", "correlation", "definition-fanout"])
def test_another_correlation_resumes_nothing(spark, kind):
    wait = spark.createDataFrame([("w", 1, 5, 1, "paid", "order-A")], WAIT)
    event = lambda i, seq, **x: (i, seq, "Received", kind, x.get("instance", 1), x.get("definition", 5), x.get("version", 1), x.get("name", "paid"), x.get("correlation", "order-A"))
    others = [event("b", 1, correlation="order-B"), event("n", 2, name="sent"), event("v", 3, version=2)]
    others += [event("i", 4, instance=2)] if kind != "correlation" else []
    others += [event("d", 5, definition=6)] if kind != "direct" else []
    assert inbox.match_pending_events(wait, routed(spark.createDataFrame(others, EVENT))).count() == 0
    hit = inbox.match_pending_events(wait, routed(spark.createDataFrame([*others, event("late", 9), event("hit", 8)], EVENT))).collect()
    assert [tuple(r) for r in hit] == [("w", 8, "hit")]


START = "key string, definition_id long, definition_version int, fingerprint string"


@pytest.mark.parametrize(
    "started, intent, requests, want",
    [
        ([], [], [(1, 1, 1, "A"), (2, 1, 1, "A"), (3, 1, 1, "B")], ["IntentCreated", "IntentJoined", "StartConflict"]),
        ([(1, 1, "A")], [], [(1, 1, 1, "B"), (2, 1, 1, "A"), (3, 2, 1, "A"), (4, 1, 2, "A")], ["StartConflict", "DeliverDirect", "StartConflict", "StartConflict"]),
        ([(1, 1, "A")], [(1, 1, "A", "Pending")], [(1, 1, 1, "A")], ["DeliverDirect"]),
        ([(1, 1, "A")], [(1, 1, "A", "Poisoned")], [(1, 1, 1, "A")], ["StartConflict"]),
        ([], [(1, 1, "A", "Pending")], [(1, 1, 1, "A"), (2, 1, 1, "C")], ["IntentJoined", "StartConflict"]),
        ([], [(1, 1, "A", "Poisoned")], [(1, 1, 1, "A")], ["StartConflict"]),
    ],
)
def test_start_or_deliver(spark, started, intent, requests, want):
    s = spark.createDataFrame([("k", 77, *x) for x in started], "key string, instance_id long, definition_id long, definition_version int, fingerprint string")
    i = spark.createDataFrame([("k", *x) for x in intent], START + ", state string")
    q = spark.createDataFrame([("k", *x) for x in requests], "key string, seq long, definition_id long, definition_version int, fingerprint string")
    rows = inbox.start_or_deliver(q, s, i).orderBy("seq").collect()
    assert [r.result for r in rows] == want and all((r.started_id == 77) == (r.result == "DeliverDirect") for r in rows)


def test_started_key_takes_its_events(spark):
    intents = spark.createDataFrame([("k", "Pending", None), ("p", "Poisoned", None)], "key string, state string, instance_id long")
    started = spark.createDataFrame([("k", 3), ("p", 4)], "key string, instance_id long")
    event = "key string, event_id string, state string, instance_id long, route_kind string, event_contract_version int, event_name string, correlation_id string, route_key string"
    rows = [("k", "mine", "Received", None, "start-or-deliver", 1, "e", "c", "old"), ("k", "applied", "Applied", None, "start-or-deliver", 1, "e", "c", "old"), ("k", "other", "Received", None, "correlation", 1, "e", "c", "old"), ("k", "has", "Received", 9, "start-or-deliver", 1, "e", "c", "old")]
    i, e = inbox.materialize_starts(intents, spark.createDataFrame(rows, event), started)
    assert {r.key: (r.state, r.instance_id) for r in i.collect()} == {"k": ("Materialized", 3), "p": ("Poisoned", None)}
    assert {r.event_id: (r.instance_id, r.route_key) for r in e.collect()} == {"mine": (3, f"direct|3|1|{b64('e')}|{b64('c')}"), "applied": (None, "old"), "other": (None, "old"), "has": (9, "old")}


def test_poison_codes_stay(spark):
    row = {"event_id": "a", "instance_id": "1", "acceptance_sequence": 1, "state": "Poisoned", "route_kind": "direct", "poison_code": "FIRST", "handoff_failure_count": 0}
    names = [x.split()[0] for x in SCHEMAS["inbox"].split(", ")]
    box = spark.createDataFrame([tuple(row.get(c) for c in names), tuple({**row, "event_id": "b", "acceptance_sequence": 2, "state": "Received", "poison_code": None}.get(c) for c in names)], SCHEMAS["inbox"])
    code = lambda df: {r.event_id: (r.state, r.poison_code) for r in df.collect()}
    assert code(inbox.poison_targets(box, box.select("instance_id"), "GONE")) == {"a": ("Poisoned", "FIRST"), "b": ("Poisoned", "GONE")}
    fails = spark.createDataFrame([(2, 0, "E")], "acceptance_sequence long, expected_count int, code string")
    out = inbox.record_handoff_failure(box, fails, F.lit(at(0)), 1)
    assert code(out) == {"a": ("Poisoned", "FIRST"), "b": ("Poisoned", "E")} and out.columns.count("poison_code") == 1
    names = [x.split()[0] for x in SCHEMAS["outbox"].split(", ")]
    o = {"outbox_record_id": "1", "state": "Poisoned", "poison_code": "FIRST"}
    out = queues.apply_dispatch_results(spark.createDataFrame([tuple(o.get(c) for c in names)], SCHEMAS["outbox"]), spark.createDataFrame([("1", "Success", None)], "outbox_record_id string, result string, code string"))
    assert out.columns.count("poison_code") == 1 and out.first().poison_code == "FIRST"


def test_lifecycle_table(spark):
    allowed = "Pending-Start-Running Running-EnterWait-Waiting Waiting-MatchWait-Running Running-Complete-Completed Running-Fail-Failed Running-Cancel-Cancelled Waiting-Cancel-Cancelled Running-Terminate-Terminated Waiting-Terminate-Terminated Running-Park-Waiting Waiting-Unpark-Running CancellationRequested-Cancel-Cancelled CancellationRequested-Terminate-Terminated Running-Timeout-TimedOut Waiting-Timeout-TimedOut"
    refused = "Waiting-Fail-Failed Running-RequestCancel-CancellationRequested Pending-Cancel-Cancelled Running-Suspend-Waiting Waiting-Complete-Completed Completed-Start-Running"
    rows, want = [], {}
    for i, (move, ok) in enumerate([*[(m, True) for m in allowed.split()], *[(m, False) for m in refused.split()]]):
        a, trigger, b = move.split("-")
        rows += [(i, 0, "", a), (i, 1, trigger, b)]
        want[i] = ok
    assert {r.instance_id: r.allowed for r in log.lifecycle_transitions(spark.createDataFrame(rows, "instance_id long, seq long, trigger string, status string")).collect()} == want


def test_lifecycle_names(spark):
    want = {
        ("Started", None): "InstanceStarted", ("ContinuedAsNew", None): "InstanceContinuedAsNew", ("StepCompleted", None): "StepCompleted", ("StepFailed", None): "StepFailed", ("WaitRegistered", None): "InstanceSuspended", ("TimerScheduled", None): "InstanceSuspended",
        ("WaitMatched", None): "InstanceResumed", ("TimerFired", None): "InstanceResumed", ("Parked", None): "InstanceParked", ("Unparked", None): "InstanceUnparked", ("Completed", None): "InstanceCompleted", ("CancellationRequested", None): "InstanceCancellationRequested",
        ("Terminal", "Failed"): "InstanceFailed", ("Terminal", "Cancelled"): "InstanceCancelled", ("Terminal", "Terminated"): "InstanceTerminated", ("Terminal", "TimedOut"): None, ("WaitCancelled", None): None, ("ResumeConsumed", None): None, ("ResourcePoolAcquired", None): None,
    }
    d = spark.createDataFrame(list(want), "event_type string, status string")
    assert {(r.event_type, r.status): r.x for r in d.withColumn("x", telemetry.lifecycle_name(F.col("event_type"), F.col("status"))).collect()} == want


def test_canonical_locations(spark):
    want = {
        None: "workflow:$", "": "workflow:$", "root": "workflow:$", "main/2": "workflow:$/n:00000002", "root/2/body/0": "workflow:$/n:00000002/while:body/n:00000000", "root/then/else": "workflow:$/if:true/if:false", "root/lease/item": "workflow:$/lease:body/foreach:body",
        "root/branches/3/1": "workflow:$/parallel:00000003/n:00000001", "root/branches/x/1": "workflow:$/n:00000001", "root/branches": "workflow:$", "root//step/007/": "workflow:$/n:00000007", "root/branches/branches/4": "workflow:$/parallel:00000004", "root/123456789": "workflow:$/n:123456789",
    }
    d = spark.createDataFrame([(p,) for p in want], "path string")
    got = {r.path: r.x for r in d.withColumn("x", canonical_location(F.col("path"))).collect()}
    assert {k: v for k, v in got.items() if k != "root/123456789"} == {k: v for k, v in want.items() if k != "root/123456789"}


NODE = "run_id long, ordinal int, child_id string, state string, failure_code string, output string"


def test_children_join_their_nodes(spark):
    cases = [  # run's state, node (state, code, output), child (status, output) -> state, code, output, conflict
        ("Running", ("StartAuthorized", None, None), ("Completed", "o"), ("Succeeded", None, "o", False)),
        ("Running", ("StartAuthorized", None, None), ("Cancelled", None), ("Failed", "CHILD_CANCELLED", None, False)),
        ("CancellationRequested", ("CancellationRequested", None, None), ("Cancelled", None), ("Cancelled", None, None, False)),
        ("Cancelled", ("Cancelled", None, None), ("Cancelled", None), ("Cancelled", None, None, False)),
        ("Running", ("CancellationRequested", None, None), ("TimedOut", None), ("Failed", "CHILD_TIMED_OUT", None, False)),
        ("Running", ("Failed", "CHILD_TERMINATED", None), ("Terminated", None), ("Failed", "CHILD_TERMINATED", None, False)),
        ("Running", ("Failed", "CHILD_FAILED", None), ("Terminated", None), ("Failed", "CHILD_FAILED", None, True)),
        ("Running", ("Succeeded", None, "o"), ("Completed", "other"), ("Succeeded", None, "o", True)),
        ("Running", ("Succeeded", None, "o"), ("Completed", "o"), ("Succeeded", None, "o", False)),
        ("Running", ("DependencyBlocked", None, None), ("Failed", None), ("DependencyBlocked", None, None, True)),
    ]
    nodes = spark.createDataFrame([(i, 0, f"c{i}", *n) for i, (_, n, _, _) in enumerate(cases)], NODE)
    runs = spark.createDataFrame([(i, r) for i, (r, _, _, _) in enumerate(cases)], "run_id long, state string")
    children = spark.createDataFrame([(f"c{i}", *c) for i, (_, _, c, _) in enumerate(cases)], "child_id string, status string, output string")
    got = {r.run_id: (r.state, r.failure_code, r.output, r.conflict) for r in dag.join_children(nodes, runs, children).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_reconciled_runs_show_their_nodes(spark):
    cases = {  # nodes (state, child's status; "-": no child named, None: child not there) -> run's state, actions
        1: ([("StartAuthorized", "Completed"), ("Pending", "-")], "Running", {0: "join"}),
        2: ([("StartAuthorized", None), ("StartAuthorized", "Running")], "Running", {0: "start"}),
        3: ([("Cancelled", "-"), ("StartAuthorized", None), ("CancellationRequested", "Running"), ("StartAuthorized", "Failed")], "CancellationRequested", {1: "cancel", 2: "cancel", 3: "join"}),
        4: ([("Succeeded", "Running"), ("StartAuthorized", "Completed")], "IntegrityFault", {}),
        5: ([("Failed", None)], "IntegrityFault", {}),
        6: ([("Pending", "Running"), ("StartAuthorized", None)], "IntegrityFault", {}),
        7: ([("DependencyBlocked", "Completed")], "IntegrityFault", {}),
        8: ([("Succeeded", "Completed"), ("Ready", "-")], "Running", {}),
    }
    nodes = spark.createDataFrame([(r, o, None if c == "-" else f"c{r}-{o}", s) for r, (ns, _, _) in cases.items() for o, (s, c) in enumerate(ns)], "run_id long, ordinal int, child_id string, state string")
    children = spark.createDataFrame([(f"c{r}-{o}", c) for r, (ns, _, _) in cases.items() for o, (_, c) in enumerate(ns) if c not in ("-", None)], "child_id string, status string")
    runs = spark.createDataFrame([*[(r, "IntegrityFault") for r in cases], (9, "Running")], "run_id long, state string")
    work, after = dag.reconcile_runs(runs, nodes, children)
    assert {r.run_id: r.state for r in after.collect()} == {r: c[1] for r, c in cases.items()}
    assert {(r.run_id, r.ordinal): r.action for r in work.collect()} == {(r, o): a for r, c in cases.items() for o, a in c[2].items()}


# folds


def event(stream, version, kind, **x):
    base = dict(step_path=f"s{version}", wait_id="w", timer_id="t", holder_key="h", error=f"e{version}", status="Failed", definition_id=4, definition_version=2, parent_instance_id=None, root_instance_id=None, outcome="Done", reason="Poison", generation=50 + version, attempt_count=3, position_stream_version=8, next_eligible_at=at(900))
    base |= x
    return (stream, version, kind, at(version), *base.values())


LOG = "stream_id long, version long, event_type string, occurred_at timestamp_ntz, step_path string, wait_id string, timer_id string, holder_key string, error string, status string, definition_id long, definition_version int, parent_instance_id long, root_instance_id long, outcome string, reason string, generation int, attempt_count int, position_stream_version long, next_eligible_at timestamp_ntz"
KINDS = ("StepCompleted", "StepFailed", "WaitRegistered", "WaitMatched", "WaitCancelled", "TimerScheduled", "TimerFired", "TimerCancelled", "ResumeConsumed", "ResourcePoolAcquired", "ResourcePoolQueued", "ResourcePoolReleased", "Completed", "CancellationRequested", "Terminal", "Parked", "Unparked", "ContinuationAttemptFailed", "ContinuationAttemptReset", "ContinuedAsNew", "ExecutionPositionChanged")


def random_log(rnd, n):
    pick = lambda *x: rnd.choice(x)
    first = [] if rnd.random() < 0.1 else ["Started"]
    kinds = [*first, *[rnd.choice(KINDS) for _ in range(n)]]
    return [dict(kind=k, wait_id=pick("w1", "w2"), timer_id=pick("t1", "t2"), holder_key=pick("h1", "h2"), status=pick("Failed", "Cancelled", "Terminated", "TimedOut", "Running", "Waiting"), error=pick("e", None), root_instance_id=pick(None, 5), outcome=pick(None, "o"), position_stream_version=pick(None, 3)) for k in kinds]


def one_by_one(stream, rows):
    """The fold of one stream, event by event."""
    from collections import namedtuple

    E = namedtuple("E", [x.split()[0] for x in LOG.split(", ")])
    s = log.new_state()
    for r in sorted(rows, key=lambda r: r[1]):
        log.apply_event(s, E(*r))
    return (stream, *[sorted(s[c]) if c in log.SETS else s[c] for c in log._STATE])


@pytest.mark.parametrize("seed", range(4))
def test_fold_by_aggregates_equals_the_fold_by_events(spark, seed):
    rnd = random.Random(seed)
    logs = {i: [event(i, v, x.pop("kind"), **x) for v, x in enumerate(random_log(rnd, rnd.randint(1, 40)), 1)] for i in range(120)}
    rows = [r for x in logs.values() for r in x]
    rnd.shuffle(rows)
    e = spark.createDataFrame(rows, LOG)
    want = {i: one_by_one(i, x) for i, x in logs.items()}
    assert {r.stream_id: tuple(r) for r in log.fold_instances(e).collect()} == want
    # cut anywhere, the rest folds onto the checkpoint
    cut = spark.createDataFrame([(i, rnd.randint(0, len(x))) for i, x in logs.items()], "stream_id long, cut long")
    part = log.fold_instances(e.join(cut, "stream_id").where("version <= cut").drop("cut"))
    assert {r.stream_id: tuple(r) for r in log.fold_from_checkpoint(part, e).collect()} == want
    for name, field, col in (("open_waits", "open_waits", "wait_id"), ("open_timers", "open_timers", "timer_id"), ("held_tickets", "tickets", "holder_key"), ("pending_resumes", "pending_resumes", "wait_id")):
        got = {}
        for r in getattr(log, name)(e).collect():
            got.setdefault(r.stream_id, []).append(r[col])
        at_ = [x.split()[0] for x in log.FOLD.split(", ")].index(field)
        assert {k: sorted(v) for k, v in got.items()} == {k: v[at_] for k, v in want.items() if v[at_]}, name


def test_fold_takes_the_events_own_numbers(spark):
    rows = [event(1, 1, "Started", parent_instance_id=9), event(1, 2, "ContinuationAttemptFailed"), event(1, 3, "Parked")]
    r = log.fold_instances(spark.createDataFrame(rows, LOG)).first()
    assert (r.definition_id, r.definition_version, r.parent_instance_id, r.root_instance_id) == (4, 2, 9, 1)
    assert (r.failure_count, r.failure_position, r.retry_not_before, r.park_reason, r.error_summary, r.status) == (3, 8, at(900), "Poison", "e3", "Waiting")
    r = log.fold_instances(spark.createDataFrame([*rows, event(1, 4, "ContinuedAsNew"), event(1, 5, "Completed")], LOG)).first()
    assert (r.generation, r.failure_count, r.retry_not_before, r.outcome, r.status, r.park_reason) == (54, 0, None, "Done", "Completed", "Poison")


def test_one_long_stream_is_no_single_task(spark):
    """Everything of the fold is summed before it is shuffled: a stream of a million events comes to few rows."""
    n = 1_000_000
    k = F.col("id")
    e = spark.range(1, n + 1, 1, 8).select(F.lit(1).cast("long").alias("stream_id"), k.alias("version"), F.when(k == 1, "Started").when(k % 2 == 0, "WaitRegistered").otherwise("WaitMatched").alias("event_type"), F.timestamp_seconds(k).cast("timestamp_ntz").alias("occurred_at"),
        F.concat(F.lit("w"), ((k / 2).cast("long") % 7).cast("string")).alias("wait_id"), F.lit("s").alias("step_path"), F.lit("t").alias("timer_id"), F.lit("h").alias("holder_key"), F.lit(None).cast("string").alias("error"))
    r = log.fold_instances(e).first()
    assert (r.stream_version, r.status, r.open_waits) == (n, "Waiting", [f"w{n // 2 % 7}"])


def test_resume_takes_what_its_wait_had(spark):
    full = "stream_id long, version long, event_type string, occurred_at timestamp_ntz, wait_id string, holder_key string, event_name string, event_contract_version int, correlation_id string, fiber_id string, scope_id string, status string"
    row = lambda v, kind, wait, *x: (1, v, kind, at(v), wait, "holder", *x, None)
    rows = [
        row(1, "WaitRegistered", "a", "paid", 3, "c", "f", "s"), row(2, "WaitMatched", "a", None, None, "other", None, None),
        row(3, "ResourcePoolQueued", "q", None, None, None, "g", None), row(4, "WaitMatched", "q", None, None, None, None, None),
        row(5, "WaitRegistered", "x", "sent", None, "c", "f", None), row(6, "WaitMatched", "x", "sent", 1, "c", None, None), row(7, "WaitMatched", "x", None, None, None, None, "z"),
        row(8, "WaitRegistered", "gone", "n", 1, "c", None, None), row(9, "WaitMatched", "gone", None, None, None, None, None), row(10, "ResumeConsumed", "gone", None, None, None, None, None),
    ]
    got = {r.wait_id: tuple(r)[2:] for r in log.pending_resumes(spark.createDataFrame(rows, full)).collect()}
    assert got == {"a": (2, "paid", 3, "other", "f", "s"), "q": (4, "ResourcePoolGranted", 1, "holder", "g", None), "x": (7, None, None, None, None, "z")}


# streams


def as_stream(spark, tmp_path, rows, schema, files, rnd, name="in"):
    """Rows dealt out over files in order of time, each file in any order, a file a batch."""
    path = tmp_path / name
    path.mkdir()
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        rnd.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def watermark(spark, rows, schema, seconds):
    return spark.createDataFrame(rows, schema).agg(F.max(F.unix_millis("at"))).first()[0] - seconds * 1000


@pytest.mark.parametrize("files", [1, 4, 16])
def test_timers_equal_their_batch_twin(spark, tmp_path, files):
    rnd = random.Random(files)
    schema = "timer_id string, version long, event_type string, fire_at timestamp, at timestamp"
    rows, version = [], {}
    for i in range(300):
        t = f"t{rnd.randint(0, 9)}"
        version[t] = version.get(t, 0) + 1
        rows.append((t, version[t], rnd.choice(("TimerScheduled", "TimerScheduled", "TimerFired", "TimerCancelled")), at(60 * i + rnd.randint(0, 4000)), at(60 * i)))
    live = as_stream(spark, tmp_path, rows, schema, files, rnd)
    got = streams.run_available(streams.stream_timers(live)).collect()
    every = spark.createDataFrame(rows, schema)
    want = streams.timers_due(every, watermark(spark, rows, schema, 600)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 10


def test_cancelled_timer_of_a_late_scheduling_stays_silent(spark, tmp_path):
    schema = "timer_id string, version long, event_type string, fire_at timestamp, at timestamp"
    rows = [("t", 2, "TimerCancelled", None, at(5)), ("t", 1, "TimerScheduled", at(100), at(1)), ("u", 1, "TimerScheduled", at(100), at(2)), ("z", 1, "TimerFired", None, at(9000))]
    live = as_stream(spark, tmp_path, rows, schema, 4, random.Random(1))
    assert [r.timer_id for r in streams.run_available(streams.stream_timers(live)).collect()] == ["u"]


@pytest.mark.parametrize("files", [1, 4, 16])
def test_stuck_equals_its_batch_twin(spark, tmp_path, files):
    rnd = random.Random(files)
    schema = "instance_id long, version long, at timestamp, status string"
    rows = [(rnd.randint(1, 8), i, at(30 * i), rnd.choice(("Running", "Running", "Waiting", "CancellationRequested", "Completed"))) for i in range(400)]
    live = as_stream(spark, tmp_path, rows, schema, files, rnd)
    got = streams.run_available(streams.stream_stuck(live, 300_000, "3 hours")).collect()
    want = streams.stuck_changes(spark.createDataFrame(rows, schema), watermark(spark, rows, schema, 3 * 3600)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r.change for r in want} == {"stuck", "cleared"}


def test_stuck_does_not_depend_on_batches(spark, tmp_path):
    schema = "instance_id long, version long, at timestamp, status string"
    rows = [(1, 1, at(6000), "Running"), (1, 3, at(6480), "Running"), (1, 2, at(6240), "Running"), (2, 1, at(6000), "Waiting"), (3, 1, at(6000), "Completed"), (4, 1, at(9000), "Completed")]
    live = as_stream(spark, tmp_path, rows, schema, 6, random.Random(0))
    got = streams.run_available(streams.stream_stuck(live, 300_000, "10 minutes")).collect()
    assert [(r.instance_id, r.change) for r in got] == [(1, "stuck")]


@pytest.mark.parametrize("files", [1, 4, 16])
def test_joined_waits_equal_the_join_of_tables(spark, tmp_path, files):
    rnd = random.Random(files)
    key = lambda: f"k{rnd.randint(0, 60)}"
    waits = [(key(), i, at(60 * i)) for i in range(200)]
    events = [(key(), i, at(60 * i + 7)) for i in range(200)]
    w, e = "key string, wait_id long, at timestamp", "key string, event_id long, at timestamp"
    live = streams.stream_join_waits(as_stream(spark, tmp_path, waits[:], w, files, rnd, "w"), as_stream(spark, tmp_path, events[:], e, files, rnd, "e"), "1 hour")
    got = sorted((r.wait_id, r.event_id or -1) for r in streams.run_available(live).collect())
    both = streams.join_waits(spark.createDataFrame(waits, w), spark.createDataFrame(events, e), "1 hour").collect()
    upto = min(watermark(spark, waits, w, 600), watermark(spark, events, e, 600))
    ms = {i: (t - datetime(1970, 1, 1)).total_seconds() * 1000 for _, i, t in waits}
    want = sorted((r.wait_id, r.event_id if r.event_id is not None else -1) for r in both if r.event_id is not None or ms[r.wait_id] + 3_600_000 < upto)
    assert [(a, b if b != -1 else -1) for a, b in got] == [(a, b if b else -1) for a, b in want] and any(b == -1 for _, b in got)


@pytest.mark.parametrize("files", [1, 4])
def test_live_fold_equals_the_batch_fold(spark, tmp_path, files):
    rnd = random.Random(files)
    logs = {i: [event(i, v, x.pop("kind"), **x) for v, x in enumerate(random_log(rnd, 25), 1)] for i in range(12)}
    rows = sorted((r for x in logs.values() for r in x), key=lambda r: r[1])
    rows += rows[:40]  # some come twice
    live = as_stream(spark, tmp_path, rows, LOG, files, rnd)
    got = streams.run_available(streams.stream_fold(live, "10 days"), "update", ["stream_id"]).drop("fault").collect()
    assert {r.stream_id: tuple(r) for r in got} == {i: one_by_one(i, x) for i, x in logs.items()}


def test_gap_is_reported_and_held(spark, tmp_path):
    rows = [event(1, 1, "Started"), *[event(1, v, "StepCompleted") for v in range(3, 400)]]
    other = [(2, 1, "Started", at(9_000_000), *event(2, 1, "Started")[4:])]
    live = as_stream(spark, tmp_path, rows + other, LOG, 2, random.Random(0))
    out = streams.run_available(streams.stream_fold(live, "1 minute", 60_000), "append").collect()
    assert {(r.stream_id, r.stream_version, r.fault) for r in out} == {(1, 1, None), (1, 1, "version 2 is missing"), (2, 1, None)}


# records that share an id or a version


@pytest.mark.parametrize("turned", [False, True])
def test_records_of_one_version_are_checked_by_payload(spark, turned):
    rows = [(1, 1, "p"), (1, 2, "a"), (1, 2, "b"), (1, 3, "c")]
    df = spark.createDataFrame(rows[::-1] if turned else rows, "owner long, version long, payload string").coalesce(1)
    df = df.withColumn("checksum", F.when(F.col("payload") == "b", "x").otherwise(F.sha2("payload", 256)))
    assert [tuple(r) for r in log.verify_checksums(df).collect()] == [(1, 2, "checksum")]


def test_released_records_may_share_an_id(spark):
    o = spark.createDataFrame([("o1", 1, "Claimed", at(0)), ("o1", 2, "Claimed", at(0))], "outbox_record_id string, rid long, state string, claimed_until timestamp")
    got = queues.release_outbox(o, o.where("rid = 2"), ("outbox_record_id", "rid"))
    assert sorted((r.rid, r.state, r.claimed_until) for r in got.collect()) == [(1, "Claimed", at(0)), (2, "Retryable", None)]


# keys worked through in groups


@pytest.mark.parametrize("files", [1, 4])
def test_few_calls_dedupe_many_ids(spark, tmp_path, files, monkeypatch):
    monkeypatch.setattr(streams, "GROUPS", 3)
    rnd = random.Random(files)
    schema = "event_id string, acceptance_sequence long, envelope_fingerprint string, at timestamp"
    rows = [(rnd.choice((None, *(f"e{k}" for k in range(40)))), i, rnd.choice(("x", "x", "y", None)), at(i)) for i in range(200)]
    first = {}
    want = []
    for e, i, p, _ in rows:
        want.append((e, i, "Accepted" if e not in first else "Duplicate" if p is not None and p == first[e] else "Conflict"))
        first.setdefault(e, p)
    spark.createDataFrame(rows, schema).repartitionByRange(files, "acceptance_sequence").sortWithinPartitions(F.desc("acceptance_sequence")).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    got = [tuple(r) for r in streams.run_available(streams.stream_dedupe(live)).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_timer_groups_hold_what_is_open():
    import pandas as pd

    rows = pd.DataFrame([("a", 1, 0, 50, False), ("a", 2, 10, None, False), ("b", 1, 0, 50, False), ("b", 1, 0, 50, False), ("c", 1, 0, 500, False)], columns=["timer_id", "version", "ms", "due", "done"])
    rows = rows.astype({"version": "int64", "ms": "int64", "due": "Int64"})
    out, held = streams.due_timers(rows, 100)
    assert out.values.tolist() == [["b", 50]] and held["timer_id"].tolist() == ["c"]
    again, _ = streams.due_timers(held, 500)
    assert again.values.tolist() == [["c", 500]]


def test_custom_partition_calls_per_scope(spark):
    rows = [(None if k == 7 else k, i, None if k == 3 and i == 0 else 10 * k + i) for k in range(12) for i in range(k % 4 + 1)]
    seen = spark.createDataFrame(rows, "scope long, item int, q long").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "3", "10000"):  # scopes cut by batches, and many in one
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out = fanout.partition_custom(seen, "scope", lambda pdf: pdf["item"].rank(ascending=False).sort_values().astype("int64") * 100 + len(pdf))
        got = [tuple(r) for r in out.collect()]
        count = {k: sum(r[0] == k for r in rows) for k, _, _ in rows}
        assert sorted(map(str, got)) == sorted(str((k, i, q, (count[k] - i) * 100 + count[k])) for k, i, q in rows)
        whole = fanout.partition_custom(seen, "scope", lambda pdf: pdf.groupby("scope", dropna=False)["item"].transform("size"), many=True)
        assert sorted(map(str, map(tuple, whole.collect()))) == sorted(str((k, i, q, count[k])) for k, i, q in rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_files_of_a_live_table_grow_with_it(spark, tmp_path):
    from wflog.jobs import stream_jobs

    spark.range(4000).selectExpr("id as event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts", "id % 50 as user_id", "'view' as event_type", "1.0d as value", "'{}' as props").write.parquet(f"{tmp_path}/events.parquet")
    conf = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        live = stream_jobs.live(spark, str(tmp_path), "inbox")
        assert len(streams.run_available(live.select("event_id", F.input_file_name().alias("f"))).select("f").distinct().collect()) == 9
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# ranks, selections, large graphs


def test_ranks_and_selections(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("aab"), rnd.randint(-50, 50), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, o long, id long")
    for r in ranks.ranked(df, ["g"], ["o", "id"]).collect():
        mine = sorted((o, i) for g, o, i in rows if g == r.g)
        assert mine[r["rank"]] == (r.o, r.id) and r.members == len(mine)
    for n in (0, 1, 2, 350, 699, 700, 701):
        kept = ranks.top(df, "o", n, "id")
        got = {r.id for r in (df if kept is None else df.where(kept)).collect()}
        assert got == {i for _, _, i in sorted(rows, key=lambda x: (-x[1], x[2]))[:n]}, n
    wide = spark.createDataFrame([(2**62,), (-(2**62),), (5,)], "o long")
    assert ranks.nth_largest(wide, "o", 2, buckets=7) == (5, 1)


def test_retention_keeps_the_newest(spark):
    s = spark.range(5000).select(F.col("id").alias("instance_id"), F.lit(at(50)).cast("timestamp_ntz").alias("settled_at"), (F.col("id") * 7919 % 5003).alias("ordinal"))
    out = retention.retention_plan(s, F.lit(at(60)).cast("timestamp_ntz"), F.expr("interval '20' second"), 3000)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 2000 and out.agg(F.max("ordinal")).first()[0] < s.join(out, "instance_id", "left_anti").agg(F.min("ordinal")).first()[0]


def test_hot_key_is_delivered_alike(spark):
    rnd = random.Random(6)
    e = spark.createDataFrame([("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 9)}", i, str(i)) for i in range(500)] + [(None, 999, "n")], "key string, acceptance_sequence long, event_id string")
    w = spark.createDataFrame([("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 9)}", at(i), f"w{i}") for i in range(400)] + [(None, at(9), "n")], "key string, registered_at timestamp_ntz, wait_id string")
    got = [sorted((r.event_id, r.wait_id, r.k) for r in inbox.deliver_exactly_once(e, w, ["key"], most).select("event_id", "wait_id", "k").collect()) for most in (5_000_000, 10)]
    assert [x[:2] for x in got[0]] == [x[:2] for x in got[1]] and len(got[0]) > 300


def test_large_graphs_by_joins(spark):
    rnd = random.Random(4)
    nodes, edges = [], []
    for run in range(12):
        n = rnd.randint(1, 40)
        nodes += [(run, o, f"n{o}", rnd.choice(("Pending", "Pending", "Ready", "Failed", "Succeeded"))) for o in range(n)]
        edges += [(run, rnd.randrange(n), rnd.randrange(n)) if rnd.random() < 0.04 else (run, o, rnd.randrange(o)) for o in range(1, n) for _ in range(rnd.randint(0, 2))]
        edges += [(run, 0, 99), (run, 98, 0)]
    n = spark.createDataFrame(nodes, "run_id long, ordinal int, node_id string, state string")
    e = spark.createDataFrame(edges, "run_id long, ordinal int, dep_ordinal int")
    for f in (dag.topological_waves, dag.blocked_closure):
        want = sorted(map(tuple, f(n, e).collect()))
        assert sorted(map(tuple, f(n, e, 0).collect())) == want and sorted(map(tuple, f(n, e, 50).collect())) == want


def test_lowest_ready_node_of_a_long_run(spark):
    """A run of 20,000 nodes: the sweep finds just the admissions that pass over a ready node, in blocks and not by pairs."""
    n = 20_000
    ready = spark.range(n).select(F.lit(1).cast("long").alias("run_id"), F.lit(1).alias("pos"), F.col("id").cast("int").alias("ordinal"), F.lit("Ready").alias("new"), F.lit("Created").alias("kind"), (F.col("id") + 2).cast("int").alias("until"))
    admitted = spark.range(n).select(F.lit(1).cast("long").alias("run_id"), (F.col("id") + 2).cast("int").alias("pos"), F.when(F.col("id") == 7000, 7001).when(F.col("id") == 7001, 7000).otherwise(F.col("id")).cast("int").alias("ordinal"), F.lit("StartAuthorized").alias("new"), F.lit("InputAdmitted").alias("kind"), F.lit(None).cast("int").alias("until"))
    ready = ready.withColumn("until", F.when(F.col("ordinal") == 7000, 7003).when(F.col("ordinal") == 7001, 7002).otherwise(F.col("until")))
    assert [r.pos for r in dag._passed_over(ready.unionByName(admitted)).collect()] == [7002]


def test_graphs_are_cut_in_parts_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 100)
    n = spark.range(2000).select((F.col("id") / 4).cast("long").alias("run_id"), (F.col("id") % 4).cast("int").alias("ordinal"), F.lit("Failed").alias("state"))
    e = n.where("ordinal > 0").select("run_id", "ordinal", (F.col("ordinal") - 1).alias("dep_ordinal"))
    for f in (dag.topological_waves, dag.blocked_closure):
        out = f(n, e)
        assert parts(out) > 20 and out.count() == 2000


def test_faulty_graphs_are_cut_in_parts_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 100)
    n = spark.range(2000).select(F.col("id").alias("run_id"), F.lit(0).alias("ordinal"), F.lit("a").alias("node_id"))
    out = dag.validate_dag(n.unionByName(n), n.select("run_id", "ordinal", F.lit(7).alias("dep_ordinal")))
    found = {r.code: (r.n, r.parts) for r in out.withColumn("part", F.spark_partition_id()).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts")).collect()}
    assert {c: x for c, (x, _) in found.items()} == {"NODE-001": 2000, "DEPENDENCY-004": 2000} and found["NODE-001"][1] > 20


def test_nodes_without_a_child_are_no_single_task(spark):
    n = spark.range(4000).select(F.col("id").alias("run_id"), F.lit(0).alias("ordinal"), F.lit("a").alias("node_id"), F.lit("Ready").alias("state"), F.when(F.col("id") < 8, F.concat(F.lit("c"), F.col("id").cast("string"))).alias("child_id"))
    c = spark.createDataFrame([("c1", "Failed", None, None, "x"), (None, "Running", None, None, None)], "child_id string, status string, created_at timestamp, updated_at timestamp, error_summary string")
    out = dag.reconstruct_run(n, c.hint("shuffle_merge"))
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000
    assert [(r.run_id, r.error_summary) for r in out.where("child_status is not null").collect()] == [(1, "x")] and out.count() == 4000


@pytest.mark.parametrize("seed", range(3))
def test_blocks_cover_their_range(spark, seed):
    rnd = random.Random(seed)
    pairs = [(a, a + rnd.randint(-3, 200)) for a in (rnd.randint(0, 300) for _ in range(200))]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("x", dag._blocks("a", "b"))
    for r in df.collect():
        assert sorted(p for x in r.x for p in range(x.number << x.level, (x.number + 1) << x.level)) == list(range(r.a, r.b + 1)) and len(r.x) <= 18


# details of records


def test_record_details(spark):
    change = lambda o, s, child=None, code=None, ready=None, start=None, end=None: (o, s, child, code, ready, start, end)
    from wflog.functions import child_id

    child = spark.range(1).select(child_id(F.lit(1), F.lit(0)).alias("c")).first().c
    t = at
    cases = {  # records (kind, time, change) -> rules by record
        1: ([("Created", t(0), change(0, "Ready", ready=t(0))), ("InputAdmitted", t(1), change(0, "StartAuthorized", "RECIPE", ready=t(0), start=t(1))), ("ChildJoined", t(2), change(0, "Succeeded", "RECIPE", ready=t(0), start=t(1), end=t(2)))], {}),
        2: ([("Created", t(5), change(0, "Ready", ready=t(5))), ("InputAdmitted", t(1), change(0, "StartAuthorized", "RECIPE", ready=t(5), start=t(1)))], {2: "time falls"}),
        3: ([("Created", t(0), change(0, "Ready", ready=t(0))), ("InputAdmitted", t(1), change(0, "StartAuthorized", "other", ready=t(0), start=t(1)))], {2: "details of the change"}),
        4: ([("Created", t(0), change(0, "Ready", ready=t(0))), ("InputAdmitted", t(1), change(0, "StartAuthorized", "RECIPE", ready=t(1), start=t(1)))], {2: "written twice"}),
        5: ([("Created", t(0), change(0, "Ready", ready=t(0))), ("InputAdmitted", t(1), change(0, "StartAuthorized", "RECIPE", ready=t(0), start=t(0)))], {2: "details of the change"}),
        6: ([("Created", t(0), change(0, "Ready")), ("MappingFailed", t(1), change(0, "Failed", end=t(1)))], {}),
        7: ([("Created", t(0), change(0, "Ready")), ("MappingFailed", t(1), change(0, "Failed", end=t(0)))], {2: "details of the change"}),
        8: ([("Created", t(0), change(0, "StartAuthorized")), ("ChildJoined", t(1), change(0, "Failed", code="CHILD_TIMED_OUT", end=t(1)))], {}),
        9: ([("Created", t(0), change(0, "StartAuthorized")), ("ChildJoined", t(1), change(0, "Failed", code="ELSE", end=t(1)))], {2: "details of the change"}),
        10: ([("Created", t(0), change(0, "StartAuthorized")), ("ChildJoined", t(1), change(0, "Succeeded", code="CHILD_FAILED", end=t(1)))], {2: "details of the change"}),
        11: ([("Created", t(0), change(0, "Ready")), ("CancellationRequested", t(1), change(0, "Cancelled", end=t(1)))], {}),
        12: ([("Created", t(0), change(0, "StartAuthorized")), ("CancellationRequested", t(1), change(0, "CancellationRequested", end=t(1)))], {2: "details of the change"}),
        13: ([("Created", t(0), change(0, "Pending")), ("ChildJoined", t(1), change(0, "Ready", ready=t(0)))], {2: "details of the change"}),
    }
    ids = {r: spark.range(1).select(child_id(F.lit(r), F.lit(0)).alias("c")).first().c for r in cases}
    assert child == ids[1]
    rows = [(r, v, kind, when, [tuple(ids[r] if x == "RECIPE" else x for x in c)]) for r, (recs, _) in cases.items() for v, (kind, when, c) in enumerate(recs, 1)]
    schema = "run_id int, stream_version long, kind string, updated_at timestamp_ntz, changes array<struct<ordinal: int, state: string, child_id: string, failure_code: string, ready_at: timestamp_ntz, started_at: timestamp_ntz, completed_at: timestamp_ntz>>"
    got = {(r.run_id, r.stream_version): r.rule for r in dag.record_detail_faults(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(r, v): rule for r, (_, want) in cases.items() for v, rule in want.items()}


# sketches, trees, tables


def test_sketches_stay_within_their_rank(spark):
    d = spark.range(200_000).select(F.lit("x").alias("s"), F.pmod(F.xxhash64("id"), F.lit(10_000_000)).alias("v"))
    values = sorted(r.v for r in d.collect())
    got = telemetry.approx_quantiles(d, "s", "v", 1000).first()
    for q, c in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        low = sum(v < got[c] for v in values)
        assert abs(low - q * len(values)) <= len(values) / 1000 + 1
    a = d.select(F.lit("step").alias("step_path"), F.lit("success").alias("result"), F.lit(0).alias("attempt"), F.col("v").alias("duration_ms"))
    assert abs(fanout.attempt_summary(a, 1000).first().p95_ms - fanout.attempt_summary(a).first().p95_ms) < 50_000


def test_failures_at_any_depth(spark):
    tree = '{"code": "0"}'
    for i in range(1, 15):
        tree = f'{{"code": "{i}", "item_index": {i}, "location": "workflow:$/n:{i:08d}", "causes": [{tree}]}}'
    rows = fanout.flatten_failures(spark.createDataFrame([(1, tree), (2, None), (3, '{"code": "x", "message": "\\"causes\\""}')], "k long, tree string"), "k", "tree").collect()
    assert sorted((r.depth, r.code, r.occurrence, r.occurrence_id) for r in rows if r.k == 1) == [(14 - i, str(i), "item" if i else "root", str(i) if i else None) for i in range(14, -1, -1)]
    assert [r.code for r in rows if r.k == 3] == ["x"] and all(r.rest is None for r in rows)
    cut = fanout.flatten_failures(spark.createDataFrame([(1, tree)], "k long, tree string"), "k", "tree", 2).where("depth = 2").first()
    assert '"11' in cut.rest.replace(chr(92), '')


def test_summaries_reset_waits_to_their_own(spark):
    own = [("a", "own a"), ("b", "own b")]
    rows = [(1, 1, "UpsertActiveWait", "old", "x", None), (1, 2, "UpsertSummary", None, "s2", own), (1, 3, "RemoveActiveWait", "a", None, None), (1, 4, "UpsertActiveWait", "c", "late", None), (2, 1, "UpsertSummary", None, "t1", own), (2, 2, "UpsertSummary", None, "t2", None)]
    ops = spark.createDataFrame(rows, "instance_id long, seq long, op string, wait_id string, value string, waits array<struct<wait_id: string, value: string>>")
    s, w, _ = projections.apply_projection_ops(ops)
    assert sorted(map(tuple, s.collect())) == [(1, "s2"), (2, "t2")] and sorted(map(tuple, w.collect())) == [(1, "b", "own b"), (1, "c", "late")]


def test_bucketed_log_is_folded_without_a_shuffle(spark, tmp_path):
    rows = [event(i, v, "Started" if v == 1 else "WaitRegistered") for i in range(20) for v in range(1, 4)]
    t = store.write_bucketed_log(spark.createDataFrame(rows, LOG), "bucketed_for_test", str(tmp_path / "log"), 4)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (log.fold_instances(t), log.stream_heads(t), log.held_tickets(t)):
            assert "Exchange hash" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert {r.status for r in log.fold_instances(t).collect()} == {"Waiting"} and log.fold_instances(t).count() == 20
    spark.sql("drop table bucketed_for_test")


def test_inputs_of_nodes_without_results(spark):
    nodes = spark.createDataFrame([(1, 0, "a", "Succeeded", "x", True), (1, 1, "b", "Succeeded", None, False), (1, 2, "c", "Ready", None, True), (2, 0, "a", "Succeeded", None, True), (2, 1, "c", "Ready", None, True), (3, 0, "c", "Ready", None, True)], "run_id long, ordinal int, node_id string, state string, output string, resultful boolean")
    edges = spark.createDataFrame([(1, 2, 0), (1, 2, 1), (2, 1, 0)], "run_id long, ordinal int, dep_ordinal int")
    runs = spark.createDataFrame([(1, "in"), (2, None)], "run_id long, input string")
    got = {r.run_id: (r.input, r.inputs, r.fault) for r in dag.node_inputs(nodes, edges, runs).collect()}
    assert got == {1: ("in", {"a": "x"}, None), 2: (None, {}, "DAG_INPUT_MAPPING_INVALID"), 3: (None, {}, None)}


def test_received_and_retries_take_targets_but_no_roots(spark):
    c = "event_id string, instance_id long, acceptance_sequence long, state string, route_kind string, handoff_failure_count int, handoff_retry_not_before timestamp_ntz"
    rows = [("a", 1, 1, "Received", "direct", 1, at(5)), ("b", None, 2, "Received", None, 1, at(3)), ("c", None, 3, "Received", "definition-fanout", 0, None), ("d", 1, 4, "Applied", "direct", 1, at(1))]
    members = [("c", 8, 3, "Received", "definition-fanout-target", 2, at(4)), ("c", 7, 3, "Received", "definition-fanout-target", 1, at(4)), ("c", 9, 3, "Received", "definition-fanout-target", 1, at(99))]
    i, t = spark.createDataFrame(rows, c), spark.createDataFrame(members, c)
    assert [(r.event_id, r.instance_id) for r in inbox.list_received(i, t, 0, 10).collect()] == [("a", 1), ("b", None), ("c", 7), ("c", 8), ("c", 9)]
    assert [(r.event_id, r.instance_id) for r in inbox.list_handoff_retries(i, t, F.lit(at(10)), 10).collect()] == [("b", None), ("c", 7), ("c", 8), ("a", 1)]
    changes = spark.createDataFrame([("c", 8, "Received", "Applied"), ("c", 9, "Poisoned", "Applied")], "event_id string, instance_id long, expected string, new_state string")
    got = {r.instance_id: (r.state, r.applied) for r in inbox.transition_inbox(t, changes, ("event_id", "instance_id")).collect()}
    assert got == {7: ("Received", False), 8: ("Applied", True), 9: ("Received", False)}


def test_blockers_by_name(spark):
    ids = spark.createDataFrame([(i,) for i in range(1, 9)], "instance_id long")
    status = {1: "Waiting", 2: "Completed", 3: "Failed", 4: "Completed", 5: "Completed", 6: "Completed", 8: "Completed"}
    p = spark.createDataFrame(list(status.items()), "instance_id long, status string")
    received = lambda *i: spark.createDataFrame([(x, "Received") for x in i], "instance_id long, state string")
    out = spark.createDataFrame([(1, "Claimed"), (4, "Poisoned"), (4, "Claimed"), (5, "Poisoned"), (5, "Retryable"), (6, "Poisoned")], "instance_id long, state string")
    heads = spark.createDataFrame([(3,)], "stream_id long")
    got = {r.instance_id: (r.exists, r.blocker) for r in retention.maintenance_blockers(ids, p, heads, received(1, 2), out, received(3)).collect()}
    assert got == {
        1: (True, "ActiveInstance"), 2: (True, "PendingInboxDelivery"), 3: (True, "PendingInboxDelivery"), 4: (True, "ClaimedOutboxDispatch"), 5: (True, "PendingOutboxDispatch"),
        6: (True, "PoisonedOutboxDispatch"), 7: (False, "None"), 8: (True, "None"),
    }


def parts(df) -> int:
    return df.select(F.spark_partition_id()).distinct().count()


def test_blockers_meet_in_parts_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 100)
    ids = spark.range(2000).select(F.col("id").alias("instance_id"))
    state = ids.withColumn("state", F.lit("Pending"))
    p = ids.withColumn("status", F.lit("Completed"))
    out = retention.maintenance_blockers(ids, p, ids.withColumnRenamed("instance_id", "stream_id").where("stream_id < 5"), state.where("instance_id < 0"), state.where("instance_id % 2 = 0"))
    assert parts(out) > 30 and out.where("blocker = 'PendingOutboxDispatch'").count() == 1000 and out.count() == 2000


def test_purged_tables_are_cut_in_parts_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 100)
    ids = spark.range(2000).select(F.col("id").alias("instance_id"))
    blockers = ids.select("instance_id", F.lit(True).alias("exists"), F.when(F.col("instance_id") % 4 == 0, "None").otherwise("ActiveInstance").alias("blocker"))
    report, left = retention.purge_instances(blockers, {"timers": (ids.withColumnRenamed("instance_id", "of"), "of")})
    assert parts(left["timers"]) > 20 and left["timers"].count() == 1500 and report.where("result = 'Purged'").count() == 500


def test_payloads_are_parsed_once(spark, capsys):
    raw = spark.createDataFrame([(1, "StepCompleted", '{"step_path": "a"}'), (2, "StepCompleted", "{}")], "event_id long, event_type string, payload string")
    for part, n in zip(store.decode_events(raw), (1, 2), strict=True):
        part.select("event_id", "event_type").explain()
        assert capsys.readouterr().out.lower().count("from_json(") == 1
        assert [r.event_id for r in part.collect()] == [n]


def test_timers_follow_their_operations_in_order(spark):
    t = spark.createDataFrame([(x, i, at(0), True, at(50)) for i, x in enumerate("abcde")], "timer_id string, instance_id long, fire_at timestamp_ntz, claimed boolean, claimed_until timestamp_ntz")
    ops = [
        ("a", 1, "upsert", at(7), 70), ("a", 2, "release", None, None),  # the new time stays
        ("b", 1, "complete", None, None), ("b", 2, "release", None, None),  # gone for good
        ("c", 1, "complete", None, None), ("c", 2, "upsert", at(9), 90),  # back
        ("d", 1, "release", None, None), ("x", 1, "release", None, None), ("y", 1, "upsert", at(8), 80), ("y", 2, "complete", None, None), ("z", 1, "upsert", at(6), 60),
    ]
    got = queues.maintain_timers(t, spark.createDataFrame(ops, "timer_id string, seq long, op string, fire_at timestamp_ntz, instance_id long"))
    assert sorted(tuple(r) for r in got.select("timer_id", "instance_id", "fire_at", "claimed", "claimed_until").collect()) == [
        ("a", 70, at(7), False, None), ("c", 90, at(9), False, None), ("d", 3, at(0), False, None), ("e", 4, at(0), True, at(50)), ("z", 60, at(6), False, None),
    ]


def test_signals_that_can_not_advance(spark):
    rows = [
        ("1", '{"instance_id": 5, "occurred_at": "2024-01-01T00:00:02"}'), ("2", '{"instance_id": 5, "occurred_at": "2024-01-01T00:00:01", "not_before": null}'),
        ("3", '{"instance_id": 5, "occurred_at": "2024-01-01T00:00:00", "not_before": "2024-01-01T00:01:00"}'), ("4", '{"instance_id": 6}'), ("5", '{"occurred_at": "2024-01-01T00:00:00"}'),
        ("6", "{"), ("7", None), ("8", '{"instance_id": 7, "occurred_at": "2024-01-01T00:00:00", "not_before": "soon"}'),
    ]
    due, others = queues.coalesce_continuations(spark.createDataFrame(rows, "outbox_record_id string, payload string"), F.lit(at(10)))
    assert [tuple(r) for r in due.collect()] == [(5, 2, 9_000_000, ["1", "2"])]
    assert {r.outbox_record_id: r.state for r in others.collect()} == {"3": "Retryable", "4": "Poisoned", "5": "Poisoned", "6": "Poisoned", "7": "Poisoned", "8": "Poisoned"}


def test_resizes_are_applied_again_without_effect(spark):
    ops = [("r1", 1, "p", 5), ("r2", 2, "p", 7), ("r1", 3, "p", 5), ("r1", 4, "p", 9), ("r2", 5, "q", 7)]
    out, now = pools.apply_resizes(spark.createDataFrame(ops, "operation_id string, seq long, pool string, capacity long"))
    got = [(r.seq, r.result, r.replay, r.recorded_pool, r.recorded_capacity) for r in out.orderBy("seq").collect()]
    assert got == [(1, "Applied", False, "p", 5), (2, "Applied", False, "p", 7), (3, "Applied", True, "p", 5), (4, "Conflict", True, "p", 5), (5, "Conflict", True, "p", 7)]
    assert [tuple(r) for r in now.collect()] == [("p", 7)]


def test_a_token_released_without_confirmation_is_not_found(spark):
    c = spark.createDataFrame([("c1", 1, "held"), ("c2", 2, "gone"), ("c3", 3, "old"), ("c4", 4, "both"), ("c1", 5, "gone")], "confirmation_id string, seq long, token string")
    holders = spark.createDataFrame([("held",), ("both",)], "token string")
    released = spark.createDataFrame([("gone", None), ("old", "c0"), ("both", None)], "token string, confirmation_id string")
    got = [r.result for r in pools.classify_stop_confirmations(c, holders, released).orderBy("seq").collect()]
    assert got == ["Released", "TokenNotFound", "AlreadyConfirmed", "TokenNotFound", "ConfirmationConflict"]


def test_lease_status_and_gauges(spark):
    phases = ["Queued", "PendingCommit", "Held", "ReviewMarked", "AmbiguousHeld", "Quarantined", "Released", "CancelledBeforeGrant", "LeaseLost", "Granted"]
    ticket = '{{"ticket_id": "t{0}", "pool": "p", "units": {0}, "generation": 1, "review_marked": false}}'
    one = '{{"kind": "Resource", "token": "k{0}", "phase": "{1}", "holder_key": "h{0}", "lease_tickets": [{2}]}}'
    rows = [(1, at(3), '{"obligations": [' + ", ".join(one.format(i, p, ticket.format(i)) for i, p in enumerate(phases)) + ', {"kind": "Other", "token": "x", "phase": "Held"}, {"kind": "Resource", "phase": "Held"}]}')]
    envelopes = spark.createDataFrame(rows, "instance_id long, updated_at timestamp_ntz, envelope string")
    tickets = spark.createDataFrame([(1, "h2", "t2", "p", 2, True), (1, "h3", "t3", "p", 3, False), (2, "h5", "t5", "q", 5, True)], "instance_id long, holder_key string, ticket_id string, pool string, units long, review_marked boolean")
    leases = pools.outstanding_leases(envelopes, tickets)
    got = {r.token: (r.status, [t.review_marked for t in r.tickets], r.quarantined_at) for r in leases.collect()}
    assert got == {
        "k0": ("Queued", [False], None), "k1": ("PendingCommit", [False], None), "k2": ("Held", [True], None), "k3": ("ReviewMarked", [False], None), "k4": ("AmbiguousHeld", [False], None),
        "k5": ("Quarantined", [False], at(3)), "k8": ("LeaseLost", [False], None), "k9": ("Queued", [False], None),
    }
    gauges = pools.lease_gauges(leases)
    assert sorted(tuple(r) for r in gauges.collect()) == [("p", "ambiguous_held", 1, 4, None), ("p", "held", 1, 2, None), ("p", "pending_commit", 1, 1, None), ("p", "quarantined", 1, 5, at(3)), ("p", "review_marked", 1, 3, None)]
    states = sorted(tuple(r) for r in pools.pool_states(tickets, gauges.where("state <> 'held'")).collect())
    assert states == [("p", "ambiguous_held", 1, 4), ("p", "held", 1, 3), ("p", "pending_commit", 1, 1), ("p", "quarantined", 1, 5), ("p", "review_marked", 1, 3), ("q", "review_marked", 1, 5)]


# the log as a live table


def test_live_log_is_dealt_out_and_sorted_before_it_is_wide(spark):
    from wflog.jobs import stream_jobs
    from wflog.sources import adapters

    d, columns = "/root/testdata/sf0.001", ["timer_id", "version", "occurred_at"]
    t, want = adapters.log_by_stream(spark, d), adapters.adapt(spark, d, "event_log")
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1 and plan.index("Window ") < plan.index("Sort ")
    assert t.count() == want.count() and t.exceptAll(want).isEmpty()
    assert stream_jobs.live(spark, d, "event_log", *columns).columns == columns


class Calls:
    """State of one group as the live fold uses it; counts the calls."""

    def __init__(self):
        self.n, self.value, self.timers, self.kept = 0, None, set(), {}

    def __getattr__(self, name):
        def call(*x):
            self.n += 1
            if name == "get":
                return self.value
            if name in ("update", "clear"):
                self.value = x[0] if x else None
            elif name in ("registerTimer", "deleteTimer"):
                (self.timers.add if name == "registerTimer" else self.timers.discard)(x[0])
            elif name == "updateValue":
                self.kept[x[0]] = x[1]
            elif name == "removeKey":
                self.kept.pop(x[0])
            else:
                return x[0] in self.kept if name == "containsKey" else self.kept[x[0]]

        return call

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def getCurrentWatermarkInMs(self):
        return 0


def test_live_fold_calls_the_state_by_group_not_by_stream():
    import pandas as pd

    state, fold = Calls(), streams._LiveFold(60_000, 60_000)
    fold.init(state)
    event = lambda v: f'{{"event_type": "{"Started" if v == 1 else "StepCompleted"}", "occurred_at": "2024-01-01T00:00:0{v}", "step_path": "s{v}"}}'
    for versions in ([2, 1], [3]):
        rows = pd.DataFrame([(str(x), v, 1000 * v, event(v)) for v in versions for x in range(300)], columns=["stream", "version", "ms", "event"])
        got = pd.concat(fold.handleInputRows((0,), iter([rows]), state))
        assert sorted(got["stream_id"]) == list(range(300)) and set(got["stream_version"]) == {max(versions)} and set(got["last_step_path"]) == {f"s{max(versions)}"}
    assert state.n < 10


def test_streams_of_one_group_keep_their_own_gaps_and_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "GROUPS", 1)
    first = [event(1, 1, "Started"), event(1, 3, "StepCompleted"), event(2, 1, "Started"), event(2, 3, "StepCompleted"), event(3, 1, "Started"), event(3, 2, "Completed"), event(None, 1, "Started")]
    late = [(r[0], r[1], r[2], at(n), *r[4:]) for n, r in ((20, event(2, 2, "StepCompleted")), (9_000_000, event(4, 1, "Started")))]
    path = tmp_path / "two"
    path.mkdir()
    for part in (first, late):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(path))
    live = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(path))
    out = streams.run_available(streams.stream_fold(live, "1 minute", 60_000, 60_000), "append").collect()
    got = sorted((str(r.stream_id), r.stream_version, r.status, str(r.fault)) for r in out)
    assert got == sorted([("1", 1, "Running", "None"), ("1", 1, "Running", "version 2 is missing"), ("2", 1, "Running", "None"), ("2", 3, "Running", "None"), ("3", 2, "Completed", "None"), ("4", 1, "Running", "None"), ("None", 1, "Running", "None")])


def test_fleet_gauges_work_the_lines_out_once(spark):
    """Tickets, waiters and the outbox are stored, so that only runs and envelopes read the lines, each for two parts of the plan that share it."""
    from wflog.jobs import projection_jobs

    plan = projection_jobs.fleet_gauges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("lineitem.parquet") <= 4  # 16 where each part works them out anew


def test_generations_by_cut_and_by_the_number_that_events_carry(spark):
    rows = [(1, 1, "Started", at(0), 7), (1, 2, "StepCompleted", at(1), 3), (1, 3, "ContinuedAsNew", at(2), 7), (1, 4, "StepCompleted", at(3), None), (2, 1, "ContinuedAsNew", at(5), 3)]
    e = spark.createDataFrame(rows, "stream_id long, version long, event_type string, occurred_at timestamp_ntz, generation int")
    of = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert of(log.generations(e)) == [(1, 0, 1, 2, at(0), at(1), 2), (1, 1, 3, 4, at(2), at(3), 2), (2, 1, 1, 1, at(5), at(5), 1)]
    carried = log.generations(e, F.col("generation"))
    assert of(carried) == [(1, 3, 2, 2, at(1), at(1), 1), (1, 7, 1, 3, at(0), at(2), 2), (1, None, 4, 4, at(3), at(3), 1), (2, 3, 1, 1, at(5), at(5), 1)]
    assert carried.schema["generation"].dataType.simpleString() == "bigint"


def test_purge_asks_for_every_instance_and_clears_every_table(spark, tmp_path):
    def table(name: str, rows: list[tuple], schema: str) -> None:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    # 2 completed; 4 completed with an outbox record; 8 waiting; 14 failed
    table("orders", [(2, 1, "F", 1.0, at(0), "1-URGENT"), (4, 1, "F", 1.0, at(0), "1-URGENT"), (8, 1, "P", 1.0, at(0), "1-URGENT"), (14, 1, "P", 1.0, at(0), "1-URGENT")],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    table("lineitem", [(4, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", at(0))],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    # streams 2 (a checkpoint), 3 (no projection) and 8 (a checkpoint)
    events = [(i, at(i), 2 if i < 12 else 8, "view", 1.0, "{}") for i in range(23)] + [(23, at(23), 3, "view", 1.0, "{}")]
    table("events", events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    got = {r.tbl: r.n for r in queue_jobs.purge_instances(spark, str(tmp_path)).collect()}
    assert got == {
        "purged": 3, "rejected": 2, "not_found": 3, "projections": 2, "active_waits": 1, "timers": 1, "outbox": 1, "history": 11, "event_log": 11, "heads": 1, "checkpoints": 1,
    }
