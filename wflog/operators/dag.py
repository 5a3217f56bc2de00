"""DAG runs: nodes (run_id, ordinal, node_id, state, ..) and edges (run_id, ordinal, dep_ordinal), for all runs at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import child_id
from ..sources.spread import parts_for, spread
from .graphs import LARGEST, over_graphs, peel_by_joins, reach_by_joins, split_by_size

LIVE = ("Pending", "Ready", "StartAuthorized", "CancellationRequested")


def _but(df: DataFrame, large: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    return df if large is None else df.join(large[0].select("run_id").distinct(), "run_id", "left_anti")


def topological_waves(nodes: DataFrame, edges: DataFrame, most: int = LARGEST) -> DataFrame:
    """Wave of each node by peeling nodes whose dependencies are peeled; -1 for nodes on or behind a cycle. Runs of more than ``most`` rows are peeled by joins."""

    def waves(g, columns):
        wave = np.full(len(g.key), -1, np.int32)
        for level, now, _ in g.peel():
            wave[now] = level
        return pa.RecordBatch.from_arrays([columns["run_id"], columns["ordinal"], pa.array(wave[g.of_row])], ["run_id", "ordinal", "wave"])

    total, large = split_by_size(nodes, edges, most)
    out = over_graphs(_but(nodes, large), _but(edges, large), "", waves, "run_id long, ordinal int, wave int", total)
    return out if large is None else out.unionByName(large[0].select("run_id", "ordinal").join(peel_by_joins(*large), ["run_id", "ordinal"]))


def validate_dag(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Diagnostics (run_id, code, ordinal) per graph; mapping kinds are read from ``mapping_count`` where nodes carry it."""
    parts = parts_for(nodes, nodes.count() + edges.count())
    edges_by_run = spread(edges.select("run_id", "ordinal", "dep_ordinal"), parts, "run_id")
    twice = spread(nodes.select("run_id", "node_id", "ordinal"), parts, "run_id").groupBy("run_id", "node_id").agg(F.count("*").alias("n"), F.max("ordinal").alias("ordinal")).where("n > 1").select("run_id", F.lit("NODE-001").alias("code"), "ordinal")
    again = edges_by_run.groupBy("run_id", "ordinal", "dep_ordinal").count().where("count > 1").select("run_id", F.lit("DEPENDENCY-001").alias("code"), "ordinal").distinct()
    own = edges_by_run.where("ordinal = dep_ordinal").select("run_id", F.lit("DEPENDENCY-002").alias("code"), "ordinal").distinct()
    asked = spread(edges.select("run_id", "ordinal", "dep_ordinal"), parts, "run_id", "dep_ordinal")
    known = spread(nodes.select("run_id", F.col("ordinal").alias("dep_ordinal")), parts, "run_id", "dep_ordinal")
    unknown = asked.join(known, ["run_id", "dep_ordinal"], "left_anti").select("run_id", F.lit("DEPENDENCY-004").alias("code"), "ordinal").distinct()
    cycle = topological_waves(nodes, edges.where("ordinal <> dep_ordinal")).where("wave < 0").groupBy("run_id").agg(F.lit("DEPENDENCY-003").alias("code"), F.min("ordinal").alias("ordinal"))
    out = twice.unionByName(again).unionByName(own).unionByName(unknown).unionByName(cycle)
    if "mapping_count" in nodes.columns:
        maps = nodes.where("mapping_count <> 1").select("run_id", F.when(F.col("mapping_count") == 0, "MAP-001").otherwise("MAP-002").alias("code"), "ordinal")
        out = out.unionByName(maps)
    return out


def ready_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending nodes whose direct dependencies all succeeded."""
    states = nodes.select("run_id", F.col("ordinal").alias("dep_ordinal"), (F.col("state") == "Succeeded").alias("done"))
    deps = edges.join(states, ["run_id", "dep_ordinal"], "left").groupBy("run_id", "ordinal").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("all_done"))
    return nodes.where("state = 'Pending'").join(deps, ["run_id", "ordinal"], "left").where(F.coalesce("all_done", F.lit(True))).drop("all_done")


def blocked_closure(nodes: DataFrame, edges: DataFrame, most: int = LARGEST) -> DataFrame:
    """Pending and ready nodes behind a failed node, at any distance, become DependencyBlocked; others stay. Runs of more than ``most`` rows are searched by joins."""

    def close(g, columns):
        state = np.array(columns["state"].to_pylist(), object)
        behind = g.reached(np.unique(g.of_row[state == "Failed"]))[g.of_row]
        state[behind & ((state == "Pending") | (state == "Ready"))] = "DependencyBlocked"
        return pa.RecordBatch.from_arrays([columns["run_id"], columns["ordinal"], pa.array(state, pa.string())], ["run_id", "ordinal", "state"])

    total, large = split_by_size(nodes, edges, most)
    out = over_graphs(_but(nodes, large), _but(edges, large), "state string", close, "run_id long, ordinal int, state string", total)
    if large is None:
        return out
    behind = reach_by_joins(*large, large[0].where("state = 'Failed'")).withColumn("behind", F.lit(True))
    state = F.when(F.col("behind") & F.col("state").isin("Pending", "Ready"), "DependencyBlocked").otherwise(F.col("state"))
    return out.unionByName(large[0].join(behind, ["run_id", "ordinal"], "left").select("run_id", "ordinal", state.alias("state")))


def cancel_barrier(runs: DataFrame, nodes: DataFrame, requested: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(result per requested run, changed nodes, child cancellations to send)."""
    r = requested.select("run_id").distinct().join(runs.select("run_id", "state"), "run_id", "left")
    result = (
        F.when(F.col("state").isNull(), "NotFound").when(F.col("state") == "Running", "Requested").when(F.col("state") == "CancellationRequested", "AlreadyRequested")
        .when(F.col("state") == "IntegrityFault", "Faulted").otherwise("AlreadyTerminal")
    )
    r = r.withColumn("result", result)
    go = r.where("result = 'Requested'").select("run_id")
    n = nodes.join(go, "run_id", "left_semi")
    new = F.when(F.col("state").isin("Pending", "Ready"), "Cancelled").when(F.col("state") == "StartAuthorized", "CancellationRequested").otherwise(F.col("state"))
    n = n.withColumn("was", F.col("state")).withColumn("state", new).withColumn("completed_at", F.when(F.col("state") == "Cancelled", at).otherwise(F.col("completed_at")))
    sends = n.where("was = 'StartAuthorized'").select("run_id", "ordinal", "child_id", F.lit("dag-child-cancel-v1").alias("kind"))
    waits = n.groupBy("run_id").agg(F.bool_or(F.col("state") == "CancellationRequested").alias("waits"))
    r = r.join(waits, "run_id", "left")
    state = F.when(F.col("result") == "Requested", F.when(F.coalesce("waits", F.lit(False)), "CancellationRequested").otherwise("Cancelled")).otherwise(F.col("state"))
    return r.select("run_id", "result", state.alias("state")), n.drop("was"), sends


def run_outcome(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cancelled, Succeeded or Failed once no live node is left, else Nonterminal."""
    per = nodes.groupBy("run_id").agg(F.bool_or(F.col("state").isin(*LIVE)).alias("live"), F.bool_and(F.col("state") == "Succeeded").alias("all_ok"))
    out = runs.select("run_id", "state").join(per, "run_id")
    outcome = F.when(F.col("live"), "Nonterminal").when(F.col("state") == "CancellationRequested", "Cancelled").when(F.col("all_ok"), "Succeeded").otherwise("Failed")
    return out.select("run_id", outcome.alias("outcome"))


RECORDS = ("Created", "InputAdmitted", "MappingFailed", "ChildJoined", "CancellationRequested", "Terminal", "IntegrityFaulted", "PoisonReconciled")
ENDED = ("Succeeded", "Failed", "Cancelled")


def _record_changes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with their place and the run's state before them, node changes with the node's state before them)."""
    order = Window.partitionBy("run_id").orderBy("stream_version", "kind")
    kind = F.col("kind")
    after = F.when(kind == "Created", "Running").when(kind.isin("CancellationRequested", "Terminal", "PoisonReconciled"), F.col("state")).when(kind == "IntegrityFaulted", "IntegrityFault")
    r = records.withColumn("pos", F.row_number().over(order)).withColumn("after", after)
    r = r.withColumn("before", F.last("after", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    c = r.select("run_id", "pos", "kind", "before", F.explode("changes").alias("c")).select("run_id", "pos", "kind", "before", "c.ordinal", F.col("c.state").alias("new"), "c.child_id")
    node = Window.partitionBy("run_id", "ordinal").orderBy("pos")
    c = c.withColumn("old", F.lag("new").over(node)).withColumn("until", F.lead("pos").over(node))
    return r, c.withColumn("old_child", F.last("child_id", ignorenulls=True).over(node.rowsBetween(Window.unboundedPreceding, -1)))


def _change_faults(c: DataFrame) -> DataFrame:
    """(run_id, pos, rule) of node changes that their kind of record doesn't allow."""
    kind, old, new, before = (F.col(x) for x in ("kind", "old", "new", "before"))
    open_ = old.isin("Pending", "Ready")
    joined = F.when(new.isin(*ENDED), old.isin("StartAuthorized", "CancellationRequested") & ~((new == "Cancelled") & (before != "CancellationRequested"))).otherwise(open_ & new.isin("Ready", "DependencyBlocked"))
    allowed = (
        F.when(kind == "Created", new.isin("Pending", "Ready"))
        .when(kind == "InputAdmitted", (before == "Running") & (old == "Ready") & (new == "StartAuthorized") & F.col("child_id").isNotNull())
        .when(kind == "MappingFailed", (before == "Running") & F.when(new == "Failed", old == "Ready").otherwise(open_ & (new == "DependencyBlocked")))
        .when(kind == "ChildJoined", joined)
        .when(kind == "CancellationRequested", (before == "Running") & F.when(open_, new == "Cancelled").otherwise((old == "StartAuthorized") & (new == "CancellationRequested")))
        .otherwise(F.lit(False))
    )
    rule = F.when((kind != "Created") & old.isNull(), "node ordinal").when(F.col("child_id") != F.col("old_child"), "child rewritten").when(~F.coalesce(allowed, F.lit(False)), "node transition")
    out = c.select("run_id", "pos", rule.alias("rule")).where("rule is not null")
    return out.unionByName(_passed_over(c))


def _blocks(first: str, last: str) -> Column:
    """first .. last as few aligned blocks (level, number): a block of level k covers the 2**k places from number * 2**k on; none where first > last."""
    levels = "sequence(0, 62)"
    start = f"named_struct('a', cast({first} as bigint), 'b', cast({last} as bigint), 'out', cast(array() as array<struct<level: int, number: bigint>>))"
    left = "if(s.a <= s.b and s.a % 2 = 1, array(named_struct('level', k, 'number', s.a)), array())"
    right = "if(s.a <= s.b and s.b % 2 = 0 and not (s.a = s.b and s.a % 2 = 1), array(named_struct('level', k, 'number', s.b)), array())"
    step = f"if(s.a > s.b, s, named_struct('a', cast((s.a + s.a % 2) div 2 as bigint), 'b', shiftright(cast(if(s.b % 2 = 0, s.b - 1, s.b) as bigint), 1), 'out', concat(s.out, cast({left} as array<struct<level: int, number: bigint>>), cast({right} as array<struct<level: int, number: bigint>>))))"
    return F.expr(f"aggregate({levels}, {start}, (s, k) -> {step}, s -> s.out)")


def _passed_over(c: DataFrame) -> DataFrame:
    """(run_id, pos, rule) of admissions while a node of a lower ordinal was ready.

    The records between a node's becoming ready and its next change are cut into aligned blocks, each of which keeps its lowest ordinal; an admission looks up the blocks that
    hold its place, one per level. That is some dozen rows a change, and no run is one task's.
    """
    span = c.groupBy("run_id").agg(F.max("pos").alias("end"))
    ready = c.where("new = 'Ready'").join(span, "run_id").select("run_id", "ordinal", F.explode(_blocks("pos + 1", "coalesce(until, end)")).alias("b"))
    lowest = ready.groupBy("run_id", "b.level", "b.number").agg(F.min("ordinal").alias("lowest"))
    levels = F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("end") + 1)).cast("int"))).alias("level")
    asked = c.where("kind = 'InputAdmitted'").join(span, "run_id").select("run_id", "pos", "ordinal", levels).withColumn("number", F.expr("shiftright(cast(pos as bigint), level)"))
    late = asked.join(lowest, ["run_id", "level", "number"]).where("lowest < ordinal").select("run_id", "pos").distinct()
    return late.withColumn("rule", F.lit("not the lowest ready node"))


CHILD_FAILURES = ("CHILD_FAILED", "CHILD_TIMED_OUT", "CHILD_TERMINATED", "CHILD_CANCELLED")


def record_detail_faults(records: DataFrame) -> DataFrame:
    """(run_id, stream_version, ordinal, rule): what records say of times, child ids and failure codes, held against their run and node.

    records: (run_id, stream_version, kind, updated_at, changes array<struct<ordinal, state, child_id, failure_code, ready_at, started_at, completed_at>>). A run's time never falls;
    a node's child and times are written once; an admission names the child by its recipe and starts at the record's time; an end is at the record's time, with a code just where a child failed.
    """
    order = Window.partitionBy("run_id").orderBy("stream_version")
    r = records.withColumn("last_at", F.lag("updated_at").over(order))
    fell = r.where("updated_at < last_at").select("run_id", "stream_version", F.lit(None).cast("int").alias("ordinal"), F.lit("time falls").alias("rule"))
    c = r.select("run_id", "stream_version", "kind", "updated_at", F.explode("changes").alias("c")).select("run_id", "stream_version", "kind", "updated_at", "c.*")
    before = Window.partitionBy("run_id", "ordinal").orderBy("stream_version").rowsBetween(Window.unboundedPreceding, -1)
    fixed = ("child_id", "ready_at", "started_at", "completed_at")
    for x in fixed:
        c = c.withColumn(f"old_{x}", F.last(x, ignorenulls=True).over(before))
    kind, state, now = F.col("kind"), F.col("state"), F.col("updated_at")
    here = lambda x: F.col(x).eqNullSafe(now)
    none = lambda x: F.col(x).isNull()
    rewritten = F.lit(False)
    for x in fixed:
        rewritten = rewritten | (F.col(f"old_{x}").isNotNull() & ~F.col(f"old_{x}").eqNullSafe(F.col(x)))
    ended = state.isin(*ENDED)
    good = (
        F.when(kind == "InputAdmitted", F.col("child_id").eqNullSafe(child_id(F.col("run_id"), F.col("ordinal"))) & here("started_at") & none("failure_code") & none("completed_at"))
        .when(kind == "MappingFailed", none("child_id") & none("started_at") & here("completed_at"))
        .when((kind == "ChildJoined") & ended, here("completed_at") & F.when(state == "Failed", F.coalesce(F.col("failure_code").isin(*CHILD_FAILURES), F.lit(False))).otherwise(none("failure_code")))
        .when((kind == "ChildJoined") & (state == "Ready"), here("ready_at"))
        .when(kind == "CancellationRequested", none("failure_code") & F.when(state == "Cancelled", here("completed_at")).otherwise(none("completed_at")))
        .otherwise(F.lit(True))
    )
    rule = F.when((kind != "Created") & rewritten, "written twice").when(~good, "details of the change")
    return fell.unionByName(c.select("run_id", "stream_version", "ordinal", rule.alias("rule")).where("rule is not null"))


def _record_faults(r: DataFrame, c: DataFrame) -> DataFrame:
    """(run_id, pos, rule) of records out of place, or with the wrong outcome for the nodes as they stand."""
    have = lambda *states: F.sum(F.col("new").isin(*states).cast("int") - F.coalesce(F.col("old").isin(*states), F.lit(False)).cast("int"))
    per = c.groupBy("run_id", "pos").agg(
        F.count("*").alias("n"), F.count_if(F.col("new").isin(*ENDED)).alias("ended"), F.count_if(F.col("new") == "Failed").alias("failed"), F.count_if(F.col("old").isNull()).alias("fresh"),
        have("Pending", "Ready", "StartAuthorized").alias("open"), have(*LIVE).alias("live"), have("Succeeded").alias("ok"), have("Cancelled", "CancellationRequested").alias("cancelled"),
    )
    before = Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = r.join(per, ["run_id", "pos"], "left").fillna(0, ["n", "ended", "failed", "fresh", "open", "live", "ok", "cancelled"])
    rows = rows.select("*", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"had_{x}") for x in ("fresh", "open", "live", "ok", "cancelled")])
    kind, state, was = F.col("kind"), F.col("state"), F.col("before")
    outcome = F.when(was == "CancellationRequested", "Cancelled").when(F.col("had_ok") == F.col("had_fresh"), "Succeeded").otherwise("Failed")
    back = F.when(F.col("had_cancelled") > 0, "CancellationRequested").otherwise("Running")
    rule = (
        F.when((F.col("stream_version") != F.col("pos")) | ((kind == "Created") != (F.col("pos") == 1)) | ~kind.isin(*RECORDS), "version or kind")
        .when(was.isin(*ENDED), "terminal barrier")
        .when((kind == "MappingFailed") & (F.col("failed") != 1), "one failed mapping")
        .when((kind == "ChildJoined") & ((F.col("ended") != 1) | ((was == "CancellationRequested") & (F.col("n") != 1))), "one child per join")
        .when((kind == "CancellationRequested") & ((state != "CancellationRequested") | (F.col("n") != F.col("had_open"))), "incomplete cancel barrier")
        .when((kind == "Terminal") & ((F.col("had_live") > 0) | (state != outcome)), "terminal outcome")
        .when((kind == "PoisonReconciled") & ((was != "IntegrityFault") | (state != back)), "reconciliation")
        .when(kind.isin("InputAdmitted", "MappingFailed", "ChildJoined") & (state != was), "implicit state change")
    )
    return rows.select("run_id", "pos", rule.alias("rule")).where("rule is not null")


def _closure_faults(r: DataFrame, c: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, pos, rule): nodes made ready or blocked at another record than that which makes them so, or not at all."""
    done = c.groupBy("run_id", "ordinal").agg(F.min(F.when(F.col("new") == "Succeeded", F.col("pos"))).alias("won"), F.min(F.when(F.col("new") == "Failed", F.col("pos"))).alias("lost"))
    deps = edges.join(done.select("run_id", F.col("ordinal").alias("dep_ordinal"), "won"), ["run_id", "dep_ordinal"], "left")
    ready = deps.groupBy("run_id", "ordinal").agg(F.when(F.count("*") == F.count("won"), F.max("won")).alias("due")).withColumn("to", F.lit("Ready"))

    def first_loss(g, columns):
        lost = np.full(len(g.key), np.iinfo(np.int64).max)
        np.minimum.at(lost, g.of_row, columns["lost"].to_numpy(zero_copy_only=False))
        behind = np.full(len(g.key), np.iinfo(np.int64).max)
        for _, _, out in g.peel():
            np.minimum.at(behind, g.to[out], np.minimum(lost, behind)[g.source[out]])
        due = behind[g.of_row]
        return pa.RecordBatch.from_arrays([columns["run_id"], columns["ordinal"], pa.array(due, mask=due == np.iinfo(np.int64).max)], ["run_id", "ordinal", "due"])

    never = F.lit(int(np.iinfo(np.int64).max))
    blocked = over_graphs(done.select("run_id", "ordinal", F.coalesce(F.col("lost").cast("long"), never).alias("lost")), edges, "lost long", first_loss, "run_id long, ordinal int, due long").withColumn("to", F.lit("DependencyBlocked"))
    due = ready.unionByName(blocked.withColumn("due", F.col("due").cast("int")))
    made = c.where("kind <> 'Created' and new in ('Ready', 'DependencyBlocked')").select("run_id", "ordinal", F.col("new").alias("to"), F.col("pos").alias("at"))
    early = made.join(due, ["run_id", "ordinal", "to"], "left").where("due is null or at <> due").select("run_id", F.col("at").alias("pos"))
    # a node that could still change when its time came, in a running run, and did not
    held = c.select("run_id", "ordinal", "new", "pos", "until")
    could = F.when(F.col("to") == "Ready", F.col("new") == "Pending").otherwise(F.col("new").isin("Pending", "Ready"))
    missed = due.where("due is not null").join(held, ["run_id", "ordinal"]).where(could & (F.col("pos") < F.col("due")) & (F.col("until").isNull() | (F.col("until") > F.col("due"))))
    missed = missed.select("run_id", F.col("due").alias("pos")).join(r.where("before = 'Running'").select("run_id", "pos"), ["run_id", "pos"])
    return early.unionByName(missed).select("run_id", "pos", F.lit("readiness or blocked closure").alias("rule"))


def fold_dag_runs(records: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Run records in order -> state, version and node states of each run before its first violation, and that violation.

    records: (run_id, stream_version, kind, state, changes array<struct<ordinal, state, child_id>>); Created lists all nodes. A record is
    judged against what all records before it say, by windows over the run and over each node, so the first violation found is the first
    there is. With ``edges`` (run_id, ordinal, dep_ordinal) it is also checked which nodes a join makes ready or blocked.
    """
    r, c = _record_changes(records)
    faults = _change_faults(c).unionByName(_record_faults(r, c))
    if edges is not None:
        faults = faults.unionByName(_closure_faults(r, c, edges))
    first = faults.groupBy("run_id").agg(F.min(F.struct("pos", "rule")).alias("f"))
    good = r.join(first, "run_id", "left").withColumn("valid", F.col("f").isNull() | (F.col("pos") < F.col("f.pos")))
    runs = good.groupBy("run_id").agg(F.max_by("after", F.when(F.col("valid") & F.col("after").isNotNull(), F.col("pos"))).alias("state"), F.count_if("valid").alias("version"), F.first("f.rule").alias("rule"))
    nodes = c.join(first, "run_id", "left").where("f is null or pos < f.pos").groupBy("run_id", "ordinal").agg(F.max_by("new", "pos").alias("node"))
    nodes = nodes.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "node"))), lambda x: F.concat_ws(":", x["ordinal"].cast("string"), x["node"])), ",").alias("nodes"))
    fault = F.when(F.col("rule").isNotNull(), "DAG_PROTOCOL_INVALID")
    return runs.join(nodes, "run_id", "left").select("run_id", "state", "version", fault.alias("fault"), "rule", F.coalesce("nodes", F.lit("")).alias("nodes"))


def discover_runs(runs: DataFrame, after: int, limit: int) -> DataFrame:
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    live = F.col("state").isin("Running", "CancellationRequested", "IntegrityFault")
    return runs.where(live & (F.col("creation_sequence") > after)).orderBy("creation_sequence", "run_id").limit(limit)


def admit_nodes(runs: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Ready nodes of running runs, lowest ordinals first, up to the free slots."""
    mine = nodes.join(runs.where("state = 'Running'").select("run_id"), "run_id", "left_semi")
    w = Window.partitionBy("run_id")
    active = F.sum(F.when(F.col("state").isin("StartAuthorized", "CancellationRequested"), 1).otherwise(0)).over(w)
    rank = F.sum(F.when(F.col("state") == "Ready", 1).otherwise(0)).over(w.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    return mine.withColumn("active", active).withColumn("rank", rank).where((F.col("state") == "Ready") & (F.col("rank") + F.col("active") <= most)).select("run_id", "ordinal", child_id(F.col("run_id"), F.col("ordinal")).alias("child_id"))


def operation_receipts(operations: DataFrame) -> DataFrame:
    """(operation_id, seq, fingerprint): committed, repeated or DAG_INTEGRITY_CONFLICT."""
    w = Window.partitionBy("operation_id").orderBy("seq")
    same = F.col("fingerprint") == F.first("fingerprint").over(w)
    return operations.withColumn("result", F.when(F.row_number().over(w) == 1, "committed").when(same, "repeated").otherwise("DAG_INTEGRITY_CONFLICT"))


def audit_run_leases(records: DataFrame, lease_s: float = 5.0, turn_s: float = 15.0) -> DataFrame:
    """Recorded leases (run_id, seq, at_s, op acquired/renewed/released, owner, fence) held against the rules of a turn.

    A lease ends ``lease_s`` after its last renewal and ``turn_s`` after it began at the latest. acquired: FenceInvalid unless the fence is one
    above the last, Overlap while another owner's lease runs; renewed and released: Stale unless the owner's lease runs; else Ok.
    """
    before = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    op, at = F.col("op"), F.col("at_s")
    last = lambda test, value: F.last(F.when(test, value), ignorenulls=True).over(before)
    acquired = op == "acquired"
    rows = records.select("run_id", "seq", "at_s", "op", "owner", "fence", last(acquired, F.col("owner")).alias("holder"), last(acquired, F.col("fence")).alias("high"), last(acquired, at).alias("began"),
        last(op.isin("acquired", "renewed"), at).alias("touched"), last(op.isin("acquired", "released"), op).alias("ended"))
    runs = (F.col("ended") == "acquired") & (at < F.least(F.col("touched") + lease_s, F.col("began") + turn_s))
    runs = F.coalesce(runs, F.lit(False))
    own = F.col("holder").eqNullSafe(F.col("owner"))
    result = F.when(acquired, F.when(F.col("fence") != F.coalesce("high", F.lit(0)) + 1, "FenceInvalid").when(runs & ~own, "Overlap").otherwise("Ok")).when(runs & own, "Ok").otherwise("Stale")
    return rows.select("run_id", "seq", "owner", result.alias("result"))


def node_inputs(nodes: DataFrame, edges: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """For each ready node the outputs of its direct dependencies as a map, and its run's ``input``; a missing output is an invalid mapping.

    A node that is declared to have no result (``resultful`` false, where nodes carry it) gives no entry, and none is missed.
    """
    gives = F.coalesce("resultful", F.lit(True)) if "resultful" in nodes.columns else F.lit(True)
    o = nodes.select("run_id", F.col("ordinal").alias("dep_ordinal"), F.col("node_id").alias("dep_id"), "output", gives.alias("gives"))
    ready = nodes.where("state = 'Ready'").select("run_id", "ordinal")
    deps = edges.join(ready, ["run_id", "ordinal"], "left_semi").join(o, ["run_id", "dep_ordinal"], "left")
    has = F.col("output").isNotNull() & F.col("gives")
    missing = F.coalesce(F.col("gives"), F.lit(True)) & F.col("output").isNull()
    per = deps.groupBy("run_id", "ordinal").agg(F.map_from_entries(F.sort_array(F.collect_list(F.when(has, F.struct("dep_id", "output"))))).alias("inputs"), F.bool_or(missing).alias("missing"))
    out = ready.join(per, ["run_id", "ordinal"], "left")
    out = out.join(runs.select("run_id", "input"), "run_id", "left") if runs is not None else out.withColumn("input", F.lit(None).cast("string"))
    return out.select("run_id", "ordinal", "input", F.coalesce("inputs", F.expr("cast(map() as map<string, string>)")).alias("inputs"), F.when(F.coalesce("missing", F.lit(False)), "DAG_INPUT_MAPPING_INVALID").alias("fault"))


def node_durations(nodes: DataFrame) -> DataFrame:
    """Per node: seconds from ready to start (queue) and from start to end (work); null where it hasn't come so far, never below 0."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    took = lambda a, b: F.greatest(F.lit(0), (us(b) - us(a)) / 1000000)
    spans = (("queue_s", "ready_at", "started_at"), ("work_s", "started_at", "completed_at"))
    return nodes.select("run_id", "ordinal", "state", *[F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), took(a, b)).alias(n) for n, a, b in spans])


def dag_fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Upper-case SHA-256 per run over its nodes and their dependencies in order, each part with its length."""
    deps = edges.groupBy("run_id", "ordinal").agg(F.array_join(F.transform(F.sort_array(F.collect_list("dep_ordinal")), lambda x: x.cast("string")), ",").alias("deps"))
    n = nodes.select("run_id", "ordinal", "node_id").join(deps, ["run_id", "ordinal"], "left")
    part = F.concat(F.length("node_id").cast("string"), F.lit(":"), "node_id", F.lit("["), F.coalesce("deps", F.lit("")), F.lit("]"))
    per = n.withColumn("part", part).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "part"))).alias("parts"))
    return per.select("run_id", F.upper(F.sha2(F.array_join("parts.part", "|"), 256)).alias("fingerprint"))


def notify_observers(runs: DataFrame, nodes: DataFrame, subscriptions: DataFrame, at: Column) -> DataFrame:
    """Live subscriptions behind their run's version get a notice each; a running run with a ready node gets an unaddressed one."""
    s = subscriptions.where(F.col("expires_at") > at).join(runs.select("run_id", "version"), "run_id").where(F.col("seen_version") < F.col("version"))
    named = s.select("run_id", "subscription_id", "version")
    ready = nodes.where("state = 'Ready'").select("run_id").distinct()
    open_ = runs.where("state = 'Running'").join(ready, "run_id", "left_semi").select("run_id", F.lit(None).cast("string").alias("subscription_id"), "version")
    notice = F.concat_ws("|", F.lit("notice"), F.col("run_id").cast("string"), F.coalesce("subscription_id", F.lit("*")), F.col("version").cast("string"))
    return named.unionByName(open_).withColumn("notice_id", notice)


def prune_observers(subscriptions: DataFrame, at: Column, most_runs: int) -> tuple[DataFrame, DataFrame]:
    """(removed, kept): the expired subscriptions of the first runs that have any."""
    expired = F.col("expires_at") <= at
    runs = subscriptions.where(expired).select("run_id").distinct().orderBy("run_id").limit(most_runs)
    removed = subscriptions.where(expired).join(runs, "run_id", "left_semi")
    return removed, subscriptions.join(removed.select("run_id", "subscription_id"), ["run_id", "subscription_id"], "left_anti")


def run_durations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per run: queue and work time of its finished nodes and its critical path, in seconds."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    timed = nodes.where("state in ('Succeeded', 'Failed')").select("run_id", "ordinal", *[F.coalesce(((us(b) - us(a)) / 1000000).cast("long"), F.lit(0)).alias(c) for a, b, c in (("ready_at", "started_at", "queue_s"), ("started_at", "completed_at", "work_s"))])

    def longest(g, columns):
        work, queue = (columns[c].to_numpy(zero_copy_only=False) for c in ("work_s", "queue_s"))
        own = np.zeros(len(g.key), np.int64)
        np.maximum.at(own, g.of_row, work)
        total = own.copy()  # a node on or behind a cycle counts its own work and what was peeled before it
        for _, now, out in g.peel():
            t = g.to[out]
            np.maximum.at(total, t, total[g.source[out]] + own[t])
        first = np.flatnonzero(np.concatenate(([True], g.run[1:] != g.run[:-1]))) if len(g.run) else np.empty(0, np.int64)
        if not len(first):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names)
        sums = [np.add.reduceat(queue, first), np.add.reduceat(work, first), np.maximum.reduceat(total[g.of_row], first)]
        return pa.RecordBatch.from_arrays([pa.array(g.run[first]), *map(pa.array, sums)], names)

    names = ["run_id", "queue_s", "work_s", "critical_s"]
    return over_graphs(timed, edges, "queue_s long,work_s long", longest, "run_id long, queue_s long, work_s long, critical_s long")


CHILD_ENDED = ("Completed", "Cancelled", "TimedOut", "Terminated", "Failed")
NODE_ENDED = (*ENDED, "DependencyBlocked")


def _child_outcome(status: Column, run_state: Column) -> tuple[Column, Column]:
    """(state, failure code) that a child's end gives its node."""
    cancelled = (status == "Cancelled") & run_state.isin("CancellationRequested", "Cancelled")
    state = F.when(status == "Completed", "Succeeded").when(cancelled, "Cancelled").otherwise("Failed")
    code = F.when(status == "Cancelled", "CHILD_CANCELLED").when(status == "TimedOut", "CHILD_TIMED_OUT").when(status == "Terminated", "CHILD_TERMINATED").otherwise("CHILD_FAILED")
    return state, F.when(state == "Failed", code)


def join_children(nodes: DataFrame, runs: DataFrame, children: DataFrame) -> DataFrame:
    """Terminal children brought back to their nodes: state, failure code and output of the node afterwards.

    conflict: a node that has ended (a blocked one too) and doesn't agree with its child in state, failure code and output; it stays as it is.
    """
    c = children.where(F.col("status").isin(*CHILD_ENDED)).select("child_id", F.col("status").alias("child_status"), F.col("output").alias("child_output"))
    out = nodes.join(c, "child_id").join(runs.select("run_id", F.col("state").alias("run_state")), "run_id")
    new, code = _child_outcome(F.col("child_status"), F.col("run_state"))
    ended = F.col("state").isin(*NODE_ENDED)
    agrees = (F.col("state") == new) & F.col("failure_code").eqNullSafe(code) & F.col("output").eqNullSafe(F.col("child_output"))
    after = lambda old, value: F.when(ended, F.col(old)).otherwise(value).alias(old)
    return out.select("run_id", "ordinal", after("state", new), after("failure_code", code), after("output", F.col("child_output")), (ended & ~agrees).alias("conflict"))


def reconcile_runs(runs: DataFrame, nodes: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work list (run_id, ordinal, action), runs with their new state) for runs in IntegrityFault.

    A run is cancelling when one of its nodes is Cancelled or CancellationRequested, and goes back to what its nodes show. It stays in IntegrityFault, without work,
    when a node disagrees with its child: the node has ended and the child hasn't (or is not there), or the node has a child and was never started.
    """
    bad = runs.where("state = 'IntegrityFault'").select("run_id")
    c = children.select("child_id", F.col("status").isin(*CHILD_ENDED).alias("child_done"))
    n = nodes.join(bad, "run_id", "left_semi")
    own = n.where("child_id is not null").select("run_id", "ordinal", "child_id", "state").join(c, "child_id", "left")
    started = F.col("state").isin("StartAuthorized", "CancellationRequested")
    done = F.coalesce("child_done", F.lit(False))
    conflict = F.when(F.col("state").isin(*ENDED), ~done).otherwise(~started)
    faults = own.where(conflict).select("run_id").distinct().withColumn("fault", F.lit(True))
    shown = n.groupBy("run_id").agg(F.bool_or(F.col("state").isin("Cancelled", "CancellationRequested")).alias("cancelling"))
    after = bad.join(shown, "run_id", "left").join(faults, "run_id", "left")
    state = F.when(F.coalesce("fault", F.lit(False)), "IntegrityFault").when(F.coalesce("cancelling", F.lit(False)), "CancellationRequested").otherwise("Running")
    after = after.select("run_id", state.alias("state"))
    action = F.when(done, "join").when(F.col("run_after") == "CancellationRequested", "cancel").when(F.col("child_done").isNull(), "start")
    work = own.where(started).join(after.where("state <> 'IntegrityFault'").withColumnRenamed("state", "run_after"), "run_id")
    return work.withColumn("action", action).where("action is not null").select("run_id", "ordinal", "action"), after


def reconstruct_run(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """Each node with its child's status, times and error; the order is (run_id, ordinal).

    Nodes without a child, often most of them, are dealt out by their run: by their child they would all be one task's.
    """
    parts = parts_for(nodes, nodes.count() + children.count())
    of_child = F.xxhash64("child_id")
    c = children.select("child_id", of_child.alias("deal"), F.col("status").alias("child_status"), "created_at", "updated_at", "error_summary")
    deal = F.when(F.col("child_id").isNull(), F.xxhash64("run_id", "ordinal")).otherwise(of_child)
    n = nodes.select("run_id", "ordinal", "node_id", "state", "child_id", deal.alias("deal"))
    out = spread(n, parts, "child_id", "deal").join(spread(c, parts, "child_id", "deal"), ["child_id", "deal"], "left")
    return out.drop("deal")
