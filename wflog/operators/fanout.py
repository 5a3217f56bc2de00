"""Fan-out, joins and steps over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def then(df: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """A step over batches of rows that gives replacement rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield step(b)

    return df.mapInPandas(run, schema)


def branch_if(df: DataFrame, test: Column, yes: Callable[[DataFrame], DataFrame], no: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Two sub-pipelines chosen by a predicate (null: no), then reunited."""
    sure = F.coalesce(test, F.lit(False))
    return yes(df.where(sure)).unionByName(no(df.where(~sure)))


def iterate_while(df: DataFrame, test: Column, body: Callable[[DataFrame], DataFrame], max_iterations: int, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The body repeated for the rows that satisfy the predicate; rows still active after ``max_iterations`` are an error.

    ``save`` writes the active rows of a round (checkpoint by default), so plans don't grow.
    """
    keep = save or (lambda x: x.checkpoint())
    sure = F.coalesce(test, F.lit(False))
    done, active = df.where(~sure), df.where(sure)
    for _ in range(max_iterations):
        active = keep(body(active))
        done = done.unionByName(active.where(~sure))
        active = active.where(sure)
        if active.isEmpty():
            return done
    raise RuntimeError(f"rows are still active after {max_iterations} iterations")


def parallel_branches(df: DataFrame, key: str, branches: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Named branches over the same rows -> one row per key and branch: (key, branch_ordinal, branch, result, failed)."""
    parts = [f(df).select(key, F.lit(i).alias("branch_ordinal"), F.lit(name).alias("branch"), "result", "failed") for i, (name, f) in enumerate(branches.items())]
    return reduce(DataFrame.unionByName, parts)


def _gather(results: DataFrame, key: str) -> DataFrame:
    return results.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("branch_ordinal", "branch", "result", "failed"))).alias("results"), F.bool_or("failed").alias("any_failed"))


def parallel_when_all(results: DataFrame, key: str, merge: Callable[[Column], Column]) -> DataFrame:
    """Results merged in authored order; any failed branch fails the scope after all have ended."""
    g = _gather(results, key)
    return g.select(key, F.when(F.col("any_failed"), "Failed").otherwise("Succeeded").alias("status"), F.when(~F.col("any_failed"), merge(F.col("results"))).alias("merged"))


def parallel_outcomes(results: DataFrame, key: str, merge: Callable[[Column], Column]) -> DataFrame:
    """The same, but failures stay outcomes and the scope always joins."""
    return _gather(results, key).select(key, F.lit("Succeeded").alias("status"), merge(F.col("results")).alias("merged"))


def first_winner(results: DataFrame, key: str) -> DataFrame:
    """(key, branch_ordinal, finished_at, failed): the first to end wins, the lowest ordinal among equals; a failed winner fails the scope."""
    best = results.groupBy(key).agg(F.min(F.struct("finished_at", "branch_ordinal", "failed")).alias("w"))
    return best.select(key, F.col("w.branch_ordinal").alias("winner"), F.when(F.col("w.failed"), "Failed").otherwise("Succeeded").alias("status"))


def for_each(df: DataFrame, key: str, items: str, step: Callable[[Column], Column], max_items: int) -> DataFrame:
    """A step per item of an array, results in index order; more than ``max_items`` fails the row, an empty list joins at once."""
    n = F.coalesce(F.size(items), F.lit(0))
    few = F.coalesce(F.col(items), F.array().cast(df.schema[items].dataType))
    ok = (n >= 0) & (n <= max_items)
    return df.select(key, F.when(ok, "Succeeded").otherwise("Failed").alias("status"), F.when(ok, F.transform(few, step)).alias("results"))


POLICIES = ("WhenAny", "FailFast", "WaitAllThenFail", "ContinueWithPartialFailures")


def join_policy(items: DataFrame, key: str, policy: str) -> DataFrame:
    """(key, item, done_order, failed) -> items with status and the scope's outcome under the policy.

    WhenAny: the first to end decides. FailFast: the first failure decides. Items after the deciding one are cancelled.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    w = Window.partitionBy(key)
    first = F.min("done_order").over(w)
    first_bad = F.min(F.when(F.col("failed"), F.col("done_order"))).over(w)
    decides = {"WhenAny": first, "FailFast": first_bad}.get(policy, F.lit(None).cast("long"))
    out = items.withColumn("decides", decides).withColumn("any_failed", F.bool_or("failed").over(w)).withColumn("first_failed", F.bool_or(F.col("failed") & (F.col("done_order") == first)).over(w))
    cut = F.col("decides").isNotNull() & (F.col("done_order") > F.col("decides"))
    status = F.when(cut, "Cancelled").when(F.col("failed"), "Failed").otherwise("Completed")
    bad = {"WhenAny": F.col("first_failed"), "ContinueWithPartialFailures": F.lit(False)}.get(policy, F.col("any_failed"))
    return out.select(*items.columns, status.alias("status"), F.when(bad, "Failed").otherwise("Succeeded").alias("outcome"))


def admit_items(items: DataFrame, key: str, path_limit: int, node_limit: int) -> DataFrame:
    """Pending items in index order up to min(path, node) less the active ones."""
    w = Window.partitionBy(key)
    active = F.sum(F.when(F.col("state") == "active", 1).otherwise(0)).over(w)
    rank = F.sum(F.when(F.col("state") == "pending", 1).otherwise(0)).over(w.orderBy("item").rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("active", active).withColumn("rank", rank).where((F.col("state") == "pending") & (F.col("rank") + F.col("active") <= min(path_limit, node_limit))).select(*items.columns)


def for_each_progress(items: DataFrame, key: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return items.groupBy(key).agg(F.count("*").alias("total"), n("active"), n("completed"), n("failed"), n("cancelled"))


def partition_items(items: DataFrame, scope: str, index: str, size: int = 1, by: str | None = None) -> DataFrame:
    """Batch number per item: fixed batches of ``size`` in order, or one batch per key in the order in which keys appear."""
    if by is None:
        return items.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(scope).orderBy(index)) - 1) / size).cast("long"))
    first = items.withColumn("_first", F.min(index).over(Window.partitionBy(scope, by)))
    return first.withColumn("batch", (F.dense_rank().over(Window.partitionBy(scope).orderBy("_first")) - 1).cast("long")).drop("_first")


def _scopes(column: pa.Array) -> list[int]:
    """Where scopes begin in a sorted column, and its length; nulls are one scope, as are NaNs."""
    a, b = column.slice(0, max(len(column) - 1, 0)), column.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(column.type):
        same = pc.or_(same, pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False)))
    return [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist(), len(column)]


def partition_custom(items: DataFrame, scope: str, function: Callable[[pd.DataFrame], pd.Series], many: bool = False) -> DataFrame:
    """Batch numbers from a function of a scope's items.

    Scopes come sorted, many in one Arrow batch, and the function is called for slices of it: most scopes are small, and a batch of their own costs far more than they do.
    With ``many`` it is called once for all whole scopes of a batch, which it tells apart by ``scope`` where it needs to; integers with nulls are floats there.
    """
    schema = T.StructType([*items.schema.fields, T.StructField("batch", T.LongType())])

    def numbers(rows: pd.DataFrame) -> np.ndarray:
        got = function(rows)
        return (got if got.index is rows.index else got.reindex(rows.index)).to_numpy() if isinstance(got, pd.Series) else np.asarray(got)

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        if many:
            batch = pa.array(numbers(t.to_pandas()), pa.int64(), from_pandas=True)
            return t.append_column("batch", batch).combine_chunks().to_batches()[0]
        edges = _scopes(t.column(scope).chunk(0))
        # integers become floats in pandas where one is null: then each scope is turned on its own, so that none depends on its neighbours
        alone = any(c.null_count and (pa.types.is_integer(c.type) or pa.types.is_boolean(c.type)) for c in t.columns)
        pdf = None if alone else t.to_pandas()
        out = []
        for s, e in zip(edges, edges[1:], strict=False):
            rows = t.slice(s, e - s).to_pandas() if alone else pdf.iloc[s:e]
            rows.index = pd.RangeIndex(e - s)
            out.append(pa.array(numbers(rows), pa.int64(), from_pandas=True))
        return pa.Table.from_arrays([*t.columns, pa.chunked_array(out)], [*t.column_names, "batch"]).combine_chunks().to_batches()[0]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            cut = _scopes(b.column(scope))[-2]  # the last scope may go on in the next batch
            meets = [x.column(scope).slice(at, 1) for x, at in ((held[-2], held[-2].num_rows - 1), (b, 0))] if len(held) > 1 else []
            if cut == 0 and meets and len(_scopes(pa.concat_arrays(meets))) > 2:
                yield solve(pa.Table.from_batches(held[:-1]))
                held = [b]
            elif cut:
                yield solve(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
                held = [b.slice(cut)]
        if held:
            yield solve(pa.Table.from_batches(held))

    return items.repartition(scope).sortWithinPartitions(scope).mapInArrow(make, schema)


FAILURE = "struct<code: string, message: string, exception_type: string>"


def run_steps_with_retry(df: DataFrame, step: Callable[[dict], dict], max_attempts: int) -> DataFrame:
    """The step called per row up to ``max_attempts`` times; a failed row keeps its state. No waiting between attempts.

    Adds status, attempts (how many), outcomes (array of attempt, outcome, failure) and failure, that of the last attempt where all
    failed. A failure's code is the exception's ``code`` where it has one. For steps with effects outside Spark, row by row; a pure step
    is a column expression or ``then``.
    """
    names = df.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"status string, attempts int, outcomes array<struct<attempt: int, outcome: string, failure: {FAILURE}>>, failure {FAILURE}"])

    def call(row: dict) -> list:
        state, outcomes = row, []
        for n in range(1, max_attempts + 1):
            try:
                state, failure = {**row, **step({**row, "attempt": n})}, None
            except Exception as ex:  # noqa: BLE001  what a step raises is its outcome
                failure = {"code": str(getattr(ex, "code", "STEP_FAILED")), "message": str(ex), "exception_type": type(ex).__name__}
            outcomes.append({"attempt": n, "outcome": "Failed" if failure else "Succeeded", "failure": failure})
            if not failure:
                break
        last = outcomes[-1] if outcomes else {"outcome": "Failed", "failure": {"code": "NO_ATTEMPT", "message": None, "exception_type": None}}
        return [*(state[c] for c in names), last["outcome"], len(outcomes), outcomes, last["failure"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([call(row) for row in b.to_dict("records")], columns=[*names, "status", "attempts", "outcomes", "failure"])

    return df.mapInPandas(run, schema)


def attempt_summary(attempts: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Per step: attempts, successes, failures, timeouts, first-try successes, 95th percentile of the duration; with ``accuracy`` within 1 / accuracy of the rank, by sketches of bounded size."""
    r = F.col("result")
    p95 = F.percentile("duration_ms", F.lit(0.95)) if accuracy is None else F.percentile_approx("duration_ms", 0.95, accuracy)
    return attempts.groupBy("step_path").agg(
        F.count("*").alias("attempts"), F.count_if(r == "success").alias("success"), F.count_if(r == "failed").alias("failed"), F.count_if(r == "timed_out").alias("timed_out"),
        F.count_if((r == "success") & (F.col("attempt") == 0)).alias("first_try"), F.round(p95.cast("double"), 3).alias("p95_ms"),
    )


def derive_status(fibers: DataFrame, scopes: DataFrame, key: str = "instance_id") -> DataFrame:
    """Instance status from fibers (is_root, phase) and scopes (phase); phases Runnable, Blocked or terminal names."""
    terminal = F.col("phase").isin("Completed", "Failed", "Cancelled", "TimedOut")
    f = fibers.groupBy(key).agg(F.max(F.when(F.col("is_root") & terminal, F.col("phase"))).alias("root_end"), F.bool_or(F.col("phase") == "Runnable").alias("runnable"), F.bool_or(F.col("phase") == "Blocked").alias("blocked"))
    s = scopes.groupBy(key).agg(F.bool_or(F.col("phase").isin("Joinable", "Merging")).alias("joining"))
    out = f.join(s, key, "left")
    status = F.when(F.col("root_end").isNotNull(), F.col("root_end")).when(F.coalesce("joining", F.lit(False)) | F.col("runnable"), "Running").when(F.col("blocked"), "Waiting").otherwise("NothingLeft")
    return out.select(key, status.alias("status"))


CAUSES = "code string, message string, location string, exception_type string, occurrence_kind string, branch_id string, item_index int, causes array<string>"


def flatten_failures(df: DataFrame, key: str, tree: str, depth: int | None = None) -> DataFrame:
    """A failure tree as JSON (fields of ``CAUSES``) -> rows (key, depth, path, code, message, location, exception_type, occurrence, occurrence_id) in cause order.

    occurrence: root, branch or item; its id is the branch's name or the item's index. Without ``depth`` all levels are given, as many as the tree with most lists of causes may have;
    with it causes below stay JSON in ``rest``.
    """
    if depth is None:
        depth = df.agg(F.max(F.size(F.split(tree, '"causes"')))).first()[0] or 1
    level = df.select(key, F.lit("0").alias("path"), F.from_json(tree, CAUSES).alias("n")).where("n is not null")
    parts = []
    for d in range(depth + 1):
        rest = F.when(F.size("n.causes") > 0, F.to_json("n.causes")) if d == depth else F.lit(None).cast("string")
        who = F.coalesce("n.branch_id", F.col("n.item_index").cast("string"))
        kind = F.coalesce(F.lower("n.occurrence_kind"), F.when(F.col("n.branch_id").isNotNull(), "branch").when(F.col("n.item_index").isNotNull(), "item").otherwise("root"))
        parts.append(level.select(key, F.lit(d).alias("depth"), "path", "n.code", "n.message", "n.location", "n.exception_type", kind.alias("occurrence"), F.when(kind != "root", who).alias("occurrence_id"), rest.alias("rest")))
        if d < depth:
            down = level.select(key, "path", F.posexplode("n.causes").alias("i", "cause"))
            level = down.select(key, F.concat_ws(".", "path", F.lpad(F.col("i").cast("string"), 4, "0")).alias("path"), F.from_json("cause", CAUSES).alias("n"))
    return reduce(DataFrame.unionByName, parts)


def end_project(df: DataFrame, output: Column, outcome: Column) -> DataFrame:
    """Final output and outcome name per row."""
    return df.select("instance_id", output.alias("output"), outcome.alias("outcome_name"))
