"""Many small graphs (or a few large ones) at once: whole Arrow batches of runs, peeled and searched with numpy.

Nodes and edges meet once by run, sorted; a task works through runs in chunks of about ``CHUNK`` rows, all graphs of
a chunk at the same time, so the cost per run is that of its rows. There a run is never cut: its nodes and edges (some 30 bytes a row) fit a task.
Runs with more rows than that go by joins, a frontier at a time (``split_by_size``, ``peel_by_joins``, ``reach_by_joins``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from ..sources.spread import parts_for, spread

CHUNK = 1 << 18
#: Rows of a run that a task is given at most.
LARGEST = 30_000_000


class Graphs:
    """Nodes of a chunk of runs in the order (run, ordinal) and the edges between them; edges of unknown nodes are left out."""

    def __init__(self, run: np.ndarray, is_edge: np.ndarray, ordinal: np.ndarray, other: np.ndarray):
        self.node_rows = np.flatnonzero(~is_edge)
        self.run = run[self.node_rows]
        new = np.concatenate(([True], run[1:] != run[:-1]))
        place = (np.cumsum(new) << 33) + (np.int64(1) << 32)
        self.key, first, self.of_row = np.unique((place + ordinal)[self.node_rows], return_index=True, return_inverse=True)
        self.first_row = self.node_rows[first]
        e = np.flatnonzero(is_edge)
        to, known_to = self._find((place + ordinal)[e])
        source, known = self._find((place + other)[e])
        both = known & known_to
        self.to, self.source = to[both], source[both]
        order = np.argsort(self.source, kind="stable")
        self.to, self.source = self.to[order], self.source[order]
        self.begin = np.searchsorted(self.source, np.arange(len(self.key) + 1))

    def _find(self, key: np.ndarray):
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key

    def edges_from(self, nodes: np.ndarray) -> np.ndarray:
        """Places of the edges that leave ``nodes``."""
        size = self.begin[nodes + 1] - self.begin[nodes]
        return np.repeat(self.begin[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def peel(self):
        """(wave, nodes of the wave, edges that leave them), wave by wave; nodes on or behind a cycle are never reached."""
        open_ = np.bincount(self.to, minlength=len(self.key))
        now, wave = np.flatnonzero(open_ == 0), 0
        while len(now):
            out = self.edges_from(now)
            yield wave, now, out
            t = self.to[out]
            np.subtract.at(open_, t, 1)
            now, wave = np.unique(t[open_[t] == 0]), wave + 1

    def reached(self, start: np.ndarray) -> np.ndarray:
        """Flags of the nodes at or behind ``start``."""
        seen = np.zeros(len(self.key), bool)
        seen[start] = True
        now = start
        while len(now):
            t = self.to[self.edges_from(now)]
            now = np.unique(t[~seen[t]])
            seen[now] = True
        return seen


def over_graphs(nodes: DataFrame, edges: DataFrame, carried: str, solve: Callable, schema: str, n_rows: int | None = None) -> DataFrame:
    """``solve(graphs, columns)`` for chunks of whole runs; columns: the node rows' Arrow arrays, ``carried`` ("name type, ..") among them. ``n_rows``: of nodes and edges, where known."""
    names = [c.split()[0] for c in carried.split(",")] if carried else []
    nulls = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in carried.split(",")] if carried else []
    a = nodes.select("run_id", F.lit(False).alias("is_edge"), "ordinal", F.lit(0).alias("other"), *names)
    b = edges.select("run_id", F.lit(True).alias("is_edge"), "ordinal", F.col("dep_ordinal").alias("other"), *nulls)
    rows = a.unionByName(b).where("run_id is not null and ordinal is not null and other is not null")

    def run_chunk(parts):
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        run, is_edge, ordinal, other = (t.column(c).to_numpy(zero_copy_only=False) for c in ("run_id", "is_edge", "ordinal", "other"))
        g = Graphs(run, is_edge, ordinal.astype(np.int64), other.astype(np.int64))
        at = pa.array(g.node_rows)
        return solve(g, {c: t.column(c).take(at) for c in ("run_id", "ordinal", *names)})

    def make(batches):
        held, size = [], 0
        for batch in batches:
            run = batch.column("run_id").to_numpy()
            cut = int(np.searchsorted(run, run[-1])) if len(run) else 0  # the last run may go on in the next batch
            if held and size + cut >= CHUNK and (cut or run[0] != held[-1].column("run_id")[-1].as_py()):
                yield run_chunk([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield run_chunk(held)

    by_run = rows.repartition("run_id") if n_rows is None else spread(rows, parts_for(rows, n_rows), "run_id")
    return by_run.sortWithinPartitions("run_id", "is_edge").mapInArrow(make, schema)


def split_by_size(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[int, tuple[DataFrame, DataFrame] | None]:
    """(rows of all runs, (nodes, edges) of the runs with more than ``most`` rows, or None where there is none); runs are only counted where the rows of all together are more."""
    total = nodes.count() + edges.count()
    if total <= most:
        return total, None
    rows = nodes.select("run_id").unionByName(edges.select("run_id"))
    rows = spread(rows, parts_for(rows, total), "run_id").groupBy("run_id").count()
    if (rows.agg(F.max("count")).first()[0] or 0) <= most:
        return total, None
    large = materialize(rows.where(F.col("count") > most).select("run_id"), "graph-large")
    pick = lambda df: materialize(df.join(large, "run_id", "left_semi"), "graph-part")
    return total, (pick(nodes), pick(edges))


def _known(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between nodes that there are."""
    n = nodes.select("run_id", "ordinal").distinct()
    e = edges.select("run_id", "ordinal", "dep_ordinal").join(n, ["run_id", "ordinal"], "left_semi")
    return materialize(e.join(n.withColumnRenamed("ordinal", "dep_ordinal"), ["run_id", "dep_ordinal"], "left_semi"), "graph-edges")


def peel_by_joins(nodes: DataFrame, edges: DataFrame, every: int = 8) -> DataFrame:
    """(run_id, ordinal, wave) like ``Graphs.peel``, -1 for nodes on or behind a cycle: each round joins the last wave with the edges that leave it.

    What is still open is written anew every ``every`` rounds, the waves each round; there are as many rounds as waves.
    """
    e = _known(nodes, edges)
    n = nodes.select("run_id", "ordinal").distinct()
    open_ = materialize(e.groupBy("run_id", "ordinal").agg(F.count("*").alias("left")), "graph-open")
    now = materialize(n.join(open_, ["run_id", "ordinal"], "left_anti"), "graph-wave")
    waves, k = [], 0
    while not now.isEmpty():
        waves.append(now.withColumn("wave", F.lit(k)))
        met = e.join(now.withColumnRenamed("ordinal", "dep_ordinal"), ["run_id", "dep_ordinal"]).groupBy("run_id", "ordinal").agg(F.count("*").alias("met"))
        after = open_.join(met, ["run_id", "ordinal"], "left").select("run_id", "ordinal", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left"))
        now = materialize(after.where("left = 0").select("run_id", "ordinal"), "graph-wave")
        k += 1
        open_ = after.where("left > 0")
        if k % every == 0:
            open_ = materialize(open_, "graph-open")
    out = open_.select("run_id", "ordinal", F.lit(-1).alias("wave"))
    for w in waves:
        out = out.unionByName(w)
    return out.withColumn("wave", F.col("wave").cast("int"))


def reach_by_joins(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """(run_id, ordinal) at or behind ``start``, a frontier at a time."""
    e = _known(nodes, edges)
    now = seen = materialize(start.select("run_id", "ordinal").distinct(), "graph-reached")
    while True:
        met = e.join(now.withColumnRenamed("ordinal", "dep_ordinal"), ["run_id", "dep_ordinal"]).select("run_id", "ordinal").distinct()
        now = materialize(met.join(seen, ["run_id", "ordinal"], "left_anti"), "graph-reached")
        if now.isEmpty():
            return seen
        seen = materialize(seen.unionByName(now), "graph-reached")
