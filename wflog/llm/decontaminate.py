"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may stand in a document with up to k = n // 16 edits. Cut into k + 2
pieces, at least two of them must stand there unchanged, no more than k characters away from each other's place, so exact piece hits (one automaton over all
pieces) that are confirmed by another give all candidate places; Myers' bit-parallel distance verifies the item against the window
around each. Cuts follow rarity: what an item shares with many others (the stem of a family of questions) is one piece, and the rest is cut into k + 1. One of those must then be
hit, so a stem alone makes no candidate of the thousands of items that have it; it only confirms. Item and document are compared in lower case with white space collapsed.

Scale: documents are only scanned, nothing is shuffled. Items are broadcast in blocks of about
``block_chars`` characters, counted before; larger test sets are worked through block after block, each
a scan of the texts alone, and what they found (a few rows, by the texts' hashes) is joined to the documents once.

Edge cases: null and empty items or texts never match; an item below 16 characters must match
exactly; repeated items each report; ids of items and documents may be of any type, null ids pass through; very long
texts are searched whole; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .rolling import prefixes, substring


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(item: str, window: str, limit: int) -> int:
    """Least edit distance of ``item`` to any part of ``window``; limit + 1 when above ``limit``."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in window:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere: no cost above the first row
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best = score
            if not best:
                break
    return best if best <= limit else limit + 1


def pieces(item: str, count: int, common: tuple[int, int] = (0, 0)) -> list[tuple[int, str]]:
    """``count`` pieces with their offsets: the stretch ``common``, if it isn't empty, as one of them, the rest in parts of nearly equal length."""
    n, (a, b) = len(item), common
    if a >= b:
        cuts = [n * i // count for i in range(count + 1)]
        return [(s, item[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]
    left = round((count - 1) * a / (n - (b - a)))
    left = min(max(left, int(a > 0), count - 1 - (n - b)), a, count - 1 - int(b < n))  # no piece is empty
    head = pieces(item[:a], left) if left else []
    tail = pieces(item[b:], count - 1 - left) if count - 1 - left else []
    return [*head, (a, item[a:b]), *[(b + s, p) for s, p in tail]]


def common_stretches(texts: list[str], n: int = 16, many: int = 8) -> list[tuple[int, int]]:
    """Per text the longest stretch in which every ``n`` characters stand in more than ``many`` of the texts; (0, 0) where there is none."""
    codes = [np.array([ord(c) for c in t], np.int64) for t in texts]
    grams = []
    for c in codes:
        if len(c) < n:
            grams.append(np.zeros(0, np.uint64))
            continue
        p = prefixes(c)
        at = np.arange(len(c) - n + 1)
        grams.append(substring(p, at, at + n))
    once = [np.unique(g) for g in grams]
    known, count = np.unique(np.concatenate([*once, np.zeros(0, np.uint64)]), return_counts=True)
    frequent = known[count > many]
    out = []
    for g in grams:
        hot = np.isin(g, frequent) if len(frequent) else np.zeros(len(g), bool)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hot.astype(np.int8), [0]))))
        if not len(edge):
            out.append((0, 0))
            continue
        first, end = edge[::2], edge[1::2]
        k = int((end - first).argmax())
        out.append((int(first[k]), int(end[k]) + n - 1))
    return out


class Matcher:
    """Items as pieces of an automaton. A piece's number leads to the items that hold it: as a piece that must be hit, or as their stem."""

    def __init__(self, items: list[tuple], per_edit: int = 16, at_once: int = 1 << 20):
        self.at_once = at_once
        self.items = [(i, t, len(t) // per_edit) for i, t in ((i, normal(t)) for i, t in items) if t]
        number: dict[str, int] = {}
        rows = []  # (piece, item, offset)
        size = len(self.items)
        self.stem, self.stem_at, self.alone = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool)
        self.budget = np.array([b for _, _, b in self.items], np.int64)
        self.reach = max((len(t) + 2 * b for _, t, b in self.items), default=0)  # pieces of one place end within so many characters
        for k, ((_, t, budget), (a, b)) in enumerate(zip(self.items, common_stretches([t for _, t, _ in self.items]), strict=True)):
            if not budget:
                cut, a, b = pieces(t, 1), 0, 0
                self.alone[k] = True  # the whole item is one piece
            elif b - a < len(t) // (budget + 2) or len(t) - (b - a) < 3 * (budget + 1):
                cut, a, b = pieces(t, budget + 2), 0, 0  # no stem, or hardly anything but it
            else:
                cut = pieces(t, budget + 2, (a, b))
            for offset, piece in cut:
                n = number.setdefault(piece, len(number))
                if a < b and offset == a:
                    self.stem[k], self.stem_at[k] = n, a
                else:
                    rows.append((n, k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, n in number.items():
            self.automaton.add_word(piece, (n, len(piece)))
        if number:
            self.automaton.make_automaton()
        self.empty = not number
        rows = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.begin = np.searchsorted(rows[:, 0], np.arange(len(number) + 1))
        self.of, self.offset = rows[:, 1], rows[:, 2]

    def candidates(self, text: str):
        """(item, where it would start without edits) that another piece confirms, by item and place.

        Hits of pieces that many items hold are worked through stretch by stretch of the text, each with what may confirm it behind its end.
        """
        found = np.array([(n, end + 1 - size, end) for end, (n, size) in self.automaton.iter(text)], np.int64).reshape(-1, 3)
        upto = np.cumsum(self.begin[found[:, 0] + 1] - self.begin[found[:, 0]])
        start, out = 0, set()
        while start < len(found):
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + self.at_once, "right")))
            stop = int(np.searchsorted(found[:, 2], found[end - 1, 2] + self.reach, "right"))
            out.update(map(tuple, self._confirmed(found[start:stop], len(text))))
            start = end
        return sorted(out)

    def _confirmed(self, found: np.ndarray, length: int) -> list:
        many = self.begin[found[:, 0] + 1] - self.begin[found[:, 0]]
        x = np.repeat(np.arange(len(found)), many)
        row = np.repeat(self.begin[found[:, 0]] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        item, piece = self.of[row], self.offset[row]
        at = found[x, 1] - piece
        order = np.lexsort((at, item))
        item, at, piece = item[order], at[order], piece[order]
        reach = self.budget[item]
        good = self.alone[item]
        # the nearest hit of another piece of the item lies beside it in this order, but for hits of the same piece
        for step in (1, -1):
            other = np.arange(len(item)) + step
            far = np.ones(len(item), bool)
            for _ in range(len(item)):
                inside = (other >= 0) & (other < len(item)) & far & ~good
                k = np.flatnonzero(inside)
                near = (item[other[k]] == item[k]) & (np.abs(at[other[k]] - at[k]) <= reach[k])
                good[k[near & (piece[other[k]] != piece[k])]] = True
                far = np.zeros(len(item), bool)
                far[k[near & (piece[other[k]] == piece[k])]] = True
                if not far.any():
                    break
                other = other + step
        # or a hit of its stem
        wide = length + 1
        stems = np.unique(found[:, 0] * (4 * wide) + found[:, 1] + wide)
        k = np.flatnonzero(~good & (self.stem[item] >= 0))
        want = self.stem[item[k]] * (4 * wide) + at[k] + self.stem_at[item[k]] + wide
        good[k[np.searchsorted(stems, want - reach[k]) < np.searchsorted(stems, want + reach[k], "right")]] = True
        pairs = np.unique(np.stack([item[good], at[good]], 1), axis=0)
        return pairs.tolist()

    def hits(self, text: str | None) -> list[tuple]:
        text = normal(text)
        if self.empty or not text:
            return []
        best: dict[int, int] = {}
        for k, at in self.candidates(text):
            if best.get(k) == 0:
                continue
            _, item, budget = self.items[k]
            if at >= 0 and text.startswith(item, at):
                best[k] = 0
                continue
            d = myers(item, text[max(0, at - budget) : max(0, at + len(item) + budget)], budget)
            if d <= budget:
                best[k] = min(d, best.get(k, d))
        return sorted(((self.items[k][0], d) for k, d in best.items()), key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1]))


def with_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = 2_000_000) -> DataFrame:
    """Documents with ``leaks``, an array of struct(item_id, distance), one entry per item found."""
    small_batches(docs.sparkSession)
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    hit = f"array<struct<item_id: {items.schema['item_id'].dataType.simpleString()}, distance: int>>"
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    text = F.col(text_col)
    if blocks == 1:
        return docs.withColumn("leaks", _finder(items.collect(), docs.sparkSession, hit)(text))
    found = []
    for b in range(blocks):  # a worker holds the pieces of one block at a time
        find = _finder(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect(), docs.sparkSession, hit)
        hits = docs.select(F.xxhash64(text).alias("leak_h1"), F.xxhash64(F.lit(1), text).alias("leak_h2"), find(text).alias("found")).where(F.size("found") > 0)
        found.append(materialize(hits.dropDuplicates(["leak_h1", "leak_h2"]), "leaks"))
    found = reduce(DataFrame.unionByName, found).groupBy("leak_h1", "leak_h2").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
    rows = docs.select(F.struct("*").alias("leak_row"), F.xxhash64(text).alias("leak_h1"), F.xxhash64(F.lit(1), text).alias("leak_h2"))
    out = rows.join(materialize(found, "leaks"), ["leak_h1", "leak_h2"], "left")
    own = [F.col("leak_row").getField(c).alias(c) for c in docs.columns if c != "leaks"]
    return out.select(*own, F.coalesce("found", F.expr(f"cast(array() as {hit})")).alias("leaks"))


def _finder(items, spark, hit: str):
    sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in items])
    made: list[Matcher] = []

    @F.pandas_udf(hit)
    def find(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Matcher(sent.value))
        return pd.Series([[{"item_id": i, "distance": d} for i, d in made[0].hits(t)] for t in texts], dtype=object)

    return find


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go.

    Null and empty texts, and all documents where there are no items, stay; repeated rows stay or go together; an empty table gives none.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    slim = with_leaks(docs.select(F.struct("*").alias("row"), F.col("text").alias("leak_text")), items, "leak_text")
    return slim.where(F.size("leaks") == 0).select("row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    """One row per document and item found in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.distance")
