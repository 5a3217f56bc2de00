"""Periodic runs of words, found in grammar-compressed texts.

A run is a longest stretch of words in which words ``period`` apart are equal, at least ``min_length`` words and ``min_exponent`` periods long. Texts of an Arrow batch are
worked on together as arrays of word numbers, no word number standing in two texts:

1. A pair of neighbours that occurs once in its text lies in no run and is never replaced; what is left are live stretches, those shorter than ``min_length`` go.
2. Re-Pair: a place is replaced by its pair's nonterminal when its pair is more frequent than those it overlaps with (the most frequent pair of a text everywhere), in rounds
   until no pair occurs twice. Rules, and every place where a nonterminal was put, are kept.
3. The runs that cross the middle of a nonterminal are computed once, at its first place; those that cross the borders of the start rule's symbols at those borders. Periods to try come from the
   next places of the words beside the border; how far words agree is read off names of all substrings of 2**k words (numbered exactly, no hashing).
4. Runs of a nonterminal are carried to all its places, and stretches of one period that overlap by a period are merged. The shortest period of a stretch is the one that counts.

Every run is found whole at the lowest node that holds it. Work is linear-logarithmic in the live words for natural and for periodic texts.

Scale: a map over documents without a shuffle; statistics of a pair never leave its text. Memory is bounded by the batch or, for a longer text, by 4 bytes a live word and doubling (90 MB for a million).

Edge cases: null and empty texts have no words, no runs and collapse to the empty text; repeated rows, ties and rows without an id get equal results, each for itself; an empty table gives no rows; other
columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, small_batches
from .rolling import mix

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the keys from 0 and how often each occurs."""
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return at, n


def _live(words: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end positions of stretches of at least ``min_length`` words all of whose neighbours occur twice."""
    at, n = _numbered(words[:-1] * (int(words.max()) + 1) + words[1:])
    twice = np.concatenate(([False], n[at] > 1, [False]))
    edge = np.flatnonzero(twice[1:] != twice[:-1])
    first, end = edge[::2], edge[1::2] + 1
    long = end - first >= min_length
    return first[long], end[long]


class Grammar:
    """Re-Pair over stretches laid end to end; positions count words in them.

    Rules: place, middle and end of a nonterminal's first occurrence. ``put`` (rule, position): all its occurrences. ``border``: where the start rule's symbols begin.
    """

    def __init__(self, words: np.ndarray, stretch_of: np.ndarray) -> None:
        sym, pos, size = words.astype(np.int64), np.arange(len(words)), np.ones(len(words), np.int64)
        glue = np.append(stretch_of[1:] == stretch_of[:-1], False)  # may this place and the next still become one
        rules, puts, done, n_rules = [], [], [], 0
        while True:
            at = np.flatnonzero(glue)
            if not len(at):
                done.append(pos)
                break
            top = int(sym.max()) + 1
            of, n = _numbered(sym[at] * top + sym[at + 1])
            glue[at[n[of] < 2]] = False
            alive = n[of] > 1
            at, of = at[alive], of[alive]
            rank = np.empty(len(n), np.int64)
            rank[np.lexsort((mix(np.arange(len(n), dtype=np.uint64) + np.uint64(1)), n))] = np.arange(len(n))  # by frequency; equal ones in no order, or rounds would be as many as neighbours that ascend
            want = np.full(len(sym) + 2, -1)
            want[at + 1] = rank[of]
            here, before, after = want[1:-1], want[:-2], want[2:]
            chain = np.flatnonzero((here >= 0) & (here != before))  # a pair of one symbol overlaps itself: every second place of such a chain counts
            odd = np.zeros(len(sym), np.int64)
            if len(chain):
                lead = np.zeros(len(sym), np.int64)
                lead[chain] = chain
                odd = (np.arange(len(sym)) - np.maximum.accumulate(lead)) & 1
            chosen = (here >= 0) & (odd == 0) & (here >= before) & (here >= after)
            left = np.flatnonzero(chosen)
            if len(left):
                right = left + 1
                rule, first = np.unique(here[left], return_index=True)
                number = n_rules + np.searchsorted(rule, here[left])
                x = left[first]
                rules.append(np.stack([pos[x], pos[x] + size[x], pos[x] + size[x] + size[x + 1]]))
                puts.append(np.stack([number, pos[left]]))
                sym[left] = top + np.searchsorted(rule, here[left])
                size[left] += size[right]
                glue[left] = glue[right]
                n_rules += len(rule)
                stay = np.ones(len(sym), bool)
                stay[right] = False
                sym, pos, size, glue = sym[stay], pos[stay], size[stay], glue[stay]
            # what can't be replaced any more leaves the sequence; glue holds between neighbours that both stay
            keep = glue | np.concatenate(([False], glue[:-1]))
            done.append(pos[~keep])
            sym, pos, size, glue = sym[keep], pos[keep], size[keep], glue[keep]
        self.first, self.middle, self.end = np.concatenate(rules, 1) if rules else np.zeros((3, 0), np.int64)
        self.put = np.concatenate(puts, 1) if puts else np.zeros((2, 0), np.int64)
        self.border = np.sort(np.concatenate(done))


class Names:
    """Numbers of all substrings of 2**k words; equal numbers mean equal words."""

    def __init__(self, words: np.ndarray, longest: int) -> None:
        self.of = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
        while 2 << len(self.of) - 1 <= min(longest, len(words)):
            last, half = self.of[-1], 1 << len(self.of) - 1
            self.of.append(_numbered(last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:])[0].astype(np.int32))

    def forward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal, up to ``limit``."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.of) - 1, -1, -1):
            names, step = self.of[k], 1 << k
            ok = np.flatnonzero(n + step <= limit)
            ok = ok[names[i[ok] + n[ok]] == names[j[ok] + n[ok]]]
            n[ok] += step
        return n

    def backward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal, up to ``limit``."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.of) - 1, -1, -1):
            names, step = self.of[k], 1 << k
            ok = np.flatnonzero(n + step <= limit)
            ok = ok[names[i[ok] - n[ok] - step] == names[j[ok] - n[ok] - step]]
            n[ok] += step
        return n


def _crossing(names: Names, first: np.ndarray, middle: np.ndarray, end: np.ndarray, min_length: int, min_exponent: int, block: int = 1 << 20):
    """(border, start, end, period) of stretches inside first .. end that cross the middle.

    One side of the middle has half of such a stretch, more than a period of it by ``beyond`` words: that many words beside the middle
    stand again a period further on that side.
    """
    n, found = len(names.of[0]), []
    sorted_names: dict[int, np.ndarray] = {}
    k = 0
    most = (end - first) // min_exponent
    while len(most) and 1 << k <= int(most.max()):
        low, high = 1 << k, (2 << k) - 1
        q = np.arange(low, min(high, int(most.max())) + 1)
        beyond = int(((np.maximum(min_length, min_exponent * q) + 1) // 2 - q).min())
        level = min(max(beyond, 1).bit_length() - 1, len(names.of) - 1)
        word, step = names.of[level].astype(np.int64), 1 << level
        if level not in sorted_names:
            sorted_names = {level: np.sort(word * n + np.arange(len(word)))}
        places = sorted_names[level]
        open_ = np.flatnonzero(most >= low)
        for right in (True, False):
            b = middle[open_]
            at = b if right else b - step
            fits = (at >= first[open_]) & (at + step <= end[open_])
            who, at = open_[fits], at[fits]
            upto = np.minimum(high, most[who])
            lo, hi = (at + low, np.minimum(at + upto, end[who] - step)) if right else (np.maximum(at - upto, first[who]), at - low)
            name = word[at] * n
            a, z = np.searchsorted(places, name + lo), np.searchsorted(places, name + hi, "right")
            many = np.where(hi >= lo, z - a, 0)
            total = np.cumsum(many)
            s = 0
            while s < len(who):  # so many candidates at once
                e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + block, "right")))
                m = many[s:e]
                x = np.repeat(np.arange(s, e), m)
                p = places[np.repeat(a[s:e] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))] - name[x]
                q, w = np.abs(p - at[x]), who[x]
                i = middle[w] if right else middle[w] - q
                start = i - names.backward(i, i + q, i - first[w])
                stop = i + q + names.forward(i, i + q, end[w] - i - q)
                ok = (start < middle[w]) & (stop > middle[w]) & (stop - start >= np.maximum(min_length, min_exponent * q))
                found.append(np.stack([w[ok], start[ok], stop[ok], q[ok]]))
                s = e
        k += 1
    return _shortest(np.concatenate(found, 1)) if found else np.zeros((4, 0), np.int64)


def _shortest(rows: np.ndarray) -> np.ndarray:
    """Of stretches with equal first three rows the one with the least last."""
    rows = rows[:, np.lexsort(rows[::-1])]
    if rows.shape[1]:
        rows = rows[:, np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(0)))]
    return rows


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """(start, end, period) with stretches of a period that overlap by that period made one."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return np.zeros((3, 0), np.int64)
    far = int(end.max()) + 1
    group = np.cumsum(np.concatenate(([0], period[1:] != period[:-1])))
    reach = np.maximum.accumulate(end + group * far) - group * far
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (start[1:] + period[1:] > reach[:-1])))
    at = np.flatnonzero(new)
    return np.stack([start[at], np.maximum.reduceat(end, at), period[at]])


def find_runs(words: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> np.ndarray:
    """(start, end, period) of all runs by start and period; texts laid end to end share no word number."""
    if len(words) < max(2, min_length):
        return np.zeros((3, 0), np.int64)
    first, end = _live(words, min_length)
    if not len(first):
        return np.zeros((3, 0), np.int64)
    size = end - first
    base = np.cumsum(size) - size  # where each stretch begins once they are laid end to end
    stretch = np.repeat(np.arange(len(size)), size)
    shift = first - base
    live = words[np.arange(len(stretch)) + shift[stretch]]
    g = Grammar(live, stretch)
    worth = np.flatnonzero(g.end - g.first >= min_length)
    border = g.border[~np.isin(g.border, base, assume_unique=True)]
    of = stretch[border]
    f = np.concatenate([g.first[worth], base[of]])
    m = np.concatenate([g.middle[worth], border])
    e = np.concatenate([g.end[worth], base[of] + size[of]])
    names = Names(live, int(size.max()))
    who, start, stop, period = _crossing(names, f, m, e, min_length, min_exponent)
    # runs inside a nonterminal go to all its places
    inside = who < len(worth)
    rule = worth[who[inside]]
    order = np.argsort(g.put[0], kind="stable")
    rules, places = g.put[0][order], g.put[1][order]
    a, z = np.searchsorted(rules, rule), np.searchsorted(rules, rule, "right")
    n = z - a
    x = np.repeat(np.arange(len(rule)), n)
    move = places[np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] - g.first[rule][x]
    start = np.concatenate([start[inside][x] + move, start[~inside]])
    stop = np.concatenate([stop[inside][x] + move, stop[~inside]])
    period = np.concatenate([period[inside][x], period[~inside]])
    start, stop, period = _merged(start, stop, period)
    zero = np.zeros(len(start), np.int64)
    _, start, stop, period = _shortest(np.stack([zero, start, stop, period]))
    order = np.lexsort((period, start))
    start, stop, period = start[order], stop[order], period[order]
    moved = shift[stretch[start]]
    return np.stack([start + moved, stop + moved, period])


def periodic_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3, text_col: str = "text") -> DataFrame:
    """Documents with ``runs``, an array of (start, length, period) in words by start and period, and ``collapsed``: the words that stand
    in no run after its first period, joined by one space. ``min_exponent`` is 3 at least.
    """
    if min_exponent < 3 or min_length < 3:
        raise ValueError("runs of fewer than three periods or words need another search")
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    source = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("words__"))
    schema = T.StructType([f for f in docs.select(*kept).schema] + [T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            texts = [t.as_py().split() for t in batch.column(len(kept)).cast(pa.binary())]
            ids, at, top = [], [0], 0
            for words in texts:
                if len(words) >= min_length:
                    number = dict(zip(dict.fromkeys(words), range(top, top + len(words)), strict=False))
                    ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                    top += len(number)
                at.append(at[-1] + (len(words) if len(words) >= min_length else 0))
            start, end, period = find_runs(np.concatenate(ids) if ids else np.zeros(0, np.int64), min_length, min_exponent)
            cut = np.searchsorted(start, at)
            runs, left = [], []
            for k, words in enumerate(texts):
                rows = slice(cut[k], cut[k + 1])
                s, e, q = start[rows] - at[k], end[rows] - at[k], period[rows]
                runs.append([{"start": a, "length": b, "period": c} for a, b, c in zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)])
                if len(s):
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, s + q, 1)
                    np.add.at(cover, e, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                left.append(b" ".join(words).decode("utf-8", "replace"))
            arrays = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(runs, kind), pa.array(left, pa.string())], [*kept, "runs", "collapsed"])

    return source.mapInArrow(run, schema)


def altered(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of some texts going round: where 10 divides crc32(doc_id), the words from a = g % n on have the
    period 1 + (n - a) // (3 + g % 8), g = crc32 // 10. Other texts, and those without an id, stay.
    """
    crc = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8"))
    words = F.array_remove(F.split("text", SPACE), "")
    d = docs.select("doc_id", "text", F.floor(crc / 10).alias("g"), F.when(crc % 10 == 0, words).alias("w"))
    d = d.select("*", F.when(F.size("w") > 0, F.size("w").cast("long")).alias("n"))
    d = d.select("*", (F.col("g") % F.col("n")).alias("a"))
    d = d.select("*", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).alias("p"))
    turned = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, get(w, cast(a + (i - a) % p as int)))), ' ')")
    return d.select("doc_id", F.when(F.col("n").isNotNull(), turned).otherwise(F.col("text")).alias("text"))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = periodic_runs(altered(docs)).drop("text")
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    runs_text = F.when(F.size("runs") > 0, F.concat(F.array_join(listed, "\n"), F.lit("\n"))).otherwise("")
    # exact: lengths by the other's period; an equal later run doesn't replace an earlier one
    best = F.aggregate("runs", F.lit(None).cast(RUNS.elementType), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(runs_text, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
