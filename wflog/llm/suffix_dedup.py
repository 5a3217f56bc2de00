"""Suffix-array dedup: bytes covered by a 200-byte string that also starts anywhere else are removed.

1. Sampling. In every 200-byte window the 64-byte piece of least hash (the leftmost of equals) is its
   anchor; equal windows have equal anchors. A window belongs to its anchor; an anchor's windows start
   at consecutive bytes, and the text from the first to the end of the last is its snippet.
2. Anchors that occur once in the corpus have no repeated window and go; nothing else does. A task
   that meets an anchor twice sends one mark to the anchor's partition and deals the rows out evenly, so a frequent
   anchor costs at most one row per batch there.
3. Equal snippets are collapsed (map-side first) to one with a count.
4. The snippets of an anchor meet in one shard of a few MB; each shard gets a suffix array by
   Larsson-Sadakane refinement (numpy) and common prefixes by Kasai's rule. Windows whose common prefix reaches 200 bytes, or
   whose snippet has copies, are repeated. An anchor with more than ``part`` different snippets is dealt to
   several shards; what stays single there is merged across shards by binary search in sorted window digests,
   which also hold one digest of each different window that a shard repeats.
5. Runs of repeated windows go back to all texts that hold the snippet, as intervals.

Scale: text crosses the network twice, compressed, by its hash; all else is rows of a few numbers, one
per about 70 bytes of text. No step gathers a group that grows with the corpus.

Edge cases: null is the empty text; texts below 200 bytes keep all; equal rows are different documents
whose strings start elsewhere, so they lose everything from 200 bytes on; null ids pass through;
empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pack, small_batches, unpack_one
from .rolling import prefixes, substring

LENGTH = 200
PIECE = 64
#: Bytes of text that are hashed, or sorted, at once.
CHUNK = 1 << 20


def owned_windows(data: np.ndarray, ends: np.ndarray):
    """Windows of the concatenated texts that end at ``ends`` -> (anchor hash, snippet hash, first start, number of starts)."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < LENGTH:
        return none.view(np.uint64), none.view(np.uint64), none, none
    p = prefixes(data)
    at = np.arange(n - PIECE + 1)
    h = substring(p, at, at + PIECE)
    low = np.uint64((1 << 28) - 1)
    order = (h & ~low) | at.astype(np.uint64)
    w = LENGTH - PIECE + 1
    blocks = -(-len(order) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(order)] = order
    grid = padded.reshape(blocks, w)
    to_right = np.minimum.accumulate(grid, axis=1).ravel()
    to_left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - LENGTH + 1)
    owner = (np.minimum(to_left[: len(starts)], to_right[w - 1 : w - 1 + len(starts)]) & low).astype(np.int64)
    text = np.searchsorted(ends, starts, side="right")
    inside = starts + LENGTH <= ends[text]
    starts, owner, text = starts[inside], owner[inside], text[inside]
    if not len(starts):
        return none.view(np.uint64), none.view(np.uint64), none, none
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]))))
    count = np.diff(np.concatenate((first, [len(starts)])))
    s = starts[first]
    return h[owner[first]], substring(p, s, s + count - 1 + LENGTH) ^ count.astype(np.uint64), s, count


def _anchor_rows(batches):
    """(th, th2, text) -> (deal, mark, h, d, th, th2, s, n); deal decides the partition, mark 1: presence only, 2: known to repeat."""
    schema = ["deal", "mark", "h", "d", "th", "th2", "s", "n"]

    def rows(texts, th, th2):
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        h, d, s, n = owned_windows(data, ends)
        if not len(h):
            return None
        which = np.searchsorted(ends, s, side="right")
        local = s - (ends - sizes)[which]
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        mark = np.zeros(len(h), np.int8)
        mark[order[many]] = 2
        deal = h.copy()
        deal[order[many]] = substring_deal(d, local, th[which])[order[many]]
        extra = order[many & new]
        cat = lambda a, b: np.concatenate((a, b))
        cols = [
            cat(deal.view(np.int64), h[extra].view(np.int64)), cat(mark, np.ones(len(extra), np.int8)), cat(h, h[extra]).view(np.int64),
            cat(d.view(np.int64), np.zeros(len(extra), np.int64)), cat(th[which], np.zeros(len(extra), np.int64)), cat(th2[which], np.zeros(len(extra), np.int64)),
            cat(local, np.zeros(len(extra), np.int64)), cat(n, np.zeros(len(extra), np.int64)).astype(np.int32),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema)

    for texts, th, th2 in chunks(batches):
        out = rows(texts, th, th2)
        if out is not None:
            yield out


def substring_deal(d: np.ndarray, local: np.ndarray, th: np.ndarray) -> np.ndarray:
    return d ^ (local.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ th.view(np.uint64)


def chunks(batches):
    """Arrow batches (th, th2, text binary) -> lists of texts of about CHUNK bytes with their hashes."""
    texts, keys, size = [], [], 0
    for batch in batches:
        th, th2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for i, t in enumerate(batch.column(2).to_pylist()):
            if len(t) < LENGTH:
                continue
            if texts and size + len(t) > CHUNK:
                k = np.array(keys, np.int64)
                yield texts, k[:, 0], k[:, 1]
                texts, keys, size = [], [], 0
            texts.append(t)
            keys.append((th[i], th2[i]))
            size += len(t)
    if texts:
        k = np.array(keys, np.int64)
        yield texts, k[:, 0], k[:, 1]


def _repeated(batches):
    """Rows sorted by (deal, h) -> those whose anchor occurs twice or more; a run may span batches."""
    names = ["h", "d", "th", "th2", "s", "n"]
    held = None  # the last row of the batch before: (h, its columns or None if given out already)
    for batch in batches:
        c = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in ("mark", *names)}
        known = c["mark"] == 2
        give = {x: [c[x][known]] for x in names}
        h = c["h"][~known]
        rest = {x: c[x][~known] for x in ("mark", *names)}
        if len(h):
            left = np.concatenate(([held is not None and held[0] == h[0]], h[1:] == h[:-1]))
            right = np.concatenate((h[1:] == h[:-1], [False]))
            sure = rest["mark"] == 1  # a presence mark stands for a repeated anchor
            again = left | right
            # rows next to a mark of the same anchor repeat as well, which left and right show
            out = again & ~sure
            if held is not None and held[1] is not None and held[0] == h[0]:
                for x in names:
                    give[x].append(held[1][x])
            for x in names:
                give[x].append(rest[x][out])
            last = len(h) - 1
            open_ = not again[last] and not sure[last]
            held = (h[last], {x: rest[x][last:] for x in names} if open_ else None)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(give[x])) for x in names], names)


def suffix_array(text: np.ndarray):
    """(suffix array, words of 8 bytes at each position, group of each position by its first 128 bytes)."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words |= padded[j : j + n] << np.uint64(56 - 8 * j)
    sa = np.argsort(words, kind="stable")
    rank = np.full(2 * n + 16, -1, np.int64)  # past the end: before everything

    def number(at: np.ndarray, key: np.ndarray):
        """Groups of equal keys among the places ``at``: the rank is the group's first place; returns the places still tied."""
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[sa[at]] = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        single = new & np.concatenate((new[1:], [True]))
        return at[~single]

    tied = number(np.arange(n), words[sa])
    depth, by_128 = 8, None
    while len(tied) and depth < n:
        if depth == 128:
            by_128 = rank[:n].copy()
        pos = sa[tied]
        key = rank[pos] << np.int64(32) | (rank[np.minimum(pos + depth, n)] + 1)
        order = np.argsort(key, kind="stable")
        sa[tied] = pos[order]
        tied = number(tied, key[order])
        depth *= 2
    return sa, words, rank[:n].copy() if by_128 is None else by_128


def kasai_reaches(sa: np.ndarray, words: np.ndarray, by_128: np.ndarray, length: int = LENGTH, stride: int = 32) -> np.ndarray:
    """For each place of the suffix array: whether its suffix shares ``length`` bytes with the one before.

    Kasai's rule, from left to right in the text: the common prefix with the suffix before shrinks by one
    byte per step at most. It is measured at every ``stride``-th position; the others start from that bound.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    maybe = np.flatnonzero((before >= 0) & (by_128 == by_128[np.maximum(before, 0)]))  # the others differ within 128 bytes
    out = np.zeros(n, bool)
    if not len(maybe):
        return out
    common = np.zeros(n, np.int64)

    def extend(pos: np.ndarray, upto: int) -> None:
        q = before[pos]
        while len(pos):
            got = common[pos]
            open_ = (got < upto) & (pos + got < n) & (q + got < n)
            pos, q, got = pos[open_], q[open_], got[open_]
            x = words[pos + got] ^ words[q + got]
            same = x == 0
            lead = np.where(same, 8, 0)
            for k in range(1, 8):  # whole equal bytes at the front of the word
                lead += (~same) & (x >> np.uint64(64 - 8 * k) == 0)
            common[pos] = np.minimum(got + lead, n - np.maximum(pos, q))  # words are filled up past the end
            pos, q = pos[same], q[same]

    head = maybe[np.concatenate(([True], maybe[1:] // stride != maybe[:-1] // stride))]
    common[head] = 120
    extend(head, length + stride)
    at = head[np.searchsorted(head, maybe, side="right") - 1]
    common[maybe] = np.maximum(np.maximum(common[at] - (maybe - at), 0), np.where(maybe == at, common[maybe], 0))
    common[maybe] = np.maximum(common[maybe], 120)
    extend(maybe, length)
    out[maybe] = common[maybe] >= length
    return out[sa]


def shard_repeats(snippets: list[bytes], counts: np.ndarray, copies: np.ndarray):
    """(one flag per window, snippet after snippet: it repeats in the shard; group of equal windows of each; text; starts)."""
    text = np.frombuffer(b"\xff".join(snippets) + b"\xff", np.uint8)
    sizes = np.array([len(s) + 1 for s in snippets])
    begin = np.cumsum(sizes) - sizes
    starts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    sa, words, by_128 = suffix_array(text)
    group = np.cumsum(~kasai_reaches(sa, words, by_128))
    of = np.empty(len(sa), np.int64)
    of[sa] = group
    total = np.bincount(of[starts], weights=np.repeat(copies, counts), minlength=int(group[-1]) + 1)
    group = of[starts]
    return total[group] > 1, group, text, starts


def runs_of(flags: np.ndarray) -> list[int]:
    """[first, last, first, last, ...] of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    edge[1::2] -= 1
    return edge.tolist()


_SHARD_OUT = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("runs", pa.list_(pa.int32())), ("w1", pa.int64()), ("w2", pa.int64()), ("off", pa.int32())])


def _shard_rows(batches, solve_size: int = CHUNK):
    """Snippets (h, part, d, copies, n, hot, snippet) sorted by (h, part) -> runs of repeated windows; of hot anchors also window digests.

    Digests are those of all single windows and of one of each different repeated window (off = -1).
    Shards are solved together up to ``solve_size`` bytes.
    """

    def solve(rows):
        h, d, copies, n, hot, snippet = zip(*rows, strict=True)
        counts = np.array(n)
        flags, group, text, starts = shard_repeats(list(snippet), counts, np.minimum(np.array(copies), 2))
        cut = np.cumsum(counts)[:-1]
        runs = [runs_of(f) for f in np.split(flags, cut)]
        out = [pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(runs, pa.list_(pa.int32()))] + [pa.nulls(len(h), t) for t in (pa.int64(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays(out, schema=_SHARD_OUT)
        wide = np.repeat(np.array(hot, bool), counts)
        again = np.flatnonzero(flags & wide)
        sent = ~flags & wide
        sent[again[np.unique(group[again], return_index=True)[1]]] = True
        if sent.any():
            row = np.repeat(np.arange(len(h)), counts)[sent]
            off = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))[sent]
            off[flags[sent]] = -1
            w = [substring(prefixes(text, k), starts[sent], starts[sent] + LENGTH, k).view(np.int64) for k in (0, 1)]
            out = [np.array(h, np.int64)[row], np.array(d, np.int64)[row], None, *w, off.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(row), pa.list_(pa.int32())) if x is None else pa.array(x) for x in out], schema=_SHARD_OUT)

    rows, size, last = [], 0, None
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("h", "d", "copies", "n", "hot", "snippet", "part")), strict=True):
            key = (r[0], r[6])
            if key != last and size > solve_size:
                yield from solve(rows)
                rows, size = [], 0
            last = key
            rows.append(r[:6])
            size += len(r[5]) + 1
    if rows:
        yield from solve(rows)


def _merge_windows(batches):
    """Digests of windows sorted by w1 -> the single ones (off >= 0) found again, in a shard that repeats them too, by binary search in the sorted digests."""
    held = None
    for batch in _and_none(batches):
        if batch is not None:
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("w1", "w2", "h", "d", "off"))
            held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))
        elif held is None:
            return
        else:
            cut = len(held[0])
        if not cut:
            continue
        part = tuple(x[:cut] for x in held)
        held = tuple(x[cut:] for x in held)
        order = np.lexsort((part[1], part[0]))
        both = np.empty(cut, [("a", np.int64), ("b", np.int64)])
        both["a"], both["b"] = part[0][order], part[1][order]
        code = np.cumsum(np.concatenate(([True], both[1:] != both[:-1])))
        found = np.searchsorted(code, code, side="right") - np.searchsorted(code, code, side="left") > 1
        hit = order[found]
        hit = hit[part[4][hit] >= 0]
        off = part[4][hit]
        yield pa.RecordBatch.from_arrays([pa.array(part[2][hit]), pa.array(part[3][hit]), pa.array([[o, o] for o in off.tolist()], pa.list_(pa.int32()))], ["h", "d", "runs"])


def _and_none(batches):
    yield from batches
    yield None


def _cut_snippets(batches):
    """(packed text, list of (h, d, s, n, copies)) -> snippet rows."""
    for batch in batches:
        out = {k: [] for k in ("h", "d", "copies", "n", "snippet")}
        for z, want in zip(batch.column("z").to_pylist(), batch.column("want").to_pylist(), strict=True):
            text = unpack_one(z)
            for r in want:
                out["h"].append(r["h"])
                out["d"].append(r["d"])
                out["copies"].append(r["copies"])
                out["n"].append(r["n"])
                out["snippet"].append(text[r["s"] : r["s"] + r["n"] - 1 + LENGTH])
        yield pa.RecordBatch.from_arrays([pa.array(out["h"], pa.int64()), pa.array(out["d"], pa.int64()), pa.array(out["copies"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["snippet"], pa.binary())], list(out))


def keep_bytes(text: bytes, hits) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal removed runs); hits: (start, [first, last, ...]) of repeated windows."""
    if not hits:
        return text, 0, 0
    step = np.zeros(len(text) + 1, np.int32)
    for s, runs in hits:
        r = np.asarray(runs, np.int64).reshape(-1, 2) + s
        np.add.at(step, r[:, 0], 1)
        np.add.at(step, r[:, 1] + LENGTH, -1)
    gone = np.cumsum(step[:-1]) > 0
    spans = int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _apply(batches):
    names = ["th", "th2", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        rows = []
        for th, th2, z, hits in zip(*(batch.column(c).to_pylist() for c in ("th", "th2", "z", "hits")), strict=True):
            text = unpack_one(z)
            kept, removed, spans = keep_bytes(text, [(x["s"], x["runs"]) for x in hits or ()])
            rows.append((th, th2, len(text), removed, spans, kept))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], names)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 4000, solve_size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(id, th, th2 of every row; th, th2, n_bytes, n_removed, n_spans, kept of every different text)."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit(1), text).alias("th2"), text.alias("text"))
    rows = keyed.select("th", "th2", F.col("text").cast("binary").alias("text")).mapInArrow(_anchor_rows, "deal long, mark byte, h long, d long, th long, th2 long, s long, n int")
    again = rows.repartition("deal").sortWithinPartitions("deal", "h").mapInArrow(_repeated, "h long, d long, th long, th2 long, s long, n int")
    again = materialize(again, "suffix-anchors")
    one = again.groupBy("h", "d").agg(F.count("*").alias("copies"), F.min(F.struct("th", "th2", "s", "n")).alias("r"))
    one = materialize(one.select("h", "d", F.least("copies", F.lit(2)).cast("int").alias("copies"), "r.*"), "suffix-snippets")
    hot = materialize(one.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > part), "suffix-hot")
    want = one.groupBy("th", "th2").agg(F.collect_list(F.struct("h", "d", "s", "n", "copies")).alias("want"))
    texts = keyed.where(F.octet_length("text") >= LENGTH).select("th", "th2", pack(F.col("text")).alias("z")).dropDuplicates(["th", "th2"])
    snippets = texts.join(want, ["th", "th2"]).mapInArrow(_cut_snippets, "h long, d long, copies int, n int, snippet binary")
    any_hot = not hot.isEmpty()
    if any_hot:
        parts = F.ceil(F.coalesce(F.col("m"), F.lit(1)) / F.lit(part))
        snippets = snippets.join(hot, "h", "left").select("h", F.pmod("d", parts).cast("int").alias("part"), "d", "copies", "n", F.col("m").isNotNull().alias("hot"), "snippet")
    else:
        snippets = snippets.select("h", F.lit(0).alias("part"), "d", "copies", "n", F.lit(False).alias("hot"), "snippet")
    found = snippets.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(partial(_shard_rows, solve_size=solve_size), "h long, d long, runs array<int>, w1 long, w2 long, off int")
    found = materialize(found.where(F.col("w1").isNotNull() | (F.size("runs") > 0)), "suffix-runs")
    runs = found.where("w1 is null").select("h", "d", "runs")
    if any_hot:
        digests = found.where("w1 is not null").select("w1", "w2", "h", "d", "off")
        runs = runs.unionByName(digests.repartition("w1").sortWithinPartitions("w1").mapInArrow(_merge_windows, "h long, d long, runs array<int>"))
    hits = again.join(runs, ["h", "d"]).groupBy("th", "th2").agg(F.collect_set(F.struct("s", "runs")).alias("hits"))
    packed = keyed.select("th", "th2", pack(F.col("text")).alias("z")).dropDuplicates(["th", "th2"])
    kept = packed.join(hits, ["th", "th2"], "left").mapInArrow(_apply, "th long, th2 long, n_bytes long, n_removed long, n_spans long, kept binary")
    return keyed.select("id", "th", "th2"), kept


def op6(spark, sf_dir: str) -> DataFrame:
    rows, kept = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = kept.select("th", "th2", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return rows.join(digest, ["th", "th2"]).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute_force(texts: list[bytes]) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by counting every window; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - LENGTH + 1):
            seen[t[i : i + LENGTH]] = seen.get(t[i : i + LENGTH], 0) + 1
    out = []
    for t in texts:
        hits = [(i, [0, 0]) for i in range(len(t) - LENGTH + 1) if seen[t[i : i + LENGTH]] > 1]
        kept, removed, spans = keep_bytes(t, hits)
        out.append((len(t), removed, spans, hashlib.sha256(kept).hexdigest()))
    return out
