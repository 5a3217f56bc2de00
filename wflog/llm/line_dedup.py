"""Line dedup: exact copies and near copies of earlier lines are removed.

Lines are read in the order (document id, line number). A line is removed when the same line, or one
within its budget of edits, stands earlier. The budget of two lines is one edit per ``per_edit`` characters of the
shorter, at most ``edits``. Near copies are found by a segment-partition join: a line
with a budget of k is indexed by its k + 1 segments; a line that is within the budget must hold one
of them unchanged, near the same place. Each line therefore probes, for every length that the budget
allows, the substrings that can align with a segment (multi-match-aware selection of positions).
Character-count signatures prune what meets, a banded bit-parallel edit distance verifies it.

Scale: lines are rows of a few numbers; only lines of candidate pairs are fetched again, from
compressed texts. The index is deduplicated within each task, so a line that stands everywhere costs each
task a dozen rows. What leaves a key's group is linear in its rows: a few pairs per row, or, where a group
is large or nearly all of it agrees (lines of one template), the rows themselves. Such rows are
read again with their lines in the order of their places, and each looks for one earlier line within its
budget: among lines that share a segment of a new partition, whose cuts give each segment an equal part of what varies
in the group. A group above ``block`` rows, or a few million characters, is solved in blocks and then dealt out by those segments, again and again
(what even that leaves in one group is dealt out as pairs of blocks), so no group is held whole. The result has all removed lines, each with one earlier line; the
links among the lines of a template, which may be millions, are not listed.

Edge cases: lines without a word are never touched; null text stays null; lines below ``per_edit`` characters
have no edits to spend; repeated rows (same id and text) are treated alike: neither is earlier;
null ids come last; ids may be of any type that sorts; very long texts are worked through whole, one at a time; a document that loses all its lines is dropped by the pipeline stage; empty
tables give empty results; other columns pass through.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bring_back, hide, materialize, pack, replaced, small_batches, unpack_one
from .rolling import mix, prefixes, substring

CHUNK = 1 << 19
#: Characters of lines of one group that are compared at once.
LINES = 1 << 22
#: Keys are even and not negative; odd ones are probes.
_KEY = np.uint64((1 << 63) - 2)


def split_lines(texts: list[str]):
    """(codes, text of each line, line number, start, end) of all lines that hold a word, over the joined texts."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.concatenate((np.flatnonzero(codes == 10), [len(codes)]))
    start = np.concatenate(([0], breaks[:-1] + 1))
    size = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(size)
    text = np.searchsorted(ends, start, side="right")
    first = np.searchsorted(start, ends - size)
    number = np.arange(len(start)) - first[text]
    solid = np.append((codes > 32) | (codes < 9) | ((codes > 13) & (codes < 32)), False)
    keep = np.logical_or.reduceat(solid, start)
    return codes, text[keep], number[keep], start[keep], breaks[keep]


def identities(codes: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = True):
    """Two 64-bit hashes of each line (or one), its id (character counts modulo 16 in 8 classes above 32 bits of hash), the prefix sums."""
    p = prefixes(codes)
    h1 = substring(p, start, end) ^ (end - start).astype(np.uint64)
    h2 = substring(prefixes(codes, 1), start, end, 1) if second else None
    step = np.zeros(len(codes) + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    kind = codes[inside] * np.uint32(0x9E3779B1) >> np.uint32(29)
    counts = np.bincount(np.repeat(np.arange(len(start)) * 8, end - start) + kind, minlength=8 * len(start)).reshape(-1, 8) % 16
    signature = (counts.astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)
    return h1, h2, signature << np.uint64(32) | h1 & np.uint64(0xFFFFFFFF), p


def signature_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least sum of count differences of two ids; an edit changes it by 2 at most."""
    total = np.zeros(np.broadcast(a, b).shape, np.uint8)
    for k in range(8):
        shift = np.uint64(32 + 4 * k)
        d = ((a >> shift) - (b >> shift)).astype(np.uint8) & np.uint8(15)
        total += np.minimum(d, np.uint8(16) - d)
    return total


def segments(n: np.ndarray, edits: int):
    """Starts and lengths of the edits + 1 segments of lines of length n; the last are one longer where n doesn't divide."""
    k = edits + 1
    short, longer = n // k, n % k
    out, at = [], np.zeros_like(n)
    for i in range(k):
        size = short + (i >= k - longer)
        out.append((at, size))
        at = at + size
    return out


def places(k: int, shorter: int) -> list[tuple[int, int]]:
    """(segment, shift) at which a line can hold a segment of one that is ``shorter`` characters shorter, within k edits."""
    return [(i, d) for i in range(k + 1) for d in range(max(-i, shorter - (k - i)), min(i, shorter + (k - i)) + 1)]


def budget(n: np.ndarray, edits: int, per_edit: int) -> np.ndarray:
    return np.minimum(edits, n // per_edit)


def segment_key(p: np.ndarray, s: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    h = substring(p, s, s + size) ^ (length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))
    return h ^ h >> np.uint64(31)


def index_rows(start, end, ids, p, edits: int, per_edit: int):
    """(key, id) of index rows (even keys) and probe rows (odd keys)."""
    keys, who = [], []
    n = end - start
    own = budget(n, edits, per_edit)
    for k in range(1, edits + 1):
        for shorter in range(k + 1):  # this line against indexed lines of its length or less
            row = np.flatnonzero(budget(n - shorter, edits, per_edit) == k) if shorter else np.flatnonzero(own == k)
            length = n[row] - shorter
            cut = segments(length, k)
            for i, shift in places(k, shorter):
                at, size = cut[i]
                ok = (at + shift >= 0) & (at + shift + size <= n[row])
                h = segment_key(p, start[row[ok]] + at[ok] + shift, size[ok], length[ok], i)
                # the same place at the same length is the index row itself
                keys.append(h & _KEY | np.uint64(bool(shorter or shift)))
                who.append(ids[row[ok]])
    return np.concatenate(keys), np.concatenate(who)


def _texts(batches, *columns):
    """Batches -> lists of rows with about CHUNK characters; the last column is the text."""
    rows, size = [], 0
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if rows and size + len(r[-1]) > CHUNK:
                yield rows
                rows, size = [], 0
            rows.append(r)
            size += len(r[-1])
    if rows:
        yield rows


def _line_rows(batches):
    names = ["row_id", "th", "no", "h1", "h2", "id", "n"]
    id_type = None

    def known_type():
        nonlocal id_type
        for batch in batches:
            id_type = batch.schema.field("row_id").type
            yield batch

    for rows in _texts(known_type(), "row_id", "th", "text"):
        codes, text, number, start, end = split_lines([r[2] for r in rows])
        if not len(start):
            continue
        h1, h2, ids, _ = identities(codes, start, end)
        owner = pa.array([r[0] for r in rows], id_type).take(pa.array(text))
        th = np.array([r[1] for r in rows], np.int64)[text]
        yield pa.RecordBatch.from_arrays([owner, pa.array(th), pa.array(number.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (h1, h2, ids)), pa.array((end - start).astype(np.int32))], names)


def _index_maker(edits: int, per_edit: int):
    def make(batches):
        seen = np.empty(0, np.uint64)
        for rows in _texts(batches, "text"):
            codes, _, _, start, end = split_lines([r[0] for r in rows])
            long_ = end - start >= per_edit
            if not long_.any():
                continue
            start, end = start[long_], end[long_]
            h1, _, ids, p = identities(codes, start, end, second=False)
            _, first = np.unique(h1, return_index=True)
            first = first[~np.isin(h1[first], seen)]
            seen = np.concatenate((seen, h1[first])) if len(seen) < 1 << 21 else h1[first]  # bounded; a line let through twice is harmless
            key, who = index_rows(start[first], end[first], ids[first], p, edits, per_edit)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(who.view(np.int64))], ["key", "id"])

    return make


def _pair_maker(edits: int, block: int, dense: int = 8):
    """Rows sorted by (key, id) -> pairs of ids (kind 0: a, b) and rows of large or dense groups (kind 1 index, 2 probe: a key, b id)."""

    def group_pairs(rows: np.ndarray, cols: np.ndarray, tile: int = 512):
        """Pairs of the first ``rows`` ids of a group with all of it; None when there are many a row."""
        a, b, total = [], [], 0
        for i in range(0, len(rows), tile):
            r, c = np.nonzero(signature_gap(rows[i : i + tile, None], cols[None, i:]) <= 2 * edits)
            r, c = r + i, c + i
            keep = r < c
            total += int(keep.sum())
            if total > dense * len(cols):
                return None
            a.append(rows[r[keep]])
            b.append(cols[c[keep]])
        return np.concatenate(a), np.concatenate(b)

    def pairs_in(key: np.ndarray, ids: np.ndarray, large: int = 64):
        """Of whole groups: (pairs, keys and ids of groups to be passed on)."""
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])))
        key, ids = key[fresh], ids[fresh]
        group = key >> np.uint64(1)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.concatenate((first, [len(key)])))
        index = key & np.uint64(1) == 0
        use = (size > 1) & index[first]
        small = use & (size <= large)
        left = np.repeat(np.where(small, first + size, 0), size)
        at = np.flatnonzero((left > 0) & index)
        a, b, passed, step = [], [], [], 1
        while len(at):
            at = at[at + step < left[at]]
            x, y = ids[at], ids[at + step]
            near = signature_gap(x, y) <= 2 * edits
            a.append(x[near])
            b.append(y[near])
            step += 1
        for s, n in zip(first[use & ~small], size[use & ~small], strict=True):
            found = group_pairs(ids[s : s + int(index[s : s + n].sum())], ids[s : s + n]) if n <= block else None
            if found is None:
                passed.append(np.arange(s, s + n))
            else:
                a.append(found[0])
                b.append(found[1])
        a, b = np.concatenate(a or [ids[:0]]), np.concatenate(b or [ids[:0]])
        out = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        out = out[out[:, 0] != out[:, 1]]
        passed = np.concatenate(passed or [np.empty(0, np.int64)])
        return out[:, 0], out[:, 1], key[passed], ids[passed]

    def rows_out(a, b, key, ids):
        kind = np.concatenate((np.zeros(len(a), np.int8), (key & np.uint64(1)).astype(np.int8) + np.int8(1)))
        first, second = np.concatenate((a, key & ~np.uint64(1))), np.concatenate((b, ids))
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(first.view(np.int64)), pa.array(second.view(np.int64))], ["kind", "a", "b"])

    def make(batches):
        none = np.empty(0, np.uint64)
        key = ids = none
        streamed = None  # a group too large to hold: its rows are passed on as they come (False: no index row, left out)
        for batch in _and_none(batches):
            if batch is not None:
                now = tuple(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "id"))
                if streamed is not None:
                    n = int(np.searchsorted(now[0] >> np.uint64(1), streamed[0], side="right"))
                    if n and streamed[1]:
                        yield rows_out(none, none, now[0][:n], now[1][:n])
                    now = tuple(x[n:] for x in now)
                    streamed = streamed if not len(now[0]) else None
                key, ids = np.concatenate((key, now[0])), np.concatenate((ids, now[1]))
                if not len(key):
                    continue
                cut = int(np.searchsorted(key >> np.uint64(1), key[-1] >> np.uint64(1)))
            else:
                cut = len(key)
            if cut:
                yield rows_out(*pairs_in(key[:cut], ids[:cut]))
                key, ids = key[cut:], ids[cut:]
            if len(key) > 4 * block:
                streamed = (key[0] >> np.uint64(1), key[0] & np.uint64(1) == 0)
                if streamed[1]:
                    yield rows_out(none, none, key, ids)
                key = ids = none

    return make


def _and_none(batches):
    yield from batches
    yield None


def banded_distance(a: str, b: str, edits: int) -> int:
    """Edit distance of two texts, edits + 1 when above ``edits``: bit-parallel over a band of 2 * edits + 1 diagonals.

    A word of the band holds the vertical differences around the diagonal; it moves down a row for each
    character of ``b``. Equal fronts and ends are cut off first.
    """
    n = min(len(a), len(b))
    low, high = 0, n
    while low < high:  # longest common front
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    a, b = a[low:], b[low:]
    n = min(len(a), len(b))
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            low = mid
        else:
            high = mid - 1
    a, b = a[: len(a) - low], b[: len(b) - low]
    if len(a) < len(b):
        a, b = b, a
    m, k = len(a), len(b)
    if m - k > edits:
        return edits + 1
    if not k:
        return m
    # rows are characters of a, columns characters of b; bit i of the band is row column + i - edits
    width = 2 * edits + 1
    full = (1 << width) - 1
    vp, vn = (full << edits) & full, 0
    score = 0  # value on the main diagonal row == column
    masks: dict[str, int] = {}
    for i in range(min(edits, m)):
        masks[a[i]] = masks.get(a[i], 0) | 1 << i
    for j in range(k):  # column j + 1; position i of a stands at bit i - j + edits
        i = j + edits
        if i < m:
            masks[a[i]] = masks.get(a[i], 0) | 1 << i
        at = masks.get(b[j], 0)
        eq = (at >> (j - edits) if j >= edits else at << (edits - j)) & full
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | ~(d0 | vp) & full
        hn = d0 & vp
        if not d0 >> edits & 1:
            score += 1
        if score > 2 * edits + 1:
            return edits + 1
        x = d0 >> 1
        vp = (hn | ~(x | hp) & full) & full
        vn = x & hp & full
    # down the last column from row k to row m
    for i in range(m - k):
        score += (vp >> (edits + i) & 1) - (vn >> (edits + i) & 1)
    return score if score <= edits else edits + 1


def plain_distance(a: str, b: str) -> int:
    """By dynamic programming; for tests."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def _cut_lines(batches):
    """(packed text, line numbers) -> (id, h1, h2, no, line) with the document's id."""
    for batch in batches:
        out = {k: [] for k in ("id", "h1", "h2", "no")}
        lines, owner = [], []
        for i, (z, want) in enumerate(zip(batch.column("z").to_pylist(), batch.column("want").to_pylist(), strict=True)):
            split = unpack_one(z).decode("utf-8", "surrogatepass").split("\n")
            for r in want:
                for k in out:
                    out[k].append(r[k])
                lines.append(split[r["no"]])
                owner.append(i)
        cols = [pa.array(v, pa.int32() if k == "no" else pa.int64()) for k, v in out.items()]
        at = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row_id").take(at), batch.column("th").take(at), *cols, pa.array(lines, pa.string())], ["row_id", "th", *out, "line"])


def _verifier(edits: int, per_edit: int):
    @F.pandas_udf(T.BooleanType())
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within(x, y, edits, per_edit) for x, y in zip(a, b, strict=True)], dtype=bool)

    return near


def within(a: str, b: str, edits: int, per_edit: int) -> bool:
    k = min(edits, min(len(a), len(b)) // per_edit)
    return banded_distance(a, b, k) <= k


def common_length(p: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How far the texts at x and y agree, at most ``most``: by halving, over prefix sums."""
    got = np.zeros(len(x), np.int64)
    step = 1 << max(0, int(most.max()).bit_length() - 1) if len(x) else 0
    while step:
        i = np.flatnonzero(got + step <= most)
        s, t = x[i] + got[i], y[i] + got[i]
        got[i[substring(p, s, s + step) == substring(p, t, t + step)]] += step
        step >>= 1
    return got


def seem_near(p: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, k: int) -> np.ndarray:
    """Whether the texts of lengths na, nb at a, b look to be within k edits: furthest places reached on each diagonal, by hashes."""
    far = {0: common_length(p, a, b, np.minimum(na, nb))}
    goal = nb - na
    out = (goal == 0) & (far[0] >= na)
    for e in range(1, k + 1):
        new = {}
        for d in range(-e, e + 1):
            best = np.full(len(a), -1, np.int64)
            for j, gain in ((d, 1), (d - 1, 0), (d + 1, 1)):
                if j in far:
                    best = np.maximum(best, np.where(far[j] >= 0, far[j] + gain, -1))
            best = np.minimum(np.minimum(best, na), nb - d)
            ok = np.flatnonzero((best >= 0) & (best + d >= 0) & ~out & ((goal == d) if e == k else True))
            reach = np.full(len(a), -1, np.int64)
            i = best[ok]
            reach[ok] = i + common_length(p, a[ok] + i, b[ok] + i + d, np.minimum(na[ok] - i, nb[ok] - i - d))
            new[d] = reach
            out |= (goal == d) & (reach >= na)
        far = new
    return out


def even_cuts(codes: np.ndarray, start: np.ndarray, length: int, k: int) -> list[int]:
    """k cuts that give each segment an equal part of what varies among the lines of ``length``."""
    cuts = [length * i // (k + 1) for i in range(1, k + 1)]
    if len(start) > 1:
        some = start[: max(2, min(512, (1 << 21) // length))]
        grid = np.sort(codes[some[:, None] + np.arange(length)], axis=0)
        kinds = 1 + np.count_nonzero(grid[1:] != grid[:-1], axis=0)
        sums = np.cumsum(np.log(kinds) + 1e-4)
        cuts = np.searchsorted(sums, sums[-1] * np.arange(1, k + 1) / (k + 1)).tolist()
    low = 0
    for i in range(k):  # no segment is empty
        low = cuts[i] = min(max(cuts[i], low + 1), length - k + i)
    return cuts


def segment_rows(p: np.ndarray, start: np.ndarray, n: np.ndarray, length: np.ndarray, cuts: np.ndarray, k: int):
    """(key, line) for lines of ``length`` to ``length`` + k characters, cut at ``cuts`` (a row of k for each line)."""
    keys, who = [], []
    edge = np.concatenate((np.zeros((len(n), 1), np.int64), cuts, length[:, None]), axis=1)
    for shorter in range(k + 1):
        row = np.flatnonzero(n - length == shorter)
        for i, shift in places(k, shorter):
            at, size = edge[row, i] + shift, edge[row, i + 1] - edge[row, i]
            ok = (at >= 0) & (at + size <= n[row])
            keys.append(segment_key(p, start[row[ok]] + at[ok], size[ok], length[row[ok]], i))
            who.append(row[ok])
    return np.concatenate(keys), np.concatenate(who)


class Group:
    """Lines in the order of their places, joined for vectorised comparison."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = np.array([len(x) for x in lines])
        end = np.cumsum(self.n)
        self.start = end - self.n
        _, _, self.ids, self.p = identities(self.codes, self.start, end, second=False)

    def look_back(self, key: np.ndarray, row: np.ndarray, settled: np.ndarray, edits: int, per_edit: int) -> np.ndarray:
        """For each line an earlier one of an equal key within its budget, or -1; lines that are ``settled`` look for none.

        Each line walks back through the lines of its keys until it meets one within the budget.
        """
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
        key, row = key[fresh], row[fresh]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        found = np.full(len(self.lines), -1, np.int64)
        at, step, width = np.arange(len(key)), 1, 1
        while True:
            at = at[(at - step >= first[at]) & (found[row[at]] < 0) & ~settled[row[at]]]
            if not len(at):
                return found
            back = at[:, None] - np.arange(step, step + width)
            i, j = np.nonzero(back >= first[at][:, None])
            a, b = row[at[i]], row[back[i, j]]
            hope = signature_gap(self.ids[a], self.ids[b]) <= 2 * edits
            a, b = a[hope], b[hope]
            if len(a):
                near = seem_near(self.p, self.start[a], self.n[a], self.start[b], self.n[b], edits)
                for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                    if found[x] < 0 and within(self.lines[x], self.lines[y], edits, per_edit):
                        found[x] = y
            step += width
            width = max(1, min(2 * width, (1 << 18) // len(at)))  # few lines are left after the first steps in most groups


def _look_back_maker(edits: int, per_edit: int, block: int | None, small: int = 48):
    """Rows (k, length, first, h1, h2, line, settled) sorted by (k, first) -> found links and the rows of groups above ``block``.

    Without a block every group is solved whole: the last level, whose groups were dealt out small enough.
    """

    def rows_out(t, found: np.ndarray, settled: np.ndarray, cuts: list[int] | None):
        """Cuts are given for a group above ``block``: all its rows go on."""
        h1, h2 = (t.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
        keep = np.flatnonzero(found >= 0) if cuts is None else np.arange(len(found))
        hit = found[keep]
        w = [pa.array(np.where(hit >= 0, h[hit], 0), mask=hit < 0) for h in (h1, h2)]
        at = pa.array(keep)
        line = pa.nulls(len(found), t.column("line").type) if cuts is None else t.column("line")
        cols = [t.column(c).take(at) for c in ("k", "length", "first", "h1", "h2")] + [line.take(at), pa.array(settled[keep] | (hit >= 0)), pa.array([cuts] * len(keep), pa.list_(pa.int32())), *w]
        return pa.RecordBatch.from_arrays(cols, ["k", "length", "first", "h1", "h2", "line", "settled", "cuts", "w1", "w2"])

    def joined(parts: list):
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return t, Group(t.column("line").to_pylist()), t.column("settled").to_numpy(zero_copy_only=False)

    def solve_small(parts: list):
        """Many groups at once, each line against all of its group."""
        t, g, settled = joined(parts)
        return rows_out(t, g.look_back(t.column("k").to_numpy(), np.arange(len(g.n)), settled, edits, per_edit), settled, None)

    def solve(parts: list, cuts: list[int] | None, hot: bool):
        """One group, or a block of one, by the segments of its own partition."""
        t, g, settled = joined(parts)
        length = t.column("length")[0].as_py()
        k = min(edits, length // per_edit)
        if cuts is None:
            cuts = even_cuts(g.codes, g.start[g.n == length], length, k)
        key, row = segment_rows(g.p, g.start, g.n, np.full(len(g.n), length), np.tile(np.array(cuts, np.int64), (len(g.n), 1)), k)
        return rows_out(t, g.look_back(key, row, settled, k, per_edit), settled, cuts if hot else None), cuts

    def make(batches):
        waiting, n_waiting, chars = [], 0, 0  # small groups
        parts, size, key, cuts, hot, length, most = [], 0, None, None, False, 0, 2

        def close():
            nonlocal waiting, n_waiting, chars
            if hot or size > small:
                yield solve(parts, cuts, hot)[0]
            elif size > 1:
                waiting, n_waiting = waiting + parts, n_waiting + size
                chars += size * length
                if n_waiting > 4096 or chars > LINES:
                    yield solve_small(waiting)
                    waiting, n_waiting, chars = [], 0, 0

        for batch in batches:
            k, lengths = (batch.column(c).to_numpy() for c in ("k", "length"))
            edge = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)] if len(k) else [0]
            for s, e in zip(edge, edge[1:], strict=False):
                if k[s] != key:
                    yield from close()
                    parts, size, key, cuts, hot, length = [], 0, k[s], None, False, int(lengths[s])
                    most = max(2, min(block, LINES // length)) if block else 1 << 62
                while s < e:
                    if size == most:
                        hot = True
                        out, cuts = solve(parts, cuts, hot)
                        yield out
                        parts, size = [], 0
                    n = min(e - s, most - size)
                    parts.append(batch.slice(s, n))
                    s, size = s + n, size + n
        yield from close()
        if waiting:
            yield solve_small(waiting)

    return make


def _deal_maker(edits: int, per_edit: int):
    """Rows of groups above a block -> one row for each segment, keyed by it."""
    names = ["length", "first", "h1", "h2", "line", "settled"]

    def make(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = batch.column("line").to_pylist()
            codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
            n = np.array([len(x) for x in lines])
            start = np.cumsum(n) - n
            p = prefixes(codes)
            group = batch.column("k").to_numpy().view(np.uint64)
            length = batch.column("length").to_numpy().astype(np.int64)
            cuts = batch.column("cuts").to_pylist()
            k = np.array([len(c) for c in cuts])
            for kk in range(1, edits + 1):
                at = np.flatnonzero(k == kk)
                if not len(at):
                    continue
                key, row = segment_rows(p, start[at], n[at], length[at], np.array([cuts[i] for i in at], np.int64), kk)
                key = mix(key + mix(group[at[row]]))
                by = np.lexsort((row, key))
                again = np.flatnonzero((key[by][1:] == key[by][:-1]) & (row[by][1:] == row[by][:-1])) + 1  # a repeated substring meets at two shifts
                by = np.delete(by, again)
                key, row = key[by], row[by]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch.column(c).take(pa.array(at[row])) for c in names)], ["k", *names])

    return make


def template_links(rows: DataFrame, edits: int, per_edit: int, block: int, depth: int = 4) -> DataFrame:
    """(k, length, first, h1, h2, line) -> (h1, h2, w1, w2): for each line with an earlier one within its budget in a group, one such."""
    order = rows.schema["first"].dataType.simpleString()
    dealt = f"k long, length int, first {order}, h1 long, h2 long, line string, settled boolean"
    rows, found = rows.withColumn("settled", F.lit(False)), []
    for level in range(depth + 1):
        run = rows.repartition("k").sortWithinPartitions("k", "first").mapInArrow(_look_back_maker(edits, per_edit, block if level < depth else None), dealt + ", cuts array<int>, w1 long, w2 long")
        run = materialize(run, "line-templates")
        found.append(run.where("w1 is not null").select("h1", "h2", "w1", "w2"))
        rest = run.where("line is not null").drop("w1", "w2")
        if level == depth or rest.isEmpty():
            break
        rows = rest.mapInArrow(_deal_maker(edits, per_edit), dealt)
        open_ = rows.groupBy("k").agg(F.count("*").alias("rows"), F.count_if(~F.col("settled")).alias("open"))
        if level < depth - 1:
            rows = rows.join(open_.where("open > 0").select("k"), "k", "left_semi")
        else:
            # what still shares a segment in such numbers: every block of open lines meets every block
            own = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(LINES // 2) / F.col("length"))))
            rows = rows.join(open_.where("open > 0").select("k", "rows"), "k").withColumn("parts", F.ceil(F.col("rows") / own).cast("int")).withColumn("own", F.pmod(F.xxhash64("h1", "h2"), "parts").cast("int"))
            rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            rows = rows.withColumn("k", F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other"))).select("k", "length", "first", "h1", "h2", "line", "settled")
    return reduce(DataFrame.unionByName, found)


def line_links(keyed: DataFrame, firsts: DataFrame, edits: int = 2, per_edit: int = 16, block: int = 2048) -> DataFrame:
    """(row_id, th, text) and the first place of each line -> (h1, h2, w1, w2): for each line that has earlier ones within its budget, at least one of them."""
    index = keyed.select("text").mapInArrow(_index_maker(edits, per_edit), "key long, id long")
    met = index.repartition(F.col("key").bitwiseAND(F.lit(-2))).sortWithinPartitions("key", "id").mapInArrow(_pair_maker(edits, block), "kind byte, a long, b long")
    met = materialize(met.distinct(), "line-pairs")
    pairs, groups = met.where("kind = 0").select("a", "b"), met.where("kind > 0")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(groups.select(F.col("b").alias("id"))).distinct()
    place = firsts.where(F.col("n") >= per_edit).join(ids, "id", "left_semi")
    want = place.groupBy("first.row_id", "first.th").agg(F.collect_list(F.struct("id", "h1", "h2", F.col("first.no").alias("no"))).alias("want"))
    texts = keyed.select("row_id", "th", pack(F.col("text")).alias("z"))
    both = texts.alias("t").join(want.alias("w"), F.col("t.row_id").eqNullSafe(F.col("w.row_id")) & (F.col("t.th") == F.col("w.th"))).select("t.row_id", "t.th", "z", "want")
    id_type = keyed.schema["row_id"].dataType.simpleString()
    lines = both.mapInArrow(_cut_lines, f"row_id {id_type}, th long, id long, h1 long, h2 long, no int, line string").dropDuplicates(["h1", "h2"])
    lines = materialize(lines.select("id", "h1", "h2", order_of_lines().alias("first"), "line"), "line-texts")
    side = lambda c: lines.select(F.col("id").alias(c), F.struct("first", "h1", "h2", "line").alias(f"{c}_"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").where(_verifier(edits, per_edit)("a_.line", "b_.line"))
    later, earlier = F.greatest("a_", "b_"), F.least("a_", "b_")
    links = materialize(links.select(later["h1"].alias("h1"), later["h2"].alias("h2"), earlier["h1"].alias("w1"), earlier["h2"].alias("w2")), "line-links")
    if groups.isEmpty():
        return links
    rows = groups.groupBy(F.col("a").alias("k"), F.col("b").alias("id")).agg(F.min("kind").alias("kind")).join(lines, "id")
    length = rows.groupBy("k").agg(F.min(F.when(F.col("kind") == 1, F.length("line"))).alias("length"))
    rows = rows.join(length, "k").where("length is not null and length(line) >= length")
    return links.unionByName(template_links(rows.select("k", "length", "first", "h1", "h2", "line"), edits, per_edit, 2 * block))


def order_of_lines():
    """Places in reading order."""
    return F.struct(F.col("row_id").isNull().alias("none"), "row_id", "th", "no")


def line_dedup(docs: DataFrame, edits: int = 2, per_edit: int = 16, id_col: str = "doc_id", text_col: str = "text", block: int = 2048) -> DataFrame:
    """Documents with ``line_dedup`` = struct(n_lines, n_exact, n_near, n_links) and ``kept_text``.

    n_exact: lines removed as copies of earlier ones, n_near: as near copies, n_links: its lines whose text is linked to a different earlier line
    (lines removed as copies included).
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    keyed = docs.where(text.isNotNull()).select(F.col(id_col).alias("row_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    id_type = keyed.schema["row_id"].dataType.simpleString()
    lines = materialize(keyed.mapInArrow(_line_rows, f"row_id {id_type}, th long, no int, h1 long, h2 long, id long, n int"), "line-rows")
    place = order_of_lines()
    firsts = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("id").alias("id"), F.min("n").alias("n"))
    firsts = materialize(firsts.withColumn("copied", F.col("first") < F.col("last")).drop("last"), "line-firsts")
    near = line_links(keyed, firsts, edits, per_edit, block).select("h1", "h2").distinct().withColumn("linked", F.lit(True))
    # only lines that are copied or linked are looked up again; written, so that a line of very many documents can be split in the join
    known = firsts.join(near, ["h1", "h2"], "left").where(F.col("copied") | F.col("linked")).select("h1", "h2", "first", F.coalesce("linked", F.lit(False)).alias("linked"))
    known = materialize(known, "line-known")
    seen = lines.join(known, ["h1", "h2"]).select("row_id", "th", "no", (place > F.col("first")).alias("exact"), "linked").where("exact or linked")
    # repeated rows give the same places twice: each is listed once
    listed = lambda test: F.size(F.collect_set(F.when(test, F.col("no")))).cast("long")
    per = seen.groupBy("row_id", "th").agg(
        listed(F.col("exact")).alias("n_exact"),
        listed(~F.col("exact")).alias("n_near"),
        listed(F.col("linked")).alias("n_links"),
        F.collect_set("no").alias("gone"),
    )
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(text).alias("th"))
    out = row.alias("d").join(per.alias("p"), F.col("d.row_id").eqNullSafe(F.col("p.row_id")) & (F.col("d.th") == F.col("p.th")), "left")
    # the lines are bound once, so a text is split once
    kept = F.expr("if(p.gone is null, whole, element_at(transform(array(split(whole, '\n', -1)), x -> array_join(transform(array_except(sequence(0, size(x) - 1), p.gone), i -> get(x, i)), '\n')), 1))")
    zero = F.lit(0).cast("long")
    n_lines = F.coalesce(F.size(F.filter(F.split("whole", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long")
    stats = F.struct(n_lines.alias("n_lines"), *[F.coalesce(f"p.{c}", zero).alias(c) for c in ("n_exact", "n_near", "n_links")])
    return out.withColumn("whole", F.col("d.row").getField(text_col)).select(*replaced(docs, "line_dedup", "kept_text"), stats.alias("line_dedup"), kept.alias("kept_text"))


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without removed lines; a document that loses all its lines goes.

    Null texts and texts without a word stay as they are; repeated rows keep the same lines; n_chars follows the text; an empty table gives none.
    """
    new = ("line_dedup", "kept_text")
    out = line_dedup(hide(docs, *new))
    lost = F.col("line_dedup.n_exact") + F.col("line_dedup.n_near")
    out = out.where((lost == 0) | (lost < F.col("line_dedup.n_lines")))
    changed = {"text": F.col("kept_text"), "n_chars": F.when(lost > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[changed[c].alias(c) if changed.get(c) is not None else own for c, own in zip(docs.columns, bring_back(docs, *new), strict=True)])


def op8(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"line_dedup.{c}").alias(c) for c in ("n_lines", "n_exact", "n_near", "n_links")], F.md5("kept_text").alias("kept_md5"))
