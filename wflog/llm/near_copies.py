"""Near copies: texts whose sets of word 5-shingles have a Jaccard similarity of 0.8 or more, linked to components.

Candidates share one of 20 bands of 4 minimal hashes, which a pair at 0.8 misses once in 37,000 (above it less often);
shingle sets of the texts decide exactly. Fingerprints of 64 bits can't: a pair at 0.8 differs in 10 bits on
average and often in 15, where unrelated texts meet.

Scale: only different texts have bands, as rows of a few numbers. First each member of a band is held against
its least member; a large group of near copies is mostly one component after that. While a band of several components is very large, its
members are held against another member, chosen anew, as long as that joins some. What then is left of a band meets in one task with
its texts, or, above ``block`` rows, as pairs of blocks: the shingles that members share are counted by one matrix product, and what leaves the task are
spanning links, never all pairs. Texts are fetched, compressed, only for bands with more than one component.

Edge cases: null is the empty text; wordless texts are copies of each other; fewer than five words make one shingle of all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, materialize, pack, unpack_one

BANDS, ROWS = 20, 4
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_rnd = np.random.default_rng(5)
_XOR = _rnd.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_TIMES = _rnd.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Sorted different hashes of a text's shingles."""
    words = text.translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle])) for i in range(n)), np.uint64, n))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band, of the minimal hashes in it."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):  # bounded memory for very long texts
        x = (hashes[None, at : at + (1 << 12)] ^ _XOR) * _TIMES
        x ^= x >> np.uint64(29)
        low = np.minimum(low, (x * np.uint64(0xBF58476D1CE4E5B9)).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for k in low.reshape(BANDS, ROWS).T:
        key = (key ^ k) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _band_rows(shingle: int):
    def rows(batches):
        for batch in batches:
            keys, n = [], []
            for t in batch.column("t").to_pylist():
                h = shingle_hashes(t, shingle)
                keys.append(band_keys(h))
                n.append(len(h))
            key = np.concatenate(keys) if keys else np.empty(0, np.int64)
            th = np.repeat(batch.column("th").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(th), pa.array(np.repeat(np.array(n, np.int64), BANDS))], ["key", "th", "n"])

    return rows


def _similar(shingle: int, similarity: float):
    @F.pandas_udf(T.BooleanType())
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = shingle_hashes(unpack_one(x), shingle), shingle_hashes(unpack_one(y), shingle)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    return similar


def _open_bands(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, th, n) rows of bands that hold more than one component -> with root and the band's size, in texts and in shingles."""
    rooted = rows.join(roots, rows["th"] == roots["node"], "left").select("key", "th", "n", F.coalesce("root", "th").alias("root"))
    sizes = rooted.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "size", "shingles")
    return materialize(rooted.join(sizes, "key"), "near-left")


def spanning_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member that it reaches) over pairs of sets with at least that Jaccard similarity; members that reach none are absent."""
    m = len(sets)
    size = np.array([len(x) for x in sets])
    member = np.repeat(np.arange(m), size)
    _, of, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # the others are in no intersection
    column = np.cumsum(shared) - 1
    member, of = member[shared[of]], column[of[shared[of]]]
    order = np.argsort(of, kind="stable")
    member, of = member[order], of[order]
    both = np.zeros((m, m), np.float32)
    for low in range(0, int(shared.sum()), 4096):
        s, e = np.searchsorted(of, (low, low + 4096))
        flags = np.zeros((m, 4096), np.float32)
        flags[member[s:e], of[s:e] - low] = 1
        both += flags @ flags.T
    near = both >= similarity * (size[:, None] + size[None, :] - both.astype(np.float64)) - 1e-9
    np.fill_diagonal(near, True)
    label = np.arange(m)
    while True:
        new = np.where(near, label[None, :], m).min(axis=1)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(m))
    return moved, label[moved]


def _cell_links(shingle: int, similarity: float):
    """Rows (key, c1, c2, th, z) sorted by (key, c1, c2) -> spanning links of each cell."""

    def solve(parts):
        th = np.concatenate([x[0] for x in parts])
        sets = [shingle_hashes(unpack_one(z), shingle) for x in parts for z in x[1]]
        a, b = spanning_links(sets, similarity)
        return pa.RecordBatch.from_arrays([pa.array(th[a]), pa.array(th[b])], ["a", "b"])

    def make(batches):
        parts, last = [], None
        for batch in batches:
            c = [batch.column(x).to_numpy() for x in ("key", "c1", "c2")]
            if not len(c[0]):
                continue
            new = np.logical_or.reduce([x[1:] != x[:-1] for x in c])
            edge = [0, *(np.flatnonzero(new) + 1).tolist(), len(c[0])]
            th, z = batch.column("th").to_numpy(), batch.column("z").to_pylist()
            for s, e in zip(edge, edge[1:], strict=False):
                cell = tuple(x[s] for x in c)
                if parts and cell != last:
                    yield solve(parts)
                    parts = []
                last = cell
                parts.append((th[s:e], z[s:e]))
        if parts:
            yield solve(parts)

    return make


def _cells(rows: DataFrame, packed: DataFrame, block: int) -> DataFrame:
    """(key, th, size, shingles) -> rows with their texts, once for each cell: a row of block i goes to the cells {i, j} of all blocks j.

    A block is about ``block`` texts, fewer where they are long.
    """
    parts = F.greatest(F.ceil(F.col("size") / F.lit(block)), F.ceil(F.col("shingles") / F.lit(1 << 20))).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("th"), parts).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.join(packed, "th").select("key", F.least("own", "j").alias("c1"), F.greatest("own", "j").alias("c2"), "th", "z")
    return rows.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2")


def near_copies(texts: DataFrame, shingle: int = 5, similarity: float = 0.8, block: int = 500, turns: int = 6, crowded: int = 4000, pairs: DataFrame | None = None) -> DataFrame:
    """Different texts (th, text) -> (node, root) of the components of two texts and more.

    ``pairs`` (a, b): candidates found by other means. They are decided first and exactly, so what they join needs no further comparison.
    """
    similar = _similar(shingle, similarity)
    rows = materialize(texts.select("th", F.col("text").cast("binary").alias("t")).mapInArrow(_band_rows(shingle), "key long, th long, n long"), "near-bands")
    shared = rows.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("th", "n")).alias("first")).where("m > 1").drop("m")
    rows = materialize(rows.join(shared, "key"), "near-shared")
    used = rows.select("th") if pairs is None else rows.select("th").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("th")))
    packed = materialize(texts.join(used.distinct(), "th", "left_semi").select("th", pack(F.col("text")).alias("z")), "near-texts")

    def links(found: DataFrame) -> DataFrame:
        fit = F.least("an", "bn") >= F.greatest("an", "bn") * F.lit(similarity) - F.lit(1e-9)
        return similar_of(found.where(fit).select("a", "b").distinct())

    def similar_of(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(packed.select(F.col("th").alias("a"), F.col("z").alias("x")), "a").join(packed.select(F.col("th").alias("b"), F.col("z").alias("y")), "b")
        return materialize(pairs.where(similar("x", "y")).select("a", "b"), "near-links")

    met = rows.where("th <> first.th").select(F.col("first.th").alias("a"), F.col("th").alias("b"), F.col("first.n").alias("an"), F.col("n").alias("bn"))
    if pairs is None:
        done = links(met)
    else:
        done = similar_of(pairs.select("a", "b").distinct())
        done = done.unionByName(links(met.join(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")))
    for turn in range(turns + 1):
        roots = connected_components(done, "near-components")
        left = _open_bands(rows.select("key", "th", "n"), roots)
        largest = left.agg(F.max("size")).first()[0]
        if largest is None:
            return roots
        more = None
        if largest > crowded and turn < turns:
            pivot = left.where(F.col("size") > crowded).groupBy("key").agg(F.min_by(F.struct("th", "n", "root"), F.xxhash64("th", F.lit(turn))).alias("p"))
            met = left.join(pivot, "key").where("root <> p.root")
            more = links(met.select(F.col("p.th").alias("a"), F.col("th").alias("b"), F.col("p.n").alias("an"), F.col("n").alias("bn")))
        if more is None or more.isEmpty():
            rest = materialize(_cells(left, packed, block).mapInArrow(_cell_links(shingle, similarity), "a long, b long"), "near-links")
            return roots if rest.isEmpty() else connected_components(done.unionByName(rest), "near-components")
        done = done.unionByName(more)
