"""SimHash near-duplicates: 64-bit fingerprints of word 4-shingles, linked at 4 or fewer differing bits.

Candidates come from pigeonring filtering. The 64 bits form a ring of 5 segments. If two fingerprints
differ in at most t = 4 bits, some start on the ring has every chain of l consecutive segments differ in
at most l * t / 5 bits: 0 in the first segment, at most 1 in the first two, 2 in three, 3 in four. The
index therefore keys each fingerprint by every pair of neighbouring segments (26 bits); a difference
of one bit in the second is met by flipping its bits on the side of odd parity only, so each pair needs
one direction. Pairs that meet are held to the longer chains' budgets, then to the full Hamming distance.

Scale: only distinct fingerprints enter the index, so exact copies cost nothing there. A key's pairs
never leave the task: pairs that pass become links, in large groups a spanning star instead of all
pairs. A key with more than ``block`` rows is dealt out as pairs of blocks, so no group is
gathered in one task and none is cut short. Components come from alternating star steps over written tables.

Edge cases: null, empty and wordless texts have fingerprint 0 and link like any other; fewer than four
words make one shingle of all; repeated rows share a component; null ids take part, and a component
of null ids only has a null id; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, materialize, small_batches
from .near_copies import near_copies

BITS = 4
#: (shift, width) of the five segments of the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash64(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    ends = (ends[-n:] - 1).tolist()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 18):  # bounded memory for very long texts
        h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 18)], ends[at : at + (1 << 18)], strict=True)), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash64(t) for t in texts], np.uint64).view(np.int64))


@F.pandas_udf(T.LongType())
def fingerprint_5(texts: pd.Series) -> pd.Series:
    """Fingerprints of word 5-shingles, those of the pipeline's stage."""
    return pd.Series(np.array([simhash64(t, 5) for t in texts], np.uint64).view(np.int64))


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    shift, width = SEGMENTS[i]
    return (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def ring_keys(batches):
    """fp -> (key, probe, fp): index rows (probe 0) and flipped rows (probe 1)."""
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        keys, probes, fps = [], [], []
        for i in range(5):
            j = (i + 1) % 5
            head = np.uint64(i) << np.uint64(26) | _segment(fp, i) << np.uint64(13)
            second = _segment(fp, j)
            keys.append(head | second)
            probes.append(np.zeros(len(fp), np.int8))
            fps.append(fp)
            odd = np.bitwise_count(second) % 2 == 1
            for b in range(SEGMENTS[j][1]):
                keys.append((head | second ^ np.uint64(1 << b))[odd])
                probes.append(np.ones(int(odd.sum()), np.int8))
                fps.append(fp[odd])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(probes)), pa.array(np.concatenate(fps).view(np.int64))], ["key", "probe", "fp"])


def _close(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Chains of 2, 3 and 4 segments from ``start`` within their budgets, then the full distance."""
    x = a ^ b
    ok = np.bitwise_count(x) <= BITS
    total = np.zeros(x.shape, np.int64)
    diffs = np.stack([np.bitwise_count(_segment(x, i)) for i in range(5)])
    rows = np.arange(x.shape[0])
    for length in range(1, 5):
        total += diffs[(start + length - 1) % 5, rows]
        ok &= total * 5 <= length * BITS
    return ok


def _links(key: np.ndarray, probe: np.ndarray, fp: np.ndarray, large: int = 48):
    """Links among rows sorted by (key, probe), all rows of a key at hand."""
    if len(key) < 2:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    use = (size > 1) & (probe[first] == 0)
    out_a, out_b = [], []
    small = use & (size <= large)
    left = np.repeat(np.where(small, first + size, 0), size)  # end of the own group, 0 where not small
    at = np.flatnonzero((left > 0) & (probe == 0))
    step = 1
    while len(at):
        at = at[at + step < left[at]]
        if len(at):
            a, b = fp[at], fp[at + step]
            ok = _close(a, b, (key[at] >> 26).astype(np.int64))
            out_a.append(a[ok])
            out_b.append(b[ok])
        step += 1
    for s, n in zip(first[use & (size > large)], size[use & (size > large)], strict=True):
        a, b = _star(fp[s : s + n], int((probe[s : s + n] == 0).sum()))
        out_a.append(a)
        out_b.append(b)
    return np.concatenate(out_a or [np.empty(0, np.uint64)]), np.concatenate(out_b or [np.empty(0, np.uint64)])


def _star(fp: np.ndarray, n_index: int, tile: int = 1024):
    """One link from each member of a large group to the least member that it reaches within the group."""
    label = np.arange(len(fp))
    changed = True
    while changed:
        before = label.copy()
        for s in range(0, n_index, tile):
            rows = slice(s, min(s + tile, n_index))
            for t in range(s, len(fp), tile):
                cols = slice(t, t + tile)
                near = np.bitwise_count(fp[rows, None] ^ fp[None, cols]) <= BITS
                low = np.where(near, label[rows, None], len(fp)).min(axis=0)
                label[cols] = np.minimum(label[cols], low)
                low = np.where(near, label[None, cols], len(fp)).min(axis=1)
                label[rows] = np.minimum(label[rows], low)
        label = label[label]
        changed = not np.array_equal(before, label)
    moved = np.flatnonzero(fp[label] != fp)
    return fp[moved], fp[label[moved]]


def _link_batches(batches):
    """Rows sorted by (key, probe) -> distinct links; a key's rows may span batches."""
    rest = None
    for batch in list_then_none(batches):
        if batch is not None:
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "probe", "fp"))
            rest = now if rest is None else tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
            cut = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
        elif rest is None:
            return
        else:
            cut = len(rest[0])
        if not cut:
            continue
        a, b = _links(rest[0][:cut], rest[1][:cut], rest[2][:cut].view(np.uint64))
        rest = tuple(x[cut:] for x in rest)
        low, high = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([low, high], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], ["a", "b"])


def list_then_none(batches):
    yield from batches
    yield None


def fingerprint_links(fps: DataFrame, block: int = 20000) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect whatever is within 4 bits."""
    keys = fps.mapInArrow(ring_keys, "key long, probe byte, fp long")
    hot = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "simhash-hot")
    if not hot.isEmpty():
        return _with_blocks(keys, hot, block)
    return keys.repartition("key").sortWithinPartitions("key", "probe").mapInArrow(_link_batches, "a long, b long")


def _with_blocks(keys: DataFrame, hot: DataFrame, block: int) -> DataFrame:
    """The same for keys of any size: a hot key's rows meet as pairs of blocks of about ``block`` rows.

    A row of block i goes to the cells {i, j} of all j, so every pair of rows meets in some cell.
    """
    n = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp", "probe"), n)
    cells = keys.join(hot, "key", "left").withColumn("own", own.cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), n - 1)))
    cells = cells.select("key", "probe", "fp", F.least("own", "j").alias("c1"), F.greatest("own", "j").alias("c2"))
    dealt = cells.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2", "probe")
    return dealt.select("key", "c1", "c2", "probe", "fp").mapInArrow(_cell_batches, "a long, b long")


def _cell_batches(batches):
    def runs():
        rest, last = [], None
        for batch in batches:
            c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(c[0]):
                continue
            change = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(c[0])]
            for s, e in zip(cuts, cuts[1:], strict=False):
                name = (c[0][s], c[1][s], c[2][s])
                if rest and name != last:
                    yield rest
                    rest = []
                last = name
                rest.append(tuple(x[s:e] for x in (c[0], c[3], c[4])))
        if rest:
            yield rest

    for run in runs():
        key, probe, fp = (np.concatenate(x) for x in zip(*run, strict=True))
        yield from _link_batches([pa.RecordBatch.from_arrays([pa.array(key), pa.array(probe), pa.array(fp)], ["key", "probe", "fp"])])


def near_duplicates(prints: DataFrame, block: int = 20000) -> DataFrame:
    """(doc_id, fp) rows -> adds component_id, the smallest doc_id reachable."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected_components(fingerprint_links(nodes.select("fp"), block), "simhash-components")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """Rows whose texts share ``text_hash__`` but differ by ``text_hash_2__`` get hashes of their own: all but those with the least second hash."""
    shared = rows.groupBy("text_hash__").agg(F.min("text_hash_2__").alias("low"), F.max("text_hash_2__").alias("high")).where("low <> high")
    shared = materialize(shared.select("text_hash__", "low"), "simhash-shared")
    if shared.isEmpty():
        return rows
    both = rows.join(shared, "text_hash__", "left")
    own = F.when(F.col("low").isNull() | (F.col("low") == F.col("text_hash_2__")), F.col("text_hash__")).otherwise(F.xxhash64("text_hash__", "text_hash_2__"))
    return materialize(both.select(*[own.alias(c) if c == "text_hash__" else c for c in rows.columns]), "simhash-docs")


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """Different texts (th, text) -> pairs (a, b) whose 5-shingle fingerprints are linked: a text of each fingerprint with the others of it and with one of each linked fingerprint."""
    prints = materialize(texts.select("th", fingerprint_5("text").alias("fp")), "simhash-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("th").alias("least")), "simhash-nodes")
    equal = prints.join(nodes, "fp").where("th <> least").select(F.col("least").alias("a"), F.col("th").alias("b"))
    links = fingerprint_links(nodes.select("fp")).distinct()
    of = lambda c: nodes.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_th"))
    near = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_th").alias("a"), F.col("b_th").alias("b"))
    return materialize(equal.unionByName(near), "simhash-pairs")


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of the documents linked by near copies (word 5-shingles, similarity 0.8) that of the smallest id stays (null last, then by text hash).

    Fingerprints of the shingles are linked first, as in ``op9``, and their pairs held to the similarity. 4 bits keep only the nearest copies: what they miss comes from ``near_copies``.
    Null and empty texts are copies of each other, as all wordless texts; of repeated rows one stays; an empty table gives none.
    """
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    printed = materialize(docs.withColumn("text_hash__", F.xxhash64(text)).withColumn("text_hash_2__", F.xxhash64(F.lit(1), text)), "simhash-docs")
    printed = _told_apart(printed).drop("text_hash_2__")
    texts = printed.select(F.col("text_hash__").alias("th"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["th"])
    roots = near_copies(texts, pairs=fingerprint_pairs(texts))
    found = printed.select("doc_id", F.col("text_hash__").alias("th")).join(roots, F.col("th") == F.col("node"), "left")
    found = found.select("doc_id", "th", F.coalesce("root", "th").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    keep = found.groupBy("root").agg(F.min(order).alias("k"))
    keep = materialize(keep.select(F.col("k.doc_id").alias("keep_id"), F.col("k.th").alias("keep_th")), "simhash-keep")
    kept = printed.join(keep, printed["doc_id"].eqNullSafe(keep["keep_id"]) & (printed["text_hash__"] == keep["keep_th"]), "left_semi")
    # rows repeated with the same id and text: one of them stays
    again = materialize(printed.groupBy("doc_id", "text_hash__").agg(F.count("*").alias("n")).where("n > 1"), "simhash-again")
    if not again.isEmpty():
        same = kept["doc_id"].eqNullSafe(again["doc_id"]) & (kept["text_hash__"] == again["text_hash__"])
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text_hash__"]))
    return kept.select(*[F.col(c) for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = materialize(docs.select("doc_id", fingerprint("text").alias("fp")), "simhash-prints")
    out = near_duplicates(prints)
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
