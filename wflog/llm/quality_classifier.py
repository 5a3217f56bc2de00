"""Quality classifier: naive Bayes features into a linear support vector machine.

Indicators of byte 3-grams and of word 1-, 2- and 3-grams, hashed into 2**18 places, are scaled by
the log ratio of their rates among good and bad documents; a hinge-loss linear model over the scaled,
length-normalised indicators is fitted by dual coordinate descent and calibrated on held-back rows.

Scale: the class counts cover every labelled learning row and are summed in Spark (at most 2**18
rows); the machine is fitted on at most about ``per_class`` rows of either class, chosen by a hash of the
id, whose indicators take 32 KB each at most (as bits where they are many). The model is two arrays of fixed size. Scoring is a scan of whole texts without a shuffle.

Edge cases: null and empty texts are scored from the bias alone; null ids count as held out;
labels given twice count once (the lowest); without labels of both classes every score is the share of
good labels, or 0.5; labels without a document don't count; very long texts are scored whole, the indicators of one text at a time; empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, replaced, small_batches
from .rolling import mix, prefixes, substring

PLACES = 1 << 18


class Indicators:
    """Sorted places of a text's n-grams; keeps one scratch array."""

    def __init__(self):
        self.flags = np.zeros(PLACES, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        codes = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, len(codes), 1 << 20):  # bounded memory for very long texts
            self._mark(codes[at : at + (1 << 20) + 64])
        out = np.flatnonzero(self.flags)
        self.flags[out] = False
        return out

    def _mark(self, codes: np.ndarray) -> None:
        if len(codes) >= 3:
            wide = codes.astype(np.uint32)
            grams = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
            self.flags[grams * np.uint32(0x9E3779B1) >> np.uint32(14)] = True
        solid = np.concatenate(([False], (codes > 32) | (codes < 9) | ((codes > 13) & (codes < 32)), [False]))
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        if len(edge):
            word = substring(prefixes(codes), edge[::2], edge[1::2])
            gram = word
            for n in range(3):
                if n:
                    gram = mix(gram[:-1] * np.uint64(3) + word[n:])
                self.flags[gram >> np.uint64(46)] = True


def packed(x: np.ndarray) -> bytes:
    """Places as 4-byte numbers after a 0, or as bits after a 1, whichever is shorter."""
    if 4 * len(x) <= PLACES // 8:
        return b"\0" + x.astype(np.int32).tobytes()
    bits = np.zeros(PLACES, bool)
    bits[x] = True
    return b"\1" + np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[0]:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)))
    return np.frombuffer(data, np.int32, offset=1)


def _learn_rows(batches):
    """(y, chosen, text) -> counts per task (place, n_bad, n_good) and the chosen rows' indicators."""
    find, counts = Indicators(), np.zeros((2, PLACES), np.int64)
    names = ["y", "place", "n", "x"]
    for batch in batches:
        kept, ys = [], []
        for y, chosen, text in zip(*(batch.column(c).to_pylist() for c in ("y", "chosen", "text")), strict=True):
            x = find(text)
            counts[y, x] += 1
            if chosen:
                kept.append(packed(x))
                ys.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.nulls(len(ys), pa.int32()), pa.nulls(len(ys), pa.int64()), pa.array(kept, pa.binary())], names)
    for y in (0, 1):
        at = np.flatnonzero(counts[y])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), y, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[y, at]), pa.nulls(len(at), pa.binary())], names)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss linear model with L2 penalty: weights and bias (a feature of value 1)."""
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def calibrate(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic curve over margins by Newton steps with a small penalty."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        r, s = weight * (y - p), weight * p * (1 - p)
        g = np.array([r @ f - 1e-2 * a, r.sum()])
        h = np.array([[s @ (f * f) + 1e-2, s @ f], [s @ f, s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def unit(x: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[x].astype(np.float32)
    n = float(np.sqrt(v @ v))
    return v / n if n else v


def fit(labelled: DataFrame, counts: dict[int, int], per_class: int = 3000, cost: float = 4.0):
    """(y, key, text) rows -> (weights scaled by the ratio, squared ratio, bias, a, b); ``counts``: rows of each class."""
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return np.zeros(PLACES), np.zeros(PLACES), 0.0, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    part = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / n1))).otherwise(F.lit(min(1.0, per_class / n0)))
    chosen = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < part * (1 << 20)
    rows = materialize(labelled.select("y", chosen.alias("chosen"), "text").mapInArrow(_learn_rows, "y int, place int, n long, x binary"), "quality-rows")
    side = lambda y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)).alias(f"n{y}")
    sums = rows.where("place is not null").groupBy("place").agg(side(0), side(1)).where("n0 + n1 > 1").toPandas()  # places seen once tell nothing
    c = np.zeros((2, PLACES))
    c[:, sums["place"]] = sums["n0"], sums["n1"]
    rate = (c + 1) / (np.array([[n0], [n1]]) + 2)
    ratio = np.log(rate[1] / rate[0])
    ratio[c.sum(axis=0) < 2] = 0.0
    sample = rows.where("x is not null").select("y", "x").toPandas()
    order = np.lexsort((sample["y"], [zlib.crc32(v) for v in sample["x"]]))  # a fixed mixing of the classes
    xs = [unpacked(sample["x"].iloc[i]) for i in order]
    y = sample["y"].to_numpy()[order]
    values = [unit(x, ratio) for x in xs]
    test = np.arange(len(xs)) % 5 == 0
    sign = np.where(y == 1, 1.0, -1.0)
    learn = np.flatnonzero(~test)
    balance = np.where(y == 1, 1.0, max(1.0, (y == 1).sum() / max(1, (y == 0).sum()))) * cost
    w, bias = dual_coordinate_descent([xs[i] for i in learn], [values[i] for i in learn], sign[learn], balance[learn], PLACES)
    f = np.array([w[x] @ v + bias for x, v in zip(xs, values, strict=True)])[test]
    real = np.where(y == 1, n1 / max(1, (y == 1).sum()), n0 / max(1, (y == 0).sum()))[test]
    a, b = calibrate(f, (y[test] == 1).astype(float), real / real.mean()) if test.any() else (1.0, 0.0)
    return w * ratio, ratio * ratio, bias, a, b


def scorer(spark, model):
    sent = spark.sparkContext.broadcast(model)
    find: list[Indicators] = []

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        if not find:
            find.append(Indicators())
        w, square, bias, a, b = sent.value
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            x = find[0](t)
            n = np.sqrt(square[x].sum())
            out[i] = a * ((w[x].sum() / n if n else 0.0) + bias) + b
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score


def bucket(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in bucket 0."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(0))


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = 3000, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``score`` and ``predicted``."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (bucket(F.col("doc_id"), folds) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    labelled = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("text")).join(known.withColumnRenamed("doc_id", "key").hint("shuffle_hash"), "key")
    there = docs.select("doc_id").join(known.hint("shuffle_hash"), "doc_id")
    counts = {r["y"]: r["count"] for r in there.groupBy("y").count().collect()}
    model = fit(labelled, counts, per_class)
    score = scorer(docs.sparkSession, model)(F.col("text"))
    row = docs.select(F.struct("*").alias("row"), (bucket(F.col("doc_id"), folds) == 0).alias("held_out"), score.alias("score"))
    return row.select(*replaced(docs, "held_out", "score", "predicted"), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
