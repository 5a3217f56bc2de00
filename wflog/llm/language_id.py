"""Language identification with interpolated Kneser-Ney character models.

Per language a model of order 4 over lower-case characters: absolute discounting, continuation counts
in the lower orders, interpolation down to the uniform distribution. All models share sorted hash
arrays: one array of n-gram hashes per order with a row of log probabilities per language, one of
context hashes with back-off weights. A text gets the language of the lowest cross-entropy per
character. One learning row in five is held back from the counts: a text is marked rejected when its
cross-entropy lies above the 99.5th percentile of its language's held-back texts, and the score is a softmax of the
negative cross-entropies whose sharpness makes the held-back rows' own languages most likely.

Scale: the models are fitted on at most about ``per_lang`` whole documents per language, chosen by a
hash of the id; their n-grams are counted in Spark, and the arrays are bounded by the sample. Scoring is a
scan of whole texts without a shuffle; equal n-grams of a batch are looked up once.

Edge cases: null texts and texts without a letter are `und` with score 0; null languages are not
learned from; null ids count as learning rows; without any language everything is `und`; of languages that tie in
cross-entropy the first by name is taken; a language without held-back rows rejects nothing; very long texts are scored
whole, a batch of them at least one text at a time; empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, replaced, small_batches
from .rolling import mix

ORDER = 4
LETTER = re.compile(r"[^\W\d_]")
#: Characters have 16 bits: code points of higher planes share the last one, 0 stands before the text.
PLANE = 1 << 16
BITS = 16


def code_points(text: str) -> np.ndarray:
    return np.clip(np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32), 1, PLANE - 1)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(4-grams of 16-bit characters, one per character; number of characters of each text)."""
    out, sizes = [], []
    for t in texts:
        c = np.concatenate((np.zeros(ORDER - 1, np.uint64), code_points(t).astype(np.uint64)))
        out.append(c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:])
        sizes.append(len(c) - 3)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.array(sizes, np.int64)


def low_bits(g: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` characters."""
    return g & np.uint64((1 << BITS * order) - 1)


def _gram_rows(batches):
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            g, n = np.unique(grams_of([t for t, x in zip(texts, langs, strict=True) if x == lang])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "g", "n"])


def kneser_ney(grams: np.ndarray, counts: np.ndarray, n_classes: int):
    """Tables of one language: for each order (n-grams, probabilities, contexts, back-off weights), and the floor."""
    by = np.argsort(grams)
    levels = [(grams[by], counts[by].astype(float))]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: how many different characters stand before
        g, n = np.unique(low_bits(levels[-1][0], order), return_counts=True)
        levels.append((g, n.astype(float)))
    levels.reverse()
    tables, below = [], None
    for order, (g, c) in enumerate(levels, 1):
        ones, twos = (c == 1).sum(), (c == 2).sum()
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
        context = g >> np.uint64(BITS)
        ctx, of, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(of, weights=c)
        weight = d * kinds / total
        lower = np.full(len(g), 1.0 / n_classes) if below is None else look(below, low_bits(g, order - 1))
        p = (c - d) / total[of] + weight[of] * lower
        below = (g, p)
        tables.append((g, p, ctx, weight))
    floor = tables[0][3][0] / n_classes if len(tables[0][3]) else 1.0 / n_classes
    return tables, floor


def look(table, g: np.ndarray) -> np.ndarray:
    """Probabilities of n-grams that the table is known to hold."""
    return table[1][np.searchsorted(table[0], g)]


def hash_of(g: np.ndarray, order: int) -> np.ndarray:
    return mix(g + np.uint64(order * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


class Models:
    """All languages in shared sorted hash arrays."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        n_classes = len(np.unique(np.concatenate([low_bits(counts[x][0], 1) for x in langs]))) + 2
        made = [kneser_ney(*counts[x], n_classes) for x in langs]
        self.floor = np.log([m[1] for m in made])
        self.keys, self.rows, self.ctx, self.back = [], [], [], []
        below = None
        for order in range(ORDER):
            union = np.unique(np.concatenate([m[0][order][0] for m in made]))
            contexts = np.unique(np.concatenate([m[0][order][2] for m in made]))
            back = np.zeros((len(contexts), len(langs)))
            for k, m in enumerate(made):
                back[np.searchsorted(contexts, m[0][order][2]), k] = np.log(m[0][order][3])
            lower = np.tile(self.floor, (len(union), 1)) if below is None else below[1][np.searchsorted(below[0], low_bits(union, order))]
            rows = lower + (back[np.searchsorted(contexts, union >> np.uint64(BITS))] if order else 0)
            for k, m in enumerate(made):
                rows[np.searchsorted(union, m[0][order][0]), k] = np.log(m[0][order][1])
            below = (union, rows)
            for keys, values, into, out in ((union, rows, self.keys, self.rows), (contexts, back, self.ctx, self.back)):
                h = hash_of(keys, order)
                by = np.argsort(h)
                into.append(h[by])
                out.append(values[by].astype(np.float32))
        self.limit = np.full(len(langs), np.inf)
        self.sharpness = 20.0

    def log_p(self, g: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each n-gram's last character in every language; unseen ones back off."""
        if not order:
            return np.tile(self.floor.astype(np.float32), (len(g), 1))
        at, hit = self._find(self.keys[order - 1], g, order)
        out = np.empty((len(g), len(self.langs)), np.float32)
        out[hit] = self.rows[order - 1][at[hit]]
        if not hit.all():
            miss = g[~hit]
            low = self.log_p(low_bits(miss, order - 1), order - 1)
            if order > 1:
                at, known = self._find(self.ctx[order - 1], miss >> np.uint64(BITS), order)
                low[known] += self.back[order - 1][at[known]]
            out[~hit] = low
        return out

    @staticmethod
    def _find(keys: np.ndarray, g: np.ndarray, order: int):
        h = hash_of(g, order - 1)
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        return at, keys[at] == h if len(keys) else np.zeros(len(g), bool)

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character of each text (none empty) in every language."""
        out, at = np.empty((len(texts), len(self.langs))), 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) < 1 << 21):
                size += len(texts[upto])
                upto += 1
            g, sizes = grams_of(texts[at:upto])
            some, inverse = np.unique(g, return_inverse=True)
            p = self.log_p(some)
            first = np.cumsum(sizes) - sizes
            for k in range(len(self.langs)):
                out[at:upto, k] = -np.add.reduceat(p[:, k][inverse], first, dtype=np.float64) / sizes
            at = upto
        return out


    def calibrate(self, own: np.ndarray, ce: np.ndarray, quantile: float = 0.995) -> None:
        """Limits and sharpness from held-back texts: their languages and their entropies in every language."""
        for k in np.unique(own):
            self.limit[k] = float(np.quantile(ce[own == k, k], quantile))
        if len(own) and len(self.langs) > 1:
            gap = ce - ce[np.arange(len(own)), own][:, None]
            grid = np.geomspace(0.5, 100.0, 40)
            self.sharpness = float(grid[np.argmin([np.logaddexp.reduce(-s * gap, axis=1).sum() for s in grid])])


def fit(rows: DataFrame, per_lang: int = 600) -> Models | None:
    """(key, lang, text) learning rows -> models."""
    rows = rows.where("lang is not null and length(text) > 0")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    part = rows.sparkSession.createDataFrame([(k, min(1.0, per_lang / n)) for k, n in counts.items()], "lang string, part double")
    chosen = rows.join(F.broadcast(part), "lang").where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.col("part") * (1 << 20))
    held = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(5)) == 0
    sample = materialize(chosen.select("lang", "text", held.alias("held")), "lang-sample")
    alone = {r["lang"] for r in sample.groupBy("lang").agg(F.bool_and("held").alias("all")).where("all").collect()}
    learned = sample.where(~F.col("held") | F.col("lang").isin(*alone)).select("lang", "text")
    table = learned.mapInArrow(_gram_rows, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    if not langs:
        return None
    models = Models(langs, {x: (t["g"].to_numpy().view(np.uint64), t["n"].to_numpy()) for x, t in table.groupby("lang")})
    sent = rows.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series(list(sent.value.entropies(list(texts))), dtype=object)

    seen = sample.where("held").where(F.col("text").rlike(r"\p{L}")).select("lang", measure("text").alias("ce")).orderBy("lang", F.xxhash64("ce")).collect()  # a fifth of the sample
    models.calibrate(np.array([langs.index(r["lang"]) for r in seen], np.int64), np.array([r["ce"] for r in seen]).reshape(len(seen), len(langs)))
    return models


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predictor(spark, models: Models | None):
    sent = spark.sparkContext.broadcast(models)

    @F.pandas_udf(PREDICTION)
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = sent.value
        lang, score, entropy, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        use = [i for i, t in enumerate(texts) if m is not None and t is not None and LETTER.search(t)]
        if use:
            ce = m.entropies([texts.iloc[i] for i in use])
            best = ce.argmin(axis=1)
            low = ce[np.arange(len(use)), best]
            share = 1 / np.exp(-m.sharpness * (ce - low[:, None])).sum(axis=1)
            for k, i in enumerate(use):
                lang[i] = m.langs[best[k]]
            score[use], entropy[use], rejected[use] = share, low, low > m.limit[best]
        return pd.DataFrame({"lang_pred": lang, "score": score, "entropy": pd.array(entropy), "rejected": rejected})

    return predict


def identify(docs: DataFrame, per_lang: int = 600) -> DataFrame:
    """Every row of ``docs`` with ``held_out`` and ``language``, a struct(lang_pred, score, entropy, rejected)."""
    small_batches(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    models = fit(docs.where(~held).select(F.col("doc_id").alias("key"), "lang", "text"), per_lang)
    row = docs.select(F.struct("*").alias("row"), held.alias("held_out"), predictor(docs.sparkSession, models)(F.col("text")).alias("language"))
    return row.select(*replaced(docs, "held_out", "language"), "held_out", "language")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs)
    return out.select("doc_id", "held_out", "language.lang_pred", "language.score", "language.rejected")
