"""License scans: a trained paragraph classifier, with template comparison confirming its predictions.

A sparse multinomial logistic regression over word 1- and 2-grams tells licence families from each other
and from other text (class ``unknown``). It learns from the families' notices, cut and mixed by fixed rules,
and from a bounded sample of the corpus' own lines as unknown ones, among them lines with words of licences that are no notice. A probability below the threshold that
keeps nearly all held-back unknown lines out counts as unknown, and a predicted family must share
enough word pairs with one of its notices, one of them a pair that no other family's notices hold, and have just the qualifiers (lesser, affero, noncommercial, sharealike ..) that
the family's name has. Lines with a licence identifier are read as expressions.
A paragraph is a line; and, as notices are often wrapped, a run of words over several lines of a block (lines without a blank one
between) that holds word pairs of notices close together.

Scale: the sample is at most about ``negatives`` documents of either kind, chosen by a hash of the text; the
model is a few thousand n-grams. Scoring is a scan of whole texts without a shuffle: every paragraph
is scored, long ones in overlapping windows of words.

Edge cases: null and empty texts have no licence; repeated rows each get their result; null ids pass
through; with an empty corpus the model learns from the notices alone; a family found twice in a paragraph is
listed once, with the higher probability; very long texts and lines are scored whole; other columns pass through.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

UNKNOWN = "unknown"
#: Usual notices of each family: fixed values.
NOTICES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Licensed under the GNU GPL version 2 or later.",
        "Licensed under the GNU GPL v3.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU LGPL version 3 or later.",
        "Licensed under the GNU LGPL v3.",
    ),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "Licensed under the GNU AGPL version 3 or later.",
        "Licensed under the GNU AGPL v3.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc-by-nd": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
    ),
    "cc-by-nc-sa": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "cc-by-nc-nd": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0.",
        "Dedicated to the public domain under CC0.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright, all rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}
#: Notices of licences that are none of the families: examples of the unknown class. Fixed values.
UNLISTED = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2 only.",
    "This software is provided under the terms of the zlib License.",
    "This file is licensed under the Common Development and Distribution License, version 1.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This work may be distributed under the conditions of the LaTeX Project Public License, version 1.3.",
    "Released under the Artistic License 2.0.",
    "This program is free software. It comes without any warranty, under the terms of the Do What The Fuck You Want To Public License, Version 2.",
    "Licensed under the Business Source License 1.1.",
    "Licensed under the Server Side Public License, version 1.",
    "Licensed under the Microsoft Public License.",
    "Released under the PostgreSQL License.",
    "Licensed under the Academic Free License version 3.0.",
    "Licensed under the Open Software License version 3.0.",
)
#: Words of a name that make it another licence than the same name without them: fixed values.
QUALIFIERS = {"lesser", "lgpl", "affero", "agpl", "nc", "noncommercial", "sa", "sharealike", "nd", "noderivatives", "noderivs"}
#: How the identifiers of a family begin, in lower case, the longest first: fixed values.
IDENTIFIERS = {"cc-by-nc-sa-": "cc-by-nc-sa", "cc-by-nc-nd-": "cc-by-nc-nd", "cc-by-sa-": "cc-by-sa", "cc-by-nd-": "cc-by-nd", "cc-by-nc-": "cc-by-nc", "cc-by-": "cc-by", "cc0-": "cc0", "lgpl-": "lgpl", "agpl-": "agpl", "gpl-": "gpl", "apache-": "apache", "bsd-": "bsd", "mpl-": "mpl"}
IDENTIFIER = re.compile(r"spdx-license-identifier:[ \t]*([^\n]*)", re.I)


def identified(line: str) -> list[str] | None:
    """Families that a line's licence expression names, operators and exceptions aside; None where the line holds none."""
    m = IDENTIFIER.search(line)
    if not m:
        return None
    out, skip = [], False
    for word in re.findall(r"[\w.+-]+", m[1].lower()):
        if skip or word in ("or", "and", "with"):
            skip = word == "with"  # what follows is an exception's name
            continue
        family = "mit" if word == "mit" else next((f for start, f in IDENTIFIERS.items() if word.startswith(start) and word[len(start) : len(start) + 1].isdigit()), None)
        if family and family not in out:
            out.append(family)
    return out


WORDS = re.compile(r"[^\W_]+")
WINDOW, STRIDE = 48, 32


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def n_grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def examples(seed: int = 11, copies: int = 40) -> list[tuple[str, list[str]]]:
    """Notices with words lost, other words around them and years put in, each labelled; and look-alikes of no family."""
    rnd = random.Random(seed)
    out = []
    filler = [w for notices in NOTICES.values() for t in notices for w in words_of(t)]
    for family, notices in NOTICES.items():
        for t in notices:
            w = words_of(t)
            out.append((family, w))
            for _ in range(copies):
                kept = [x for x in w if rnd.random() > 0.08] or w
                head = rnd.choice(([], ["copyright", str(rnd.randint(1990, 2025))], ["see", "license"], ["the", "file", "is"]))
                out.append((family, head + kept))
    for _ in range(6 * copies):  # the same words without their order tell nothing
        out.append((UNKNOWN, [rnd.choice(filler) for _ in range(rnd.randint(3, 20))]))
    for t in UNLISTED:
        w = words_of(t)
        for _ in range(copies if copies else 0):
            out.append((UNKNOWN, [x for x in w if rnd.random() > 0.05] or w))
    for t in ("he has the right to reserve a seat", "the public was free to use the general store", "a work of the people under the law", "version two of the story was released", "this is the file", "the terms of the contract were met"):
        out += [(UNKNOWN, words_of(t))] * (copies // 4)
    return out


def word_pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def templates() -> dict[str, list[set[str]]]:
    """The word pairs of each family's notices."""
    return {f: [set(word_pairs(w)) for w in map(words_of, notices)] for f, notices in NOTICES.items()}


def resemblance(words: list[str], known: dict[str, list[set[str]]]) -> float:
    """The greatest share of a notice's word pairs that ``words`` hold."""
    pairs = set(word_pairs(words))
    return max((len(t & pairs) / len(t) for sets in known.values() for t in sets), default=0.0)


class Model:
    def __init__(self, negatives: list[str], seed: int = 11, epochs: int = 30, miss: float = 0.995):
        rnd = random.Random(seed)
        rows = examples(seed) + [(UNKNOWN, words_of(t)) for t in negatives]
        rnd.shuffle(rows)
        self.families = [UNKNOWN, *NOTICES]
        grams = sorted({g for family, w in examples(seed, 0) for g in n_grams(w)})
        self.vocabulary = {g: i for i, g in enumerate(grams)}
        self.weights = np.zeros((len(grams) + 1, len(self.families)))
        xs = [self.places(w) for _, w in rows]
        ys = np.array([self.families.index(f) for f, _ in rows])
        train = [i for i in range(len(rows)) if i % 5]
        for epoch in range(epochs):  # stochastic gradient with L2 shrinkage
            rate = 0.5 / (1 + 0.2 * epoch)
            for i in train:
                p = self.probabilities(xs[i])
                p[ys[i]] -= 1
                self.weights[xs[i]] -= rate * (p / np.sqrt(len(xs[i])) + 1e-4 * self.weights[xs[i]])
        held = [1 - self.probabilities(xs[i])[0] for i in range(0, len(rows), 5) if ys[i] == 0]
        #: least probability of being licensed: above what unknown paragraphs held back reach
        self.threshold = max(0.6, float(np.quantile(held, miss)) if held else 0.6)
        self.templates = templates()
        self.hints = {p for sets in self.templates.values() for t in sets for p in t}
        others = {f: {p for g, sets in self.templates.items() if g != f for t in sets for p in t} for f in NOTICES}
        names = {f: [QUALIFIERS.intersection(words_of(t)) for t in notices] for f, notices in NOTICES.items()}
        self.qualified = [(set.union(*q), q) for q in names.values()]
        self.own = {f: {p for t in sets for p in t} - others[f] for f, sets in self.templates.items()}

    def places(self, words: list[str]) -> np.ndarray:
        """Sorted places of the known n-grams; the last place is the bias."""
        known = self.vocabulary
        hit = {known[w] for w in words if w in known}
        if hit:
            hit |= {known[g] for g in (f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in known and b in known) if g in known}
        return np.array([*sorted(hit), len(known)], np.int64)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[x].sum(axis=0) / np.sqrt(len(x)) * 2
        z = np.exp(z - z.max())
        return z / z.sum()

    def family(self, words: list[str], least: float = 0.6) -> tuple[str, float]:
        """(family or unknown, probability); the prediction must share ``least`` of a notice's word pairs."""
        x = self.places(words)
        if len(x) < 3:  # fewer than two known n-grams
            return UNKNOWN, 0.0
        p = self.probabilities(x)
        if 1 - p[0] < self.threshold:
            return UNKNOWN, 0.0
        pairs, there = set(word_pairs(words)), QUALIFIERS.intersection(words)
        # a family whose name has other qualifiers than the text is another licence
        rest = np.array([there <= every and any(q <= there for q in each) for every, each in self.qualified]) * p[1:]
        if not rest.any():
            return UNKNOWN, 0.0
        best = int(rest.argmax())
        family, sure = self.families[1 + best], float(rest[best] / rest.sum())
        if p[1 + best] < 0.05 or sure < 0.5:
            return UNKNOWN, 0.0
        share = max(len(t & pairs) / len(t) for t in self.templates[family])
        return (family, sure * float(1 - p[0])) if share >= least and pairs & self.own[family] else (UNKNOWN, 0.0)

    def wrapped(self, lines: list[list[str]]):
        """(line, family, probability) of runs of notices' word pairs that cross a line break; lines of a block, as words."""
        words = [w for line in lines for w in line]
        of = [i for i, line in enumerate(lines) for _ in line]
        at = [i for i, p in enumerate(word_pairs(words)) if p in self.hints]
        start = 0
        for k, i in enumerate(at):
            last = k + 1 == len(at)
            if not last and at[k + 1] - i <= 4 and at[k + 1] + 2 - at[start] <= WINDOW:
                continue
            if of[at[start]] < of[i + 1]:
                family, p = self.family(words[at[start] : i + 2])
                if family != UNKNOWN:
                    yield of[at[start]], family, p
            start = k + 1

    def scan(self, text: str | None) -> list[dict]:
        best: dict[tuple[int, str], float] = {}
        block: list[list[str]] = []
        plain = (text or "").split("\n")
        named = {no: f for no, x in enumerate(plain) if "dentifier:" in x or "DENTIFIER:" in x for f in [identified(x)] if f is not None}
        lines = [[] if no in named else words_of(x) for no, x in enumerate(plain)]
        for no, words in enumerate([*lines, []]):
            for family in named.get(no, ()):
                best[no, family] = 1.0
            for at in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE):
                part = words[at : at + WINDOW]
                if part:
                    family, p = self.family(part)
                    if family != UNKNOWN:
                        best[no, family] = max(p, best.get((no, family), 0.0))
            if words:
                block.append(words)
            elif block:
                first = no - len(block)
                for line, family, p in self.wrapped(block) if len(block) > 1 else ():
                    if (first + line, family) not in best and (first + line + 1, family) not in best:
                        best[first + line, family] = p
                block = []
        for no, family in list(best):
            if family == "bsd":  # its notice begins with these words, a few lines above
                for k in range(no - 4, no + 1):
                    best.pop((k, "proprietary"), None)
        return [{"paragraph": no, "family": f, "probability": p} for (no, f), p in sorted(best.items())]


FOUND = T.ArrayType(T.StructType([T.StructField("paragraph", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType())]))


def scan_licenses(docs: DataFrame, text_col: str = "text", negatives: int = 300) -> DataFrame:
    """Documents with ``licenses``, an array of struct(paragraph, family, probability)."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col(text_col)
    filled = docs.where(F.length(F.trim(F.translate(text, "\n", ""))) > 0)
    n = filled.count()
    chosen = F.pmod(F.xxhash64(text, F.lit(3)), F.lit(1 << 62)) < F.lit((1 << 62) * negatives // max(n, negatives))
    lines = filled.where(chosen).select(F.explode(F.split(text, "\n")).alias("line")).where(F.length(F.trim("line")) > 0)
    taught = F.lower("line").rlike("licen[cs]e|rights reserved|copyright|public domain|permission")
    # both kinds are a bounded sample; lines that look like a notice are no examples of the unknown class
    rows = [r[0] for test in (~taught, taught) for r in lines.where(test).distinct().orderBy(F.xxhash64("line"), "line").limit(4 * negatives).collect()]
    if n and not rows:
        raise RuntimeError(f"none of {n} documents was chosen as an example")
    known = templates()
    sent = spark.sparkContext.broadcast(Model([x for x in rows if resemblance(words_of(x), known) < 0.3]))

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.scan(t) for t in texts], dtype=object)

    return docs.withColumn("licenses", find(text))


def op1(spark, sf_dir: str) -> DataFrame:
    """One row per document: its families, most probable first, the paragraphs that name them, and the highest probability."""
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    families = F.array_join(F.array_sort(F.array_distinct("licenses.family")), ",")
    return out.select("doc_id", families.alias("families"), F.size("licenses").alias("n_paragraphs"), F.round(F.coalesce(F.array_max("licenses.probability"), F.lit(0.0)), 4).alias("probability"))
