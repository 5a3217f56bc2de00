"""Packing, periodic runs and the Merkle manifest against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wflog.llm import decontaminate, licenses, merkle, mixing, packing, periodic_runs, quality_rules, simhash
from wflog.llm.common import ranked

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_ranked_is_a_row_number(spark):
    rows = [(i % 7 if i % 3 else 0, (i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, o long").repartition(5)
    out = ranked(df, ["g"], ["o"], "t").collect()
    by = defaultdict(list)
    for r in out:
        by[r.g].append((r["rank"], r.o, r.members))
    for got in by.values():
        got.sort()
        assert [x[0] for x in got] == list(range(len(got))) and [x[1] for x in got] == sorted(x[1] for x in got) and {x[2] for x in got} == {len(got)}


# 11


def test_words_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(TOKENIZER), packing.Words(TOKENIZER, keep=50)
    texts = ["", " ", "It's Élan, ÇA VA?! naïve... x1y2 a-b_c 3.14 don'T", "<|endoftext|> <|ENDOFTEXT|> a<|endoftext|>b.", "ﬁ Å é é. ́a ΑΣ ας İI ß ẞ ÿ× ÷!", "日本語。テスト €. '. 's. x's. s'.", "tab\tnew\nline\x0bv\x0cf\rr\x1cs\x85n\xa0b　w", "a" * 300 + ".", "word.word,word;;word!?!", "\U0001f600\U0001f600. ok:", "ª º µ"]
    rnd = random.Random(5)
    letters = "aAbB.,'!? \n\xe9\xc9\xd7|<>-_019́€　"
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(600)]
    for t in texts:
        assert words.tokenize([t.encode()])[0].tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert [x.tolist() for x in words.tokenize([t.encode() for t in texts])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    other = packing.Words(public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(other.tokenize([t.encode()])[0].tolist() == plain.encode(t, add_special_tokens=False).ids for t in texts)


@pytest.mark.parametrize("seed", range(6))
def test_layout_is_full_and_covers_every_piece(seed):
    rnd = random.Random(seed)
    size = rnd.choice([16, 64, 100])
    histogram = {length: rnd.choice([0, 1, 3, 50, 1000]) for length in range(1, size + 1) if rnd.random() < 0.7}
    rows = packing.shortest_pack_first(histogram, size)
    seq, seen = defaultdict(list), defaultdict(list)
    for of, rank, n, start, part, first, offset in rows:
        for k in range(n):
            seen[of, rank + k].append((start, part))
            seq[first + k].append((offset, part))
    assert set(seen) == {(length, k) for length, n in histogram.items() for k in range(n)}
    for (of, _), parts in seen.items():
        at = 0
        for start, part in sorted(parts):
            assert start == at
            at += part
        assert at == of
    total = sum(a * b for a, b in histogram.items())
    assert sorted(seq) == list(range(len(seq)))
    for k, parts in seq.items():
        at = 0
        for offset, part in sorted(parts):
            assert offset == at
            at += part
        assert at == size if k < total // size else at & (at - 1) == 0
    # longest first: an uncut piece never comes after a shorter one
    whole = [of for of, _, _, start, part, _, _ in rows if start == 0]
    assert whole == sorted(whole, reverse=True)


def test_layout_grows_with_lengths_not_documents():
    few = packing.shortest_pack_first({length: 40 for length in range(1, 4097)}, 4096)
    many = packing.shortest_pack_first({length: 40_000_000 for length in range(1, 4097)}, 4096)
    assert len(many) <= 1.5 * len(few)


def test_packing_gives_all_ids_back(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    want = {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    pieces = packing.pack_documents(docs, TOKENIZER)
    rows = pieces.collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.doc_tokens))
    assert set(got) == set(want)
    for k, parts in got.items():
        parts.sort()
        assert sum((p[1] for p in parts), []) == want[k] and [p[0] for p in parts] == [sum(len(q[1]) for q in parts[:i]) for i in range(len(parts))] and {p[2] for p in parts} == {len(want[k])}
    sequences = packing.packed_sequences(pieces).collect()
    total = sum(map(len, want.values()))
    sizes = Counter(r.length for r in sequences)
    assert sizes.pop(4096) == total // 4096 and all(n == 1 and s & (s - 1) == 0 for s, n in sizes.items()) and sum(sizes) == total % 4096
    first = min((r for r in rows if r.sequence_id == 0), key=lambda r: r.offset)
    assert bytes(next(r.ids for r in sequences if r.sequence_id == 0)).startswith(bytes(first.ids))
    crc = {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in packing.op11(spark, MORE).collect()}
    assert crc == {(r.doc_id, r.start): (r.length, zlib.crc32(bytes(r.ids))) for r in rows}


# 12


def runs_brute(words, min_length=24, min_exponent=3):
    n, out = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, q, e) for (s, e), q in out.items())


def hard_texts(rnd):
    yield []
    yield ["a"]
    yield ["a"] * 23
    yield ["a"] * 24
    yield ["a"] * 500
    yield (["a"] * 30 + ["b"]) * 8
    yield (["a"] * 9 + ["b"]) * 5 + (["a"] * 9 + ["c"]) * 5
    f = ["a"], ["b"]
    while len(f[1]) < 300:
        f = f[1], f[1] + f[0]
    yield f[1]
    t = [0]
    while len(t) < 250:
        t = t + [1 - x for x in t]
    yield t
    for _ in range(30):
        out = [rnd.randrange(50) for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.randint(1, 6)):
            p = [rnd.randrange(rnd.choice([1, 2, 3, 60])) for _ in range(rnd.randint(1, 40))]
            whole = p * rnd.randint(1, 12)
            out += whole[: rnd.randint(1, len(whole))] if rnd.random() < 0.6 else whole
            if rnd.random() < 0.4:
                out += out[-rnd.randint(1, len(out)) :]
        yield out
    for k in (2, 3):
        yield [rnd.randrange(k) for _ in range(300)]
    yield [int(rnd.random() < 0.06) for _ in range(400)]


def test_runs_against_all_periods():
    rnd = random.Random(11)
    texts = [[str(w) for w in t] for t in hard_texts(rnd)]
    number, ids, at = {}, [], [0]
    for k, t in enumerate(texts):
        ids += [number.setdefault((k, w), len(number)) for w in t]
        at.append(at[-1] + len(t))
    for least, exponent in ((24, 3), (6, 3), (40, 5)):
        got = defaultdict(list)
        for s, e, q in periodic_runs.find_runs(np.array(ids), least, exponent).T.tolist():
            k = int(np.searchsorted(at, s, "right")) - 1
            got[k].append((s - at[k], q, e - at[k]))
        for k, t in enumerate(texts):
            assert got[k] == runs_brute(t, least, exponent), (k, least)
            alone = [number[k, w] for w in t]
            assert [(s, q, e) for s, e, q in periodic_runs.find_runs(np.array(alone, np.int64), least, exponent).T.tolist()] == got[k]


def test_grammar_derives_the_text():
    rnd = random.Random(3)
    words = np.array([rnd.randrange(3) for _ in range(400)] + [7, 8, 9] * 40)
    g = periodic_runs.Grammar(words, np.zeros(len(words), int))
    assert len(g.first) and (g.first < g.middle).all() and (g.middle < g.end).all()
    for rule, pos in g.put.T.tolist():
        a, b = g.first[rule], g.end[rule]
        assert words[a:b].tolist() == words[pos : pos + b - a].tolist()
    assert g.border[0] == 0 and len(g.border) < len(words)


def test_long_periodic_text_is_quick():
    import time

    n = 400_000
    for words in (np.zeros(n, np.int64), np.arange(n) % 5000, np.array(([0] * 99 + [1]) * (n // 100)), np.random.default_rng(1).integers(0, 2, n)):
        t = time.process_time()
        periodic_runs.find_runs(words)
        assert time.process_time() - t < 30


def digests(text, doc_id):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_brute(words)
    best, gone = None, set()
    for s, q, e in runs:
        gone.update(range(s + q, e))
        if best is None or (e - s) * best[2] > best[1] * q:
            best = (s, e - s, q)
    listed = "".join(f"{s},{e - s},{q}\n" for s, q, e in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_op12_against_all_periods(spark):
    out = periodic_runs.op12(spark, SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(out) == len(docs) and any(r.n_runs for r in out)
    for r in out:
        assert tuple(r)[1:] == digests(docs[r.doc_id], r.doc_id), r.doc_id


def test_runs_collapse(spark):
    line = "one two three four five six seven eight "
    docs = spark.createDataFrame([(1, "start " + line * 5 + "end", "x"), (2, line * 2, "y"), (3, None, None), (4, "", "z"), (5, line * 2 + line.upper() * 3, "w")], "id long, body string, runs string")
    out = {r.id: r for r in periodic_runs.periodic_runs(docs, text_col="body").collect()}
    assert out[1].collapsed == "start " + line + "end" and [tuple(x) for x in out[1].runs] == [(1, 40, 8)]
    assert out[2].collapsed == (line * 2).strip() and out[3].collapsed == out[4].collapsed == "" and not out[3].runs
    assert out[5].collapsed == line * 2 + line.upper().strip() and out[3].body is None


# 13


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Root and, per leaf, the (left, right) of its run level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k in range(len(leaves)):
            i = at[k]
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            paths[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
            at[k] = i // 16
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def manifest_brute(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda s: None if s is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    by = defaultdict(list)
    for r in rows:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        leaf = H(*map(enc, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))
        by[r.source].append((r.doc_id is not None, r.doc_id, leaf, H(*map(enc, (r.doc_id, r.source, r.lang, r.n_chars, low(r.text)))) if hit else leaf))
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[2] for x in sorted(by[s])]) for s in keys}
    root, above = tree([subs[s][0] for s in keys])
    out = []
    for k, s in enumerate(keys):
        for (_, doc_id, leaf, tampered), path in zip(sorted(by[s]), subs[s][1], strict=True):
            way, h = path + above[k], tampered
            for a, b in way:
                h = H(a, h, b)
            out.append((doc_id, leaf, subs[s][0], root, H(*[a + b for a, b in way]), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("d", [SMALL, MORE])
def test_op13_against_plain_trees(spark, d):
    got = sorted(map(tuple, merkle.op13(spark, d).collect()), key=str)
    assert got == manifest_brute(spark.read.parquet(f"{d}/documents.parquet").collect())
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "b": 16, "a": 17}, {None: 300, "": 1, "é": 2, "z": 256, "Z": 257}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_of_odd_sizes(spark, tmp_path, sizes):
    rows, k = [], 0
    for s, n in sizes.items():
        for i in range(n):
            rows.append((None if i == 3 else k, s, None if k % 5 else "en", k if k % 7 else None, [None, "", "Ab", "ab", "É x"][k % 5]))
            k += 1
    if len(rows) > 20:
        rows += [rows[5], rows[5]]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, merkle.op13(spark, str(tmp_path)).collect()), key=str)
    assert got == manifest_brute(spark.createDataFrame(rows, schema).collect())


def test_manifest_keeps_columns(spark):
    docs = spark.createDataFrame([(i, "s", f"x{i}", "own") for i in range(40)], "doc_id long, source string, row string, tree string").withColumn("leaf", merkle.record_hash(F.col("doc_id"), F.col("row")))
    out = merkle.merkle_proofs(docs)
    assert out.columns == [*docs.columns, "path", "subroot", "root"]
    rows = out.withColumn("again", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(rows) == 40 and all(r.again == r.root and r.tree == "own" and r.row == f"x{r.doc_id}" for r in rows)


# 2


def test_pieces_cover_the_item():
    rnd = random.Random(2)
    for _ in range(3000):
        n = rnd.randint(16, 120)
        item, count = "".join(rnd.choice("abc") for _ in range(n)), n // 16 + 2
        a = rnd.randint(0, n - 1)
        b = rnd.randint(a, n)
        if n - (b - a) < count - 1:
            continue
        cut = decontaminate.pieces(item, count, (a, b))
        assert len(cut) == count - (a == b == 0) * 0 and "".join(p for _, p in cut) == item and all(p and item.startswith(p, s) for s, p in cut)
        assert a == b or (a, item[a:b]) in cut


def edited(rnd, s, n):
    for _ in range(n):
        i = rnd.randrange(len(s) + 1)
        s = rnd.choice((s[:i] + rnd.choice("abcdef ") + s[i:], s[:i] + s[i + 1 :], s[:i] + rnd.choice("abcdef ") + s[i + 1 :]))
    return s


def test_items_with_one_stem_are_all_found():
    """The same result as every item against every text, for families of items with long, short and no common parts."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randint(2, 6)))
    stems = [" ".join(word() for _ in range(k)) for k in (3, 8, 12, 30)]
    items = [(i, f"{rnd.choice(['', word() + ' '])}{stem} {' '.join(word() for _ in range(rnd.randint(0, 9)))}") for i, stem in enumerate(rnd.choice(stems) for _ in range(120))]
    items += [(200 + i, " ".join(word() for _ in range(rnd.randint(1, 20)))) for i in range(40)]
    matcher, little = decontaminate.Matcher(items), decontaminate.Matcher(items, at_once=5)
    assert (matcher.stem >= 0).sum() > 30
    for _ in range(150):
        text = " ".join(word() for _ in range(rnd.randint(0, 10)))
        for _ in range(rnd.randint(0, 3)):
            text += " " + edited(rnd, decontaminate.normal(rnd.choice(items)[1]), rnd.randint(0, 9)) + " " + rnd.choice(stems) + " " + word()
        flat = decontaminate.normal(text)
        want = []
        for i, t in items:
            t = decontaminate.normal(t)
            d = decontaminate.myers(t, flat, len(t) // 16)
            if t and d <= len(t) // 16:
                want.append((i, d))
        assert matcher.hits(text) == little.hits(text) == sorted(want)


def test_a_stem_of_thousands_is_quick():
    import time

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randint(3, 8)))
    stem = "which of the following statements about the passage above is correct: "
    items = [(i, stem + " ".join(word() for _ in range(8))) for i in range(8000)]
    matcher = decontaminate.Matcher(items)
    text = " ".join(stem + " ".join(word() for _ in range(40)) for _ in range(5)) + " " + items[77][1]
    t = time.process_time()
    assert matcher.hits(text) == [(77, 0)]
    assert time.process_time() - t < 0.1


# 1


@pytest.fixture(scope="module")
def license_model(spark):
    rows = spark.read.parquet(f"{MORE}/documents.parquet").where("text is not null").select("text").limit(300).collect()
    known = licenses.templates()
    lines = [x for r in rows for x in r.text.split("\n") if x.strip()][:2400]
    return licenses.Model([x for x in lines if licenses.resemblance(licenses.words_of(x), known) < 0.3])


NAMED = [
    ("lgpl", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version."),
    ("gpl", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License"),
    ("cc-by-nc-sa", "This work is licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-sa", "Licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("agpl", "Licensed under the GNU AGPL v3"),
    ("apache,mit", "// SPDX-License-Identifier: MIT OR Apache-2.0"),
    ("apache,mit", "SPDX-License-Identifier: (Apache-2.0 AND MIT)"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0"),
    ("lgpl", "spdx-license-identifier: LGPL-2.1+"),
    ("", "SPDX-License-Identifier: BSL-1.0"),
    ("", "SPDX-License-Identifier: MIT-0"),
    ("bsd", "Copyright (c) 2012, Someone\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:"),
    ("proprietary", "Copyright 2020 Acme. All rights reserved."),
    # licences that neither the families nor the examples of the unknown class hold
    ("", "Licensed under the NASA Open Source Agreement, version 1.3"),
    ("", "Released under the ISC License."),
    ("", "This work is licensed under the Q Public License, version 1.0."),
    ("", "Licensed under the Universal Permissive License v 1.0"),
    ("", "Licensed under the Sleepycat License"),
    ("", "Licensed under the Nethack General Public License"),
]


@pytest.mark.parametrize("families, text", NAMED)
def test_license_names_with_qualifiers(license_model, families, text):
    assert ",".join(sorted(x["family"] for x in license_model.scan(text))) == families


# 3


def test_sample_is_in_proportion_to_size(spark):
    """Over many seeds a document is taken as often as its probability says; large ones are certain."""
    rows = [(i, "a", s) for i, s in enumerate([900, 50, 40, 30, 20, 10, 5, 5, 0])]
    sized = spark.createDataFrame([(str(i), s, n) for i, s, n in rows], "id string, source string, size long")
    rest = spark.createDataFrame([("a", 980.0)], "source string, rest double")
    slope = mixing.slopes(sized, rest).first().slope
    p = [min(1.0, slope * n) for _, _, n in rows]
    assert abs(sum(a * n for a, (_, _, n) in zip(p, rows, strict=True)) - 980) < 1e-6 and p[0] == 1 and p[1] < 1
    taken = np.zeros(len(rows))
    draws = 300
    seeds = spark.range(draws).select(F.col("id").alias("s"))
    u = (F.conv(F.substring(F.md5(F.concat("id", F.lit(":"), F.col("s").cast("string"))), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**48))
    for r in sized.where("size > 0").crossJoin(seeds).select("id", "size", "s", u.alias("u")).collect():
        q = 0.0 if p[int(r.id)] >= 1 else r.u / (1 - r.u) / (p[int(r.id)] / (1 - p[int(r.id)]))
        taken[int(r.id)] += q < 1
    assert abs(taken / draws - p).max() < 0.12


# the stage of near copies


def test_planted_near_copies_are_caught(spark):
    """Of pairs at a 5-shingle similarity of 0.8 and more none is missed here; one in 37,000 is to be expected at 0.8."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 7)))
    rows, pairs = [], 0
    for i in range(400):
        words = [word() for _ in range(rnd.randint(120, 400))]
        other = list(words)
        for _ in range(max(1, len(words) // 60)):
            other[rnd.randrange(len(other))] = word()
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, other))
        near = len(a & b) / len(a | b) >= 0.8
        pairs += near
        rows += [(2 * i, " ".join(words), near), (2 * i + 1, " ".join(other), near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near boolean")
    kept = {r.doc_id for r in simhash.simhash_stage(spark, docs, "").collect()}
    assert pairs > 150 and kept == {i for i, _, near in rows if not near or i % 2 == 0}


def test_texts_of_one_hash_are_told_apart(spark):
    rows = spark.createDataFrame([(7, 1, "a"), (7, 2, "b"), (7, 2, "b"), (8, 1, "c")], "text_hash__ long, text_hash_2__ long, text string")
    got = {}
    for r in simhash._told_apart(rows).collect():
        got.setdefault(r["text"], set()).add(r["text_hash__"])
    assert got["a"] == {7} and got["c"] == {8} and len(got["b"]) == 1 and got["b"] != {7}


# the stages quality rules and mixing against plain versions

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_brute(rows):
    """(doc_id, text) of the documents that the quality rules keep."""
    texts = defaultdict(set)
    for r in rows:
        texts[r.source].add(r.text or "")
    norm = lambda line: " ".join(WORD.findall(line)).lower()
    frequent = {}
    for host, own in texts.items():
        counts = Counter(x for t in own for x in {norm(line) for line in t.split("\n")} if x)
        frequent[host] = {x for x, n in counts.items() if n > 20 and n > 0.05 * len(own)}
    out = []
    for r in rows:
        words = WORD.findall(r.text or "")
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
            continue
        lines = r.text.split("\n")
        gone = [line for line in lines if norm(line) in frequent[r.source]]
        if len(words) - sum(len(WORD.findall(x)) for x in gone) < 0.5 * len(words):
            continue
        out.append((r.doc_id, "\n".join(x for x in lines if norm(x) not in frequent[r.source]) if gone else r.text))
    return sorted(out)


def test_quality_stage_against_plain_rules(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    extra = spark.range(60).select((F.col("id") + 10_000).alias("doc_id"), F.concat(F.lit("Read the full  story on our site\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x"), i.cast("string"))), " ")).alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    docs = docs.unionByName(extra)
    got = sorted((r.doc_id, r.text) for r in quality_rules.quality_stage(spark, docs, MORE).collect())
    assert got == kept_brute(docs.collect()) and any(i >= 10_000 and "story" not in t for i, t in got)


def mixed_brute(rows, weights=(5, 2, 1), share=1.5, cap=2.0, seed=42):
    """{doc_id: copies}: targets by giving shares again and again, samples by sorting."""
    by = defaultdict(list)
    for r in rows:
        by[r.source].append((r.doc_id, len(WORD.findall(r.text or ""))))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n in by[s]) for s in names}
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(size.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > cap * size[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: cap * size[s] for s in full}
        left -= sum(cap * size[s] for s in full)
        open_ -= full
    out = {}
    for s in names:
        whole = math.floor(target[s] / size[s] + 1e-12) if size[s] else 0
        rest = target[s] - whole * size[s]
        out |= {i: whole for i, _ in by[s]}
        if rest <= 1e-9:
            continue
        sizes, sure = sorted((n for _, n in by[s] if n), reverse=True), 0
        while (c := (rest - sum(sizes[:sure])) / sum(n * n for n in sizes[sure:])) * sizes[sure] > 1:
            sure += 1
        ranks = []
        for i, n in by[s]:
            if n:
                u = (int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                p = c * n
                ranks.append((0.0 if p >= 1 else u / (1 - u) / (p / (1 - p)), str(i), n, i))
        upto = 0
        for _, _, n, i in sorted(ranks):
            if 2 * upto + n > 2 * rest:
                break
            upto += n
            out[i] += 1
    return out


def test_mixing_stage_against_plain_sampling(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    want = mixed_brute(docs.collect())
    got = Counter(r.doc_id for r in mixing.mix_stage(spark, docs, MORE).collect())
    assert got == Counter({i: n for i, n in want.items() if n}) and len(set(want.values())) > 1
