"""Packing of tokenised documents into training sequences by shortest-pack-first over the length histogram.

A document's ids are cut into pieces of the sequence length and a rest. Only the histogram of piece lengths, one number per length, reaches the driver. There lengths are
placed longest first, each into the packs with the most room left (the shortest packs). Packs of equal content are one pattern with a count, and a step places as many pieces
as the smaller of the two counts, so the work follows the number of patterns and not of documents. The number of packs is fixed beforehand: as many as the ids fill, and for what
is left one pack for each power of two in it. A piece that no pack has room for is cut: its first part fills the shortest pack, its rest goes back into the histogram among the
shorter lengths. So every pack is full and nothing is padded. The layout (ranges of ranks of a length -> ranges of sequences) is joined back to the pieces by their rank within their length.

Scale: texts are tokenised once, in Arrow batches; a word is tokenised once a worker while it stays in a cache of bounded size. Ranks come from ``ranked``, so a
length that a third of all pieces have (copies, full pieces) is spread over many tasks. Layout and pieces meet by (length, rank // 256), which no key dominates. Ids move once, in the join by document.

Edge cases: null text counts as empty and holds the end id alone; repeated rows and rows without an id are documents of their own; a very long text is one document of many pieces; ties in length go by
document id and position; an empty table gives no rows; only the id and text columns are read, whatever others are named.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked, small_batches

#: Ranks of one length that meet the layout together.
BLOCK = 256

#: Words joined by spaces, each as letters, final punctuation and, where it is no plain word, the rest.
_PARTS = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*)([.,;:!?]*)([^ ]*)(?: |$)")
#: Letters, a digit, or ASCII signs but the apostrophe, which may begin a word's end: each is a token of its own before the model merges.
_RUNS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9]|[!-&(-/:-@[-`{-~]+")


class Words:
    """Ids of texts by way of their words, as white space ends every token: a word is tokenised once while it is kept.

    Plain words are cut before their final punctuation and tokenised in lower case by the tokenizer's model alone: what the whole tokenizer does with letters.
    Tokenizers to which white space or case matters get whole words or whole texts.
    """

    def __init__(self, path: str, keep: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self.whole, self.keep = Tokenizer.from_file(path), keep
        self.by_word = self.ids("one two\n\ttwo") == self.ids("one") + 2 * self.ids("two")
        self.plain = self.ids("A\xe9.") == self.ids("a\xe9") + self.ids(".") and self.whole.encode("abc", add_special_tokens=False).tokens == ["abc</w>"]
        if hasattr(self.whole.model, "_resize_cache"):
            self.whole.model._resize_cache(0)  # this is the cache
        # the model sees bytes: those that can't be shown as letters from 256 on, the others as themselves
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.bytes = dict(zip((b for b in range(256) if b not in shown), range(256, 512), strict=False))
        self.model = self.whole.model
        self.parts: dict[str, bytes] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all words; ``number``: word -> its place in ``start`` and ``size``, which say where in ``flat`` its ids are."""
        self.number: dict[bytes, int] = {}
        self.flat, self.start, self.size = array("i"), array("q"), array("i")
        if len(self.parts) > self.keep:
            self.parts.clear()

    def ids(self, word: str) -> list[int]:
        return self.whole.encode(word, add_special_tokens=False).ids

    def part(self, part: str) -> bytes:
        """Ids of letters in lower case, or of punctuation."""
        found = self.parts.get(part)
        if found is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.bytes)
            found = self.parts[part] = array("i", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found

    def learn(self, words: list[bytes]) -> None:
        """Tokenise words that are not kept."""
        flat, parts, at = self.flat, self.parts, len(self.flat)
        text = b" ".join(words).decode("utf-8", "replace")
        pieces = _PARTS.findall(text) if self.plain else [("", "", w) for w in text.split(" ")]
        for word, (letters, end, rest) in zip(words, pieces, strict=False):
            if rest:
                whole = letters + end + rest
                runs = _RUNS.findall(whole) if self.plain and "<|" not in whole else ()
                if sum(map(len, runs)) == len(whole):
                    for low in map(str.lower, runs):
                        flat.frombytes(parts.get(low) or self.part(low))
                else:
                    flat.extend(self.ids(whole))
            else:
                low = letters.lower()
                if low:
                    flat.frombytes(parts.get(low) or self.part(low))
                if end:
                    flat.frombytes(parts.get(end) or self.part(end))
            self.number[word] = len(self.start)
            self.start.append(at)
            self.size.append(len(flat) - at)
            at = len(flat)

    def tokenize(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts in UTF-8."""
        if not self.by_word:
            return [np.array(self.ids(t.decode("utf-8", "replace")), np.int32) for t in texts]
        if len(self.number) > self.keep:
            self.reset()
        split = [t.split() for t in texts]
        at = [np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words)) for words in split]
        new = [[words[i] for i in np.flatnonzero(x < 0).tolist()] for words, x in zip(split, at, strict=True)]
        self.learn(list(set().union(*new)))
        flat, start, sizes, out = np.frombuffer(self.flat, np.int32), np.frombuffer(self.start, np.int64), np.frombuffer(self.size, np.int32), []
        for x, words in zip(at, new, strict=True):
            x[x < 0] = [self.number[w] for w in words]
            size = sizes[x].astype(np.int64)
            ends = np.cumsum(size)
            out.append(flat[np.repeat(start[x] - ends + size, size) + np.arange(ends[-1])] if len(x) else np.zeros(0, np.int32))
        return out


_WORDS: dict[str, Words] = {}


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(at, doc_id, doc_tokens, ids): the ids and the end id as little-endian 32-bit numbers; ``at`` numbers the rows."""
    small_batches(docs.sparkSession)
    fields = [f for f in docs.select(F.col(id_col).alias("doc_id")).schema.fields]

    def run(batches):
        words = _WORDS.get(tokenizer)
        if words is None:
            words = _WORDS[tokenizer] = Words(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [x.astype("<u4").tobytes() + end for x in words.tokenize([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])]
            n = [len(x) // 4 for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "doc_tokens", "ids"])

    kind = fields[0].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, doc_tokens long, ids binary")
    return materialize(out.select(F.monotonically_increasing_id().alias("at"), "*"), "pack-tokens")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Layout of pieces of ``histogram`` (length -> count) in full packs of ``size`` and powers of two below.

    Rows (length, rank, count, start, part, sequence, offset): of the pieces of this length with the ranks rank .. rank + count - 1, the ids from ``start``
    on, ``part`` of them, lie in the sequences sequence .. sequence + count - 1, one each, at ``offset``.
    """
    total = sum(n * length for length, n in histogram.items())
    room: dict[int, deque] = {}  # room left -> patterns (first sequence, count, used)
    if total // size:
        room[size] = deque([(0, total // size, 0)])
    sequence = total // size
    for b in range(size.bit_length(), -1, -1):
        if (total % size) >> b & 1:
            room.setdefault(1 << b, deque()).append((sequence, 1, 0))
            sequence += 1
    supply = {length: deque([(length, 0, n, 0)]) for length, n in histogram.items() if n}
    rows, most = [], max(room, default=0)
    for length in range(max(supply, default=0), 0, -1):
        pieces = supply.pop(length, ())
        while pieces:
            while not room.get(most):
                most -= 1
            of, rank, n, start = pieces.popleft()
            first, count, used = room[most].popleft()
            m, part = min(n, count), min(length, most)
            rows.append((of, rank, m, start, part, first, used))
            if count > m:
                room[most].appendleft((first + m, count - m, used))
            if most > part:
                room.setdefault(most - part, deque()).append((first, m, used + part))
            if n > m:
                pieces.appendleft((of, rank + m, n - m, start))
            if length > part:
                supply.setdefault(length - part, deque()).append((of, rank, m, start + part))
    return rows


def layout(tokens: DataFrame, size: int = 4096) -> DataFrame:
    """(at, doc_id, doc_tokens) -> (at, start, length, sequence_id, offset): where each piece of each document lies."""
    spark = tokens.sparkSession
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(size).cast("long"))).alias("begin")
    pieces = tokens.select("at", "doc_id", "doc_tokens", cuts).select("at", "doc_id", "begin", F.least(F.lit(size).cast("long"), F.col("doc_tokens") - F.col("begin")).alias("of"))
    pieces = ranked(pieces, ["of"], ["doc_id", "begin", "at"], "pack-pieces")
    histogram = {r["of"]: r["n"] for r in pieces.groupBy("of").agg(F.max("members").alias("n")).collect()}  # a row per length, size at most
    rows = shortest_pack_first(histogram, size)
    plan = spark.createDataFrame(rows, "of long, first long, n long, inside long, length long, sequence long, offset long")
    plan = plan.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("n") - 1) / BLOCK))))
    pieces = pieces.withColumn("block", F.floor(F.col("rank") / BLOCK))
    both = pieces.join(plan, ["of", "block"]).where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    return both.select("at", (F.col("begin") + F.col("inside")).alias("start"), "length", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ``ids``, the piece's ids as little-endian 32-bit numbers."""
    tokens = tokenized(docs, tokenizer, end_id, id_col, text_col)
    placed = layout(tokens.select("at", "doc_id", "doc_tokens"), size)
    # the pieces are a fiftieth of the ids: they are the side held in memory, ids stream past
    out = tokens.join(placed.hint("shuffle_hash"), "at")
    ids = F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))")
    return out.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", ids.alias("ids"))


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the sequences themselves, each the pieces of ``pack_documents`` in their order; at most one sequence's pieces meet."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
