"""Quality rules with cross-document line frequency, in DataFrame expressions only.

Per document the base counts are computed inside the row. The method then hashes every normalised
line (lower case, white space collapsed), counts in how many distinct documents of a host (source) it
stands, treats lines above the host's limit as boilerplate and rejects a document when too little of
it is left; what stays is given back without those lines. A document's exact copies within a host are one document here: they neither raise a
line's count nor deplete each other; near-duplicate operators deal with copies.

Scale: the line table has one small row per distinct line of a distinct document (no text); counts
are combined map-side, so a line that stands in every document costs one row per task; the join back
meets only frequent lines and can be split when skewed.

Edge cases: null and empty text have no words and fail the base rules; null source is a host of its
own; null ids pass through (ids are never read); a very long text is one row, its words and lines an array each; repeated rows are exact copies; lines without a word are ignored and stay; null text stays null; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bring_back, hide, materialize, replaced

SYMBOLS = "#*$%&|<>"
ROOM = " \t\n\x0b\x0c\r"


def line_hash(line):
    """Hash of a normalised line."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``base`` = struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines, digest).

    lines: array of struct(h, w), one entry per distinct normalised line, w its words counted over all repeats.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.struct("*").alias("row"), text.alias("t"))
    d = d.select("row", "t", F.array_remove(F.split("t", SPACE), "").alias("words"), F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, ROOM, "")) > 0).alias("ls"))
    d = d.select("row", "t", "words", "ls", F.expr("if(size(words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))").alias("h"))
    # only documents with a repeated window sort theirs by (hash, position)
    d = d.select("row", "t", "words", "ls", F.expr("if(size(array_distinct(h)) < size(h), sort_array(transform(h, (x, i) -> struct(x as x, i as i))), cast(array() as array<struct<x: bigint, i: int>>))").alias("s"))
    d = d.select("row", "t", "words", "ls", F.expr("sort_array(transform(filter(s, (e, i) -> (i > 0 and get(s, i - 1).x = e.x) or get(s, i + 1).x <=> e.x), e -> e.i))").alias("p"))
    repeat = F.expr("aggregate(transform(p, (q, i) -> least(3, coalesce(get(p, i + 1), q + 3) - q)), 0L, (a, x) -> a + x)")
    lines = F.transform("ls", lambda x: F.struct(line_hash(x).alias("h"), F.size(F.array_remove(F.split(x, SPACE), "")).alias("w")))
    base = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", ROOM, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        lines.alias("lines"),
        F.md5("t").alias("digest"),
    )
    return d.select(*replaced(docs, "base"), base.alias("base"))


def quality_rules(docs: DataFrame, text_col: str = "text", source_col: str = "source", min_words: int = 50, max_repeat: float = 0.5, min_docs: int = 20, max_share: float = 0.05, min_left: float = 0.5) -> DataFrame:
    """Documents with ``quality`` = struct(n_words .. n_repeat_words, base_failed, boilerplate_words, kept) and ``kept_text``.

    A line is boilerplate on a host when more than max(``min_docs``, ``max_share`` of the host's distinct
    documents) hold it. kept: the base rules hold and at least ``min_left`` of the words stand outside boilerplate.
    kept_text: the text without its boilerplate lines.
    """
    counted = base_counts(docs.select(F.col(text_col).alias("text"), F.col(source_col).alias("q_host")))
    slim = materialize(counted.groupBy("q_host", F.col("base.digest").alias("digest")).agg(F.first("base").alias("base")), "quality-lines")
    lines = slim.select("q_host", "digest", F.explode("base.lines").alias("l")).groupBy("q_host", "digest", F.col("l.h").alias("h")).agg(F.sum("l.w").alias("w"))
    hosts = slim.groupBy("q_host").agg(F.count("*").alias("n_host"))
    frequent = lines.groupBy("q_host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    frequent = frequent.alias("f").join(hosts.alias("n"), F.col("f.q_host").eqNullSafe(F.col("n.q_host"))).where(F.col("n_docs") > F.col("n_host") * F.lit(max_share)).select("f.q_host", "f.h")
    gone = lines.alias("l").join(frequent.alias("f"), F.col("l.q_host").eqNullSafe(F.col("f.q_host")) & (F.col("l.h") == F.col("f.h")), "left_semi")
    gone = gone.groupBy("q_host", "digest").agg(F.sum("w").alias("lost"), F.collect_set("h").alias("gone"))
    verdicts = slim.select("q_host", "digest", *[F.col(f"base.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
    verdicts = verdicts.alias("v").join(gone.alias("g"), F.col("v.q_host").eqNullSafe(F.col("g.q_host")) & (F.col("v.digest") == F.col("g.digest")), "left")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * F.lit(max_repeat))
    lost = F.coalesce(F.col("lost"), F.lit(0))
    kept = ~failed & (F.col("n_words") - lost >= F.col("n_words") * F.lit(min_left))
    verdicts = verdicts.select("v.q_host", "v.digest", F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), lost.alias("boilerplate_words"), kept.alias("kept")).alias("quality"), "gone")
    keyed = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("q_host"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    out = keyed.alias("d").join(verdicts.alias("v"), F.col("d.q_host").eqNullSafe(F.col("v.q_host")) & (F.col("d.digest") == F.col("v.digest")))
    whole = F.col("d.row").getField(text_col)
    rest = F.array_join(F.filter(F.split(whole, "\n"), lambda x: ~F.array_contains(F.col("v.gone"), line_hash(x))), "\n")
    kept_text = F.when(F.col("v.gone").isNull(), whole).otherwise(rest)
    return out.select(*replaced(docs, "quality", "kept_text"), F.col("v.quality").alias("quality"), kept_text.alias("kept_text"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; the others lose their boilerplate lines.

    Null and empty texts are rejected; a text of boilerplate lines alone too; repeated rows stay or go together; an empty table gives none.
    """
    new = ("quality", "kept_text")
    out = quality_rules(hide(docs, *new)).where("quality.kept")
    cut = F.col("quality.boilerplate_words") > 0
    changed = {"text": F.col("kept_text"), "n_chars": F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[changed[c].alias(c) if changed.get(c) is not None else own for c, own in zip(docs.columns, bring_back(docs, *new), strict=True)])


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    q = quality_rules(docs)
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


_COUNTS_SQL = r"""
w as (select *, row_number() over () as rid, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from __docs__),
g as (select rid, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
g1 as (select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram from g),
g2 as (select rid, i, count(*) over (partition by rid, gram) as n from g1),
g3 as (select rid, i, lead(i) over (partition by rid order by i) as nxt from g2 where n > 1),
g4 as (select rid, sum(least(3, coalesce(nxt - i, 3)))::bigint as n_repeat_words from g3 group by rid),
b as (select w.*, len(words)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, md5(t) as digest
  from w left join g4 using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b),
dd as (select distinct source, digest, ls from f),
li as (select source, digest, unnest(ls) as line from dd),
lj as (select source, digest, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) as l, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from li),
lk as (select source, digest, l, sum(n) as n from lj group by all),
ho as (select source, count(*) as n_host from dd group by source),
fr as (select k.source, k.l from (select source, l, count(*) as n_docs from lk group by all) k join ho on k.source is not distinct from ho.source where n_docs > 20 and n_docs > n_host * 0.05::double),
go as (select lk.source, lk.digest, sum(n) as lost from lk join fr on lk.source is not distinct from fr.source and lk.l = fr.l group by all),
quality as (select f.*, not base_failed and n_words - coalesce(lost, 0) >= n_words * 0.5::double as kept
  from f left join go on f.source is not distinct from go.source and f.digest = go.digest)
"""

OP10_SQL = "with " + _COUNTS_SQL.replace("__docs__", "documents") + "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from quality"
