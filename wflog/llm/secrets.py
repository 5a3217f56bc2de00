"""Secret scans over an incremental blob ledger, in DataFrame expressions only.

Every version of every path is addressed by the SHA-256 of its text (its blob). A ledger remembers
which (blob, rule version) pairs were scanned; only unseen pairs are scanned, each distinct text once
however many paths and versions carry it, and the findings are joined back to all paths.

A rule is (kind, version, pattern, group, least length, guard): matches are leftmost and
non-overlapping; those whose group is shorter than the least length are dropped afterwards. Spans are
code points, end exclusive. They come from splitting the text at the matches: piece and match lengths add up to positions.

Scale: the ledger work runs on (blob, path) rows without text; the text moves once, each blob to
its own place, so a text that a third of all paths share is scanned once. The join back is splittable.

Edge cases: null text is the empty text and has a blob of its own; repeated rows each get their
findings; very long texts are scanned whole, in time linear in their matches; null paths are a path like any other; empty tables give empty results; only the named columns are read, so others may clash freely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_EITHER = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key")) + ")"
ASSIGN = "(" + _EITHER[3:-1] + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: kind, version, pattern, group, least length of the group, guard (one of these must be in the text).
#: The order of the kinds is the order of spans that start at the same place. Hex and access runs are
#: maximal, so a run too short can never hide a later match and the length can stand in the pattern.
RULES = (
    ("assign", "1", ASSIGN, 2, 12, (":", "=")),
    ("access", "1", "AKIA[A-Z0-9]{14,}", 0, 0, ("AKIA",)),
    ("hex", "1", "[0-9a-f]{16,}", 0, 0, ()),
    ("forge", "1", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, ("gh",)),
    ("jwt", "1", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 0, ("eyJ",)),
    ("pem", "1", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("-----BEGIN",)),
)
BASE = ("assign", "access", "hex")
#: Matches whose spans are put together at once.
BLOCK = 256
SPAN = "struct<start: int, rank: int, end: int, kind: string>"


def rule_key(rule) -> str:
    return f"{rule[0]}@{rule[1]}"


def spans_of(text: Column, rank: int, rule) -> Column:
    """Array of struct(start, rank, end, kind) of one rule's matches."""
    kind, _, pattern, group, least, guard = rule
    size = lambda a: F.transform(a, lambda x: F.length(x))
    bind = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  (a value that is used often is made once)
    pattern_col = F.lit(pattern)
    parts = F.arrays_zip(
        size(F.split(text, pattern, -1)).alias("gap"),
        size(F.regexp_extract_all(text, pattern_col, F.lit(0))).alias("hit"),
        size(F.regexp_extract_all(text, pattern_col, F.lit(group))).alias("part"),
    )
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def step(acc, x):
        at = acc["pos"] + x["gap"]
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + x["hit"]).alias("end"), F.lit(kind).alias("kind"))
        out = F.when(x["hit"].isNotNull() & (x["part"] >= least), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((at + F.coalesce(x["hit"], F.lit(0))).alias("pos"), out.alias("out"))

    def block_spans(blocks):
        """Appending costs the length of what is there: positions are added up by blocks, and within each."""
        ends = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + F.coalesce(x["hit"], F.lit(0))))
        begin = F.aggregate(ends, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        scan = lambda at: F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b, F.struct(F.get(at, i).alias("pos"), none.alias("out")), step)["out"]))
        return bind(begin, scan)

    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda b: F.slice(p, b * BLOCK + 1, F.lit(BLOCK)))
    found = bind(parts, lambda p: bind(cut(p), block_spans))
    test = text.rlike(pattern)
    if guard:
        some = F.contains(text, F.lit(guard[0]))
        for g in guard[1:]:
            some = some | F.contains(text, F.lit(g))
        test = some & test
    return F.when(test, found).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def scan_secrets(versions: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, path_col: str = "doc_id", text_col: str = "text", rules=RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings by path, blob findings, ledger).

    ``ledger`` (blob, rule) and ``known`` (blob, start, rank, end, kind per rule version ``rule``) are the
    results of earlier runs, or None; one without the other is refused, as known blobs would seem to be clean.
    Findings by path: path, blob, spans (array sorted by start, then rule order).
    """
    if (ledger is None) != (known is None):
        raise ValueError("a ledger and its findings belong together")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = versions.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    paths = materialize(keyed.select("path", "blob"), "secret-paths")
    todo = paths.groupBy("blob").agg(F.min("path").alias("path")).withColumn("rules", F.array(*[F.lit(rule_key(r)) for r in rules]))
    if ledger is not None:
        pairs = todo.select("blob", "path", F.explode("rules").alias("rule"))
        todo = pairs.join(ledger.select("blob", "rule"), ["blob", "rule"], "left_anti").groupBy("blob").agg(F.min("path").alias("path"), F.collect_set("rule").alias("rules"))
    texts = keyed.alias("k").join(todo.alias("t").hint("shuffle_hash"), (F.col("k.blob") == F.col("t.blob")) & F.col("k.path").eqNullSafe(F.col("t.path")))
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    spans = F.concat(*[F.when(F.array_contains("t.rules", rule_key(r)), spans_of(F.col("k.text"), i, r)).otherwise(empty) for i, r in enumerate(rules)])
    found = texts.select("k.blob", spans.alias("spans")).where(F.size("spans") > 0).dropDuplicates(["blob"])
    names = F.array(*[F.lit(rule_key(r)) for r in rules])
    fresh = found.select("blob", F.explode("spans").alias("s")).select("blob", F.element_at(names, F.col("s.rank") + 1).alias("rule"), "s.*")
    if known is not None:
        current = known.where(F.col("rule").isin([rule_key(r) for r in rules]))
        fresh = fresh.unionByName(current.select(fresh.columns))
        by_blob = fresh.groupBy("blob").agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("spans"))
    else:
        by_blob = found
    # written, so that a blob of very many paths can be split in the join
    by_blob = materialize(by_blob.select("blob", F.sort_array("spans").alias("spans")), "secret-spans")
    out = paths.alias("p").join(by_blob.alias("b"), F.col("p.blob") == F.col("b.blob"), "left").select("p.path", "p.blob", F.coalesce("b.spans", empty).alias("spans"))
    done = todo.select("blob", F.explode("rules").alias("rule"))
    return out, fresh, (done if ledger is None else ledger.select("blob", "rule").unionByName(done))


def scan_store(versions: DataFrame, store: str, path_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Findings by path; the ledger and the findings of all runs are kept as tables in the folder ``store``.

    A run appends what it scanned. Findings are written before the ledger: a run that is lost in between is scanned again, and
    its findings are read once.
    """
    spark = versions.sparkSession
    tables = {"ledger": "blob string, rule string", "findings": "blob string, rule string, start int, rank int, end int, kind string"}
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{store}/{name}")
    old = {name: spark.read.schema(schema).parquet(f"{store}/{name}").distinct() for name, schema in tables.items()}
    out, found, done = scan_secrets(versions, old["ledger"], old["findings"], path_col, text_col, rules)
    out = materialize(out, "secret-paths-found")
    fresh = materialize(done.join(old["ledger"], ["blob", "rule"], "left_anti"), "secret-scanned")
    found.join(fresh, ["blob", "rule"], "left_semi").select("blob", "rule", "start", "rank", "end", "kind").write.mode("append").parquet(f"{store}/findings")
    fresh.write.mode("append").parquet(f"{store}/ledger")
    return out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, _, _ = scan_secrets(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(F.col("path").alias("doc_id"), *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _op7_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, (k, _, p, g, least, _) in enumerate(RULES):
        parts.append(
            f"select rid, {i} as rank, {quote(k)} as kind, {least} as least, regexp_split_to_array(t, {quote(p)}) as gaps, regexp_extract_all(t, {quote(p)}) as hits, regexp_extract_all(t, {quote(p)}, {g}) as parts from d"
        )
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(parts)}),
e as (select rid, rank, kind, least, gaps, hits, parts, unnest(range(1, len(hits) + 1)) as i from m),
s as (select rid, rank, kind, length(parts[i]) >= least as ok, length(hits[i]) as n,
  list_sum(list_transform(gaps[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::bigint as a from e),
g as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, rank) filter (kind in ('assign', 'access', 'hex')), '') as base,
  string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, rank) as spans from s where ok group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (rid)
"""


OP7_SQL = _op7_sql()
