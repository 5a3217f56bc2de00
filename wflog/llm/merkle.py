"""Merkle manifest of a dataset: a hash per document, a tree per source, a tree over the sources.

Slot pivot: the children of a node stand in ``fanout`` columns, filled by conditional aggregates over (tree, number // fanout).
Concatenating the columns and hashing them gives the node; concatenating the columns before and after a child's own gives its
siblings. Levels are built bottom-up, a table each, then proofs run top-down: a node's proof is its siblings and its parent's proof.

Scale: documents are read once; what goes on is one digest a document. Numbers inside a source come from ``ranked``, so a source with a third of all rows
is spread over many tasks. Each level has a ``fanout``-th of the rows of the one below, is combined map-side and joined by (tree, number), which no key dominates.
The number of levels is the logarithm of the largest source. A proof's text is made for a node's children in the task that holds the node.

Edge cases: a null in any field is hashed as ``-``; null and empty texts differ; null source is a tree of its own, the first; rows without an id come first in their tree;
repeated rows are leaves of equal hash beside each other, which may trade places without changing any digest; one very long text is hashed as one value; an empty
table gives no rows; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked, replaced

STEP = "array<struct<left: string, right: string>>"


def record_hash(*values: Column) -> Column:
    """SHA-256 of a record: each value as its length in bytes, ``:`` and itself, a null as ``-``."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings(path: Column) -> Column:
    """The siblings of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _levels(nodes: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """nodes (tree, number, members, h, row) -> per level the parents (tree, number, members of the level below, s0 .., h)."""
    most = nodes.agg(F.max("members")).first()[0] or 1
    levels = []
    for k in range(max(1, math.ceil(round(math.log(most, fanout), 9)))):
        slot = F.col("number") % fanout
        item = F.struct("h", "row") if k == 0 else F.struct("h")
        slots = [F.first(F.when(slot == i, item), ignorenulls=True).alias(f"s{i}") for i in range(fanout)]
        up = nodes.groupBy("tree", "members", F.floor(F.col("number") / fanout).alias("number")).agg(*slots)
        joined = F.sha2(F.concat(*[F.coalesce(F.col(f"s{i}.h"), F.lit("")) for i in range(fanout)]), 256)
        up = materialize(up.withColumn("h", F.when(F.col("members") > 1, joined).otherwise(F.col("s0.h"))), f"{name}-{k}")
        levels.append(up)
        nodes = up.select("tree", "number", F.ceil(F.col("members") / fanout).alias("members"), "h")
    return levels


def _descend(levels: list[DataFrame], tops: DataFrame, fanout: int, name: str) -> DataFrame:
    """Proofs of all leaves; tops: (tree, number 0, path, subroot, root) -> (item, path, subroot, root)."""
    for k in range(len(levels) - 1, -1, -1):
        both = levels[k].join(tops, ["tree", "number"])
        h = [F.coalesce(F.col(f"s{i}.h"), F.lit("")) for i in range(fanout)]
        children = []
        for i in range(fanout):
            left = F.concat(F.lit(""), *h[:i])
            right = F.concat(F.lit(""), *h[i + 1 :])
            path = F.when(F.col("members") > 1, F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))).otherwise(F.col("path"))
            child = F.struct((F.col("number") * fanout + i).alias("number"), F.col(f"s{i}").alias("item"), path.alias("path"))
            children.append(F.when(F.col(f"s{i}").isNotNull(), child))
        out = both.select("tree", "subroot", "root", F.explode(F.filter(F.array(*children), lambda c: c.isNotNull())).alias("c"))
        tops = out.select("tree", "c.number", "c.item", "c.path", "subroot", "root")
        tops = tops if k == 0 else materialize(tops.drop("item"), f"{name}-paths-{k}")
    return tops


def merkle_proofs(leaves: DataFrame, source_col: str = "source", order_col: str = "doc_id", hash_col: str = "leaf", fanout: int = 16) -> DataFrame:
    """Leaves with ``path`` (siblings per level, left and right of the node), ``subroot`` of their source and the dataset's ``root``.

    Leaves of a source ascend by ``order_col``; every ``fanout`` consecutive nodes become one until one is left. Sources ascend bytewise, null first.
    """
    # a null source's tree has the smallest name; the others keep their order behind a common first letter
    tree = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string"))).alias("tree")
    rows = leaves.select(tree, F.col(order_col).alias("o"), F.col(hash_col).alias("h"), F.struct("*").alias("row"))
    nodes = ranked(rows, ["tree"], ["o", "h"], "merkle-leaves").withColumnRenamed("rank", "number")
    trees = _levels(nodes, fanout, "merkle-tree")
    subroots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("o"), "h", F.struct("tree").alias("row"))
    above = _levels(ranked(subroots, ["tree"], ["o"], "merkle-subroots").withColumnRenamed("rank", "number"), fanout, "merkle-top")
    top = above[-1].select("tree", "number", F.array().cast(STEP).alias("path"), F.lit("").alias("subroot"), F.col("h").alias("root"))
    ways = materialize(_descend(above, top, fanout, "merkle-top"), "merkle-ways")
    tops = ways.select(F.col("item.row.tree").alias("tree"), F.lit(0).cast("long").alias("number"), "path", F.col("item.h").alias("subroot"), "root")
    out = _descend(trees, tops, fanout, "merkle-tree").withColumn("row", F.col("item.row"))
    return out.select(*replaced(leaves, "path", "subroot", "root"), "path", "subroot", "root")


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0
    leaf = record_hash(*head, F.col("text"))
    leaves = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(hit, record_hash(*head, tampered)).alias("tampered"))
    out = merkle_proofs(materialize(leaves, "merkle-hashes"))
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, start: str, depth: int) -> str:
    """Levels 0 .. depth of a tree as tables name0 ..: number i from 0, n nodes of the level, h, and the nodes before and after in the run."""
    of = lambda k: f"{name}{k} as materialized (select *, coalesce(string_agg(h, '') over l, '') as lft, coalesce(string_agg(h, '') over r, '') as rgt from {name}{k}_ window l as (partition by tree, i // 16 order by i rows between unbounded preceding and 1 preceding), r as (partition by tree, i // 16 order by i rows between 1 following and unbounded following))"
    parts = [f"{name}0_ as ({start})", of(0)]
    for k in range(depth):
        parts.append(f"{name}{k + 1}_ as (select tree, i // 16 as i, (any_value(n) + 15) // 16 as n, case when any_value(n) > 1 then sha256(string_agg(h, '' order by i)) else any_value(h) end as h from {name}{k} group by tree, i // 16)")
        parts.append(of(k + 1))
    return ",\n".join(parts)


#: Depth that the SQL unrolls: sources of up to 16 ** 6 documents, up to 16 ** 4 sources.
_DEPTH, _ABOVE = 6, 4
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda d: ord(d)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_FIELD = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c} end"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _op13_sql() -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"with d as materialized (select doc_id, coalesce('s' || source, '') as tree, {_LEAF('text')} as leaf, case when {_CRC} % 5 = 0 then {_LEAF(low)} end as tampered from documents),\n"
    sql += "p as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n from d),\n"
    sql += _tree_sql("t", "select tree, i, n, leaf as h from p", _DEPTH) + ",\n"
    sql += _tree_sql("u", f"select '' as tree, row_number() over (order by tree) - 1 as i, count(*) over () as n, h, tree as of from t{_DEPTH}", _ABOVE) + ",\n"
    # every leaf with its ancestor on each level
    steps = [f"t{k}" for k in range(_DEPTH)] + [f"u{k}" for k in range(_ABOVE)]
    joins = " ".join(f"join t{k} on t{k}.tree = p.tree and t{k}.i = p.i // {16**k}" for k in range(_DEPTH))
    joins += " join u0 on u0.of = p.tree" + "".join(f" join u{k} on u{k}.i = u0.i // {16**k}" for k in range(1, _ABOVE + 1))
    folded = "coalesce(tampered, leaf) as f0"
    cols = ", ".join(f"{s}.n as {s}n, {s}.lft as {s}l, {s}.rgt as {s}r" for s in steps)
    proof = " || ".join(f"case when {s}.n > 1 then {s}.lft || {s}.rgt else '' end" for s in steps)
    sql += f"w0 as (select p.doc_id, leaf, u0.h as subroot, u{_ABOVE}.h as root, sha256({proof}) as proof_sha256, {folded}, {cols} from p {joins})"
    for k, s in enumerate(steps):
        sql += f",\nw{k + 1} as (select * exclude (f{k}), case when {s}n > 1 then sha256({s}l || f{k} || {s}r) else f{k} end as f{k + 1} from w{k})"
    last = len(steps)
    return sql + f"\nselect doc_id, leaf, subroot, root, proof_sha256, f{last} as folded_root, f{last} = root as verified from w{last}"


OP13_SQL = _op13_sql()
