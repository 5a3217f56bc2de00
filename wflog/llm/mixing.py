"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. All its documents are taken ``floor(target / size)`` times for
certain; the rest of the target is filled by one Pareto order sample without replacement. A document's inclusion probability is in
proportion to its size, p = min(1, c * size), with c such that the expected words, the sum of p * size, are the rest; those at 1 are taken for certain. Documents
are ranked by q = odds(u) / odds(p), u a uniform number fixed by the document's id and the seed, and the smallest q are taken until their words
meet the rest of the target (the document that crosses it is taken when that comes nearer).

Scale: documents are never sorted or gathered by source. c comes from a histogram of sizes (a row per source and size, combined map-side), the cut from one histogram of q per source (``buckets``
rows at most): it tells the bucket in which the cut falls, and only that bucket's
documents, 1 in ``buckets`` of a source, are ranked exactly. What decides about a document is then
one row per source, so a source with a third of all rows only costs a splittable join.

Edge cases: null text has 0 words, and documents without words are never in the sample; null source is a source of its own, the last; repeated rows (same
id, same size) are taken or left together; rows without an id draw by their text and source, so only equal texts among them go together;
a very long text is one document, and the source that it crosses the target of ends up to half of it away; empty tables give empty results; other columns, whatever
their names, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, bring_back, hide, materialize, replaced


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def draw_key(doc_id: Column, text: Column, source: Column) -> Column:
    """What a document draws by: its id, or its text and source where it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(text, F.lit(""))), F.lit(" "), F.coalesce(source.cast("string"), F.lit(""))))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by the key, a text: 48 bits of an MD5."""
    digest = F.md5(F.concat(key, F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> plus target: weighted shares of ``share`` times all words, none above ``cap`` times its source.

    Water filling in closed form: by rising cap per weight a source is capped while the even share of
    what is left lies above its cap. One row per source goes through the one-partition windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights)) + 1)
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (
        t.withColumn("before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("w_left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("capped", (F.col("total") - F.col("before")) / F.col("w_left") > F.col("cap") / F.col("w"))
        .withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything))
        .withColumn("w_sum", F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(everything))
    )
    level = (F.col("total") - F.col("cap_sum")) / F.when(F.col("w_sum") > 0, F.col("w_sum")) * F.col("w")
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.coalesce(level, F.lit(0.0))).alias("target"))


def mixing_plan(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42, buckets: int = 65536) -> DataFrame:
    """One row per source: what decides how often each of its documents is taken.

    ``sized``: (id, source, size). Result: source, source_size, target, whole (certain copies), slope
    (probability of the extra copy per word), cut (struct q, id, size of the last document of the sample; null: none).
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, share, cap)
    whole = F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))
    plan = plan.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialize(plan.where("rest > 0 and source_size > 0").transform(lambda x: slopes(sized, x)).alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")), "right").select("p.*", "s.slope"), "mix-targets")
    ranked = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    ranked = ranked.where("p.slope is not null and d.size > 0").select("d.id", "d.source", "d.size", "p.rest", pareto_rank(F.col("d.id"), F.col("d.size"), F.col("p.slope"), seed).alias("q"))
    bucket = F.floor(F.col("q") / (1 + F.col("q")) * buckets)
    ranked = ranked.withColumn("bucket", bucket)
    hist = ranked.groupBy("source", "rest", "bucket").agg(F.sum("size").alias("words"))
    up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("upto", F.sum("words").over(up))
    edge = hist.where(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("below")), "bucket").alias("e"))
    near = ranked.alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.bucket") == F.col("e.e.bucket")))
    near = near.select("r.*", F.col("e.e.below").alias("below"))
    order = Window.partitionBy("source").orderBy("q", "id", "size")
    ties = Window.partitionBy("source", "q", "id", "size")
    near = near.withColumn("upto", F.col("below") + F.sum("size").over(order)).withColumn("tie", F.sum("size").over(ties))
    taken = near.where(2 * F.col("upto") - F.col("tie") <= 2 * F.col("rest"))
    cuts = taken.groupBy("source").agg(F.max(F.struct("q", "id", "size")).alias("cut"))
    cuts = edge.alias("e").join(cuts.alias("c"), F.col("e.source").eqNullSafe(F.col("c.source")), "left").select("e.source", F.col("e.e.bucket").alias("bucket"), "c.cut")
    out = plan.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
    return materialize(out.select("p.source", "p.source_size", "p.target", "p.whole", "p.slope", "c.bucket", "c.cut"), "mix-plan")


def slopes(sized: DataFrame, rest: DataFrame) -> DataFrame:
    """(source, slope): the c for which the sum of min(1, c * size) * size over a source's documents is its ``rest``.

    Where those above a size are certain, c is what they leave of the rest over the sum of squares below; it holds from the size on at which the largest below stays within 1.
    """
    counts = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    counts = counts.withColumn("words", F.col("n").cast("decimal(38,0)") * F.col("size")).withColumn("squares", F.col("n").cast("decimal(19,0)") * F.col("size") * F.col("size").cast("decimal(19,0)"))
    upto = Window.partitionBy("source").orderBy("size")
    total = Window.partitionBy("source")
    counts = counts.withColumn("below", F.sum("squares").over(upto)).withColumn("above", F.sum("words").over(total) - F.sum("words").over(upto))
    both = counts.alias("c").join(rest.alias("r"), F.col("c.source").eqNullSafe(F.col("r.source")))
    slope = (F.col("r.rest") - F.col("c.above").cast("double")) / F.col("c.below").cast("double")
    fits = both.select("c.source", "c.size", slope.alias("slope")).where("slope * size <= 1")
    return fits.groupBy("source").agg(F.max_by("slope", "size").alias("slope"))


def pareto_rank(key: Column, size: Column, slope: Column, seed: int) -> Column:
    """Rank of a document in its source's sample; 0 where it is certain."""
    u, p = uniform(key, seed), slope * size
    return F.when(p >= 1, F.lit(0.0)).otherwise(u / (1 - u) / (p / (1 - p)))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int = 65536) -> DataFrame:
    """Documents with ``mix`` = struct(size, source_size, target, copies, taken); no row is dropped or repeated here."""
    key = draw_key(F.col(id_col), F.col(text_col), F.col(source_col)).alias("id")
    sized = materialize(docs.select(key, F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sized")
    plan = mixing_plan(sized, weights, share, cap, seed, buckets)
    return apply_plan(docs, plan, seed, id_col, text_col, source_col, buckets)


def apply_plan(docs: DataFrame, plan: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int = 65536, size: Column | None = None, key: Column | None = None) -> DataFrame:
    key = draw_key(F.col(id_col), F.col(text_col), F.col(source_col)) if key is None else key
    row = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("mix_source"), key.alias("mix_id"), (word_count(F.col(text_col)) if size is None else size).alias("mix_size"))
    both = row.join(plan.alias("p"), row["mix_source"].eqNullSafe(F.col("p.source")), "left")
    q = pareto_rank(F.col("mix_id"), F.col("mix_size"), F.col("p.slope"), seed)
    b = F.floor(q / (1 + q) * buckets)
    here = F.struct(q.alias("q"), F.col("mix_id").alias("id"), F.col("mix_size").alias("size"))
    # no bucket: the rest takes every document; below the edge bucket all are taken, in it those up to the cut
    extra = F.when(F.col("p.slope").isNull() | (F.col("mix_size") <= 0), 0).when(F.col("p.bucket").isNull() | (b < F.col("p.bucket")), 1).when(b > F.col("p.bucket"), 0)
    extra = extra.when(F.col("p.cut").isNotNull() & (here <= F.col("p.cut")), 1).otherwise(0)
    copies = (F.coalesce(F.col("p.whole"), F.lit(0)) + extra).cast("long")
    mix = F.struct(F.col("mix_size").alias("size"), F.col("p.source_size"), F.col("p.target"), copies.alias("copies"), (copies * F.col("mix_size")).alias("taken"))
    return both.select(*replaced(docs, "mix"), mix.alias("mix"))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as many times as the mix takes it, numbered by ``mix_copy``.

    Null and empty texts have no words and are taken as often as their source's draw says; repeated rows are taken alike; an empty table gives none.
    """
    new = ("mix", "mix_copy")
    out = mix_sources(hide(docs, *new)).where("mix.copies > 0")
    number = F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int"))).alias("mix_copy")
    own = bring_back(docs, *new)
    return out.select(*own, number) if "mix_copy" not in docs.columns else out.select(*own, number.alias("mix_copy_number"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = draw_key(F.col("doc_id"), F.col("text"), F.col("source"))
    sized = materialize(docs.select("doc_id", key.alias("id"), "source", word_count(F.col("text")).alias("size")), "mix-sized")
    plan = mixing_plan(sized.drop("doc_id"))
    out = apply_plan(sized, plan, size=F.col("size"), key=F.col("id"))
    return out.select("doc_id", "size", F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target"), F.col("mix.taken").alias("taken"))


OP3_SQL = r"""
with sized as (
  select doc_id, coalesce(doc_id::varchar, 'null ' || md5(coalesce(text, '')) || ' ' || coalesce(source, '')) as id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sizes as (select source, sum(size)::bigint as source_size from sized group by source),
t0 as (select *, list_extract(list_value(5.0::double, 2.0::double, 1.0::double), (row_number() over (order by source asc nulls last) - 1) % 3 + 1) as w, source_size * 2.0::double as cap from sizes),
t1 as (select *, sum(cap) over (order by cap / w, source asc nulls last rows unbounded preceding) - cap as before,
  sum(w) over (order by cap / w, source asc nulls last rows between current row and unbounded following) as w_left,
  (sum(source_size) over ())::double * 1.5::double as total from t0),
t2 as (select *, (total - before) / w_left > cap / w as capped from t1),
t3 as (select *, sum(case when capped then cap else 0.0::double end) over () as cap_sum, sum(case when capped then 0.0::double else w end) over () as w_sum from t2),
t4 as (select source, source_size, case when capped then cap else coalesce((total - cap_sum) / nullif(w_sum, 0) * w, 0.0::double) end as target from t3),
t5 as (select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as whole from t4),
t6 as (select *, target - whole * source_size as rest from t5),
h as (select source, size, count(*) as n from sized where size > 0 group by source, size),
h1 as (select *, sum(n::hugeint * size * size) over w as below, sum(n::hugeint * size) over (partition by source) - sum(n::hugeint * size) over w as above from h window w as (partition by source order by size)),
h2 as (select h1.source, h1.size, (rest - above::double) / below::double as slope from h1 join t6 on h1.source is not distinct from t6.source where rest > 0),
t7 as (select t6.*, slope from t6 left join (select source, arg_max(slope, size) as slope from h2 where slope * size <= 1 group by source) x on x.source is not distinct from t6.source),
u as (select s.*, p.source_size, p.target, p.whole, p.rest, p.slope,
  (('0x' || substr(md5(id || ':42'), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double as u
  from sized s join t7 p on s.source is not distinct from p.source),
r as (select *, case when slope is null or size = 0 then null when slope * size >= 1 then 0.0::double else u / (1 - u) / (slope * size / (1 - slope * size)) end as q from u),
c as (select *, case when q is not null then sum(size) over (partition by source order by q nulls last, id, size) end as upto, sum(size) over (partition by source, q, id, size) as tie from r)
select doc_id, size, source_size, target,
  ((whole + case when q is not null and 2 * upto - tie <= 2 * rest then 1 else 0 end) * size)::bigint as taken from c
"""
