"""Queries over fan-out, joins and steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical_location, fiber_id
from ..operators import fanout as X
from ..sources.adapters import adapt, cte
from .registry import job


def orders(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("instance_id"), F.col("o_custkey").alias("n"), F.col("o_orderstatus").alias("s"))


O_SQL = "with o as (select o_orderkey as instance_id, o_custkey as n, o_orderstatus as s from orders)"


@job("then_step", O_SQL + " select instance_id, n * 2 + 1 as n, s from o")
def then_step(spark, d):
    return X.then(orders(spark, d), lambda b: b.assign(n=b["n"] * 2 + 1), "instance_id long, n long, s string")


@job("branch_if", O_SQL + " select instance_id, case when n % 3 = 0 then n * 10 else -n end as n, s from o")
def branch_if(spark, d):
    return X.branch_if(orders(spark, d), F.col("n") % 3 == 0, lambda f: f.withColumn("n", F.col("n") * 10), lambda f: f.withColumn("n", -F.col("n")))


@job("iterate_while", "with recursive o as (select o_orderkey as instance_id, o_custkey as n, 0 as rounds from orders), w as (select * from o union all select instance_id, n // 3, rounds + 1 from w where n > 10) select instance_id, n, rounds::bigint as rounds from w where not n > 10")
def iterate_while(spark, d):
    body = lambda f: f.withColumn("n", F.floor(F.col("n") / 3).cast("long")).withColumn("rounds", F.col("rounds") + 1)
    start = orders(spark, d).select("instance_id", "n", F.lit(0).cast("long").alias("rounds"))
    return X.iterate_while(start, F.col("n") > 10, body, 40, save=lambda f: f)


BRANCHES = {
    "double": lambda f: f.withColumn("result", F.col("n") * 2).withColumn("failed", F.lit(False)),
    "square": lambda f: f.withColumn("result", F.col("n") * F.col("n")).withColumn("failed", F.col("n") % 7 == 0),
    "minus": lambda f: f.withColumn("result", -F.col("n")).withColumn("failed", F.col("s") == "P"),
}


def merged(r):
    return F.array_join(F.transform(r, lambda x: F.concat(x["branch"], F.lit("="), F.when(x["failed"], F.lit("failed")).otherwise(x["result"].cast("string")))), ",")


@job("parallel_when_all", O_SQL + " select instance_id, case when n % 7 = 0 or s = 'P' then 'Failed' else 'Succeeded' end as status, case when not (n % 7 = 0 or s = 'P') then 'double=' || n * 2 || ',square=' || n * n || ',minus=' || -n end as merged from o")
def parallel_when_all(spark, d):
    return X.parallel_when_all(X.parallel_branches(orders(spark, d), "instance_id", BRANCHES), "instance_id", merged)


@job("parallel_outcomes", O_SQL + " select instance_id, 'Succeeded' as status, 'double=' || n * 2 || ',square=' || case when n % 7 = 0 then 'failed' else cast(n * n as varchar) end || ',minus=' || case when s = 'P' then 'failed' else cast(-n as varchar) end as merged from o")
def parallel_outcomes(spark, d):
    return X.parallel_outcomes(X.parallel_branches(orders(spark, d), "instance_id", BRANCHES), "instance_id", merged)


ITEMS = "select l_orderkey as scope, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as int) as item, cast(l_quantity as bigint) as q, l_partkey % 5 as k, l_returnflag = 'R' as failed, cast(l_partkey * 1000 + l_suppkey as bigint) as done_order, case l_returnflag when 'R' then 'failed' when 'A' then 'active' else case when l_linestatus = 'O' then 'pending' else 'completed' end end as state from {lineitem}"


def items(spark, d):
    return spark.sql(ITEMS, lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))


I_SQL = f"with i as ({ITEMS.format(lineitem='lineitem')})"


@job("first_winner", I_SQL + " , w as (select *, row_number() over (partition by scope order by done_order, item, failed) as rn from i) select scope, item as winner, case when failed then 'Failed' else 'Succeeded' end as status from w where rn = 1")
def first_winner(spark, d):
    i = items(spark, d).select("scope", F.col("item").alias("branch_ordinal"), F.col("done_order").alias("finished_at"), "failed")
    return X.first_winner(i, "scope")


@job("for_each", I_SQL + " select scope, case when count(*) <= 6 then 'Succeeded' else 'Failed' end as status, case when count(*) <= 6 then string_agg(q * 2, ',' order by item) end as results from i group by scope")
def for_each(spark, d):
    rows = items(spark, d).groupBy("scope").agg(F.transform(F.sort_array(F.collect_list(F.struct("item", "q"))), lambda x: x["q"]).alias("list"))
    out = X.for_each(rows, "scope", "list", lambda q: q * 2, 6)
    return out.select("scope", "status", F.array_join(F.transform("results", lambda x: x.cast("string")), ",").alias("results"))


def _policy_sql(policy: str) -> str:
    decides = {"WhenAny": "min(done_order) over (partition by scope)", "FailFast": "min(done_order) filter (failed) over (partition by scope)"}.get(policy, "null::bigint")
    bad = {"WhenAny": "bool_or(failed and done_order = fst) over (partition by scope)", "ContinueWithPartialFailures": "false"}.get(policy, "bool_or(failed) over (partition by scope)")
    return I_SQL + f""", f as (select *, min(done_order) over (partition by scope) as fst, {decides} as decides from i)
    select scope, item, done_order, failed, case when decides is not null and done_order > decides then 'Cancelled' when failed then 'Failed' else 'Completed' end as status, case when {bad} then 'Failed' else 'Succeeded' end as outcome from f"""  # fmt: skip


def _policy(policy: str):
    @job(f"join_policy_{policy.lower()}", _policy_sql(policy))
    def run(spark, d):
        return X.join_policy(items(spark, d).select("scope", "item", "done_order", "failed"), "scope", policy)


for _p in X.POLICIES:
    _policy(_p)


@job("admit_items", I_SQL + ", a as (select *, count(*) filter (state = 'active') over (partition by scope) as active, count(*) filter (state = 'pending') over (partition by scope order by item) as rank from i) select scope, item from a where state = 'pending' and rank + active <= 2")
def admit_items(spark, d):
    return X.admit_items(items(spark, d), "scope", 3, 2).select("scope", "item")


@job("for_each_progress", I_SQL + " select scope, count(*) as total, count(*) filter (state = 'active') as active, count(*) filter (state = 'completed') as completed, count(*) filter (state = 'failed') as failed, count(*) filter (state = 'cancelled') as cancelled from i group by scope")
def for_each_progress(spark, d):
    return X.for_each_progress(items(spark, d), "scope")


@job("partition_items", I_SQL + " select scope, item, (row_number() over (partition by scope order by item) - 1) // 3 as batch from i")
def partition_items(spark, d):
    return X.partition_items(items(spark, d), "scope", "item", 3).select("scope", "item", "batch")


@job("partition_items_by_key", I_SQL + ", f as (select *, min(item) over (partition by scope, k) as fst from i) select scope, item, k, dense_rank() over (partition by scope order by fst) - 1 as batch from f")
def partition_items_by_key(spark, d):
    return X.partition_items(items(spark, d), "scope", "item", by="k").select("scope", "item", "k", "batch")


@job("partition_items_custom", I_SQL + " select scope, item, q // 10 as batch from i")
def partition_items_custom(spark, d):
    return X.partition_custom(items(spark, d).select("scope", "item", "q"), "scope", lambda pdf: pdf["q"] // 10, many=True).select("scope", "item", "batch")


def _flaky(row: dict) -> dict:
    if row["n"] % 5 >= row["attempt"]:
        raise ValueError(f"n={row['n']}")
    return {"n": row["n"] + 1}


@job("run_steps_with_retry", O_SQL + """, k as (select *, case when n % 5 < 3 then n % 5 + 1 else 3 end::int as attempts, n % 5 < 3 as ok from o)
    select instance_id, case when ok then n + 1 else n end as n, case when ok then 'Succeeded' else 'Failed' end as status, attempts,
      array_to_string(list_transform(range(1, attempts + 1), lambda i: i || case when ok and i = attempts then ':Succeeded' else ':Failed' end), ',') as outcomes,
      case when not ok then 'STEP_FAILED' end as code, case when not ok then 'n=' || n end as message, case when not ok then 'ValueError' end as exception_type from k""")  # fmt: skip
def run_steps_with_retry(spark, d):
    out = X.run_steps_with_retry(orders(spark, d).select("instance_id", "n"), _flaky, 3)
    outcomes = F.array_join(F.transform("outcomes", lambda o: F.concat_ws(":", o["attempt"].cast("string"), o["outcome"])), ",")
    return out.select("instance_id", "n", "status", "attempts", outcomes.alias("outcomes"), "failure.*")


@job("attempt_summary", cte("attempts") + " select step_path, count(*) as attempts, count(*) filter (result = 'success') as success, count(*) filter (result = 'failed') as failed, count(*) filter (result = 'timed_out') as timed_out, count(*) filter (result = 'success' and attempt = 0) as first_try, round(quantile_cont(duration_ms, 0.95), 3)::double as p95_ms from attempts group by 1")
def attempt_summary(spark, d):
    return X.attempt_summary(adapt(spark, d, "attempts"))


FIBERS = "select l_orderkey as instance_id, l_linenumber = 1 as is_root, case l_returnflag when 'R' then 'Completed' when 'A' then 'Blocked' else case when l_linestatus = 'O' then 'Runnable' else 'Failed' end end as phase from {lineitem}"
SCOPES = "select o_orderkey as instance_id, case when o_orderkey % 6 = 0 then 'Joinable' when o_orderkey % 6 = 1 then 'Merging' else 'Open' end as phase from {orders}"


@job("derive_status", f"with f as ({FIBERS.format(lineitem='lineitem')}), s as ({SCOPES.format(orders='orders')})" + """, a as (select instance_id, max(phase) filter (is_root and phase in ('Completed', 'Failed')) as root_end, bool_or(phase = 'Runnable') as r, bool_or(phase = 'Blocked') as b from f group by 1)
    select a.instance_id, case when root_end is not null then root_end when coalesce(s.phase in ('Joinable', 'Merging'), false) or r then 'Running' when b then 'Waiting' else 'NothingLeft' end as status from a left join s using (instance_id)""")  # fmt: skip
def derive_status(spark, d):
    return X.derive_status(spark.sql(FIBERS, lineitem=spark.read.parquet(f"{d}/lineitem.parquet")), spark.sql(SCOPES, orders=spark.read.parquet(f"{d}/orders.parquet")))


@job("flatten_failures", O_SQL + """ select instance_id, 0 as depth, '0' as path, 'E' || n % 4 as code, 'top' as message, 'workflow:$' as location, null as exception_type, 'root' as occurrence, null as occurrence_id from o
    union all select instance_id, 1, '0.0000', 'E1', 'cause ' || n, null, 'System.IO', 'item', n::varchar from o where n % 2 = 0
    union all select instance_id, 1, '0.0001', 'E2', null, 'workflow:$/n:00000001', null, 'branch', 'left' from o where n % 2 = 0 union all select instance_id, 2, '0.0001.0000', 'E3', 'deep', null, null, 'root', null from o where n % 2 = 0""")  # fmt: skip
def flatten_failures(spark, d):
    deep = '{"code": "E2", "location": "workflow:$/n:00000001", "occurrence_kind": "Branch", "branch_id": "left", "causes": [{"code": "E3", "message": "deep"}]}'
    first = F.concat(F.lit('{"code": "E1", "exception_type": "System.IO", "item_index": '), F.col("n").cast("string"), F.lit(', "message": "cause '), F.col("n").cast("string"), F.lit('"}'))
    causes = F.when(F.col("n") % 2 == 0, F.concat(F.lit(', "causes": ['), first, F.lit(", " + deep + "]"))).otherwise("")
    tree = F.concat(F.lit('{"code": "E'), (F.col("n") % 4).cast("string"), F.lit('", "message": "top", "location": "workflow:$", "occurrence_kind": "Root"'), causes, F.lit("}"))
    return X.flatten_failures(orders(spark, d).withColumn("tree", tree), "instance_id", "tree").drop("rest")


@job("canonical_location", O_SQL + """ select instance_id, case when instance_id % 3 = 0 then 'workflow:$' else 'workflow:$/if:true/parallel:' || lpad(cast(n % 12 as varchar), 8, '0') || '/n:' || lpad(cast(n as varchar), 8, '0')
      || case when s = 'F' then '/while:body/n:00000002' when s = 'O' then '/lease:body' else '/foreach:body' end || '/if:false' end as location from o""")
def canonical(spark, d):
    inner = F.when(F.col("s") == "F", "body/2").when(F.col("s") == "O", "lease").otherwise("branches/item")
    path = F.concat_ws("/", F.lit("root/then/branches"), (F.col("n") % 12).cast("string"), F.lit("step"), F.col("n").cast("string"), inner, F.lit("else"))
    path = F.when(F.col("instance_id") % 3 != 0, path).when(F.col("instance_id") % 2 == 0, "root")
    return orders(spark, d).select("instance_id", canonical_location(path).alias("location"))


@job("fiber_ids", O_SQL + " select instance_id, upper(sha256('item|' || instance_id || '|' || n)) as fiber_id from o")
def fiber_ids(spark, d):
    return orders(spark, d).select("instance_id", fiber_id("item", F.col("instance_id"), F.col("n")).alias("fiber_id"))


@job("end_project", O_SQL + " select instance_id, n + 1 as output, case when s = 'F' then 'Done' else 'Open' end as outcome_name from o")
def end_project(spark, d):
    return X.end_project(orders(spark, d), F.col("n") + 1, F.when(F.col("s") == "F", "Done").otherwise("Open"))


