"""Queries over resource pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pools as P
from ..sources.adapters import adapt, cte
from ..sources.spread import parts_for, spread
from .registry import job

AT, AT_SQL = "timestamp_ntz '1998-06-01 00:00:00'", "timestamp '1998-06-01 00:00:00'"
T3 = ("pools", "tickets", "waiters")
_AGG = "t as (select pool, sum(units)::bigint as reserved, count(*) as held, count(*) filter (review_marked) as expired, min(review_deadline) filter (review_marked) as oldest from tickets group by 1), q as (select pool, count(distinct waiter_id) as queued from waiters group by 1)"


def three(spark, d):
    return [adapt(spark, d, n) for n in T3]


@job("pool_snapshots", cte(*T3) + f", {_AGG} select pool, capacity, greatest(0, capacity - coalesce(reserved, 0)) as available, coalesce(held, 0) as held, coalesce(queued, 0) as queued, coalesce(expired, 0) as expired from pools left join t using (pool) left join q using (pool)")
def pool_snapshots(spark, d):
    return P.pool_snapshots(*three(spark, d))


@job("pool_management", cte(*T3) + f", {_AGG} select pool, coalesce(reserved, 0) as reserved, greatest(0, coalesce(reserved, 0) - capacity) as debt, coalesce(queued, 0) as queued, oldest as oldest_review from pools left join t using (pool) left join q using (pool)")
def pool_management(spark, d):
    return P.pool_management(*three(spark, d))


POOL_LOG = """select user_id * 4 + event_id % 4 as pool, event_id as seq, 'h' || cast(event_id % 6 as string) as holder, case when event_type in ('click', 'error') then 'release' else 'acquire' end as op, 1 + event_id % 2 as units from {events}"""
CAPACITIES = "select distinct user_id * 4 + event_id % 4 as pool, cast(2 + user_id % 3 as bigint) as capacity from {events} where event_type <> 'signup'"


@job("audit_pool_log", f"with r as ({POOL_LOG.format(events='events')}), c as ({CAPACITIES.format(events='events')})" + """, a as (select r.*, capacity, coalesce(lag(op) over (partition by r.pool, holder order by seq) = 'acquire', false) as has from r left join c using (pool)),
    b as (select *, last_value(case when op = 'acquire' and not has then units end ignore nulls) over (partition by pool, holder order by seq rows between unbounded preceding and 1 preceding) as held from a),
    u as (select *, sum(case when capacity is null then 0 when op = 'acquire' and not has then units when op = 'release' and has then -held else 0 end) over (partition by pool order by seq rows unbounded preceding)::bigint as used from b)
    select pool, seq, holder, used, case when op = 'acquire' then case when capacity is null then 'Rejected' when has then 'Repeated' when used > capacity then 'Overcommitted' else 'Granted' end
      when has and capacity is not null then 'Released' else 'NotHeld' end as result from u""")  # fmt: skip
def audit_pool_log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return P.audit_pool_log(spark.sql(POOL_LOG, events=e), spark.sql(CAPACITIES, events=e))


@job("mark_ticket_review", cte("tickets") + f" select ticket_id, review_deadline <= {AT_SQL} and not review_marked as newly, review_marked or review_deadline <= {AT_SQL} as review_marked from tickets")
def mark_ticket_review(spark, d):
    return P.mark_ticket_review(adapt(spark, d, "tickets"), F.expr(AT)).select("ticket_id", "newly", "review_marked")


RESIZES = "select 'r' || cast(o_orderkey % 4000 as string) as operation_id, o_orderkey as seq, o_custkey % 50 as pool, cast(o_orderkey % 4000 % 7 + case when o_orderkey % 9 = 0 then 1 else 0 end as bigint) as capacity from {orders}"


@job("apply_resizes", f"with r as ({RESIZES.format(orders='orders')}), b as (select *, first_value(pool) over w = pool and first_value(capacity) over w = capacity as same, row_number() over w as rn from r window w as (partition by operation_id order by seq))" + """,
    c as (select *, case when same then case when rn = 1 then 'Applied' else 'Applied again' end else 'Conflict' end as result from b)
    select 'operation' as part, operation_id || '@' || seq as id, result as value from c union all select 'pool', cast(pool as varchar), cast(arg_max(capacity, seq) as varchar) from c where rn = 1 group by pool""")  # fmt: skip
def apply_resizes(spark, d):
    out, now = P.apply_resizes(spark.sql(RESIZES, orders=spark.read.parquet(f"{d}/orders.parquet")))
    a = out.select(F.lit("operation").alias("part"), F.concat_ws("@", "operation_id", "seq").alias("id"), F.when((F.col("result") == "Applied") & F.col("replay"), "Applied again").otherwise(F.col("result")).alias("value"))
    return a.unionByName(now.select(F.lit("pool").alias("part"), F.col("pool").cast("string").alias("id"), F.col("capacity").cast("string").alias("value")))


CONFIRM = "select 'c' || cast(event_id % 900 as string) as confirmation_id, event_id as seq, 't' || cast(event_id % 700 as string) as token, event_id from {events}"


@job("classify_stop_confirmations", f"with c as ({CONFIRM.format(events='events')})" + """, h as (select distinct token from c where cast(substring(token, 2) as int) % 3 = 0),
    r as (select distinct token, case when cast(substring(token, 2) as int) % 2 = 0 then 'old' || token end as was from c where cast(substring(token, 2) as int) % 3 = 1 or cast(substring(token, 2) as int) % 15 = 0),
    x as (select confirmation_id, seq, token, true as new from c union all select was, -1, token, false from r where was is not null),
    y as (select x.*, h.token is not null and r.token is null as held, r.was from x left join h on h.token = x.token left join r on r.token = x.token),
    z as (select *, first_value(case when not new or held then token end ignore nulls) over (partition by confirmation_id order by seq rows between unbounded preceding and 1 preceding) as bound from y),
    f as (select *, coalesce(bool_or(new and held and bound is null) over (partition by token order by seq, confirmation_id rows between unbounded preceding and 1 preceding), false) as freed from z)
    select confirmation_id, seq, token, case when bound is not null then case when bound = token then 'AlreadyConfirmed' else 'ConfirmationConflict' end when freed or was is not null then 'AlreadyConfirmed'
      when held then 'Released' else 'TokenNotFound' end as result from f where new""")  # fmt: skip
def classify_stop_confirmations(spark, d):
    c = spark.sql(CONFIRM, events=spark.read.parquet(f"{d}/events.parquet"))
    token = F.regexp_extract("token", "([0-9]+)", 1).cast("int")
    holders = c.where(token % 3 == 0).select("token").distinct()
    released = c.where((token % 3 == 1) | (token % 15 == 0)).select("token", F.when(token % 2 == 0, F.concat(F.lit("old"), F.col("token"))).alias("confirmation_id")).distinct()
    return P.classify_stop_confirmations(c.drop("event_id"), holders, released)


ENVELOPES = """select l_orderkey as instance_id, 'h' || cast(l_linenumber as string) as holder_key, case when l_linenumber = 7 then 'Other' else 'Resource' end as kind,
  case when l_linenumber = 6 then null else 'tok' || cast(l_orderkey * 10 + l_linenumber as string) end as token, min(min(l_shipdate)) over (partition by l_orderkey) as updated_at,
  case (l_orderkey + l_linenumber) % 9 when 0 then 'Held' when 1 then 'PendingCommit' when 2 then 'Released' when 3 then 'Quarantined' when 4 then 'ReviewMarked' when 5 then 'AmbiguousHeld' when 6 then 'LeaseLost' when 7 then 'CancelledBeforeGrant' else 'Requested' end as phase
from {lineitem} group by l_orderkey, l_linenumber"""
#: Open obligations and their tickets; the pools know three quarters of the tickets.
LEASES = f"""e as ({ENVELOPES.format(lineitem="lineitem")}), o as (select * from e where kind = 'Resource' and token is not null and phase not in ('Released', 'CancelledBeforeGrant')),
    lt as (select instance_id, holder_key, cast(pool as varchar) as pool, units % 5 as generation, ticket_id, units, units % 7 = 0 or (review_marked and units % 4 <> 0) as marked from tickets),
    lg as (select pool, case phase when 'PendingCommit' then 'pending_commit' when 'Held' then 'held' when 'ReviewMarked' then 'review_marked' when 'AmbiguousHeld' then 'ambiguous_held' else 'quarantined' end as state, count(*) as n, sum(units)::bigint as units, min(updated_at) filter (phase = 'Quarantined') as oldest
      from o join lt using (instance_id, holder_key) where phase in ('PendingCommit', 'Held', 'ReviewMarked', 'AmbiguousHeld', 'Quarantined') group by all)"""


def leases(spark, d, tickets=None):
    """Envelopes of obligations, read; all that is of an instance meets in the partition where its lines are, so that lines and tickets are dealt out once."""
    lines, t = spark.read.parquet(f"{d}/lineitem.parquet"), adapt(spark, d, "tickets") if tickets is None else tickets
    parts = parts_for(lines, lines.count())
    e = spark.sql(ENVELOPES, lineitem=spread(lines, parts, "l_orderkey"))
    e = e.groupBy("instance_id", "updated_at").agg(F.collect_list(F.struct("kind", "token", "phase", "holder_key")).alias("obligations"))
    ticket = F.struct("ticket_id", F.col("pool").cast("string").alias("pool"), "units", (F.col("units") % 5).alias("generation"), (F.col("units") % 7 == 0).alias("review_marked"))
    own = spread(t, parts, "instance_id").groupBy("instance_id").agg(F.collect_list(F.struct("holder_key", ticket.alias("ticket"))).alias("own"))
    of = lambda o: F.filter("own", lambda x: x["holder_key"] == o["holder_key"])["ticket"]
    whole = F.transform("obligations", lambda o: F.struct(*[o[c].alias(c) for c in ("kind", "token", "phase", "holder_key")], of(o).alias("lease_tickets")))
    json = e.join(own, "instance_id", "left").select("instance_id", "updated_at", F.to_json(F.struct(whole.alias("obligations"))).alias("envelope"))
    return P.outstanding_leases(json, t.where("units % 4 <> 0"))


@job("outstanding_leases", cte("tickets") + f""", {LEASES}, g as (select instance_id, holder_key, string_agg(concat_ws('/', pool, generation, ticket_id, units, marked), ',' order by pool, generation, ticket_id) as tickets from lt group by all)
    select instance_id, holder_key, token, case when phase in ('Held', 'PendingCommit', 'Quarantined', 'ReviewMarked', 'AmbiguousHeld', 'LeaseLost') then phase else 'Queued' end as status, coalesce(tickets, '') as tickets, case when phase = 'Quarantined' then updated_at end as quarantined_at
    from o left join g using (instance_id, holder_key)""")  # fmt: skip
def outstanding_leases(spark, d):
    text = F.transform("tickets", lambda t: F.concat_ws("/", t["pool"], t["generation"].cast("string"), t["ticket_id"], t["units"].cast("string"), t["review_marked"].cast("string")))
    return leases(spark, d).withColumn("tickets", F.array_join(text, ","))


@job("lease_gauges", cte("tickets") + f", {LEASES} select * from lg")
def lease_gauges(spark, d):
    return P.lease_gauges(leases(spark, d))


@job("release_evidence", "with e as (select user_id as instance_id, 'h' || (event_id % 3) as holder_key, event_id as seq, event_type as evidence from events) select * from e qualify row_number() over (partition by instance_id, holder_key order by seq desc) = 1")
def release_evidence(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return P.release_evidence(e.select(F.col("user_id").alias("instance_id"), F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string")).alias("holder_key"), F.col("event_id").alias("seq"), F.col("event_type").alias("evidence")))
