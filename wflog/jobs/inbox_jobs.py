"""Queries over inbound events, routes and matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import envelope_fingerprint, payload_fingerprint
from ..operators import inbox as I
from ..sources.adapters import adapt, cte
from .log_jobs import STARTS, starts
from .registry import job

AT = "timestamp_ntz '2024-01-20 00:00:00'"
AT_SQL = "timestamp '2024-01-20 00:00:00'"
TERMINAL = "('Completed', 'Failed', 'TimedOut', 'Cancelled', 'Terminated')"
_B64 = "base64(encode({}))"


def _part(c: str) -> str:
    return f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), '~')"


_ENVELOPE = ("event_name", "event_contract_version", "event_id", "correlation_id", "route_kind", "payload")


@job("envelope_fingerprint", cte("inbox") + f" select acceptance_sequence, upper(sha256({' || chr(124) || '.join(_part(c) for c in _ENVELOPE)})) as envelope, upper(sha256(payload)) as body from inbox")
def envelope(spark, d):
    return adapt(spark, d, "inbox").select("acceptance_sequence", envelope_fingerprint(*[F.col(c) for c in _ENVELOPE]).alias("envelope"), payload_fingerprint(F.col("payload")).alias("body"))


_TAIL = f"event_contract_version || '|' || {_B64.format('event_name')} || '|' || {_B64.format('correlation_id')}"
_DIRECT = f"'direct|' || instance_id || '|' || {_TAIL}"
_CORRELATION = f"'correlation|' || definition_id || '|' || {_TAIL}"
_TARGET = f"'definition-fanout-target|' || instance_id || '|' || definition_id || '|' || {_TAIL}"
_EVENT_ROUTE = f"case route_kind when 'direct' then {_DIRECT} when 'correlation' then {_CORRELATION} else {_TARGET} end"


def event_routes(spark, d):
    i = adapt(spark, d, "inbox")
    c = F.col
    return i.withColumn("route_key", I.event_route(c("route_kind"), c("instance_id"), c("definition_id"), c("event_contract_version"), c("event_name"), c("correlation_id")))


@job("route_keys", cte("inbox") + f" select acceptance_sequence, {_EVENT_ROUTE} as route_key from inbox")
def route_keys(spark, d):
    return event_routes(spark, d).select("acceptance_sequence", "route_key")


@job("classify_acceptance", cte("inbox") + """, b as (select *, first_value(envelope_fingerprint) over w as f, row_number() over w as rn from inbox window w as (partition by event_id order by acceptance_sequence))
    select event_id, acceptance_sequence, case when rn = 1 then 'Accepted' when f = envelope_fingerprint then 'Duplicate' else 'Conflict' end as result from b""")  # fmt: skip
def classify_acceptance(spark, d):
    return I.classify_acceptance(adapt(spark, d, "inbox"))


@job("check_direct_targets", cte("inbox", "projections") + f""" select acceptance_sequence, i.instance_id, case when p.status is null then 'DirectInstanceNotFound' when p.status in {TERMINAL} then 'DirectInstanceTerminal' else 'Ok' end as "check"
    from inbox i left join projections p using (instance_id) where route_kind = 'direct'""")  # fmt: skip
def check_direct_targets(spark, d):
    return I.check_direct_targets(adapt(spark, d, "inbox").where("route_kind = 'direct'"), adapt(spark, d, "projections")).select("acceptance_sequence", "instance_id", "check")


_FAN = "e as (select event_id, acceptance_sequence, definition_id from inbox where route_kind = 'definition-fanout' and state = 'Received'), live as (select definition_id, instance_id from projections where status not in " + TERMINAL + "), n as (select definition_id, count(*) as n from live group by 1)"


def fan_events(spark, d):
    return adapt(spark, d, "inbox").where("route_kind = 'definition-fanout' and state = 'Received'").select("event_id", "acceptance_sequence", "definition_id")


@job("definition_fanout", cte("inbox", "projections") + f", {_FAN} select acceptance_sequence, instance_id from e join n using (definition_id) join live using (definition_id) where n.n <= 1024")
def definition_fanout(spark, d):
    return I.definition_fanout(fan_events(spark, d), adapt(spark, d, "projections"))[0].select("acceptance_sequence", "instance_id")


@job("definition_fanout_limits", cte("inbox", "projections") + f", {_FAN} select acceptance_sequence, coalesce(n.n, 0) as n_targets, case when n.n > 350 then 'FanoutLimitExceeded' else 'Accepted' end as result from e left join n using (definition_id)")
def definition_fanout_limits(spark, d):
    return I.definition_fanout(fan_events(spark, d), adapt(spark, d, "projections"), 350)[1].select("acceptance_sequence", "n_targets", "result")


@job("match_pending_events", cte("inbox", "active_waits") + f""", p as (select *, {_EVENT_ROUTE} as route_key from inbox where state = 'Received'),
    w as (select wait_id, unnest([{_DIRECT}, {_CORRELATION}, {_TARGET}]) as route_key from active_waits),
    m as (select w.wait_id, p.acceptance_sequence, p.event_id, row_number() over (partition by w.wait_id order by p.acceptance_sequence, p.event_id, p.instance_id) as rn from w join p using (route_key))
    select wait_id, acceptance_sequence, event_id from m where rn = 1""")  # fmt: skip
def match_pending_events(spark, d):
    return I.match_pending_events(adapt(spark, d, "active_waits"), event_routes(spark, d))


_KEY = "definition_id, event_name, event_contract_version, correlation_id"


@job("resolve_correlation", cte("inbox", "active_waits") + f""", o as (select {_KEY}, count(distinct instance_id) as n, min(instance_id) as t from active_waits group by all)
    select acceptance_sequence, case when coalesce(n, 0) = 0 then 'buffered' when n = 1 then 'deliver' else 'ambiguous' end as result, case when n = 1 then t end as target from inbox left join o using ({_KEY}) where route_kind = 'correlation'""")  # fmt: skip
def resolve_correlation(spark, d):
    return I.resolve_correlation(adapt(spark, d, "inbox").where("route_kind = 'correlation'"), adapt(spark, d, "active_waits")).select("acceptance_sequence", "result", "target")


@job("pick_wait", cte("active_waits") + """, k as (select wait_id, instance_id, row_number() over (partition by instance_id, event_name, event_contract_version, correlation_id order by wait_sequence, coalesce(fiber_id, ''), wait_id) as rn from active_waits)
    select wait_id, instance_id from k where rn = 1""")  # fmt: skip
def pick_wait(spark, d):
    return I.pick_wait(adapt(spark, d, "active_waits")).select("wait_id", "instance_id")


@job("deliver_exactly_once", cte("inbox", "active_waits") + """, e as (select *, row_number() over (partition by event_name, correlation_id order by acceptance_sequence, event_id) as k from inbox where state = 'Received'),
    w as (select *, row_number() over (partition by event_name, correlation_id order by registered_at, wait_id) as k from active_waits)
    select e.acceptance_sequence, w.wait_id from e join w using (event_name, correlation_id, k)""")  # fmt: skip
def deliver_exactly_once(spark, d):
    return I.deliver_exactly_once(adapt(spark, d, "inbox").where("state = 'Received'"), adapt(spark, d, "active_waits"), ["event_name", "correlation_id"]).select("acceptance_sequence", "wait_id")


@job("list_received", cte("inbox") + """ select acceptance_sequence, event_id, instance_id from inbox where state = 'Received' and acceptance_sequence > 1000 order by 1, 2, 3 limit 500""")
def list_received(spark, d):
    i = adapt(spark, d, "inbox")
    return I.list_received(i, i.where("route_kind = 'definition-fanout'"), 1000, 500)


@job("list_handoff_retries", cte("inbox") + f""" select acceptance_sequence, event_id, instance_id from inbox where state = 'Received' and handoff_failure_count > 0 and handoff_retry_not_before <= {AT_SQL}
    order by handoff_retry_not_before, acceptance_sequence, event_id, instance_id limit 300""")  # fmt: skip
def list_handoff_retries(spark, d):
    i = adapt(spark, d, "inbox")
    roots = F.col("route_kind") == "definition-fanout"
    return I.list_handoff_retries(i.where(~roots), i.where(roots), F.expr(AT), 300).select("acceptance_sequence", "event_id", "instance_id")


@job("record_handoff_failure", cte("inbox") + f""", f as (select acceptance_sequence, cast(acceptance_sequence % 5 as int) as expected_count from inbox),
    h as (select i.*, coalesce(state = 'Received' and handoff_failure_count = expected_count, false) as hit from inbox i left join f using (acceptance_sequence))
    select acceptance_sequence, case when hit and handoff_failure_count + 1 >= 4 then 'Poisoned' else state end as state, case when hit then handoff_failure_count + 1 else handoff_failure_count end as handoff_failure_count,
      case when hit and handoff_failure_count + 1 >= 4 then null when hit then {AT_SQL} + cast(least(60, pow(2, handoff_failure_count)) as int) * interval '1' second else handoff_retry_not_before end as handoff_retry_not_before,
      case when hit and handoff_failure_count + 1 >= 4 then 'E1' end as poison_code, hit as applied from h""")  # fmt: skip
def record_handoff_failure(spark, d):
    i = adapt(spark, d, "inbox")
    f = i.select("acceptance_sequence", (F.col("acceptance_sequence") % 5).cast("int").alias("expected_count"), F.lit("E1").alias("code"))
    return I.record_handoff_failure(i, f, F.expr(AT), 4).select("acceptance_sequence", "state", "handoff_failure_count", "handoff_retry_not_before", "poison_code", "applied")


@job("transition_inbox", cte("inbox") + """, c as (select acceptance_sequence, case when acceptance_sequence % 4 = 0 then null else 'Received' end as expected from inbox),
    h as (select i.*, c.acceptance_sequence is not null and (expected is null or expected = state) as hit from inbox i left join c using (acceptance_sequence))
    select acceptance_sequence, case when hit then 'DuplicateIgnored' else state end as state, hit as applied from h""")  # fmt: skip
def transition_inbox(spark, d):
    i = adapt(spark, d, "inbox")
    c = i.select("acceptance_sequence", F.when(F.col("acceptance_sequence") % 4 != 0, "Received").alias("expected"), F.lit("DuplicateIgnored").alias("new_state"))
    return I.transition_inbox(i, c).select("acceptance_sequence", "state", "applied")


_INTENTS = """q as ({starts}), i as (select "key", definition_id, definition_version, fingerprint, case when cast("key" as bigint) % 5 = 0 then 'Poisoned' else 'Pending' end as state from q where seq % 40 = 0 qualify row_number() over (partition by "key" order by seq) = 1),
    s as (select "key", cast("key" as bigint) as instance_id, definition_id, definition_version, fingerprint from q where cast("key" as bigint) % 7 = 0 qualify row_number() over (partition by "key" order by seq) = 1)"""


def intents(spark, d):
    q = starts(spark, d)
    rn = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    number = F.col("key").cast("long")
    i = q.where("seq % 40 = 0").withColumn("rn", rn).where("rn = 1").drop("rn", "seq").withColumn("state", F.when(number % 5 == 0, "Poisoned").otherwise("Pending"))
    s = q.where(number % 7 == 0).withColumn("rn", rn).where("rn = 1").drop("rn", "seq").withColumn("instance_id", number)
    return q, i, s


@job("start_or_deliver", "with " + _INTENTS.format(starts=STARTS.format(orders="orders")) + """,
    r as (select q.*, s.instance_id, s.definition_id as sd, s.definition_version as sv, s.fingerprint as sf, i.state, i.definition_id as d, i.definition_version as v, i.fingerprint as f,
      first_value(q.definition_id) over w as fd, first_value(q.definition_version) over w as fv, first_value(q.fingerprint) over w as ff, row_number() over w as rn
      from q left join s using ("key") left join i using ("key") where seq % 40 <> 0 window w as (partition by "key" order by seq)),
    c as (select *, case when instance_id is not null and not (definition_id = sd and definition_version = sv and fingerprint = sf) then true when state = 'Poisoned' then true
      when state is not null and not (definition_id = d and definition_version = v and fingerprint = f) then true
      when instance_id is null and state is null then not (definition_id = fd and definition_version = fv and fingerprint = ff) else false end as conflict from r)
    select "key", seq, case when conflict then 'StartConflict' when instance_id is not null then 'DeliverDirect' when state is null and rn = 1 then 'IntentCreated' else 'IntentJoined' end as result,
      case when not conflict then instance_id end as started_id from c""")  # fmt: skip
def start_or_deliver(spark, d):
    q, i, s = intents(spark, d)
    return I.start_or_deliver(q.where("seq % 40 <> 0"), s, i)


@job("materialize_starts", "with " + _INTENTS.format(starts=STARTS.format(orders="orders")) + """, x as (""" + cte("inbox")[5:].split(" as (", 1)[1][:-1] + """),
    e as (select cast(definition_id * 7 % 150 as varchar) as "key", acceptance_sequence, event_name, event_contract_version, correlation_id, state, case when acceptance_sequence % 3 = 0 then null else instance_id end as instance_id, 'old' as route_key, case when acceptance_sequence % 4 = 0 then 'correlation' else 'start-or-deliver' end as route_kind from x),
    h as (select e.*, s.instance_id as new_id, s.instance_id is not null and e.instance_id is null and state = 'Received' and route_kind = 'start-or-deliver' as mine from e left join s using ("key"))
    select 'event' as part, cast(acceptance_sequence as varchar) as id, state, case when mine then new_id else instance_id end as instance_id, case when mine then 'direct|' || new_id || '|' || event_contract_version || '|' || base64(encode(event_name)) || '|' || base64(encode(correlation_id)) else route_key end as route_key from h
    union all select 'intent', i."key", case when s.instance_id is not null and i.state = 'Pending' then 'Materialized' else i.state end, case when i.state = 'Pending' then s.instance_id end, null from i left join s using ("key")""")  # fmt: skip
def materialize_starts(spark, d):
    _, i, s = intents(spark, d)
    x = adapt(spark, d, "inbox")
    e = x.select((F.col("definition_id") * 7 % 150).cast("string").alias("key"), "acceptance_sequence", "event_name", "event_contract_version", "correlation_id", "state", F.when(F.col("acceptance_sequence") % 4 == 0, "correlation").otherwise("start-or-deliver").alias("route_kind"), F.when(F.col("acceptance_sequence") % 3 != 0, F.col("instance_id")).alias("instance_id"), F.lit("old").alias("route_key"))
    i2, e2 = I.materialize_starts(i.withColumn("instance_id", F.lit(None).cast("long")), e, s)
    events = e2.select(F.lit("event").alias("part"), F.col("acceptance_sequence").cast("string").alias("id"), "state", "instance_id", "route_key")
    return events.unionByName(i2.select(F.lit("intent").alias("part"), F.col("key").alias("id"), "state", "instance_id", F.lit(None).cast("string").alias("route_key")))


@job("poison_targets", cte("inbox") + """, h as (select *, state = 'Received' and route_kind = 'direct' and instance_id % 12 = 0 as hit from inbox)
    select acceptance_sequence, case when hit then 'Poisoned' else state end as state, case when hit then 'TARGET_GONE' end as poison_code from h""")  # fmt: skip
def poison_targets(spark, d):
    p = adapt(spark, d, "inbox").where("instance_id % 12 = 0").select("instance_id")
    return I.poison_targets(adapt(spark, d, "inbox"), p, "TARGET_GONE").select("acceptance_sequence", "state", "poison_code")


@job("poison_start_keys", "with " + _INTENTS.format(starts=STARTS.format(orders="orders")) + """, x as (""" + cte("inbox")[5:].split(" as (", 1)[1][:-1] + """),
    e as (select cast(definition_id * 7 % 150 as varchar) as "key", acceptance_sequence, state, case when state = 'Poisoned' then 'EARLIER' end as poison_code from x),
    b as (select "key" from i where state = 'Pending' and cast("key" as bigint) % 2 = 0)
    select 'event' as part, cast(acceptance_sequence as varchar) as id, case when b."key" is not null and state = 'Received' then 'Poisoned' else state end as state, case when b."key" is not null and state = 'Received' then 'START_GONE' else poison_code end as poison_code from e left join b using ("key")
    union all select 'intent', i."key", case when b."key" is not null then 'Poisoned' else state end, case when b."key" is not null then 'START_GONE' end from i left join b using ("key")""")  # fmt: skip
def poison_start_keys(spark, d):
    q, i, _ = intents(spark, d)
    x = adapt(spark, d, "inbox")
    e = x.select((F.col("definition_id") * 7 % 150).cast("string").alias("key"), "acceptance_sequence", "state", F.when(F.col("state") == "Poisoned", "EARLIER").alias("poison_code"))
    i2, e2 = I.poison_start_keys(i, e, q.where(F.col("key").cast("long") % 2 == 0).select("key"), "START_GONE")
    events = e2.select(F.lit("event").alias("part"), F.col("acceptance_sequence").cast("string").alias("id"), "state", "poison_code")
    return events.unionByName(i2.select(F.lit("intent").alias("part"), F.col("key").alias("id"), "state", "poison_code"))


@job("classify_direct_delivery", cte("inbox", "projections", "active_waits") + f""", e as (select acceptance_sequence, event_id, envelope_fingerprint, instance_id, event_name, event_contract_version, 'c' || (instance_id % 1500) as correlation_id from inbox),
    a as (select distinct instance_id, event_name, event_contract_version from active_waits),
    r as (select e.*, p.status, a.instance_id is not null as waiting from e left join projections p using (instance_id) left join a on a.instance_id = e.instance_id and a.event_name = e.event_name and a.event_contract_version = e.event_contract_version),
    f as (select *, coalesce(status not in {TERMINAL} and waiting, false) as fit from r),
    g as (select *, first_value(case when fit then envelope_fingerprint end ignore nulls) over (partition by instance_id, event_id order by acceptance_sequence rows between unbounded preceding and 1 preceding) as earlier from f)
    select acceptance_sequence, case when earlier is not null then case when earlier = envelope_fingerprint then 'Duplicate' else 'EventConflict' end when status is null then 'InstanceNotFound' when status in {TERMINAL} then 'InstanceTerminal' when not waiting then 'NoActiveWait' else 'Accepted' end as result from g""")  # fmt: skip
def classify_direct_delivery(spark, d):
    i = adapt(spark, d, "inbox").withColumn("correlation_id", F.lit("c"))
    w = adapt(spark, d, "active_waits").withColumn("correlation_id", F.lit("c"))
    return I.classify_direct_delivery(i, adapt(spark, d, "projections"), w).select("acceptance_sequence", "result")


