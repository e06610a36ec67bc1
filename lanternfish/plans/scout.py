"""Queries over the interaction queue's side effects: arrivals, seeding, routing, alerts, rechecks, phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish.operators import interactions as it
from lanternfish.operators import scouting
from lanternfish.plans import flow
from lanternfish.plans.common import plain, registry, relation
from lanternfish.plans.projections import INTERACTIONS_SQL, interactions
from lanternfish.plans.reports import ADJUDICATIONS, STATES
from lanternfish.streaming import queue

QUERIES, ORACLE_SQL, query = registry()

#: What is known of a user, and the open entries of every third one.
_CACHE = """select distinct concat('U', user_id) as handle, case when user_id % 4 > 0 then cast('2024-01-05 00:00:00' as timestamp) - (user_id % 40) * interval 1 day end as last_full_audit,
    case when user_id % 3 = 0 then cast('2024-01-10 00:00:00' as timestamp) - (user_id % 9) * interval 1 day end as last_light_check, case when user_id % 2 = 0 then 'LOW' else 'AUDITED' end as risk from {events}"""
_QUEUE = "select distinct concat('u', user_id) as handle, case when user_id % 2 = 0 then 'LIGHT_CHECK' else 'FULL_AUDIT' end as level, case when user_id % 5 = 0 then 'HIGH' else 'LOW' end as priority from {events} where user_id % 3 = 0"
SETTINGS = scouting.Settings(likes=False)


@query(f"""with i as ({INTERACTIONS_SQL}), c as ({plain(_CACHE)}), q as ({plain(_QUEUE)}),
r as (select i.*, q.level as open_level, q.handle is not null as was_open, solicits as told, coalesce(abs(epoch_us(i.ts) - epoch_us(last_full_audit)) / 86400e6 <= 30, false) or (coalesce(risk = 'LOW', false) and coalesce(abs(epoch_us(i.ts) - epoch_us(last_light_check)) / 86400e6 <= 7, false)) as recent
    from i left join c on lower(c.handle) = i.handle left join q on q.handle = i.handle),
l as (select *, recent and not told as quiet, case when told or kind = 'NEW_FOLLOW' then 'FULL_AUDIT' when kind = 'LIKE' then 'OFF' else 'LIGHT_CHECK' end as level from r),
o as (select *, was_open or coalesce(bool_or(not quiet and level <> 'OFF') over (partition by handle order by seq rows between unbounded preceding and 1 preceding), false) as open_before, not quiet and level <> 'OFF' as goes from l),
d as (select *, greatest(case open_level when 'FULL_AUDIT' then 2 when 'LIGHT_CHECK' then 1 else 0 end, coalesce(max(case when (open_before or goes) and level = 'FULL_AUDIT' then 2 else 0 end) over (partition by handle order by seq rows between unbounded preceding and 1 preceding), 0)) as deep from o)
select seq, handle, case when not open_before and not goes then case when quiet then 'HISTORY_UPDATED' else 'IGNORED' end when not open_before then 'QUEUED' when level = 'FULL_AUDIT' and deep < 2 then 'MERGED_AND_ESCALATED' else 'MERGED_INTO_OPEN_ENTRY' end as result, level from d""")
def scout_arrivals(spark, sf_dir):
    """What each interaction does to the queue; solicitation is the trigger, and likes are switched off."""
    rows = interactions(spark, sf_dir).withColumn("triggers", F.when(F.col("solicits"), F.array(F.lit("suspicious solicitation begins"))).otherwise(F.array().cast("array<string>")))
    return scouting.arrivals(rows, relation(spark, sf_dir, _CACHE), relation(spark, sf_dir, _QUEUE), SETTINGS)


@query(ORACLE_SQL["scout_arrivals"])
def stream_arrivals(spark, sf_dir):
    """The same as a stream over the table's files, whose state starts with the cache and the open entries."""
    triggers = F.when(F.col("solicits"), F.array(F.lit("suspicious solicitation begins"))).otherwise(F.array().cast("array<string>"))
    stream = interactions(spark, sf_dir, stream=True).withColumn("triggers", triggers)
    cache, opened = relation(spark, sf_dir, _CACHE), relation(spark, sf_dir, _QUEUE)
    rows, _ = queue.run_once(stream, lambda s: queue.arrivals(s, cache, opened, SETTINGS))
    return rows.select("seq", "handle", "result", "level")


@query(flow.ORACLE_SQL["audit_queue"])
def stream_queue(spark, sf_dir):
    """The queue that a stream over the table's files leaves in its state."""
    stream = interactions(spark, sf_dir, stream=True).withColumn("triggers", F.array().cast("array<string>"))
    _, checkpoint = queue.run_once(stream, queue.arrivals, kept=False)
    return queue.open_entries(spark, checkpoint).select(F.col("key").alias("handle"), "level", "priority", "source_kind", "n_interactions")


_LATEST = f"a as (select *, lower(ltrim(handle, '@')) as key from ({plain(ADJUDICATIONS)})), l as (select * exclude (handle, id) from a qualify row_number() over (partition by key order by id desc) = 1)"
_OLD = "select concat('ACCT', p_partkey) as handle, case p_partkey % 3 when 0 then 'KEEP' when 1 then 'REVIEW' end as current_action, p_size % 4 as c, cast('2024-01-01 00:00:00' as timestamp) as last_full_audit from {part}"


@query(f"""with s as ({plain(STATES)}), {_LATEST}, c as ({plain(_OLD)})
select s.handle, case when k % 2 = 0 then timestamp '2024-03-01 12:00:00' else timestamp '2024-03-02 08:30:00' end as last_full_audit, enforcement as current_action, action as owner_action from s left join l on l.key = lower(s.handle)
where lower(s.handle) not in (select lower(handle) from c where c = 1)""")
def cache_seed(spark, sf_dir):
    states = relation(spark, sf_dir, STATES).withColumn("audited_on", F.when(F.col("k") % 2 == 0, "2024-03-01").otherwise("2024-03-02T08:30:00"))
    rows = scouting.seeded(states, relation(spark, sf_dir, ADJUDICATIONS), relation(spark, sf_dir, _OLD).where("c = 1"))
    return rows.withColumn("last_full_audit", F.col("last_full_audit").cast("timestamp_ntz"))


@query(f"with q as ({plain(_QUEUE)}) select distinct 'U' || user_id as handle, 'u' || user_id in (select handle from q where level = 'FULL_AUDIT') as audit from events")
def full_audit_routing(spark, sf_dir):
    return scouting.routed(relation(spark, sf_dir, "select distinct concat('U', user_id) as handle from {events}"), relation(spark, sf_dir, _QUEUE))


_ENTRIES = "select concat('acct', s_suppkey * 2) as handle from {supplier}"
_CLASS = "case k % 4 when 0 then ['NORMAL'] when 1 then ['SPAM'] when 2 then ['SPAM', 'SCAM'] else ['IMPERSONATION'] end"
_OLD_CLASS = "case c when 0 then ['NORMAL'] when 1 then ['SPAM'] when 2 then ['SCAM', 'SPAM'] end"


@query(f"""with s as (select *, {_CLASS} as classification from ({plain(STATES)})), {_LATEST}, c as (select *, {_OLD_CLASS} as old from ({plain(_OLD)})),
t as (select s.*, c.current_action, l.judged, coalesce(old, []::varchar[]) as old from s left join c on lower(c.handle) = lower(s.handle) left join l on l.key = lower(s.handle) where lower(s.handle) in (select handle from ({plain(_ENTRIES)})) and enforcement <> 'KEEP'),
r as (select handle, list_filter([case when coalesce(current_action = 'KEEP', true) then case when enforcement = 'REVIEW' then 'crossed REVIEW' else 'became ' || enforcement end end, case when judged is null then 'needs owner adjudication' end,
    case when len(list_filter(classification, lambda x: x <> 'NORMAL' and not list_contains(old, x))) > 0 then 'classification changed' end], lambda x: x is not null) as reasons from t)
select handle, array_to_string(reasons, '; ') as reasons from r where len(reasons) > 0""")
def scout_alerts(spark, sf_dir):
    lists = lambda *values: F.array(*[F.array(*map(F.lit, v)) if v else F.lit(None) for v in values])
    states = relation(spark, sf_dir, STATES).withColumn("classification", F.get(lists(["NORMAL"], ["SPAM"], ["SPAM", "SCAM"], ["IMPERSONATION"]), (F.col("k") % 4).cast("int")))
    cache = relation(spark, sf_dir, _OLD).withColumn("current_classification", F.get(lists(["NORMAL"], ["SPAM"], ["SCAM", "SPAM"], []), F.col("c").cast("int")))
    rows = scouting.alerts(states, cache, relation(spark, sf_dir, _ENTRIES), relation(spark, sf_dir, ADJUDICATIONS), scouting.Settings(review_flagged=True))
    return rows.select("handle", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""with s as ({plain(STATES)}), c as ({plain(_OLD)})
select handle, enforcement as current_action, timestamp '2024-06-15' as last_full_audit from s union all select handle, current_action, last_full_audit from c where lower(handle) not in (select lower(handle) from s)""")
def cache_synced(spark, sf_dir):
    rows = scouting.synced(relation(spark, sf_dir, STATES), relation(spark, sf_dir, _OLD), F.lit("2024-06-15").cast("timestamp"))
    return rows.withColumn("last_full_audit", F.col("last_full_audit").cast("timestamp_ntz"))


@query(f"""with q as ({plain(_QUEUE)}), w as (select distinct 'u' || user_id as handle from events where value > 50)
select coalesce(q.handle, w.handle) as handle, case when w.handle is not null then 'FULL_AUDIT' else level end as level, coalesce(priority, 'HIGH') as priority, case when w.handle is null then 'stale' when q.handle is null then 'owner asked' else 'owner asked; stale' end as reasons from q full join w on q.handle = w.handle""")
def owner_rechecks(spark, sf_dir):
    queue = relation(spark, sf_dir, _QUEUE).withColumn("reasons", F.array(F.lit("stale")))
    rows = scouting.owner_rechecks(queue, relation(spark, sf_dir, "select concat('U', user_id) as handle from {events} where value > 50"))
    return rows.select("handle", "level", "priority", F.array_join("reasons", "; ").alias("reasons"))


_ALERTS = "select o_orderkey as id, concat('acct', o_custkey) as handle, case o_orderkey % 3 when 0 then 'OPEN' when 1 then 'KEPT' else 'BLOCKED' end as status from {orders}"
_ANSWERS = "select concat('ACCT', c_custkey) as handle, case c_custkey % 2 when 0 then 'KEPT' else 'BLOCKED' end as how from {customer} where c_acctbal > 3000"


@query(f"with a as ({plain(_ALERTS)}), h as ({plain(_ANSWERS)}) select id, a.handle, case when status = 'OPEN' then coalesce(how, status) else status end as status from a left join h on lower(h.handle) = a.handle")
def alerts_resolved(spark, sf_dir):
    return scouting.resolved(relation(spark, sf_dir, _ALERTS), relation(spark, sf_dir, _ANSWERS))


def _words(kind: str, one: str, many: str) -> str:
    return f"case when count(*) filter (kind = '{kind}') = 1 then '{one}' when count(*) filter (kind = '{kind}') > 1 then replace('{many}', '{{}}', (count(*) filter (kind = '{kind}'))::varchar) end"


@query(f"with i as ({INTERACTIONS_SQL}), p as (select handle, array_to_string(list_filter([{', '.join(_words(*w) for w in scouting.WORDS)}], lambda x: x is not null), ' + ') as t from i group by 1) select handle, upper(t[1]) || t[2:] as phrase from p")
def interaction_phrases(spark, sf_dir):
    rows = it.history(interactions(spark, sf_dir))
    return rows.select("handle", scouting.phrase({k: F.col(f"n_{k.lower()}") for k in it.KINDS}).alias("phrase"))
