"""Queries over block plans, reports, unblocks and the paced job, from tables of states, adjudications and report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish.operators import jobs, ledger
from lanternfish.plans.common import plain, registry, relation
from lanternfish.plans.evidence import EXCLUSIONS, name_rule_sql

QUERIES, ORACLE_SQL, query = registry()

STATES = """
select c_custkey as k, concat(case when c_custkey % 2 = 0 then 'Acct' else 'acct' end, c_custkey) as handle, case c_custkey % 4 when 0 then 'KEEP' when 1 then 'REVIEW' when 2 then 'BLOCK_CANDIDATE' else 'BLOCK_CONFIRMED' end as enforcement
from {customer}"""
ADJUDICATIONS = """
select o_orderkey as id, concat(case when o_orderkey % 2 = 0 then '@ACCT' else 'acct' end, o_custkey) as handle, case o_orderkey % 5 when 0 then 'BLOCK' when 1 then 'BLOCK' when 2 then 'KEEP' when 3 then 'KEEP' end as action,
       o_orderkey % 11 = 0 as unblock_requested from {orders}"""
#: Rows of reports: a supplier's lines are a batch, a part's number an account.
REPORTS = """
select l_orderkey * 10 + l_linenumber as seq, l_suppkey as batch, concat(case when l_partkey % 2 = 0 then '@Acct' else 'acct' end, l_partkey % 1500 + 1) as handle, l_orderkey % 10 > 0 as handle_reverified, case when l_orderkey % 12 > 0 then l_orderkey % 3 > 0 end as decision_confirmed,
       l_linenumber % 2 = 1 as block_clicked, l_linenumber % 6 = 2 as already_blocked, l_partkey % 7 > 0 as reloaded, l_partkey % 9 > 0 as shows_blocked, l_partkey % 13 = 0 as account_gone, l_shipdate as ts,
       case l_orderkey % 97 when 5 then 'RATE_LIMIT' when 6 then 'CAPTCHA' end as stop_reason, l_linenumber % 3 > 0 as report_submitted, l_partkey % 5 > 0 as confirmed, l_partkey % 101 = 0 as bio_link_clicked,
       case l_linenumber % 3 when 0 then 'spam' when 1 then 'Impersonation' else '' end as report_option, l_linenumber % 2 = 0 as unblock_clicked, l_partkey % 4 > 0 as shows_unblocked
from {lineitem}"""


def _reports(spark, sf_dir):
    """REPORTS with arrival, a row's place in the table's files, as two lines of an order may have one number."""
    from lanternfish.plans.common import filed

    return filed(spark, sf_dir, REPORTS, "lineitem")


PLAN = "select distinct l_suppkey as batch, concat('ACCT', l_partkey % 1500 + 1) as handle from {lineitem} where l_quantity > 5"
_CUT = f"""
with rows_ as ({plain(REPORTS)}), plan as (select batch, lower(handle) as key from ({plain(PLAN)})),
cut as (select *, lower(ltrim(handle, '@')) as key, coalesce(max(stop_reason is not null) over (partition by batch order by seq rows between unbounded preceding and 1 preceding), false) as stopped from rows_),
r as (select c.*, p.key is not null as planned from cut c left join plan p using (batch, key) where not stopped)
"""
_ENFORCED = _CUT + """, enforced as (
    select batch, seq, key, ts, stop_reason, already_blocked, account_gone as gone, block_clicked and planned as attempted,
           handle_reverified and coalesce(decision_confirmed, false) and (block_clicked or already_blocked) and reloaded and shows_blocked and planned as verified, planned, handle_reverified, reloaded, shows_blocked from r)
"""


def _enforced(spark, sf_dir):
    return ledger.enforcement_records(_reports(spark, sf_dir), relation(spark, sf_dir, PLAN))


@query(_ENFORCED + """select batch, seq, key, attempted, verified, case when stop_reason = 'RATE_LIMIT' then 'RATE_LIMITED' when stop_reason is not null then 'SECURITY_PAUSE' end as pause,
    array_to_string(list_filter([case when not planned then 'handle was not in the planned batch: ignored' end, case when attempted and not reloaded then 'block clicked but page not reloaded: NOT verified' end,
        case when attempted and reloaded and not shows_blocked then 'reloaded but not shown as blocked' end, case when not handle_reverified then 'handle not re-verified' end], lambda x: x is not null), '; ') as problems from enforced""")
def enforcement_records(spark, sf_dir):
    return _enforced(spark, sf_dir).select("batch", "seq", "key", "attempted", "verified", "pause", F.array_join("problems", "; ").alias("problems"))


@query(_ENFORCED + f""", s as ({plain(STATES)}),
per as (select key, bool_or(attempted) as a, bool_or(verified) as v, arg_max(ts, seq) filter (verified) as vt, arg_max(ts, seq) filter (attempted) as att from enforced group by 1)
select handle, case when v then 'BLOCK_VERIFIED' when a then 'BLOCK_ATTEMPTED_UNVERIFIED' else 'NOT_BLOCKED' end as status, case when v then vt else att end as block_ts from s left join per on lower(handle) = key""")
def enforcement_status(spark, sf_dir):
    return ledger.enforcement_status(relation(spark, sf_dir, STATES), _enforced(spark, sf_dir).withColumn("id", F.col("seq")))


_LATEST = f"latest as (select lower(ltrim(handle, '@')) as key, arg_max(coalesce(action, '-'), id) as action_, arg_max(unblock_requested, id) as unblock_requested from ({plain(ADJUDICATIONS)}) group by 1), latest_ as (select key, nullif(action_, '-') as action, unblock_requested from latest)"


@query(_ENFORCED + f""", s as ({plain(STATES)}), {_LATEST},
done as (select distinct key from enforced where verified),
t as (select s.handle, s.enforcement, action from s left join latest_ l on l.key = lower(s.handle) where lower(s.handle) not in (select key from done))
select 'REVIEW_WITH_ME' as mode, handle, enforcement, 'owner chose BLOCK' as basis from t where action = 'BLOCK'
union all select 'HIGH_CONFIDENCE_AUTO_CLEAN', handle, enforcement, case when action = 'BLOCK' then 'owner chose BLOCK' else 'BLOCK_CONFIRMED: all gates passed' end from t where coalesce(action, '') <> 'KEEP' and (action = 'BLOCK' or enforcement = 'BLOCK_CONFIRMED')""")
def enforcement_plan(spark, sf_dir):
    """The block plans of all modes; AUDIT_ONLY plans nothing."""
    states, adjudications, done = relation(spark, sf_dir, STATES), relation(spark, sf_dir, ADJUDICATIONS), _enforced(spark, sf_dir).where("verified")
    out = None
    for mode in ledger.MODES:
        rows = ledger.block_plan(states, adjudications, done, mode).select(F.lit(mode).alias("mode"), "handle", "enforcement", "basis")
        out = rows if out is None else out.unionByName(rows)
    return out


_REPORTED = _CUT + """, reported as (
    select batch, seq, key, handle_reverified and report_submitted and confirmed and planned as done, account_gone, planned, handle_reverified, report_submitted, confirmed, bio_link_clicked, nullif(upper(report_option), '') as option
    from r where stop_reason is null or report_submitted)
"""


def _reported(spark, sf_dir):
    return ledger.report_records(_reports(spark, sf_dir), relation(spark, sf_dir, PLAN))


@query(_REPORTED + """select batch, seq, key, case when done then 'REPORTED' else 'REPORT_FAILED' end as status, option, account_gone and not done as no_retry,
    array_to_string(list_filter([case when not planned then 'handle was not in the planned batch: ignored' end, case when not handle_reverified then 'handle not re-verified' end, case when report_submitted and not confirmed then 'submitted but not confirmed' end,
        case when bio_link_clicked then 'a bio link was clicked (never allowed)' end, case when account_gone and not done then 'account suspended or missing: not retried' end], lambda x: x is not null), '; ') as problems from reported""")
def report_records(spark, sf_dir):
    return _reported(spark, sf_dir).select("batch", "seq", "key", "status", "option", "no_retry", F.array_join("problems", "; ").alias("problems"))


LISTED = "select p_partkey as pos, concat('Acct', p_partkey) as handle, case p_partkey % 6 when 0 then 'Elon Musk' when 1 then 'melon farm' else p_name end as display_name from {part}"
ALLOWED = "select concat('acct', s_suppkey * 11) as handle from {supplier}"
UNBLOCKED = "select concat('ACCT', s_suppkey * 7) as handle, case s_suppkey % 4 when 0 then 'QUEUED' when 1 then 'FAILED_RETRY' when 2 then 'UNBLOCKED' else 'REJECTED' end as status from {supplier}"
_LISTS = f", {_LATEST}, listed as ({plain(LISTED)}), allowed as ({plain(ALLOWED)}), unblocked as ({plain(UNBLOCKED)}), kept as (select key from latest_ where action = 'KEEP' or unblock_requested)"


@query(_ENFORCED + _LISTS + f""", history as (select key, count(*) as attempts, arg_max(done, seq) as reported, bool_or(account_gone and not done) as no_retry from (select * from ({_REPORTED} select * from reported where batch % 3 = 0)) group by 1)
select key, case when coalesce({name_rule_sql('key')}, {name_rule_sql('min(display_name)')}) is not null then 'IMPERSONATION' else 'SPAM' end as option, coalesce(any_value(attempts), 0) + 1 as attempt
from (select distinct key from enforced where verified and seq % 8 > 0) e join listed on lower(listed.handle) = key left join history h using (key)
where key not in (select lower(handle) from allowed) and key not in (select lower(handle) from unblocked) and key not in (select key from kept) and coalesce(not reported and not no_retry and attempts < 3, true) group by key""")
def report_candidates(spark, sf_dir):
    """Lines whose number 8 divides stand for imported blocks, batches whose number 3 divides for earlier reports."""
    past = jobs.report_history(_reported(spark, sf_dir).where("batch % 3 = 0").select(F.col("key").alias("handle"), F.col("seq").alias("id"), "status", "option", F.lit(None).cast("timestamp").alias("ts"), "no_retry"))
    sides = (relation(spark, sf_dir, x) for x in (LISTED, ALLOWED, UNBLOCKED, ADJUDICATIONS))
    enforced = _enforced(spark, sf_dir).withColumn("legacy", F.col("seq") % 8 == 0)
    return ledger.report_candidates(enforced, *sides, past, exclusions=EXCLUSIONS)


OUTCOMES = "select concat('acct', p_partkey) as handle, case p_partkey % 9 when 0 then 'GONE' when 1 then 'GAVE_UP' when 2 then 'FAILED' else 'PLANNED' end as status, p_size % 5 as attempts from {part}"
_GROUPS = _ENFORCED + _LISTS + f""", outcomes as ({plain(OUTCOMES)}),
groups as (
    select pos, lower(l.handle) as key, case when lower(l.handle) in (select lower(handle) from allowed) or lower(l.handle) in (select lower(handle) from unblocked) or lower(l.handle) in (select key from kept) then 'SKIPPED_KEPT'
        when lower(l.handle) in (select key from enforced where verified) then 'BLOCKED' when o.status = 'GONE' then 'GONE' when o.status = 'GAVE_UP' or o.attempts >= 3 then 'GAVE_UP' else 'PENDING' end as "group"
    from listed l left join outcomes o on o.handle = lower(l.handle))
"""


def _groups(spark, sf_dir):
    sides = [relation(spark, sf_dir, x) for x in (LISTED, ALLOWED, ADJUDICATIONS, UNBLOCKED)]
    return ledger.list_groups(*sides, _enforced(spark, sf_dir), relation(spark, sf_dir, OUTCOMES))


@query(_GROUPS + 'select pos, key, "group" from groups')
def known_bots_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


@query(_GROUPS + """, batch as (select key from groups where "group" = 'PENDING' order by pos, key limit 25)
select coalesce(o.handle, b.key) as key, case when b.key is not null and coalesce(o.status, '') <> 'FAILED' then 'PLANNED' else o.status end as status, coalesce(o.attempts, 0) as attempts, case when b.key is not null then 'kb1' end as batch
from outcomes o full join batch b on b.key = o.handle""")
def known_bots_planned(spark, sf_dir):
    """The job's outcomes after its next batch, of which 40 are asked for and 25 given, is planned."""
    batch = ledger.list_batch(_groups(spark, sf_dir), 40)
    outcomes = relation(spark, sf_dir, OUTCOMES).withColumnRenamed("handle", "key").withColumn("batch", F.lit(None).cast("string"))
    return ledger.planned_outcomes(outcomes, batch, "kb1")


@query(_ENFORCED + f""", outcomes as ({plain(OUTCOMES)}),
mine as (select key, arg_max(verified, seq) as v, arg_max(already_blocked, seq) as al, arg_max(gone, seq) as g, arg_max(stop_reason is not null and not attempted, seq) as st from enforced where planned group by 1)
select coalesce(o.handle, m.key) as key, case when m.key is null then status when v then case when al then 'ALREADY_BLOCKED' else 'BLOCKED' end when g then 'GONE' when st then 'PLANNED' when coalesce(attempts, 0) + 1 >= 3 then 'GAVE_UP' else 'FAILED' end as status,
       coalesce(attempts, 0) + case when m.key is not null and not v and not g and not st then 1 else 0 end as attempts
from outcomes o full join mine m on m.key = o.handle""")
def known_bots_outcomes(spark, sf_dir):
    return ledger.outcomes_after(relation(spark, sf_dir, OUTCOMES).withColumnRenamed("handle", "key"), _enforced(spark, sf_dir))


#: Moments and batches of the paced job: a user's events.
_MOMENTS = """select user_id as job, ts as moment, case when event_id % 3 = 0 then ts - interval 4 minutes when event_id % 3 = 1 then ts - interval 40 minutes end as last_ingest, case when event_id % 10 = 0 then ts + interval 2 hours when event_id % 10 = 1 then ts - interval 2 hours end as backoff_until from {events}"""
_BATCHES = "select user_id as job, ts as planned_at, event_id as batch from {events}"


@query(f"""with m as (select *, row_number() over () as r from ({plain(_MOMENTS)})), b as ({plain(_BATCHES)}),
d as (select r, any_value(m.job) as job, any_value(m.moment) as moment, any_value(m.last_ingest) as last_ingest, any_value(m.backoff_until) as backoff_until, count(planned_at) as n, min(planned_at) as first
    from m left join b on b.job = m.job and b.planned_at > m.moment - interval 24 hours and b.planned_at <= m.moment group by r)
select job, moment, case when moment < backoff_until then 'BACKOFF' when moment < last_ingest + interval 10 minutes then 'PAUSE' when n >= 5 then 'DAILY_LIMIT' end as wait,
       case when moment < backoff_until then backoff_until when moment < last_ingest + interval 10 minutes then last_ingest + interval 10 minutes when n >= 5 then first + interval 24 hours end as earliest from d""")
def batch_may_start(spark, sf_dir):
    """For each event of a user, as the job's clock, whether a batch may start."""
    return ledger.may_start(relation(spark, sf_dir, _MOMENTS), relation(spark, sf_dir, _BATCHES))


@query(f"with b as ({plain(_BATCHES)}) select job, planned_at, batch from (select *, row_number() over (partition by job order by planned_at desc, batch desc) as place from b) where place <= 60")
def kept_batches(spark, sf_dir):
    return ledger.kept_batches(relation(spark, sf_dir, _BATCHES))


_BLOCKS = "select concat('Acct', p_partkey) as handle, case p_partkey % 3 when 0 then 'KNOWN_SCAM_LIST' when 1 then 'OWNER_TRAINED' else 'BLOCK_CONFIRMED' end as tier, case p_partkey % 4 when 0 then 'VERIFIED' when 1 then 'PLANNED' else 'FAILED_RETRY' end as status from {part} where p_size > 10"
_REQUESTS = "select concat('@acct', c_custkey) as handle, c_mktsegment as words from {customer} where c_acctbal < 5000"


@query(f"""with req as (select lower(ltrim(handle, '@')) as key, min(words) as words from ({plain(_REQUESTS)}) group by 1), blocks as (select lower(handle) as key, tier from ({plain(_BLOCKS)})), q as ({plain(UNBLOCKED)}), {_LATEST},
t as (select req.*, coalesce(tier, case when action = 'BLOCK' then 'OWNER_BLOCK' end) as tier_before from req left join blocks using (key) left join latest_ using (key))
select key, words, tier_before, case when tier_before is null then 'NO_AUTO_BLOCK' else 'DISAGREE' end as agreement, 'KEEP' as action, key not in (select lower(handle) from q where status in ('QUEUED', 'FAILED_RETRY')) as queued,
       'owner asked to unblock; auto-block tier ' || tier_before as recheck_reason from t""")
def unblock_requests(spark, sf_dir):
    return ledger.unblock_requests(*(relation(spark, sf_dir, x) for x in (_REQUESTS, _BLOCKS, UNBLOCKED, ADJUDICATIONS)))


@query(_CUT.split("r as (select c.*")[0].rstrip().rstrip(",") + f""", q as ({plain(UNBLOCKED)})
select batch, seq, key, case when stop_reason is not null then 'STOPPED' when key in (select lower(handle) from q where status in ('QUEUED', 'FAILED_RETRY')) and handle_reverified and unblock_clicked and reloaded and shows_unblocked then 'UNBLOCKED' else 'FAILED_RETRY' end as result from cut where not stopped""")
def unblock_results(spark, sf_dir):
    return ledger.unblock_results(_reports(spark, sf_dir), relation(spark, sf_dir, UNBLOCKED))


@query(f"""with b as (select lower(handle) as key, tier, status from ({plain(_BLOCKS)})), v as (select lower(handle) as key, 'OWNER_BLOCK' as tier, 'PLANNED' as status from ({plain(STATES)}))
select coalesce(b.key, v.key) as key, case when v.key is null or b.status = 'VERIFIED' then b.tier else v.tier end as tier, case when v.key is null or b.status = 'VERIFIED' then b.status else v.status end as status from b full join v on b.key = v.key""")
def auto_block_record(spark, sf_dir):
    """All states are planned; blocks that are verified stay."""
    blocks = relation(spark, sf_dir, _BLOCKS).select(F.lower("handle").alias("key"), "tier", "status")
    verdicts = relation(spark, sf_dir, STATES).select(F.lower("handle").alias("key"), F.lit("OWNER_BLOCK").alias("tier"), F.lit("PLANNED").alias("status"))
    return ledger.recorded_blocks(blocks, verdicts)


@query(f"""with a as ({plain(ADJUDICATIONS)}), p as (select c_custkey as n, 'acct' || (c_custkey - c_custkey % 2) as key, c_mktsegment as reason, c_custkey % 2 = 1 as marks from customer),
last as (select key, max(n) as n, arg_max(reason, n) as reason, bool_or(marks) as marks from p group by 1),
x as (select a.*, row_number() over (partition by lower(ltrim(handle, '@')) order by id desc) = 1 as newest from a)
select id, handle, action, case when newest and last.key is not null then reason else 'none' end as reason, case when newest and marks then 'yes' end as mark from (select id, handle, coalesce(action, 'NONE') as action, newest from x) x left join last on last.key = lower(ltrim(handle, '@'))""")
def adjudication_patch(spark, sf_dir):
    """Customers patch the latest adjudication of an account, some of them two in turn."""
    rows = relation(spark, sf_dir, ADJUDICATIONS).select("id", "handle", F.create_map(F.lit("action"), F.coalesce("action", F.lit("NONE")), F.lit("reason"), F.lit("none")).alias("record"))
    patches = relation(spark, sf_dir, "select c_custkey as n, concat('acct', c_custkey - c_custkey % 2) as handle, c_mktsegment as reason, c_custkey % 2 = 1 as marks from {customer}")
    some = F.create_map(F.lit("reason"), F.col("reason"))
    patches = patches.select("n", "handle", F.when(F.col("marks"), F.map_concat(some, F.create_map(F.lit("mark"), F.lit("yes")))).otherwise(some).alias("patch"))
    return ledger.patched(rows, patches).select("id", "handle", *[F.try_element_at("record", F.lit(n)).alias(n) for n in ("action", "reason", "mark")])
