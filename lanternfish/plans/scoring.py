"""Queries over evidence scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.operators import scoring
from lanternfish.plans.common import plain, relation
from lanternfish.plans.projections import INSTANCES_SQL, RECORDS_SQL, instances, records
from lanternfish.sources.registry import features_sql, weights_sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_MALICIOUS = ", ".join(f"'{s}'" for s in config.MALICIOUS_SCORES)
_FORBIDDEN = ", ".join(f"'{s}'" for s in config.FORBIDDEN_PROXIES)
_BASE = f"""
with inst as ({INSTANCES_SQL}),
reg as (select * from {features_sql()}),
wts as (select * from {weights_sql()}),
best as (
    select handle, feature_id, cnt, pos, fact_key from (
        select i.*, coalesce(n, n_min, 1) as cnt, row_number() over (partition by handle, i.feature_id order by coalesce(n, n_min, 1) desc, pos) as place
        from inst i join reg using (feature_id) where category <> 'NETWORK') where place = 1),
contrib as (
    select handle, feature_id, score, category, coalesce(fact_key, fact_group) as grp, cnt,
           case when cnt < min_count then case strength when 'STRONG' then 'MODERATE' else 'WEAK' end else strength end as strength,
           round_even(greatest(-cap, least(cap, base * case when cnt < min_count and strength = 'WEAK' then 0.0 when cnt < min_count then 0.5 else 1.0 end
               + case when base > 0 and cnt > min_count then per_extra * (cnt - min_count) else 0 end))::double, 0)::int as weight,
           corroborated or coalesce(corroborated_score, '') = score as needs_other, can_block and cnt >= min_count as can_block
    from best join reg using (feature_id) join wts using (feature_id)),
corr as (
    select * replace (case when needs_other and weight > 0 and not coalesce(lo <> grp or hi <> grp, false) then 0 else weight end as weight) from (
        select *, min(case when strength <> 'WEAK' and not needs_other and weight > 0 then grp end) over w as lo,
               max(case when strength <> 'WEAK' and not needs_other and weight > 0 then grp end) over w as hi
        from contrib window w as (partition by handle, score))),
chosen as (
    select * from (select *, row_number() over (partition by handle, score, grp order by abs(weight) desc, weight desc, feature_id) as place from corr where weight <> 0) where place = 1),
sums as (
    select handle, score, greatest(0, least(100, sum(weight) - greatest(0, sum(case when weight > 0 and strength = 'WEAK' then weight else 0 end) - 15))) as total,
           max(case when weight > 0 and strength = 'STRONG' then 1 else 0 end) as strong, max(case when weight > 0 and strength <> 'WEAK' then 1 else 0 end) as moderate
    from chosen group by all),
gate1 as (select *, case when score in ({_MALICIOUS}) and total >= 90 and strong = 0 then 89 else total end as first from sums),
scores as (select handle, score, case when score in ({_MALICIOUS}) and first >= 65 and moderate = 0 then 64 else first end::int as value, total from gate1)
"""


@query(f"with inst as ({INSTANCES_SQL}), reg as (select * from {features_sql()}) select case when feature_id in ({_FORBIDDEN}) then 'FORBIDDEN_PROXY' else 'UNKNOWN_OR_NETWORK_FEATURE_IN_RECORD' end as reason, feature_id, count(*) as n_rejected from inst where feature_id not in (select feature_id from reg where category <> 'NETWORK') group by all")
def feature_rejects(spark, sf_dir):
    return scoring.rejected(instances(spark, sf_dir)).groupBy("reason", "feature_id").agg(F.count("*").alias("n_rejected"))


@query(_BASE + "select handle, feature_id, cnt, pos, fact_key from best")
def feature_best_instance(spark, sf_dir):
    return scoring.best_instances(instances(spark, sf_dir)).select("handle", "feature_id", "cnt", "pos", "fact_key")


@query(_BASE + "select handle, feature_id, score, strength, weight, can_block from contrib")
def feature_contrib(spark, sf_dir):
    return scoring.contributions(scoring.best_instances(instances(spark, sf_dir))).select("handle", "feature_id", "score", "strength", "weight", "can_block")


@query(_BASE + "select handle, feature_id, score, weight from corr where needs_other")
def feature_corroborated(spark, sf_dir):
    each, _, _ = scoring.scored(instances(spark, sf_dir))
    return each.where("needs_other").select("handle", "feature_id", "score", "weight")


@query(_BASE + "select handle, score, grp as fact_group, feature_id, weight from chosen")
def feature_group_dedup(spark, sf_dir):
    _, picked, _ = scoring.scored(instances(spark, sf_dir))
    return picked.select("handle", "score", F.col("group").alias("fact_group"), "feature_id", "weight")


@query(_BASE + "select handle, score, value, value <> total as gated from scores")
def account_scores(spark, sf_dir):
    _, _, valued = scoring.scored(instances(spark, sf_dir))
    return valued


_WIDE = ", ".join(f"coalesce(max(value) filter (score = '{s}'), 0) as {s.lower()}" for s in (*config.MALICIOUS_SCORES, "HUMAN_CONTINUITY"))
_TRIGGERS = ", ".join(f"max(case when score = '{s}' and strength = 'STRONG' and can_block then 1 else 0 end) as t_{s.lower()}" for s in config.MALICIOUS_SCORES)
_ACTIONS = _BASE + f""",
wide as (select handle, {_WIDE} from scores group by 1),
trig as (
    select handle, count(distinct case when strength <> 'WEAK' then grp end) as groups, count(distinct case when strength = 'STRONG' then grp end) as strong_groups, {_TRIGGERS}
    from chosen where score in ({_MALICIOUS}) and weight > 0 group by 1),
human as (
    select handle, max(case when strength = 'STRONG' then 1 else 0 end) as human_strong, max(case when strength <> 'WEAK' then 1 else 0 end) as human_moderate
    from corr where category = 'HUMAN' and weight <> 0 group by 1),
allrows as (
    select handle, greatest(coalesce(automation, 0), coalesce(spam, 0), coalesce(scam, 0), coalesce(impersonation, 0), coalesce(deception, 0)) as top_score,
           coalesce(groups, 0) as n_groups, coalesce(strong_groups, 0) as n_strong_groups, coalesce(human_continuity, 0) as hum, coalesce(human_strong, 0) as hs, coalesce(human_moderate, 0) as hm,
           coalesce((spam >= 90 and t_spam = 1) or (scam >= 90 and t_scam = 1) or (impersonation >= 90 and t_impersonation = 1) or (deception >= 90 and t_deception = 1)
               or (automation >= 90 and greatest(spam, scam, impersonation, deception) >= 65 and greatest(t_automation, t_spam, t_scam, t_impersonation, t_deception) = 1), false) as path1
    from (select distinct handle from corr) left join wide using (handle) left join trig using (handle) left join human using (handle)),
paths as (select *, n_strong_groups >= 3 and top_score >= 65 as path2 from allrows)
select handle, top_score, n_groups, n_strong_groups, path1, path2,
       case when (path1 or path2) and (hum >= 30 or hs = 1) then 'REVIEW' when (path1 or path2) and hm = 1 then 'REVIEW' when path1 or path2 then 'BLOCK_CANDIDATE_PENDING_2ND_PASS'
            when top_score >= 65 or n_strong_groups > 0 or n_groups >= 2 then 'REVIEW' else 'KEEP' end as action
from paths"""


@query(_ACTIONS)
def account_actions(spark, sf_dir):
    return scoring.actions(*scoring.scored(instances(spark, sf_dir)))


_VERDICTS = "select concat('o', o_orderkey) as handle, case o_orderkey % 3 when 0 then 'CONFIRMED' when 1 then 'DOWNGRADE_TO_REVIEW' end as verdict, o_orderkey % 7 = 0 as significant_contrary from {orders}"
_JUDGED = _ACTIONS[: _ACTIONS.index("select handle, top_score, n_groups, n_strong_groups, path1, path2,")] + f""", v as ({plain(_VERDICTS)}),
j as (select paths.*, coalesce(verdict, '') as verdict, coalesce(significant_contrary, false) as contrary from paths left join v using (handle))
select handle, top_score, n_groups, n_strong_groups, path1, path2,
       case when (path1 or path2) and (hum >= 30 or hs = 1 or contrary) then 'REVIEW' when (path1 or path2) and hm = 1 and verdict <> 'CONFIRMED' then 'REVIEW' when (path1 or path2) and verdict = 'CONFIRMED' then 'BLOCK'
            when (path1 or path2) and verdict = 'DOWNGRADE_TO_REVIEW' then 'REVIEW' when path1 or path2 then 'BLOCK_CANDIDATE_PENDING_2ND_PASS'
            when top_score >= 65 or n_strong_groups > 0 or n_groups >= 2 or verdict = 'DOWNGRADE_TO_REVIEW' then 'REVIEW' else 'KEEP' end as action
from j"""


@query(_JUDGED)
def account_actions_judged(spark, sf_dir):
    """The ladder with second passes: confirmed, downgraded, none, and significant contrary evidence."""
    rows = scoring.actions(*scoring.scored(instances(spark, sf_dir)), relation(spark, sf_dir, _VERDICTS))
    return rows.select("handle", "top_score", "n_groups", "n_strong_groups", "path1", "path2", "action")


@query(_BASE + """, ids as (select handle, score, string_agg(distinct feature_id, '+' order by feature_id) as ids from chosen where weight <> 0 group by all),
d as (select s.handle, list_position(['AUTOMATION', 'SPAM', 'SCAM', 'IMPERSONATION', 'DECEPTION', 'HUMAN_CONTINUITY'], s.score) as place,
    case s.score when 'AUTOMATION' then 'AUTO' when 'IMPERSONATION' then 'IMP' when 'DECEPTION' then 'DEC' when 'HUMAN_CONTINUITY' then 'HUM' else s.score end || ' ' || s.value || '=' || coalesce(ids, '') as text
    from scores s left join ids using (handle, score) where s.value > 0 and s.score <> 'NETWORK_COORDINATION')
select handle, string_agg(text, '; ' order by place) as drivers from d group by 1""")
def score_drivers(spark, sf_dir):
    _, picked, valued = scoring.scored(instances(spark, sf_dir))
    return scoring.drivers(picked, valued)


@query(_BASE + f"select handle, strength, count(distinct grp) as n_groups, string_agg(distinct feature_id, '|' order by feature_id) as features from chosen where score in ({_MALICIOUS}) and weight > 0 group by all")
def score_evidence(spark, sf_dir):
    return scoring.evidence(scoring.scored(instances(spark, sf_dir))[1])


@query(f"""
with r as ({RECORDS_SQL}), m as (
    select *, left(date_collected, 4)::int * 12 + substr(date_collected, 6, 2)::int as now_m, left(joined, 4)::int * 12 + substr(joined, 6, 2)::int as joined_m,
           left(last_change, 4)::int * 12 + substr(last_change, 6, 2)::int as change_m, greatest(followers, 1) as f1 from r)
select handle, 'D001' as feature_id, null::bigint as n from m where location_consistency = 'MISMATCH'
union all select handle, 'W001', null from m where now_m - joined_m between 0 and 2
union all select handle, 'W004', null from m where following >= 20 * f1 and post_count < 20
union all select handle, 'W006', null from m where following >= 300 and following >= 10 * f1
union all select handle, 'W005', null from m where coalesce(now_m - change_m between 0 and 1, false) or username_changes >= 3
union all select handle, 'A004', null from m where n_replies >= 30 and generic_reply_ratio >= 0.5
union all select handle, 'A006', null from m where n_items >= 30 and original_content_ratio < 0.05
union all select handle, 'A007', null from m where n_items >= 30 and reply_ratio + repost_ratio >= 0.9
union all select handle, 'A009', null from m where activity_hours >= 20
union all select handle, 'A001', near_duplicates from m where near_duplicates >= 10
union all select handle, 'A002', near_duplicates from m where near_duplicates between 3 and 9""")
def derived_features(spark, sf_dir):
    return scoring.derived_features(records(spark, sf_dir))
