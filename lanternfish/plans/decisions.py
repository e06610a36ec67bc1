"""Queries over coverage, continuity, repurposing, second passes, gates and tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.operators import decisions
from lanternfish.plans.common import registry
from lanternfish.plans.projections import RECORDS_SQL, records
from lanternfish.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

_COVERAGE = f"""
with r as ({RECORDS_SQL}),
parts as (
    select *, coalesce(post_count = 0, false) as is_none,
           coalesce(post_count > 0 and coalesce(n_posts, 0) + coalesce(n_replies, 0) >= post_count, false) as whole,
           coalesce(left(date_collected, 4)::int * 12 + substr(date_collected, 6, 2)::int - left(joined, 4)::int * 12 - substr(joined, 6, 2)::int < 6, false) as young,
           regexp_matches(lower(reply_summary), 'has not replied|no replies|no posts') as no_replies, regexp_matches(lower(post_summary), 'no posts') as no_posts from r),
scored as (
    select *,
      15 * (case when display_name is not null and display_name <> '' then 0.5 else 0 end + case when bio is not null then 0.5 else 0 end)::double as c_profile,
      15 * (case when joined is not null then 1 else 0 end + case when country is not null then 1 else 0 end + case when username_changes is not null then 1 else 0 end) / 3.0::double as c_about,
      (case when whole or is_none then 20 when n_posts is null then 0 when n_posts = 0 and no_posts then 20 else 20 * least(1.0, n_posts / greatest(1, least(5, coalesce(post_count, 5)))::double) end)::double as c_posts,
      (case when whole then 15 when n_replies is null then case when is_none then 15 else 0 end when n_replies = 0 and (no_replies or is_none) then 15 else 15 * least(1.0, n_replies / 3.0::double) end)::double as c_replies,
      (case when whole or older_sampled or young or is_none then 15 else 0 end)::double as c_older,
      10 * (case when any_link_known then 0.5 else 0 end + case when website_known then 0.5 else 0 end)::double as c_links,
      10 * (case when followers is not null then 1 else 0 end + case when following is not null then 1 else 0 end + case when post_count is not null then 1 else 0 end) / 3.0::double as c_counts
    from parts),
cov as (
    select *, round_even(c_profile + c_about + c_posts + c_replies + c_older + c_links + c_counts, 0)::int as coverage_score,
           collection_status in ('SUSPENDED', 'PROTECTED', 'NOT_FOUND', 'NOT_LOADED')
           or ((display_name is null or display_name = '') and (bio is null or bio = '') and post_count is null and joined is null and quality = 'NONE') as gone from scored),
state as (select *, case when gone then 'UNAVAILABLE' when coverage_score >= 70 then 'SUFFICIENT' when coverage_score >= 45 then 'PARTIAL' else 'INSUFFICIENT' end as evidence_state from cov)
"""


@query(_COVERAGE + "select handle, coverage_score, evidence_state, round(c_posts, 6) as c_posts, round(c_replies, 6) as c_replies, c_older from state")
def coverage_state(spark, sf_dir):
    rows = decisions.coverage(records(spark, sf_dir))
    return rows.select("handle", "coverage_score", "evidence_state", F.round("c_posts", 6).alias("c_posts"), F.round("c_replies", 6).alias("c_replies"), "c_older")


@query(_COVERAGE + """select handle, case when human_score >= 30 or has_h003 then 'EVIDENCE_OF_HUMANITY' when has_other_human then 'SOME_EVIDENCE'
    when evidence_state in ('SUFFICIENT', 'PARTIAL') then 'NO_EVIDENCE_FOUND' else 'NOT_SEARCHED' end as continuity_state, human_score >= 30 or has_h003 as substantial from state""")
def continuity_state(spark, sf_dir):
    return decisions.continuity(decisions.coverage(records(spark, sf_dir))).select("handle", "continuity_state", "substantial")


_REPURPOSED = f"""
with r as ({RECORDS_SQL}),
points as (
    select *, case when has_d007 then 50 else 0 end
        + case when coalesce(username_changes >= 1 and left(last_change, 4)::int >= left(date_collected, 4)::int, false) then 10 else 0 end
        + case when regexp_matches(lower(coalesce(display_name, 'None') || ' ' || coalesce(bio, 'None')), '{config.PERSONA_WORDS}') and (has_d007 or coalesce(username_changes >= 1, false)) then 15 else 0 end
        + case when max_year_gap >= 2 then 15 else 0 end + case when max_year_gap >= 2 and solicits then 10 else 0 end as total from r)
select handle, least(100, case when has_d007 then total else least(total, 40) end)::int as repurposed_score,
       least(100, case when has_d007 then total else least(total, 40) end) >= 50 as is_repurposed,
       least(100, case when has_d007 then total else least(total, 40) end) >= 50 and malicious_strong as compound_strong from points"""


@query(_REPURPOSED)
def repurposed_score(spark, sf_dir):
    return decisions.repurposed(records(spark, sf_dir)).select("handle", "repurposed_score", "is_repurposed", "compound_strong")


_TYPES = ("PROFILE_HISTORY", "ORIGINAL_POSTS", "REPLIES", "OLDER_CONTENT", "EXTERNAL_LINKS", "FOLLOW_GRAPH", "MEDIA")
_BASES = ("I001", "S004", "S008", "S010", "A001")
_CHECKS = ("contradictory_evidence", "real_conversations", "long_term_continuity", "older_posts", "account_predates_behavior", "duplicated_text_legit_explanation", "common_public_source_quote")


def _pass_record(spark, sf_dir):
    """Second passes from orders: bits of the key choose the lists' members."""
    k = F.col("o_orderkey")
    pick = lambda values, factor, rest: F.filter(F.array(*[F.when((k * factor + i * 5) % 8 < rest, F.lit(v)) for i, v in enumerate(values)]), lambda x: x.isNotNull())
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), k).alias("handle"), (k % 9 != 0).alias("done"), pick(_TYPES, 3, 6).alias("available"), pick(_TYPES, 1, 7).alias("sampled"), pick(_TYPES, 7, 1).alias("unobservable"),
        pick(_TYPES, 5, 2).alias("basis_types"), pick(_BASES, 1, 2).alias("basis"), pick(_BASES, 1, 6).alias("verified"), pick(_BASES, 3, 1).alias("paraphrased"),
        F.when(k % 31 == 0, F.array(F.lit("q"))).otherwise(F.expr("array()").cast("array<string>")).alias("gone"), pick(_CHECKS, 1, 7).alias("checks_done"),
        (k % 4 == 0).alias("all_examined"), (k % 13 != 0).alias("answered"), (k % 29 == 0).alias("contrary"),
    )


def _pick_sql(values, factor, rest):
    return "list_filter([" + ", ".join(f"case when (k * {factor} + {i * 5}) % 8 < {rest} then '{v}' end" for i, v in enumerate(values)) + "], lambda x: x is not null)"


_in = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_PASS = f"""
with p as (
    select 'o' || o_orderkey as handle, o_orderkey as k, o_orderkey % 9 <> 0 as done, {_pick_sql(_TYPES, 3, 6)} as available, {_pick_sql(_TYPES, 1, 7)} as sampled, {_pick_sql(_TYPES, 7, 1)} as unobservable,
           {_pick_sql(_TYPES, 5, 2)} as basis_types, {_pick_sql(_BASES, 1, 2)} as basis, {_pick_sql(_BASES, 1, 6)} as verified, {_pick_sql(_BASES, 3, 1)} as paraphrased, {_pick_sql(_CHECKS, 1, 7)} as checks_done,
           o_orderkey % 31 = 0 as is_gone, o_orderkey % 4 = 0 as all_examined, o_orderkey % 13 <> 0 as answered, o_orderkey % 29 = 0 as contrary from orders),
q as (
    select *, list_filter(available, lambda x: not list_contains(unobservable, x)) as denom,
           list_distinct(list_filter(available, lambda x: x in ('PROFILE_HISTORY', 'REPLIES', 'OLDER_CONTENT', 'ORIGINAL_POSTS') or list_contains(basis_types, x) or (x = 'EXTERNAL_LINKS' and list_has_any(basis, {_in(config.LINK_BASIS)})))) as required,
           ['contradictory_evidence'] || case when list_contains(available, 'REPLIES') then ['real_conversations'] else [] end || case when list_contains(available, 'OLDER_CONTENT') then ['long_term_continuity', 'older_posts'] else [] end
           || case when list_contains(available, 'PROFILE_HISTORY') then ['account_predates_behavior'] else [] end || case when list_has_any(basis, {_in(config.REPEAT_BASIS)}) then ['duplicated_text_legit_explanation'] else [] end
           || case when list_has_any(basis, {_in(config.QUOTE_BASIS)}) then ['common_public_source_quote'] else [] end as checks from p),
s as (
    select *, case when len(denom) = 0 then 100 else round_even(100.0::double * len(list_filter(denom, lambda x: list_contains(sampled, x))) / len(denom), 0) end::int as pass_coverage,
           list_sort(list_filter(required, lambda x: not list_contains(sampled, x) and not list_contains(unobservable, x))) as missing,
           list_sort(list_filter(basis, lambda x: not list_contains(verified, x) or list_contains(paraphrased, x))) as unverified,
           list_sort(list_filter(checks, lambda x: not list_contains(checks_done, x))) as checks_missing from q),
t as (select *, (all_examined or len(missing) = 0) and len(unverified) = 0 and len(checks_missing) = 0 and answered as ok from s)
"""


@query(_PASS + """select handle, pass_coverage, array_to_string(missing, ',') as missing, array_to_string(unverified, ',') as unverified, array_to_string(checks_missing, ',') as checks_missing, ok and done as complete,
    case when not done then 'PENDING' when contrary or is_gone then 'REFUTES' when ok then 'CONFIRMS' else 'INCOMPLETE' end as result from t""")
def second_pass_eval(spark, sf_dir):
    joined = [F.array_join(n, ",").alias(n) for n in ("missing", "unverified", "checks_missing")]
    return decisions.second_pass(_pass_record(spark, sf_dir)).select("handle", "pass_coverage", *joined, "complete", "result")


_GATES = {
    "automation": "k * 7 % 101", "spam": "k * 11 % 97", "scam": "k * 13 % 103", "impersonation": "k * 17 % 95", "deception": "k * 19 % 89", "network_coordination": "k % 90",
    "path1": "k % 3 = 0", "strong_groups": "k % 4", "compound_strong": "k % 5 = 0", "n_groups": "k % 4", "strong_feature": "k % 6 = 0",
    "evidence_state": "case k % 7 when 0 then 'UNAVAILABLE' when 1 then 'INSUFFICIENT' when 2 then 'PARTIAL' else 'SUFFICIENT' end", "complete": "k % 2 = 0",
    "result": "case k % 11 when 0 then 'PENDING' when 1 then 'REFUTES' when 2 then 'INCOMPLETE' else 'CONFIRMS' end", "substantial": "k % 8 = 0", "contrary": "k % 17 = 0", "network_confirmed": "k % 3 = 1", "review_floor": "k % 10 = 3",
}


@query("with g as (select 'o' || k as handle, " + ", ".join(f"{e} as {n}" for n, e in _GATES.items()) + """ from (select o_orderkey as k from orders)),
h as (select *, greatest(automation, spam, scam, impersonation, deception) as top from g),
e as (select *, (path1 or (strong_groups + case when compound_strong then 1 else 0 end >= 3 and top >= 65)) and strong_groups > 0 as eligible, evidence_state = 'SUFFICIENT' as enough, substantial or contrary as against from h),
o as (select *, case when evidence_state = 'UNAVAILABLE' then 'UNKNOWN' when eligible and enough and complete and result = 'CONFIRMS' and not against then 'BLOCK_CONFIRMED'
    when eligible and against then 'REVIEW' when eligible and result = 'PENDING' then 'BLOCK_CANDIDATE' when eligible and result = 'REFUTES' then 'REVIEW' when eligible and not enough then 'REVIEW_INSUFFICIENT_DATA' when eligible then 'REVIEW'
    when top >= 65 or strong_feature or n_groups >= 2 or (network_confirmed and network_coordination >= 65) or review_floor then 'REVIEW' when evidence_state = 'INSUFFICIENT' then 'LOW_EVIDENCE_KEEP' else 'KEEP' end as outcome from e)
select handle, outcome, case when automation >= 65 and substantial then 'MIXED_OR_ASSISTED' when automation >= 65 then 'AUTOMATION_LIKELY' when substantial and automation < 40 then 'HUMAN_LIKELY' else 'UNKNOWN' end as nature,
    case when outcome in ('LOW_EVIDENCE_KEEP', 'UNKNOWN') then 'KEEP' when outcome = 'REVIEW_INSUFFICIENT_DATA' then 'REVIEW' else outcome end as enforcement from o""")
def decision_gates(spark, sf_dir):
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    rows = k.select(F.concat(F.lit("o"), "k").alias("handle"), *[F.expr(e).alias(n) for n, e in _GATES.items()])
    return decisions.decided(rows).select("handle", "outcome", "nature", "enforcement")


_TIERS = {
    "owner_action": "case k % 19 when 0 then 'KEEP' when 1 then 'BLOCK' end", "never_listed": "k % 23 = 0", "enforcement": "case k % 5 when 0 then 'BLOCK_CONFIRMED' when 1 then 'REVIEW' else 'KEEP' end",
    "listed": "k % 29 = 0", "exact_chat_link": "k % 31 = 0", "owner_scoped": "k % 4 = 0", "evidence_state": "case k % 7 when 0 then 'UNAVAILABLE' when 1 then 'INSUFFICIENT' when 2 then 'PARTIAL' else 'SUFFICIENT' end",
    "substantial": "k % 8 = 0", "honest_label": "k % 37 = 0", "refuted": "k % 41 = 0", "name_hit": "k % 43 = 0", "phrase_hit": "k % 47 = 0", "link_hit": "k % 6 = 0",
    "model_score": "case when k % 3 > 0 then k * 7 % 100 / 128D end", "threshold": "0.5D", "basis": "k % 2 = 1",
}
_FEATS = ("I001", "I002", "I003", "S004", "S005", "S006", "S008", "S010", "S016", "A003")
_tier_sql = {n: e.replace("128D", "128.0::double").replace("0.5D", "0.5::double") for n, e in _TIERS.items()}


@query("with g as (select 'o' || k as handle, " + ", ".join(f"{e} as {n}" for n, e in _tier_sql.items()) + f""",
    {_pick_sql(_FEATS, 1, 3)} as features, {_pick_sql(_FEATS, 3, 1)} as strong0 from (select o_orderkey as k from orders)),
h as (select *, list_filter(strong0, lambda x: x in ('I001', 'S004', 'S008')) as strong, evidence_state <> 'UNAVAILABLE' and not substantial and not honest_label and not refuted as guarded,
    list_has_any(features, {_in(config.PERSONA)}) and list_has_any(features, {_in(config.FUNNEL)}) and list_has_any(features, {_in(config.LURE)}) as compound from g),
i as (select *, guarded and evidence_state in ('SUFFICIENT', 'PARTIAL') and (len(strong) > 0 or compound) as pattern_ok, list_contains(strong, 'I001') as i001,
    len(list_filter(features || strong, lambda x: x in ('S004', 'S005', 'S006', 'S010', 'S012', 'S016') and not list_contains(strong, x))) > 0 as sol,
    case when name_hit then 'NAME_RULE' when phrase_hit then 'PHRASE_RULE' when link_hit and guarded and list_has_any(features || strong0, {_in(config.LINK_COMPANIONS)}) then 'WATCHLISTED_LINK_PLUS_LURE' end as shared from h),
j as (select *, case when owner_action = 'KEEP' then null when owner_action = 'BLOCK' then 'OWNER_BLOCK' when never_listed then null when enforcement = 'BLOCK_CONFIRMED' then 'BLOCK_CONFIRMED'
    when listed or exact_chat_link then 'KNOWN_SCAM_LIST' when pattern_ok or shared is not null then 'AUTO_BLOCK_PATTERN' when coalesce(model_score >= threshold, false) and basis and guarded then 'OWNER_TRAINED' end as tier from i)
select handle, tier, case when tier = 'AUTO_BLOCK_PATTERN' then case when not pattern_ok then shared when len(strong) = 0 then 'CELEBRITY_PERSONA_FUNNEL_SCAM' when owner_scoped and len(strong) = 1 and i001 then 'OWNER_POLICY_IDENTITY'
    when i001 and sol then 'CELEBRITY_IMPERSONATION_PLUS_SOLICITATION' when i001 then 'CELEBRITY_OR_COMPANY_IMPERSONATION' when list_contains(strong, 'S004') then 'SCAM_OR_DM_FUNNEL_SCRIPT' else 'MALICIOUS_LINK' end end as pattern,
    not (owner_action is not null or never_listed or tier is not null) and (enforcement <> 'KEEP' or link_hit or coalesce(model_score >= 0.75 * threshold, false)) as held from j""")
def autoblock_tier(spark, sf_dir):
    k = F.col("k")
    pick = lambda values, factor, rest: F.filter(F.array(*[F.when((k * factor + i * 5) % 8 < rest, F.lit(v)) for i, v in enumerate(values)]), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    rows = rows.select(F.concat(F.lit("o"), "k").alias("handle"), *[F.expr(e).alias(n) for n, e in _TIERS.items()], pick(_FEATS, 1, 3).alias("features"), pick(_FEATS, 3, 1).alias("strong"))
    return decisions.tiers(rows).select("handle", "tier", "pattern", "held")


@query("""select enforcement, action, case when action is null then 'NO_OWNER_ACTION' when action = 'BLOCK' and enforcement in ('BLOCK_CANDIDATE', 'BLOCK_CONFIRMED') or action = 'KEEP' and enforcement = 'KEEP' then 'AGREE'
    when enforcement = 'REVIEW' then 'REVIEW_RESOLVED_' || action else 'DISAGREE' end as agreement, count(*) as n from (
    select case doc_id % 4 when 0 then 'KEEP' when 1 then 'REVIEW' when 2 then 'BLOCK_CANDIDATE' else 'BLOCK_CONFIRMED' end as enforcement, case when quality = 0 then 'BLOCK' when doc_id % 5 > 0 then 'KEEP' end as action from labels) group by all""")
def owner_agreement(spark, sf_dir):
    enforcement = F.element_at(F.array(*map(F.lit, ("KEEP", "REVIEW", "BLOCK_CANDIDATE", "BLOCK_CONFIRMED"))), (F.col("doc_id") % 4 + 1).cast("int"))
    action = F.when(F.col("quality") == 0, "BLOCK").when(F.col("doc_id") % 5 > 0, "KEEP")
    rows = table(spark, sf_dir, "labels").select(enforcement.alias("enforcement"), action.alias("action"))
    return rows.groupBy("enforcement", "action", decisions.agreement(F.col("enforcement"), F.col("action")).alias("agreement")).agg(F.count("*").alias("n"))
