"""Queries over exports, statistics, metrics, classifications, tags, second-pass conversion and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish.operators import reports
from lanternfish.plans.common import plain, registry, relation
from lanternfish.plans.ledger import _ENFORCED, _enforced
from lanternfish.plans.projections import INSTANCES_SQL, instances

QUERIES, ORACLE_SQL, query = registry()

STATES = """
select c_custkey as k, concat(case when c_custkey % 2 = 0 then 'Acct' else 'acct' end, c_custkey) as handle, case c_custkey % 4 when 0 then 'KEEP' when 1 then 'REVIEW' when 2 then 'BLOCK_CANDIDATE' else 'BLOCK_CONFIRMED' end as enforcement,
       case c_custkey % 5 when 0 then 'UNAVAILABLE' when 1 then 'INSUFFICIENT' when 2 then 'PARTIAL' else 'SUFFICIENT' end as evidence_state, c_custkey * 7 % 101 as coverage, case c_custkey % 3 when 0 then 'AUTOMATION_LIKELY' when 1 then 'HUMAN_LIKELY' else 'MIXED_OR_ASSISTED' end as nature,
       case c_custkey % 5 when 0 then 'CONFIRMS' when 1 then 'REFUTES' when 2 then 'INCOMPLETE' else 'PENDING' end as second_pass, c_custkey % 7 in (1, 2) as is_scam, c_custkey % 6 = 3 as is_impersonation,
       case when c_custkey % 3 = 0 then concat('N6-', c_nationkey) end as cluster, c_nationkey as nation from {customer}"""
ADJUDICATIONS = """
select o_orderkey as id, concat(case when o_orderkey % 2 = 0 then '@ACCT' else 'acct' end, o_custkey) as handle, case o_orderkey % 5 when 0 then 'BLOCK' when 1 then 'BLOCK' when 2 then 'KEEP' when 3 then 'KEEP' end as action, true as judged,
       case o_orderkey % 7 when 0 then 'HUMAN_LIKELY' when 1 then 'BOT_LIKELY' end as nature_label, case when o_orderkey % 3 > 0 then o_orderkey % 4 = 1 end as adjudicated_scam, case when o_orderkey % 3 > 0 then o_orderkey % 6 = 1 end as adjudicated_impersonation from {orders}"""
_BASE = f"""
with s as ({plain(STATES)}), a as (select *, lower(ltrim(handle, '@')) as key from ({plain(ADJUDICATIONS)})),
l as (select * exclude (handle) from a qualify row_number() over (partition by key order by id desc) = 1),
t as (select s.*, l.* exclude (key, id) from s left join l on l.key = lower(s.handle))
"""


def _states(spark, sf_dir):
    return relation(spark, sf_dir, STATES), relation(spark, sf_dir, ADJUDICATIONS)


_BASELINE = "select concat('ACCT', c_custkey) as handle, case c_custkey % 3 when 0 then 'KEEP' when 1 then 'REVIEW' else 'BLOCK_CANDIDATE_PENDING_2ND_PASS' end as action from {customer} where c_acctbal > 0"


@query(_BASE + f"select s.handle, b.action as before, s.enforcement as after from s join ({plain(_BASELINE)}) b on lower(b.handle) = lower(s.handle) where replace(b.action, '_PENDING_2ND_PASS', '') <> s.enforcement")
def score_changes(spark, sf_dir):
    return reports.score_changes(_states(spark, sf_dir)[0], relation(spark, sf_dir, _BASELINE))


@query(_BASE + """, d as (select a.id, a.key, a.action, s.enforcement, case when a.action is null then 'NO_OWNER_ACTION' when a.action = 'BLOCK' then case when enforcement like 'BLOCK%' then 'AGREE' when enforcement = 'REVIEW' then 'REVIEW_RESOLVED_BLOCK' else 'DISAGREE' end
    else case enforcement when 'KEEP' then 'AGREE' when 'REVIEW' then 'REVIEW_RESOLVED_KEEP' else 'DISAGREE' end end as agreement from a join s on lower(s.handle) = a.key)
select * from d where agreement in ('DISAGREE', 'REVIEW_RESOLVED_BLOCK')""")
def disagreements(spark, sf_dir):
    return reports.disagreements(*_states(spark, sf_dir))


@query(_BASE + """select handle, case when enforcement = 'BLOCK_CANDIDATE' then 'second pass pending' when second_pass = 'INCOMPLETE' then 'second pass incomplete' else 'awaiting owner review' end as because from t where enforcement in ('REVIEW', 'BLOCK_CANDIDATE') and judged is null
union all select 's' || s_suppkey, 'deeper recheck queued: ' || s_name from supplier""")
def unresolved_cases(spark, sf_dir):
    return reports.unresolved(*_states(spark, sf_dir), relation(spark, sf_dir, "select concat('s', s_suppkey) as handle, s_name as reason from {supplier}"))


@query(_BASE + """select nation, count(*) as accounts, min(coverage) as least, max(coverage) as greatest, list_sort(list(coverage))[count(*) // 2 + 1] as median, count(*) filter (evidence_state = 'SUFFICIENT') as sufficient,
    count(*) filter (evidence_state = 'PARTIAL') as partial, count(*) filter (evidence_state = 'INSUFFICIENT') as insufficient, count(*) filter (evidence_state = 'UNAVAILABLE') as unavailable from s group by 1""")
def coverage_stats(spark, sf_dir):
    return reports.coverage_stats(_states(spark, sf_dir)[0], "nation")


_BLOCKS = "select case p_partkey % 4 when 0 then 'VERIFIED' when 1 then 'PLANNED' when 2 then 'FAILED_RETRY' else 'UNBLOCKED' end as status from {part}"


@query(_ENFORCED + ", " + _BASE.strip().removeprefix("with ") + f""", per as (select key, bool_or(verified) as v, bool_or(attempted or not verified) as tried from enforced group by 1), b as ({plain(_BLOCKS)})
select count(*) as accounts, count(*) filter (enforcement = 'KEEP') as keep, count(*) filter (enforcement = 'REVIEW') as review, count(*) filter (enforcement = 'BLOCK_CANDIDATE') as block_candidate, count(*) filter (enforcement = 'BLOCK_CONFIRMED') as block_confirmed,
    count(*) filter (enforcement <> 'KEEP' and judged is null) as unresolved, count(*) filter (evidence_state in ('INSUFFICIENT', 'UNAVAILABLE')) as insufficient, count(distinct cluster) as clusters,
    (select count(*) from l where action = 'BLOCK') as owner_blocks, (select count(*) from l where action = 'KEEP') as owner_keeps, (select count(*) from per where v) as blocks_verified, (select count(*) from per where not v and tried) as block_failures,
    (select count(*) from b where status = 'VERIFIED') as auto_blocked, (select count(*) from b where status = 'FAILED_RETRY') as auto_failed, (select count(*) from b where status = 'PLANNED') as auto_pending from t""")
def completion_report(spark, sf_dir):
    return reports.completion(*_states(spark, sf_dir), _enforced(spark, sf_dir), relation(spark, sf_dir, _BLOCKS))


_FLAGGED = "enforcement in ('BLOCK_CANDIDATE', 'BLOCK_CONFIRMED')"
_BOT = "nature in ('AUTOMATION_LIKELY', 'MIXED_OR_ASSISTED')"
_METRICS = {
    "BLOCK_PRECISION": ("enforcement = 'BLOCK_CONFIRMED' and action = 'BLOCK'", "enforcement = 'BLOCK_CONFIRMED' and action is not null"), "BLOCK_RECALL": ("enforcement = 'BLOCK_CONFIRMED' and action = 'BLOCK'", "action = 'BLOCK'"),
    "BLOCK_PRECISION_FLAGGED": (f"{_FLAGGED} and action = 'BLOCK'", f"{_FLAGGED} and action is not null"), "BLOCK_RECALL_FLAGGED": (f"{_FLAGGED} and action = 'BLOCK'", "action = 'BLOCK'"),
    "RECALL_INTO_REVIEW": ("enforcement <> 'KEEP' and action = 'BLOCK'", "action = 'BLOCK'"), "FALSE_NEGATIVE_RATE": ("enforcement = 'KEEP' and action = 'BLOCK'", "action = 'BLOCK'"), "KEEP_FALSE_POSITIVE_RATE": (f"{_FLAGGED} and action = 'KEEP'", "action = 'KEEP'"),
    "BOT_DETECTION_PRECISION": (f"{_BOT} and nature_label = 'BOT_LIKELY'", f"{_BOT} and nature_label is not null"), "BOT_DETECTION_RECALL": (f"{_BOT} and nature_label = 'BOT_LIKELY'", "nature_label = 'BOT_LIKELY'"),
    "SCAM_PRECISION": ("is_scam and adjudicated_scam", "is_scam and adjudicated_scam is not null"), "SCAM_RECALL": ("is_scam and adjudicated_scam", "adjudicated_scam"),
    "IMPERSONATION_PRECISION": ("is_impersonation and adjudicated_impersonation", "is_impersonation and adjudicated_impersonation is not null"), "IMPERSONATION_RECALL": ("is_impersonation and adjudicated_impersonation", "adjudicated_impersonation"),
}


@query(_BASE + ", m as (" + " union all ".join(f"select '{name}' as metric, count(*) filter ({k}) as k, count(*) filter ({n}) as n from t" for name, (k, n) in _METRICS.items()) + """),
w as (select *, k / n::double as p, 1.96 * 1.96 as zz from m),
b as (select *, (p + zz / (2 * n) - 1.96 * sqrt((p * (1 - p) + zz / (4 * n)) / n)) / (1 + zz / n) as lo, (p + zz / (2 * n) + 1.96 * sqrt((p * (1 - p) + zz / (4 * n)) / n)) / (1 + zz / n) as hi from w)
select metric, k, n, case when n > 0 then round_even(p, 4) end as value, case when n > 0 then round_even(greatest(0.0, lo), 4) end as low, case when n > 0 then round_even(least(1.0, hi), 4) end as high, coalesce(n > 0 and round_even(greatest(0.0, lo), 4) >= 0.98, false) as can_claim from b""")
def metric_family(spark, sf_dir):
    return reports.metric_family(*_states(spark, sf_dir))


_SCORES = f"""
select c_custkey as k, concat('c', c_custkey) as handle, c_custkey * 7 % 100 as spam, c_custkey * 11 % 100 as scam, c_custkey * 13 % 100 as impersonation, c_custkey * 17 % 100 as automation, c_custkey % 4 = 1 as substantial, c_custkey % 9 = 0 as confirmed_network,
       c_custkey % 8 = 0 as repurposed, case c_custkey % 5 when 0 then 'BLOCK' when 1 then 'KEEP' end as action, case c_custkey % 6 when 0 then 'HUMAN_LIKELY' when 1 then 'BOT_LIKELY' end as nature_label, case c_custkey % 3 when 0 then 'REVIEW' else 'KEEP' end as enforcement,
       case c_custkey % 4 when 0 then 'REFUTES' else 'CONFIRMS' end as second_pass, c_custkey % 10 = 0 as disputed, case c_custkey % 5 when 2 then 'INSUFFICIENT' when 3 then 'UNAVAILABLE' else 'SUFFICIENT' end as evidence_state, c_custkey % 7 as f, c_custkey % 11 as h from {{customer}}""".replace("{{", "{").replace("}}", "}")
_FEATURES = {0: ("S011",), 1: ("S004", "I001"), 2: ("S001",), 3: ("I001",), 4: (), 5: ("A003", "S008"), 6: ("S012",)}
_FEATURE_SQL = "case f " + " ".join(f"when {k} then [{', '.join(map(repr, v))}]::varchar[]" for k, v in _FEATURES.items()) + " end"
_HINT_SQL = "case h when 3 then ['SCAM', 'OWNER_RULE'] when 4 then ['OWNER_RULE'] else []::varchar[] end"


def _scores(spark, sf_dir):
    lists = lambda table: F.array(*[F.array(*map(F.lit, v)).cast("array<string>") for v in table])
    rows = relation(spark, sf_dir, _SCORES)
    rows = rows.withColumn("strong", F.get(lists(_FEATURES.values()), F.col("f").cast("int")))
    hints = F.when(F.col("h") == 3, F.array(F.lit("SCAM"), F.lit("OWNER_RULE"))).when(F.col("h") == 4, F.array(F.lit("OWNER_RULE"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"raising": F.col("strong"), "weaker": F.col("strong"), "hints": hints})


@query(f"""with s as (select *, {_FEATURE_SQL} as strong, {_HINT_SQL} as hints from ({plain(_SCORES)})),
c as (select *, list_filter([case when spam >= 65 or list_has_any(strong, ['S011']) then 'SPAM' end, case when scam >= 65 or list_has_any(strong, ['S004', 'S008']) then 'SCAM' end, case when impersonation >= 65 or list_has_any(strong, ['I001']) then 'IMPERSONATION' end,
    case when confirmed_network then 'COORDINATED_NETWORK' end, case when repurposed then 'REPURPOSED_ACCOUNT' end], lambda x: x is not null) as base, case when automation >= 65 and substantial then 'MIXED_OR_ASSISTED' when automation >= 65 then 'AUTOMATION_LIKELY' when substantial and automation < 40 then 'HUMAN_LIKELY' else 'UNKNOWN' end as nature from s),
d as (select *, list_concat(base, list_filter(hints, lambda x: not list_contains(base, x))) as every from c)
select handle, case when len(every) = 0 then 'NORMAL' else array_to_string(every, '|') end as classification, nature,
    case when list_contains(every, 'IMPERSONATION') then 'impersonation' when list_contains(every, 'SCAM') then 'scam' when nature = 'AUTOMATION_LIKELY' then 'bot' when list_contains(every, 'SPAM') then 'spam' else 'uncertain' end as label from d""")
def classification_set(spark, sf_dir):
    return reports.classification(_scores(spark, sf_dir)).select("handle", F.array_join("classification", "|").alias("classification"), "nature", "label")


@query(f"""with s as (select *, {_FEATURE_SQL} as strong from ({plain(_SCORES)}))
select handle, array_to_string(list_filter([case when coalesce(nature_label = 'HUMAN_LIKELY', false) or (substantial and coalesce(action = 'KEEP', false)) then 'HUMAN_CONTINUITY_POSITIVE_CONTROL' end, case when enforcement = 'REVIEW' and list_has_any(strong, ['S001', 'S018', 'A003', 'S012']) then 'ENGAGEMENT_FARM_REVIEW_CONTROL' end,
    case when action = 'BLOCK' and confirmed_network then 'CONFIRMED_COORDINATED_NETWORK' end, case when action = 'BLOCK' and list_contains(strong, 'I001') and second_pass <> 'REFUTES' and not disputed then 'CONFIRMED_IMPERSONATION' end,
    case when action = 'BLOCK' and list_has_any(strong, ['S004', 'S008']) and second_pass <> 'REFUTES' then 'CONFIRMED_SCAM' end, case when evidence_state in ('INSUFFICIENT', 'UNAVAILABLE') then 'LOW_EVIDENCE_UNKNOWN' end], lambda x: x is not null), '|') as tags from s""")
def calibration_tags(spark, sf_dir):
    return reports.calibration_tags(_scores(spark, sf_dir)).select("handle", F.array_join("tags", "|").alias("tags"))


_OLDER = "select concat('ACCT', p_partkey) as handle, p_brand as cluster, p_size % 2 = 0 as confirmed, p_size as score from {part}"
_MEMBERS = "select concat('acct', s_suppkey * 3) as handle, concat('N6-', s_nationkey) as cluster, s_suppkey % 5 as evidence from {supplier}"


@query(_BASE + f""", o as ({plain(_OLDER)}), m as ({plain(_MEMBERS)}) select s.handle, coalesce(m.cluster, '') as cluster, coalesce(m.evidence, 0) as evidence, coalesce(o.cluster, '') as older_cluster, m.cluster is not null or coalesce(o.confirmed, false) as confirmed, coalesce(o.score, 0) as coordination
from s left join m on m.handle = lower(s.handle) left join o on lower(o.handle) = lower(s.handle)""")
def account_network(spark, sf_dir):
    return reports.network_view(_states(spark, sf_dir)[0], relation(spark, sf_dir, _MEMBERS), relation(spark, sf_dir, _OLDER))


_SCORED = "select concat('O', o_orderkey) as handle, case o_orderkey % 3 when 0 then 'BLOCK_CANDIDATE_PENDING_2ND_PASS' else 'REVIEW' end as action from {orders}"
_STRONG = "('A001', 'S004', 'S008', 'S011', 'I001')"


@query(f"""with i as ({INSTANCES_SQL}), o as ({plain(_SCORED)}), f as (select lower(handle) as key, string_agg(distinct feature_id, '|' order by feature_id) as features from i where feature_id in {_STRONG} and coalesce(n, 0) > 0 group by 1)
select handle, 'PENDING' as status, coalesce(features, '') as features from o left join f on f.key = lower(o.handle) where action like 'BLOCK%' and lower(handle) not in (select 'o' || l_orderkey from lineitem where l_quantity > 45)""")
def second_pass_templates(spark, sf_dir):
    """Orders with a large line have a second pass already."""
    found = instances(spark, sf_dir).select("handle", "feature_id", F.when(F.expr(f"feature_id in {_STRONG}"), "STRONG").alias("strength"), (F.coalesce("n", F.lit(0)) > 0).alias("raises"))
    existing = relation(spark, sf_dir, "select distinct concat('o', l_orderkey) as handle from {lineitem} where l_quantity > 45")
    rows = reports.second_pass_templates(relation(spark, sf_dir, _SCORED), found, existing)
    return rows.select("handle", "status", F.array_join("features", "|").alias("features"))


_FIRST_FORM = """
select concat('c', c_custkey) as handle, c_custkey % 3 > 0 as complete, case c_custkey % 4 when 0 then 'DOWNGRADE_TO_REVIEW' when 1 then 'CONFIRMED' end as verdict, case when c_custkey % 7 > 0 then c_custkey % 7 = 1 end as contrary, case when c_custkey % 5 > 0 then c_custkey % 3 end as post_count,
       case when c_custkey % 6 > 0 then c_custkey % 2 end as replies_sampled, c_custkey % 8 = 0 as older_sampled, c_custkey % 9 as items, case when c_custkey % 10 > 0 then c_custkey % 3 end as threads, case when c_custkey % 11 > 0 then c_custkey % 2 = 0 end as older_checked,
       c_custkey % 12 > 5 as human_searched, c_custkey % 13 = 0 as exhausted, c_custkey % 4 as n_quotes, c_name from {customer}"""


@query(f"""with r as ({plain(_FIRST_FORM)}), s as (select *, coalesce(post_count > 0, true) as posts, list_slice([c_name || ' one', c_name || ' two', c_name || ' three'], 1, n_quotes) as quotes from r),
t as (select *, posts and (older_sampled or coalesce(older_checked, false)) as older, case when n_quotes = 0 then 'the recorded evidence' else array_to_string(list_transform(list_slice(quotes, 1, 2), lambda q: '''' || q || ''''), '; ') end as said from s)
select handle, case when complete then 'DONE' else 'PENDING' end as status, array_to_string(list_filter(['PROFILE_HISTORY', case when posts then 'ORIGINAL_POSTS' end, case when posts and coalesce(replies_sampled <> 0, true) then 'REPLIES' end, case when older then 'OLDER_CONTENT' end], lambda x: x is not null), '|') as available,
    array_to_string(list_filter([case when n_quotes > 0 then 'PROFILE_HISTORY' end, case when items > 0 then 'ORIGINAL_POSTS' end, case when coalesce(threads > 0, false) then 'REPLIES' end, case when coalesce(older_checked, false) and older then 'OLDER_CONTENT' end], lambda x: x is not null), '|') as sampled,
    exhausted as all_examined, case when human_searched then 7 else 0 end as n_checks, 'The account is a fan, parody or commentary account, or a real person quoting/joking, and ' || said || ' is not meant as a real claim or solicitation.' as strongest_case,
    coalesce(contrary, false) or coalesce(verdict = 'DOWNGRADE_TO_REVIEW', false) as contrary from t""")
def second_pass_converted(spark, sf_dir):
    rows = relation(spark, sf_dir, _FIRST_FORM)
    quotes = F.slice(F.array(*[F.concat("c_name", F.lit(f" {n}")) for n in ("one", "two", "three")]), F.lit(1), F.col("n_quotes").cast("int"))
    out = reports.converted_pass(rows.withColumn("quotes", quotes))
    return out.select("handle", "status", F.array_join("available", "|").alias("available"), F.array_join("sampled", "|").alias("sampled"), "all_examined", F.size("checks_done").alias("n_checks"), "strongest_case", "contrary")


_REACTIONS = """select o_orderkey as id, concat('c', o_custkey) as handle, case o_orderkey % 4 when 0 then 'KEEP' when 1 then 'REVIEW' when 2 then 'BLOCK_CANDIDATE' else 'BLOCK_CONFIRMED' end as enforcement, case o_orderkey % 5 when 0 then 'BLOCK' when 1 then 'BLOCK' when 2 then 'KEEP' when 3 then 'KEEP' end as action,
    case o_orderkey % 6 when 0 then 'HUMAN_LIKELY' when 1 then 'BOT_LIKELY' end as nature, o_orderkey % 3 = 0 as disputed, case o_orderkey % 7 when 0 then 'he is a real person' when 1 then 'this is fake' when 2 then 'clearly automated' when 3 then 'this is a fake bot' else concat('order  ', o_orderkey, ' of   ', o_orderstatus, ' and a long tail of words ', o_custkey) end as words from {orders}"""


@query(f"""with r as ({plain(_REACTIONS)}), g as (select *, case when action is null then 'NO_OWNER_ACTION' when action = 'BLOCK' then case when enforcement like 'BLOCK%' then 'AGREE' when enforcement = 'REVIEW' then 'REVIEW_RESOLVED_BLOCK' else 'DISAGREE' end
    else case enforcement when 'KEEP' then 'AGREE' when 'REVIEW' then 'REVIEW_RESOLVED_KEEP' else 'DISAGREE' end end as agreement from r)
select id, agreement, coalesce(action, 'UNRESOLVED') as adjudicated, case when nature is not null and not disputed then nature else 'UNKNOWN' end as adjudicated_nature, case when nature is null then 'no explicit owner nature label' when disputed then 'LABEL_AMBIGUITY' else 'owner explicit statement' end as adjudication_reason,
    agreement = 'DISAGREE' as recheck_queued, case when regexp_matches(words, '(?i)\\b(real person|is human|a human|real human|actual person|not a bot)\\b') then 'HUMAN' when regexp_matches(words, '(?i)\\b(this|that|it|account)\\s*(is|''s|’s|was)\\s+(definitely\\s+|clearly\\s+|obviously\\s+)?(an?\\s+)?fake(\\s+account)?\\b') and not regexp_matches(words, '(?i)\\bbot\\b') then 'FAKE' when regexp_matches(words, '(?i)automated') then 'AUTOMATED' else 'BOT' end as word,
    case when length(trim(regexp_replace(words, '\\s+', ' ', 'g'))) <= 30 then trim(regexp_replace(words, '\\s+', ' ', 'g')) else rtrim(left(trim(regexp_replace(words, '\\s+', ' ', 'g')), 29)) || '…' end as short from g""")
def adjudication_records(spark, sf_dir):
    rows = reports.adjudication_records(relation(spark, sf_dir, _REACTIONS))
    return rows.select("id", "agreement", "adjudicated", "adjudicated_nature", "adjudication_reason", "recheck_queued", reports.nature_word(F.col("words")).alias("word"), reports.shortened(F.col("words"), 30).alias("short"))


@query(f"""with i as (select handle, feature_id, n, feature_id like 'S%' as weighs from ({INSTANCES_SQL})), e as (select handle, feature_id from i where feature_id not in ('W001', 'W002', 'W003') and (coalesce(n, 0) <> 0 or weighs)
    union all select 'o' || o_orderkey, 'OP_IDENTITY' from orders where o_orderkey % 3 = 0 union all select 'o' || o_orderkey, 'OP_RULE' from orders where o_orderkey % 5 = 0),
f as (select handle, string_agg(distinct feature_id, '|' order by feature_id) as features from e group by 1),
a as (select *, lower(ltrim(handle, '@')) as key from (select o_orderkey as id, case when o_orderkey % 2 = 0 then '@O' else 'o' end || (o_orderkey - o_orderkey % 4) as handle, case o_orderkey % 5 when 0 then 'BLOCK' when 1 then 'BLOCK' when 2 then 'KEEP' when 3 then 'KEEP' end as action, case when o_orderkey % 7 = 0 then 'HUMAN_LIKELY' end as nature_label from orders)),
l as (select * exclude (handle, id) from a qualify row_number() over (partition by key order by id desc) = 1)
select f.handle, case when action = 'BLOCK' then 1 else 0 end as label, coalesce(nature_label = 'HUMAN_LIKELY', false) or f.handle in (select 'o' || s_suppkey from supplier) as human, features from f join l on l.key = f.handle where action is not null""")
def training_rows(spark, sf_dir):
    """The owner's model's rows of all orders that were answered, from features and answers."""
    found = instances(spark, sf_dir).select("handle", "feature_id", "n", F.col("feature_id").startswith("S").alias("weighs"))
    policy = relation(spark, sf_dir, "select concat('o', o_orderkey) as handle, o_orderkey % 3 = 0 as identity, o_orderkey % 5 = 0 as rule from {orders}")
    states = reports.model_features(found, ("W001", "W002", "W003"), policy)
    answers = relation(spark, sf_dir, "select o_orderkey as id, concat(case when o_orderkey % 2 = 0 then '@O' else 'o' end, o_orderkey - o_orderkey % 4) as handle, case o_orderkey % 5 when 0 then 'BLOCK' when 1 then 'BLOCK' when 2 then 'KEEP' when 3 then 'KEEP' end as action, case when o_orderkey % 7 = 0 then 'HUMAN_LIKELY' end as nature_label from {orders}")
    rows = reports.training_rows(states, answers, relation(spark, sf_dir, "select concat('O', s_suppkey) as handle from {supplier}"))
    return rows.select("handle", "label", "human", F.array_join("features", "|").alias("features"))


@query("select 'acct' || p_partkey as handle, 'https://x.com/acct' || p_partkey as profile_url, 'NOT_AUDITED' as enforcement, 'UNKNOWN' as nature from part")
def stub_states(spark, sf_dir):
    return reports.stub_states(relation(spark, sf_dir, "select concat('@ACCT', p_partkey) as handle from {part}"))
