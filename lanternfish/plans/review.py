"""Queries over reasons, confidence, diagnosis, policy and first-form second passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish.operators import review
from lanternfish.plans.common import registry
from lanternfish.plans.projections import INSTANCES_SQL, instances
from lanternfish.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()
_PHRASES = ", ".join(f"""('{f}', '{p.replace("'", "''")}', {i})""" for i, (f, p) in enumerate(review.PHRASES))


@query(f"""with i as ({INSTANCES_SQL}), p as (select * from (values {_PHRASES}) t(feature_id, phrase, place)),
h as (select handle, arg_min(feature_id, place) as f, arg_min(phrase, place) as phrase from i join p using (feature_id) where coalesce(n, 0) > 0 group by 1)
select handle, case when f is null then case when handle like '%7' then 'Almost nothing could be read on this profile.' else 'No strong warning signs found.' end
    when f in ('S011', 'S008', 'D007') then phrase || '.' else phrase || ': "seen ' || f || ' on the page"' end as reason from (select distinct handle from i) left join h using (handle)""")
def short_reasons(spark, sf_dir):
    rows = instances(spark, sf_dir)
    found = rows.select("handle", "feature_id", F.coalesce("n", F.lit(0)).alias("weight"), F.concat(F.lit("seen  "), "feature_id", F.lit("\non the page")).alias("evidence"))
    outcome = F.when(F.col("handle").endswith("7"), "UNKNOWN").otherwise("KEEP")
    return review.short_reasons(found, rows.select("handle").distinct().withColumn("outcome", outcome))


@query("""select c_custkey as custkey, round_even(greatest(0, least(cap + plus, base + 20.0::double * (c_custkey % 16) / 15 + 5 * least(3, c_custkey % 5) + plus - case when c_custkey % 3 = 0 and c_custkey % 97 >= 40 then 10 else 0 end, 100)), 0)::int as confidence from (
    select *, [5, 25, 45, 65][c_custkey % 4 + 1] as base, [20, 55, 75, 90][c_custkey % 4 + 1] as cap, case when c_custkey % 7 = 0 then 10 else 0 end as plus from customer)""")
def overall_confidence(spark, sf_dir):
    k = F.col("c_custkey")
    quality = F.element_at(F.array(*map(F.lit, ("NONE", "LOW", "MEDIUM", "HIGH"))), (k % 4 + 1).cast("int"))
    value = review.confidence(quality, k % 16, k % 5, k % 7 == 0, k % 3 == 0, k % 97)
    return table(spark, sf_dir, "customer").select(k.alias("custkey"), value.alias("confidence"))


_CASE = {
    "action": "case k % 5 when 0 then null when 1 then 'KEEP' else 'BLOCK' end", "disputed": "k % 29 = 0", "enforcement": "case k % 4 when 0 then 'KEEP' when 1 then 'REVIEW' when 2 then 'BLOCK_CANDIDATE' else 'KEEP' end",
    "evidence_state": "case k % 7 when 0 then 'UNAVAILABLE' when 1 then 'INSUFFICIENT' when 2 then 'PARTIAL' else 'SUFFICIENT' end", "g1": "k % 3 = 0", "g2": "k % 2 = 0", "g3": "k % 8 > 0", "g6": "k % 11 > 0",
    "result": "case k % 13 when 0 then 'REFUTES' when 1 then 'INCOMPLETE' when 2 then 'PENDING' else 'CONFIRMS' end", "rule_hit": "k % 17 = 0", "strong_feature": "k % 6 = 1", "top_score": "k * 7 % 90", "n_groups": "k % 3",
    "capped": "k % 9 = 4", "weak": "k % 10 = 7", "human_evidence": "k % 2 = 1",
}


@query("with r as (select k, " + ", ".join(f"{e} as {n}" for n, e in _CASE.items()) + """ from (select o_orderkey as k from orders))
select k, case when action is null then null when disputed then 'LABEL_AMBIGUITY' when case when action = 'BLOCK' then enforcement in ('BLOCK_CANDIDATE', 'BLOCK_CONFIRMED') else enforcement in ('KEEP', 'REVIEW') end then null
    when action = 'KEEP' then case when human_evidence then 'SCORING_FAILURE' else 'LABEL_AMBIGUITY' end when evidence_state in ('INSUFFICIENT', 'UNAVAILABLE') then 'COLLECTION_FAILURE'
    when g1 and g2 and (result = 'REFUTES' or not g6) then 'LABEL_AMBIGUITY' when g1 and g2 and (result in ('INCOMPLETE', 'PENDING') or not g3) then 'COLLECTION_FAILURE' when rule_hit then 'LABEL_AMBIGUITY'
    when (strong_feature and enforcement = 'REVIEW') or top_score >= 65 or n_groups >= 2 then 'DECISION_THRESHOLD_FAILURE' when capped or weak then 'SCORING_FAILURE' when evidence_state = 'PARTIAL' then 'COLLECTION_FAILURE'
    else 'FEATURE_EXTRACTION_FAILURE' end as failure from r""")
def failure_diagnosis(spark, sf_dir):
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return review.diagnosed(k.select("k", *[F.expr(e).alias(n) for n, e in _CASE.items()])).select("k", "failure")


_FORM = {
    "complete": "k % 10 > 0", "verdict": "case k % 4 when 0 then 'DOWNGRADE_TO_REVIEW' when 1 then 'PENDING' else 'CONFIRMED' end", "contrary": "case k % 13 when 0 then true when 1 then null else false end", "items": "k % 25 + 5",
    "threads": "k % 5 + 1", "exhausted": "k % 2 = 0", "visible_items": "k % 22", "visible_threads": "k % 4", "older_checked": "k % 19 > 0", "quotes_verified": "k % 23 > 0", "human_searched": "true", "domains": "k % 29 > 0",
    "repeated": "k % 31 > 0", "network": "case when k % 3 > 0 then true end", "claims_identity": "k % 6 = 0", "claim_quoted": "k % 12 = 0",
}


@query("with r as (select k, " + ", ".join(f"{e} as {n}" for n, e in _FORM.items()) + """ from (select o_orderkey as k from orders)),
p as (select *, (case when items >= 20 or (exhausted and visible_items < 20 and items >= visible_items) then 0 else 1 end
    + case when threads >= 3 or (exhausted and visible_items < 20 and visible_threads < 3 and threads >= visible_threads) then 0 else 1 end + case when older_checked then 0 else 1 end + case when quotes_verified then 0 else 1 end
    + case when domains then 0 else 1 end + case when repeated then 0 else 1 end + case when coalesce(network, true) then 0 else 1 end + case when not claims_identity or claim_quoted then 0 else 1 end)::int as n_problems from r)
select k, n_problems, case when not complete or verdict = 'PENDING' then 'PENDING' when coalesce(contrary, false) or verdict = 'DOWNGRADE_TO_REVIEW' then 'DOWNGRADE_TO_REVIEW'
    when verdict = 'CONFIRMED' and coalesce(not contrary, false) and n_problems = 0 then 'CONFIRMED' else 'INCONCLUSIVE' end as effective_verdict from p""")
def first_form_pass(spark, sf_dir):
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    rows = review.first_form_pass(k.select("k", *[F.expr(e).alias(n) for n, e in _FORM.items()]))
    return rows.select("k", F.size("problems").alias("n_problems"), "effective_verdict")


@query("""select doc_id::varchar as handle, 'IDENTITY' as kind, name from documents, (values ('the'), ('und')) t(name) where regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || name || '($|[^\\p{L}\\p{N}_])')
union all select doc_id::varchar, 'RULE', 'Q1' from documents where regexp_matches(lower(text), 'licen[sc]e') union all select doc_id::varchar, 'RULE', 'Q2' from documents where regexp_matches(lower(text), 'worthless') and doc_id % 2 = 0""")
def policy_matches(spark, sf_dir):
    features = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("S005"))).otherwise(F.expr("array()").cast("array<string>"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("handle"), "text", features.alias("features"))
    who = spark.createDataFrame([("the",), ("und",)], "name string")
    answers = spark.createDataFrame([("Q1", "licen[sc]e", []), ("Q2", "worthless", ["S005", "S010"])], "name string, pattern string, required array<string>")
    return review.policy_matches(texts, who, answers)
