"""Queries over checks of interactions and payloads, words of owners, and the backtest of a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.operators import decisions, jobs, ledger, metrics, model, reports, review
from lanternfish.operators import interactions as it
from lanternfish.plans.common import registry, relation
from lanternfish.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()
_RE2 = lambda pattern: pattern.replace("'", "''")

_CUSTOMER = "select c_custkey as k, c_mktsegment as segment from {customer}"


@query("select c_custkey as k, case c_custkey % 6 when 0 then 'KEEP' when 1 then 'KEEP' when 2 then 'BLOCK' when 3 then 'BLOCK' when 4 then 'KEEP' end as action from customer")
def owner_reactions(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ("✅", " keep", "❌", "Block ", "KEEP", None))), (F.col("k") % 6 + 1).cast("int"))
    return relation(spark, sf_dir, _CUSTOMER).select("k", decisions.reaction(text).alias("action"))


#: What owners say of accounts; a text is one of these behind the name of a segment.
_SAID = (
    "this is definitely a bot", "he is a real person", "maybe it is a bot", "bot", "the account is fake", "it's an automated account", "clearly automated posts", "probably human", "no idea", "spambot!", "that was obviously a fake account", "she is human",
)
_SAYS = f"select c_custkey as k, list_element([{', '.join(repr(x) if chr(39) not in x else chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in _SAID)}], (c_custkey % {len(_SAID)} + 1)::int) as t from customer"
_FAKE = r"\b(this|that|it|account)\s*(is|'s|’s|was)\s+(definitely\s+|clearly\s+|obviously\s+)?(an?\s+)?fake(\s+account)?\b"


@query(f"""with s as ({_SAYS}), f as (select k, regexp_matches(t, '(?i){_RE2(decisions.HUMAN_SAID)}') as human, regexp_matches(t, '(?i){_RE2(decisions.DOUBT_SAID)}') as doubt, regexp_matches(t, '(?i){_RE2(decisions.BOT_SAID)}') as bot,
    regexp_matches(t, '(?i){_RE2(_FAKE)}') and not regexp_matches(t, '(?i)\\bbot\\b') as fake, regexp_matches(t, '(?i)automated') as automated from s)
select k, case when human then 'HUMAN_LIKELY' when not doubt and bot then 'BOT_LIKELY' end as nature, case when human then 'HUMAN' when fake then 'FAKE' when automated then 'AUTOMATED' else 'BOT' end as word from f""")
def owner_natures(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("k") % len(_SAID) + 1).cast("int"))
    rows = relation(spark, sf_dir, _CUSTOMER).withColumn("t", text)
    return rows.select("k", decisions.explicit_nature(F.col("t")).alias("nature"), reports.nature_word(F.col("t")).alias("word"))


@query("""with p as (select doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') as p from documents)
select doc_id, case when length(p) <= 90 then p else rtrim(left(p, 89), ' ') || '…' end as text from p""")
def shortened_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", reports.shortened(F.col("text")).alias("text"))


_PREDICTED = "select o_orderkey as handle, o_orderpriority as tier, o_orderkey % 3 = 0 or o_orderkey % 11 = 0 as flagged, cast(case o_orderkey % 4 when 0 then 1 when 1 then 1 when 2 then 0 end as int) as label, o_orderkey % 13 = 0 as human from {orders}"


@query(f"""with p as ({_PREDICTED.replace("{orders}", "orders")})
select tier, count(*) filter (label = 1) as n_blocks, count(*) filter (label = 1 and flagged) as n_caught, count(*) filter (label = 0 and flagged) as n_false, count(*) filter (human and flagged) as n_false_human,
       round_even(count(*) filter (label = 1 and flagged) / count(*) filter (label = 1), 4) as recall from p group by 1""")
def backtest_tiers(spark, sf_dir):
    return model.backtest(relation(spark, sf_dir, _PREDICTED), "tier")


@query(f"""with p as ({_PREDICTED.replace("{orders}", "orders")})
select tier, handle, case when label = 1 then 'MISSED_BLOCK' when label = 0 then 'FLAGGED_KEEP' else 'FLAGGED_HUMAN' end as what from p
where (label = 1 and not flagged) or (flagged and label = 0) or (flagged and human and label is null)""")
def backtest_lists(spark, sf_dir):
    return model.backtest_lists(relation(spark, sf_dir, _PREDICTED), "tier")


@query("""with r as (select event_id, case event_id % 9 when 0 then '@@u' || user_id when 1 then 'bad handle' when 2 then null when 3 then 'u234567890123456' else 'u' || user_id end as handle, case event_id % 7 when 0 then false when 1 then null else true end as confirmed, event_type, event_id % 5 = 0 as timeless from events)
select event_id, array_to_string(list_filter([case when not coalesce(regexp_matches(ltrim(trim(handle), '@'), '^[A-Za-z0-9_]{1,15}$'), false) then 'invalid handle' end, case when not coalesce(confirmed, false) then 'handle not confirmed' end,
    case when event_type not in ('signup', 'click') then 'unknown interaction type' end, case when timeless then 'timestamp missing or invalid' end], lambda x: x is not null), '|') as problems from r""")
def interaction_problems(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    handle = F.when(k % 9 == 0, F.concat(F.lit("@@u"), "user_id")).when(k % 9 == 1, "bad handle").when(k % 9 == 2, None).when(k % 9 == 3, "u234567890123456").otherwise(F.concat(F.lit("u"), "user_id"))
    kind = F.when(F.col("event_type") == "signup", "NEW_FOLLOW").when(F.col("event_type") == "click", "REPLY").otherwise("WAVE")
    rows = e.select("event_id", handle.alias("handle"), F.when(k % 7 == 0, False).when(k % 7 > 1, True).alias("handle_confirmed"), kind.alias("kind"), F.when(k % 5 > 0, F.col("ts")).alias("ts"))
    return it.problems(rows).select("event_id", F.array_join("problems", "|").alias("problems"))


@query("""select event_id, array_to_string(list_transform(regexp_extract_all('{"Auth" : ' || props || '}', '"([^"]*)"\\s*:', 1), lambda x: lower(x)), '|') as keys from events""")
def payload_keys(spark, sf_dir):
    payload = F.concat(F.lit('{"Auth" : '), "props", F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(jobs.payload_keys(payload), "|").alias("keys"))


_PROPOSED = "select s_suppkey as proposal, s_suppkey % 2 = 0 as changes_weights, '1.0' as current_version, case s_suppkey % 5 when 0 then '1.0' when 1 then '' when 2 then cast(null as string) else '1.1' end as new_version, s_suppkey % 6 as n_tests from {supplier}"
_EXAMPLES = "select l_suppkey as proposal, concat(case l_orderkey % 2 when 0 then 'u' else 'U' end, l_partkey % 4) as handle, l_linenumber % 2 as round, case when l_partkey % 3 = 0 then 'COLLECTION_FAILURE' else 'SCORING_FAILURE' end as diagnosis from {lineitem} where l_quantity = 7 and l_linenumber < 3"
_RERUNS = "select l_suppkey as proposal, concat('set', l_linenumber) as set_id from {lineitem} where l_quantity = 9"
_FROZEN = "select concat('set', r_regionkey + 1) as set_id from {region} where r_regionkey < 3"
_SQL = lambda text: text.replace("as string", "as varchar").replace("{", "").replace("}", "")


@query(f"""with p as ({_SQL(_PROPOSED)}), x as ({_SQL(_EXAMPLES)}), f as ({_SQL(_FROZEN)}), r as (select distinct proposal, set_id from ({_SQL(_RERUNS)})),
s as (select proposal, count(distinct lower(handle)) as n_examples, count(distinct round) as n_rounds, bool_or(diagnosis = 'COLLECTION_FAILURE') as uncollected from x group by 1),
m as (select p.proposal, coalesce(string_agg(f.set_id, ',' order by f.set_id) filter (r.set_id is null), '') as missing from p cross join f left join r on r.proposal = p.proposal and r.set_id = f.set_id group by 1)
select proposal, coalesce(n_examples, 0) as n_examples, coalesce(n_rounds, 0) as n_rounds, missing, array_to_string(list_filter([case when coalesce(n_examples, 0) < 3 then 'fewer than 3 examples' end, case when coalesce(n_rounds, 0) < 2 then 'one round only' end,
    case when changes_weights and coalesce(uncollected, false) then 'weights may not change for a collection failure' end, case when coalesce(new_version, '') in ('', '1.0') then 'no version bump' end,
    case when n_tests = 0 then 'no regression tests' end, case when missing <> '' then 'reruns missing' end], lambda v: v is not null), '|') as problems from p left join s using (proposal) join m using (proposal)""")
def rule_changes(spark, sf_dir):
    rows = review.rule_changes(*(relation(spark, sf_dir, text) for text in (_PROPOSED, _EXAMPLES, _FROZEN, _RERUNS)))
    return rows.select("proposal", "n_examples", "n_rounds", F.array_join("missing", ",").alias("missing"), F.array_join("problems", "|").alias("problems"))


@query(f"""with e as (select source, count(*) filter (toxic = 1) as errors from documents join labels using (doc_id) group by 1),
n as (select source, errors, unnest(range(errors + 1, 20000)) as n from e),
w as (select *, (n - errors)::double / n as p, {config.WILSON_Z} as z from n)
select source, errors, min(n) as n_needed from w where round_even(greatest(0.0, (p + z * z / (2 * n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 4) >= 0.9 group by 1, 2""")
def cases_needed(spark, sf_dir):
    """How many labels a source would need for a precision of 0.9, with as many errors as it has toxic documents."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = d.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("errors")).withColumn("target", F.lit(0.9))
    return metrics.cases_needed(rows).select("source", "errors", "n_needed")


_ASKED = "select c_custkey as instance from {customer}"
_ANSWERS = "select o_custkey as instance, o_orderkey as id, case o_orderkey % 5 when 0 then null when 1 then false else true end as yes, o_orderdate as answered_at, o_orderpriority as words from {orders} where o_orderkey % 3 = 0"
_PAUSES = "select c_custkey as instance, date '1997-01-01' as began, date '1997-01-02' as backoff_until from {customer} where c_custkey % 2 = 0"


@query(f"""with a as (select *, row_number() over (partition by instance order by answered_at desc, id desc) as place from ({_SQL(_ANSWERS)}) where yes is not null)
select i.instance, a.instance is null as ask_now, case when yes then 'YES' when not yes then 'NO' end as answer, words, coalesce(yes, false) as opted_in from ({_SQL(_ASKED)}) i left join a on a.instance = i.instance and place = 1""")
def list_offers(spark, sf_dir):
    return ledger.offers(relation(spark, sf_dir, _ASKED), relation(spark, sf_dir, _ANSWERS)).select("instance", "ask_now", "answer", "words", "opted_in")


@query(f"""with a as (select *, row_number() over (partition by instance order by answered_at desc, id desc) as place from ({_SQL(_ANSWERS)}) where yes is not null)
select p.instance, case when coalesce(a.yes and a.answered_at > began, false) then null else backoff_until end as backoff_until from ({_SQL(_PAUSES)}) p left join a on a.instance = p.instance and place = 1""")
def list_backoffs(spark, sf_dir):
    offered = ledger.offers(relation(spark, sf_dir, _ASKED), relation(spark, sf_dir, _ANSWERS))
    return ledger.resumed(relation(spark, sf_dir, _PAUSES), offered).select("instance", "backoff_until")
