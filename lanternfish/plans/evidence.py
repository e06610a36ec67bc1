"""Queries from account records: items, years, links, list checks, list upkeep; each starts from records, not from ready flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.functions import names
from lanternfish.operators import known
from lanternfish.plans.common import plain, registry, relation
from lanternfish.sources import lists, records
from lanternfish.sources.shared import numbered, spread

QUERIES, ORACLE_SQL, query = registry()

#: Sampled items: a document is an item of one of as many accounts as there are customers.
_ITEMS = """
select concat('a', doc_id % 150) as handle, case doc_id % 3 when 0 then 'POST' when 1 then 'REPLY' else 'OLDER' end as src, text,
       case when doc_id % 7 = 0 then 'UNKNOWN' when doc_id % 7 = 1 then concat('20', 10 + doc_id % 14, '-13-01') when doc_id % 7 = 2 then concat('20', 10 + doc_id % 14) else concat('20', 10 + doc_id % 14, '-0', 1 + doc_id % 9, '-1', doc_id % 10, 'T08:00:00Z') end as date,
       case when doc_id % 3 = 1 then concat('T', doc_id % 20) end as target, doc_id
from {documents}"""

#: Accounts of the records: names, biographies with links, websites and values, all from a customer's number.
_ACCOUNTS = """
select concat(case when c_custkey % 2 = 0 then 'A' else 'a' end, c_custkey) as handle, c_custkey as k,
       case c_custkey % 9 when 0 then 'Elon Musk' when 1 then 'iam_el0n' when 2 then 'melon farm' when 3 then 'UNKNOWN' when 4 then 'Tesla CE0' when 5 then 'muskrat' when 6 then 'SpaceX Musk' when 7 then 'Big 3lon' else c_name end as display_name,
       case c_custkey % 5 when 0 then concat('see https://www.shop', c_custkey % 40, '.com/Item?utm_source=x&b=2&a=', c_custkey % 3, ' now') when 1 then 'UNKNOWN' when 2 then concat('Kindly send me a follow request, claim your prize ', c_custkey % 7) when 3 then 'plain words' else '' end as bio,
       case c_custkey % 4 when 0 then concat('HTTP://T.me/User', c_custkey % 30, '/') when 1 then 'UNKNOWN' when 2 then concat('http://shop', c_custkey % 40, '.com/') end as website,
       case when c_custkey % 6 = 0 then concat('text on zangi 34151', 10000 + c_custkey % 50) end as post,
       case when c_custkey % 8 = 0 then concat(' 0xAB', c_custkey % 5, ' ') when c_custkey % 8 = 1 then 'UNKNOWN' end as wallet
from {customer}"""

#: The links of those accounts as they are after normalisation.
_LINKS = f"""
with accounts as ({plain(_ACCOUNTS)}),
found as (
    select handle, k, 'shop' || k % 40 || '.com/Item?a=' || k % 3 || '&b=2' as url, 'shop' || k % 40 || '.com' as domain, 'other' as kind from accounts where k % 5 = 0
    union all select handle, k, 't.me/user' || k % 30, 't.me', 'telegram' from accounts where k % 4 = 0
    union all select handle, k, 'shop' || k % 40 || '.com', 'shop' || k % 40 || '.com', 'other' from accounts where k % 4 = 2
    union all select handle, k, 'services.zangi.com/dl/34151' || (10000 + k % 50), 'services.zangi.com', 'zangi' from accounts where k % 6 = 0)
"""


def _records(spark, sf_dir):
    """Records of the accounts, without sampled items but one post."""
    rows = relation(spark, sf_dir, _ACCOUNTS)
    item = F.struct(F.col("post").alias("text"), F.lit("2024-01-01").alias("date"), F.lit(None).cast("string").alias("target"))
    value = lambda c: F.when(F.col(c).isNotNull(), F.array(F.struct(F.col(c).alias("value"))))
    filled = {
        "recent_original_posts": F.when(F.col("post").isNotNull(), F.struct(F.lit(1).cast("long").alias("sampled_count"), F.array(item).alias("items"))), "wallet_addresses": value("wallet"),
        "provenance": F.struct((F.col("k") % 7).cast("long").alias("row"), F.lit("UNKNOWN").alias("website")),
    }
    return _filled(rows.withColumns(filled))


def _sampled(spark, sf_dir):
    """Records that hold the sampled items of each account in their three blocks."""
    rows = relation(spark, sf_dir, _ITEMS)
    of = lambda src: F.collect_list(F.when(F.col("src") == src, F.struct("text", "date", "target")))
    named = {name: F.struct(F.lit(None).cast("long").alias("sampled_count"), of(src).alias("items")).alias(name) for name, src in records.BLOCKS.items()}
    return _filled(rows.groupBy("handle").agg(*named.values()))


def _filled(rows):
    """All fields of a record; those that the rows lack are null."""
    from pyspark.sql.types import _parse_datatype_string

    return rows.select("handle", *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(records.RECORD) if f.name != "handle"])


@query(f"""with i as ({plain(_ITEMS)}), a as ({plain(_ACCOUNTS)}),
e as (select handle, 'TEXT' as kind, text as v, date as d, target, src from i where text <> '' union all select handle, 'TEXT', post, '2024-01-01', null, 'POST' from a where post is not null
    union all select handle, 'BIO', bio, null, null, 'BIO' from a where bio not in ('', 'UNKNOWN') union all select handle, 'WALLET', wallet, null, null, 'wallet_addresses' from a where wallet not in ('', 'UNKNOWN'))
select handle, kind, src, sha256(v) as value_sha256, try_cast(case when regexp_matches(d, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then left(d, 10) end as date) as date, target from e""")
def record_items(spark, sf_dir):
    """Every item of all records, with its text as a hash."""
    rows = records.items(_sampled(spark, sf_dir)).unionByName(records.items(_records(spark, sf_dir)))
    return rows.select("handle", "kind", "src", F.sha2("value", 256).alias("value_sha256"), "date", "target")


@query(f"""with i as ({plain(_ITEMS)}), y as (select handle, left(date, 4)::int as y from i where regexp_matches(date, '^\\d{{4}}')),
g as (select handle, y, y - lag(y) over (partition by handle order by y) as gap from y)
select i.handle, count(y) as n_years, max(gap) as max_gap from (select distinct handle from i) i left join g on i.handle = g.handle group by 1""")
def record_year_gaps(spark, sf_dir):
    rows = records.year_gaps(_sampled(spark, sf_dir))
    return rows.select("handle", F.col("n_years").cast("long").alias("n_years"), "max_gap")


@query(_LINKS + "select handle, url, domain, kind from found")
def record_links(spark, sf_dir):
    return records.each_link(records.record_links(spread(_records(spark, sf_dir))), "handle").select("handle", "url", "domain", "kind")


@query(f"""with a as ({plain(_ACCOUNTS)})
select handle, array_to_string(list_filter([display_name, bio, handle, post], lambda t: t is not null and t <> '' and t <> 'UNKNOWN'), chr(10)) as text, row_number() over (order by k % 7, lower(handle)) as place from a""")
def record_policy_text(spark, sf_dir):
    """The text that policies are matched against, with each record's place in the order of work (a report: it numbers all records)."""
    rows = records.ordered(_records(spark, sf_dir))
    placed = numbered(rows.select("handle", F.col("place").alias("order")), "order", "place").select("handle", "place")
    return records.policy_text(rows).join(placed, "handle").select("handle", "text", F.col("place").cast("long").alias("place"))


EXCLUSIONS = ("melon",)


def name_rule_sql(name: str) -> str:
    """The name rule in the other engine, for names in ASCII: an expression over a column."""
    any_of = lambda text, words: "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"
    quoted = lambda rule: "'" + rule.replace("'", "''") + "'"

    def of(reading: tuple[str, str]) -> str:
        words = f"regexp_extract_all(regexp_replace(translate(lower(translate({name}, '|$@', 'lsa')), '{reading[0]}', '{reading[1]}'), '[_.''’-]', '', 'g'), '[a-z]+')"
        rest = f"list_transform({words}, lambda w: replace(w, '{EXCLUSIONS[0]}', '-'))"
        joined = f"array_to_string({rest}, '')"
        terms = " ".join(f"when contains({joined}, '{t}') then {quoted(names.RULE_TERM % t)}" for t in config.COMPACT_TERMS)
        part = f"""case when p = 'elon' then {quoted(names.RULE_NAME)} when starts_with(p, 'elon') or ends_with(p, 'elon') then {quoted(names.RULE_JOINED)}
            when contains(p, 'elon') and {any_of("replace(p, 'elon', '-')", config.ROLE_WORDS)} then {quoted(names.RULE_ROLE)} end"""
        return f"""case when len(list_filter({words}, lambda w: regexp_matches(w, '{names.CLAIMED}'))) > 0 then {quoted(names.RULE_CLAIM)} {terms}
            when contains({joined}, 'musk') and {any_of(f"replace({joined}, 'musk', '-')", config.PARTNER_WORDS)} then {quoted(names.RULE_PARTNER)}
            else list_filter(list_transform(string_split(array_to_string({rest}, '-'), '-'), lambda p: {part}), lambda r: r is not null)[1] end"""

    return f"coalesce({of(config.LEET_L)}, {of(config.LEET_I)})"


@query(f"with a as ({plain(_ACCOUNTS)}) select handle, display_name, {name_rule_sql('display_name')} as rule from a")
def name_rule(spark, sf_dir):
    """The rule that each account's name meets."""
    rows = relation(spark, sf_dir, _ACCOUNTS)
    return rows.select("handle", "display_name", names.impersonates(F.col("display_name"), EXCLUSIONS).alias("rule"))


_LISTED = "select concat('@A', s_suppkey * 3) as handle, concat('seen in ', s_nationkey) as reason, s_suppkey % 5 = 0 as tombstone from {supplier}"
_ALLOWED = "select concat('a', n_nationkey * 6) as handle from {nation}"
_WATCH = """
select r_regionkey as pos, concat('t.me/user', r_regionkey * 4) as entry, 'exact' as entry_type from {region}
union all select 10 + r_regionkey as pos, concat('shop', r_regionkey * 2, '.com') as entry, 'exact' as entry_type from {region}
union all select 20 + r_regionkey as pos, concat('services.zangi.com/dl/341511000', r_regionkey) as entry, 'prefix' as entry_type from {region}"""


@query(f"""{_LINKS}, listed as ({plain(_LISTED)}), allowed as ({plain(_ALLOWED)}), watch as ({plain(_WATCH)}),
hits as (
    select handle, url, kind, case when not regexp_matches(entry, '[/?]') then case when domain = entry then 'domain' end when entry_type = 'exact' then case when url = entry then 'exact' end when starts_with(url, entry) then 'prefix' end as how,
           row_number() over (partition by handle, url order by case when (not regexp_matches(entry, '[/?]') and domain = entry) or (regexp_matches(entry, '[/?]') and (entry_type = 'exact' and url = entry or entry_type = 'prefix' and starts_with(url, entry))) then 0 else 1 end, pos) as place
    from found, watch),
hit as (select handle, count(*) as n_link_hits, min(url) as first_hit, bool_or(how = 'exact' and kind in ('telegram', 'zangi')) as exact_chat from hits where how is not null and place = 1 group by 1),
named as (select handle, k, case when display_name <> 'UNKNOWN' then display_name end as dn, bio from accounts),
ruled as (select *, {name_rule_sql('handle')} as by_handle, {name_rule_sql('dn')} as by_name, lower(handle) in (select lower(handle) from allowed) as allow from named)
select handle, allow as allowlisted, case when not allow then (select min(reason) from listed where '@' || lower(r.handle) = lower(listed.handle) and not tombstone) end as listed_reason,
       coalesce(n_link_hits, 0) as n_link_hits, first_hit, coalesce(exact_chat, false) as exact_chat,
       case when allow then null when by_handle is not null then 'HANDLE' when by_name is not null then 'DISPLAY_NAME' end as name_field, case when not allow then coalesce(by_handle, by_name) end as name_rule,
       not allow and coalesce(contains(regexp_replace(lower(bio), '[^a-z]', '', 'g'), 'kindlysendmeafollowrequest'), false) as phrase_hit
from ruled r left join hit using (handle)""")
def list_check(spark, sf_dir):
    """All records against the lists, as at decision time."""
    listed = relation(spark, sf_dir, _LISTED).where("not tombstone").select("handle", "reason")
    return known.checked(known.facts(spread(_records(spark, sf_dir))), listed, relation(spark, sf_dir, _WATCH), relation(spark, sf_dir, _ALLOWED), EXCLUSIONS)


_ANSWERS = "select o_orderkey as id, concat('A', o_custkey) as handle, case o_orderkey % 9 when 0 then 'KEEP' when 1 then 'BLOCK' end as action from {orders}"


@query(f"""with lc as ({ORACLE_SQL["list_check"]}), acc as ({plain(_ACCOUNTS)}), act as (select lower(handle) as key, arg_max(coalesce(action, '-'), id) as action from ({plain(_ANSWERS)}) group by 1),
r as (select lc.*, k % 11 = 0 as confirmed, k % 3 = 0 as lures, nullif(action, '-') as action, k % 4 = 1 as review from lc join acc using (handle) left join act on act.key = lower(handle)),
t as (select *, case when name_rule is not null then 'NAME_RULE' when phrase_hit then 'PHRASE_RULE' when n_link_hits > 0 and lures then 'WATCHLISTED_LINK_PLUS_LURE' end as shared from r),
v as (select *, case when action = 'KEEP' then null when action = 'BLOCK' then 'OWNER_BLOCK' when allowlisted then null when confirmed then 'BLOCK_CONFIRMED' when listed_reason is not null or exact_chat then 'KNOWN_SCAM_LIST' when shared is not null then 'AUTO_BLOCK_PATTERN' end as tier from t)
select handle, tier, case when tier = 'AUTO_BLOCK_PATTERN' then shared end as pattern, not (action is not null or allowlisted or tier is not null) and (review or n_link_hits > 0) as held from v""")
def auto_block_verdicts(spark, sf_dir):
    """Verdicts of all records: the lists are checked and the owner's answers joined as a decision is made."""
    from lanternfish.operators import decisions, ledger

    listed = relation(spark, sf_dir, _LISTED).where("not tombstone").select("handle", "reason")
    check = known.checked(known.facts(spread(_records(spark, sf_dir))), listed, relation(spark, sf_dir, _WATCH), relation(spark, sf_dir, _ALLOWED), EXCLUSIONS)
    none = F.array().cast("array<string>")
    states = relation(spark, sf_dir, _ACCOUNTS).select(
        "handle", F.lower("handle").alias("key"), F.when(F.col("k") % 11 == 0, "BLOCK_CONFIRMED").when(F.col("k") % 4 == 1, "REVIEW").otherwise("KEEP").alias("enforcement"), F.when(F.col("k") % 3 == 0, F.array(F.lit("S012"))).otherwise(none).alias("features"),
    )
    rows = check.join(states, "handle").join(ledger.latest_actions(relation(spark, sf_dir, _ANSWERS)), "key", "left")
    false, named = F.lit(False), F.col("name_rule").isNotNull()
    rows = rows.select(
        "handle", "enforcement", "features", none.alias("strong"), F.col("action").alias("owner_action"), F.col("allowlisted").alias("never_listed"), F.col("listed_reason").isNotNull().alias("listed"), F.col("exact_chat").alias("exact_chat_link"), false.alias("owner_scoped"),
        F.lit("SUFFICIENT").alias("evidence_state"), *[false.alias(n) for n in ("substantial", "honest_label", "refuted", "basis")], named.alias("name_hit"), F.col("phrase_hit"), (F.col("n_link_hits") > 0).alias("link_hit"), F.lit(None).cast("double").alias("model_score"), F.lit(0.5).alias("threshold"),
    )
    return decisions.tiers(rows).select("handle", "tier", "pattern", "held")


#: Rows of a list ingest: customers' handles in pairs, with biographies that hold links.
_INGEST = """
select c_custkey as seq, case when c_custkey % 17 = 0 then 'not a handle' else concat('A', c_custkey - c_custkey % 2) end as handle, c_name as display_name,
       case c_custkey % 5 when 0 then concat('https://shop', c_custkey % 40, '.com/x?ref=1') when 1 then concat('t.me/group', c_custkey % 25) when 2 then 'bit.ly' when 3 then concat('go to news', c_custkey % 3, '.never.com/a') else 't.me/abc…' end as bio
from {customer}"""
_INGESTED = f"""
with rows_ as ({plain(_INGEST)}), listed as ({plain(_LISTED)}), allowed as ({plain(_ALLOWED)}), watch as ({plain(_WATCH)}),
keyed as (select *, lower(handle) as key, not regexp_matches(lower(handle), '^[a-z0-9_]{{1,15}}$') as invalid, lower(handle) in (select lower(handle) from allowed) as allow from rows_),
accounts as (
    select *, case when invalid then 'INVALID' when allow then 'ALLOWLISTED' when '@' || key in (select lower(handle) from listed where tombstone) then 'REMOVED_BEFORE' when '@' || key in (select lower(handle) from listed) then 'LISTED'
        when row_number() over (partition by key order by seq) > 1 then 'DUPLICATE' else 'ADDED' end as result from keyed),
found as (
    select seq, key, case seq % 5 when 0 then 'shop' || seq % 40 || '.com/x' when 1 then 't.me/group' || seq % 25 when 2 then 'bit.ly' when 3 then 'news' || seq % 3 || '.never.com/a' else 't.me/abc' end as url,
           case when seq % 5 = 4 then 'prefix' else 'exact' end as match_type, seq % 5 in (2, 3, 4) as skipped from accounts where not invalid and not allow),
link_rows as (select *, case when skipped then 'SKIPPED' when exists (select 1 from watch where entry = url and entry_type = match_type) then 'ALREADY_PRESENT' when row_number() over (partition by url, match_type, skipped order by seq) = 1 then 'ADDED' else 'ALREADY_PRESENT' end as result from found)
"""


def _ingested(spark, sf_dir):
    rows = relation(spark, sf_dir, _INGEST).withColumn("links", F.lit(None).cast("array<string>"))
    allowed = relation(spark, sf_dir, _ALLOWED)
    accounts = lists.ingested(relation(spark, sf_dir, _LISTED), rows, allowed)
    return accounts, known.link_results(known.candidates(rows, allowed), relation(spark, sf_dir, _WATCH), never=("never.com",))


@query(_INGESTED + "select seq, key, url, match_type, result from link_rows")
def list_ingest_links(spark, sf_dir):
    return _ingested(spark, sf_dir)[1].select("seq", "key", "url", "match_type", "result")


@query(_INGESTED + """select count(*) filter (result = 'ADDED') as accounts_added, count(*) filter (result in ('LISTED', 'DUPLICATE')) as already_present, count(*) filter (result = 'ALLOWLISTED') as skipped_allowlist,
    count(*) filter (result = 'REMOVED_BEFORE') as skipped_removed_earlier, count(*) filter (result = 'INVALID') as skipped_invalid, (select count(*) from link_rows where result = 'ADDED') as links_added,
    (select count(*) from link_rows where result = 'ALREADY_PRESENT') as links_already_present, (select count(*) from link_rows where result = 'SKIPPED') as links_skipped from accounts""")
def list_ingest_counts(spark, sf_dir):
    return known.counters(*_ingested(spark, sf_dir))


@query(f"""with l as ({plain(_LISTED)}), r as (select 'a' || n_nationkey * 9 as handle, 'asked by ' || n_name as reason from nation)
select l.handle, tombstone or r.handle is not null as tombstone, case when not tombstone and r.handle is not null then '2024-06-15' end as removed, case when not tombstone then r.reason end as removed_reason
from l left join r on '@' || r.handle = lower(l.handle)""")
def list_removal(spark, sf_dir):
    """Nations ask for the removal of listed accounts."""
    rows = relation(spark, sf_dir, _LISTED).select("handle", "tombstone", F.lit(None).cast("string").alias("removed"), F.lit(None).cast("string").alias("removed_reason"))
    asked = relation(spark, sf_dir, "select concat('a', n_nationkey * 9) as handle, concat('asked by ', n_name) as reason from {nation}")
    return known.removed(rows, asked, F.lit("2024-06-15"))
