"""Queries over stored layouts, instants, owners' names and light checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.functions.instants import instant
from lanternfish.operators import interactions as it
from lanternfish.plans.common import registry, relation
from lanternfish.sources import layouts
from lanternfish.sources.shared import shared_path
from lanternfish.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()


@query("""with t as (select event_id, strftime(ts, '%Y-%m-%d') as d, strftime(ts, '%H:%M:%S.%f') as c from events),
x as (select event_id, case event_id % 7 when 0 then d when 1 then d || 'T' || c || 'Z' when 2 then d || ' ' || c || '+02:00' when 3 then d || 'T' || c || '-0330' when 4 then d || 'T' || left(c, 5) when 5 then left(d, 7) else d || 'T' || c || '+05' end as t from t)
select event_id, case event_id % 7 when 0 then epoch_us(t::timestamp) when 4 then epoch_us(t::timestamp) when 5 then null when 3 then epoch_us((left(t, length(t) - 5) || '-03:30')::timestamptz) else epoch_us(t::timestamptz) end as at_us from x""")
def iso_instants(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("d"), F.date_format("ts", "HH:mm:ss.SSSSSS").alias("c"))
    k, day, clock = F.col("event_id") % 7, F.col("d"), F.col("c")
    text = (
        F.when(k == 0, day).when(k == 1, F.concat(day, F.lit("T"), clock, F.lit("Z"))).when(k == 2, F.concat(day, F.lit(" "), clock, F.lit("+02:00"))).when(k == 3, F.concat(day, F.lit("T"), clock, F.lit("-0330")))
        .when(k == 4, F.concat(day, F.lit("T"), F.substring(clock, 1, 5))).when(k == 5, F.substring(day, 1, 7)).otherwise(F.concat(day, F.lit("T"), clock, F.lit("+05")))
    )
    return e.select("event_id", F.unix_micros(instant(text)).alias("at_us"))


_NAMES = "select c_custkey as custkey, case c_custkey % 5 when 0 then concat(' @', c_name, '! ') when 1 then concat('_template', c_mktsegment) when 2 then '@-. ' when 3 then cast(null as string) else c_mktsegment end as account from {customer}"


@query("""with n as (select c_custkey as custkey, case c_custkey % 5 when 0 then ' @' || c_name || '! ' when 1 then '_template' || c_mktsegment when 2 then '@-. ' when 3 then null else c_mktsegment end as account from customer),
s as (select custkey, regexp_replace(lower(ltrim(trim(coalesce(account, '')), '@')), '[^a-z0-9_]', '', 'g') as s from n)
select custkey, case when s = '' then 'owner' when starts_with(s, '_template') then 'x' || s else s end as slug from s""")
def owner_slugs(spark, sf_dir):
    return relation(spark, sf_dir, _NAMES).select("custkey", layouts.slug(F.col("account")).alias("slug"))


@query("""select c_custkey as custkey, case when c_custkey % 50 = 7 then -1.0 else c_acctbal::double end as balance from customer
union all select -c_custkey, c_acctbal::double from customer where c_custkey % 90 = 1""")
def upserted_accounts(spark, sf_dir):
    """Customers in buckets by key, after changed and new rows were put in twice."""
    path = shared_path(spark, "accounts")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").cast("double").alias("balance"))
    layouts.upsert(path, rows, "custkey")
    changed = rows.where("custkey % 50 = 7").withColumn("balance", F.lit(-1.0))
    new = changed.unionByName(rows.where("custkey % 90 = 1").withColumn("custkey", -F.col("custkey")))
    layouts.upsert(path, new, "custkey")
    layouts.upsert(path, new, "custkey")
    return spark.read.parquet(path).select("custkey", "balance")


@query("select c_custkey as custkey, c_nationkey as nation from customer where c_nationkey % 3 = 1")
def instance_rows(spark, sf_dir):
    """What one of three owners reads of the tables that all of them write; its plan may scan no other's files."""
    folder = shared_path(spark, "instances")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nation"))
    owners = [layouts.Instances(spark, folder, f"@Owner {n}") for n in range(3)]
    for n, owner in enumerate(owners):
        owner.write("customers", rows.where(F.col("nation") % 3 == n))
    return owners[1].checked(owners[1].read("customers").select("custkey", "nation"))


@query(f"""with h as (select sha256('{{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '"}}') as s, count(*) as n from orders group by 1),
b as (select case when sum(n) // {layouts.LEAF} = 0 then 0 else floor(log2(sum(n) // {layouts.LEAF}))::int + 1 end as bits from h)
select (('0x' || substr(s, 1, 12))::bigint >> (48 - bits)) as block, sum(n)::bigint as n, sha256(string_agg(s || ':' || n, ',' order by s)) as digest from h, b group by 1""")
def frozen_leaves(spark, sf_dir):
    """The blocks of a frozen set, as they are found again."""
    path = shared_path(spark, "frozen")
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").cast("long").alias("o_custkey"))
    manifest = layouts.freeze(rows, path, "orders")
    _, kept = layouts.load_frozen(spark, path)
    return layouts.leaves(kept, manifest["bits"])


_FLAGS = ("in_network", "policy_match", "repurposed", "listed", "link_hit", "phrase_hit", "name_hit", "owner_blocked")
_CHECK = {
    "strong": "case when k % 9 = 0 then array('A001') else array() end", "features": "case when k % 7 = 0 then array('S005', 'W001') when k % 7 = 1 then array('W001') else array() end", "top_score": "k * 11 % 80",
    **{f: f"k % {n} = 0" for f, n in zip(_FLAGS, (31, 37, 41, 43, 47, 53, 59, 61))},
}


@query(f"""with r as (select c_custkey as k, c_custkey % 9 = 0 as strong, c_custkey % 7 = 0 as marked, c_custkey * 11 % 80 >= {config.REVIEW_SCORE} as high, {", ".join(f"c_custkey % {n} = 0 as {f}" for f, n in zip(_FLAGS, (31, 37, 41, 43, 47, 53, 59, 61)))} from customer),
l as (select k, list_filter([case when strong then 'strong feature' end, case when marked then 'impersonation/scam/solicitation feature' end, case when high then 'malicious score in review band' end, {", ".join(f"case when {f} then '{f.replace('_', ' ')}' end" for f in _FLAGS)}], lambda x: x is not null) as reasons from r)
select k, array_to_string(reasons, '|') as reasons, case when len(reasons) > 0 then 'ESCALATE' else 'LOW_RISK' end as result from l""")
def light_checks(spark, sf_dir):
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    rows = k.select("k", *[F.expr(e).cast("array<string>").alias(n) if "array" in e else F.expr(e).alias(n) for n, e in _CHECK.items()])
    return it.light_check(rows).select("k", F.array_join("reasons", "|").alias("reasons"), "result")
