"""The relations of the domain as projections of the driver's tables, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.sources import tables
from lanternfish.sources.tables import table

#: Every id an instance may have: all features, the forbidden ones and one that nobody knows.
IDS = (*[f.feature_id for f in config.FEATURES], *config.FORBIDDEN_PROXIES, "X999")


def instances(spark, sf_dir) -> DataFrame:
    """Feature instances from order lines: an order is an account, a line is an instance."""
    line = table(spark, sf_dir, "lineitem")
    ids = F.array(*map(F.lit, IDS))
    n = F.col("l_quantity").cast("int") % 13
    return line.select(
        F.concat(F.lit("o"), F.col("l_orderkey")).alias("handle"),
        (F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")).alias("pos"),
        F.element_at(ids, ((F.col("l_partkey") + 7 * F.col("l_linenumber")) % len(IDS) + 1).cast("int")).alias("feature_id"),
        F.when(n > 0, n).cast("long").alias("n"),
        F.when(n == 0, F.col("l_linenumber")).cast("long").alias("n_min"),
        F.when(F.col("l_partkey") % 17 == 0, F.concat(F.lit("K"), F.col("l_suppkey") % 3)).alias("fact_key"),
    )


INSTANCES_SQL = f"""
select 'o' || l_orderkey as handle, l_linenumber::bigint * 1000000 + l_partkey as pos,
       [{", ".join(f"'{i}'" for i in IDS)}][(l_partkey + 7 * l_linenumber) % {len(IDS)} + 1] as feature_id,
       case when floor(l_quantity)::int % 13 > 0 then floor(l_quantity)::int % 13 end::bigint as n,
       case when floor(l_quantity)::int % 13 = 0 then l_linenumber end::bigint as n_min,
       case when l_partkey % 17 = 0 then 'K' || (l_suppkey % 3) end as fact_key
from lineitem"""


def records(spark, sf_dir) -> DataFrame:
    """Account records from customers, with the number of their orders for followers."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    c = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.selectExpr(*[f"{e} as {n}" for n, e in _RECORD.items()])


_K = "c_custkey"
_RECORD = {
    "handle": f"concat('c', {_K})",
    "date_collected": "'2024-06-15'",
    "joined": f"case when {_K} % 5 = 0 then null else concat(2015 + {_K} % 10, '-', lpad(cast({_K} % 12 + 1 as string), 2, '0')) end",
    "followers": "coalesce(n_orders, 0)",
    "following": f"{_K} * 37 % 900",
    "post_count": f"case when {_K} % 11 = 0 then null else {_K} * 7 % 41 end",
    "username_changes": f"case when {_K} % 4 = 0 then null else {_K} % 5 end",
    "last_change": f"case when {_K} % 3 = 0 then concat('2024-0', {_K} % 6 + 1) end",
    "n_posts": f"case when {_K} % 6 = 0 then null else {_K} % 7 end",
    "n_replies": f"case when {_K} % 7 = 0 then null else {_K} * 3 % 60 end",
    "generic_reply_ratio": f"cast({_K} % 100 as double) / 100",
    "n_items": f"{_K} % 70",
    "original_content_ratio": f"cast({_K} * 3 % 100 as double) / 100",
    "reply_ratio": f"cast({_K} % 64 as double) / 64",
    "repost_ratio": f"cast({_K} % 32 as double) / 64",
    "activity_hours": f"cast({_K} % 25 as double)",
    "near_duplicates": f"case when {_K} % 9 = 0 then null else {_K} % 15 end",
    "location_consistency": f"case {_K} % 3 when 0 then 'CONSISTENT' when 1 then 'MISMATCH' else 'UNKNOWN' end",
    "display_name": f"case {_K} % 8 when 0 then null when 1 then 'Tesla Official' when 2 then '' else c_name end",
    "bio": f"case {_K} % 6 when 0 then null when 1 then '' when 2 then 'CEO of rockets' else c_mktsegment end",
    "country": f"case when {_K} % 5 < 3 then cast(c_nationkey as string) end",
    "collection_status": f"case when {_K} % 50 = 0 then 'SUSPENDED' else 'OK' end",
    "quality": f"case {_K} % 4 when 0 then 'NONE' when 1 then 'LOW' when 2 then 'MEDIUM' else 'HIGH' end",
    "reply_summary": f"case when {_K} % 10 = 0 then 'Has not replied yet' else '' end",
    "post_summary": f"case when {_K} % 13 = 0 then 'No posts' else '' end",
    "older_sampled": f"{_K} % 3 = 0",
    "any_link_known": f"{_K} % 2 = 0",
    "website_known": f"{_K} % 4 < 2",
    "human_score": f"{_K} * 5 % 70",
    "has_h003": f"{_K} % 23 = 0",
    "has_other_human": f"{_K} % 3 = 1",
    "has_d007": f"{_K} % 4 = 1",
    "max_year_gap": f"{_K} % 4",
    "solicits": f"{_K} % 5 = 2",
    "malicious_strong": f"{_K} % 7 = 3",
}
RECORDS_SQL = (
    "select " + ", ".join(f"{e.replace('cast(' + _K + ' % 12 + 1 as string)', '(' + _K + ' % 12 + 1)::varchar').replace('as string', 'as varchar')} as {n}" for n, e in _RECORD.items())
    + " from customer left join (select o_custkey, count(*) as n_orders from orders group by 1) on c_custkey = o_custkey"
)


def interactions(spark, sf_dir, stream: bool = False) -> DataFrame:
    """Interactions from events, in the order of event_id; as a stream, the table's files are its source."""
    kind = F.create_map(*[F.lit(x) for x in ("signup", "NEW_FOLLOW", "click", "REPLY", "view", "LIKE", "purchase", "QUOTE_POST")])
    e = (tables.stream if stream else table)(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.col("user_id")).alias("handle"),
        F.coalesce(F.get(F.array(F.try_element_at(kind, F.col("event_type"))), F.lit(0)), F.lit("OTHER")).alias("kind"),
        F.get_json_object("props", "$.k").alias("post"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 97 == 0).alias("solicits"),
    )


INTERACTIONS_SQL = """
select event_id as seq, 'u' || user_id as handle,
       case event_type when 'signup' then 'NEW_FOLLOW' when 'click' then 'REPLY' when 'view' then 'LIKE' when 'purchase' then 'QUOTE_POST' else 'OTHER' end as kind,
       json_extract_string(props, '$.k') as post, ts, event_id % 97 = 0 as solicits
from events"""
