"""Queries over interactions, windows, plans, reports, metrics and the relational base."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanternfish.operators import interactions as it
from lanternfish.operators import jobs, metrics
from lanternfish.plans.common import registry
from lanternfish.plans.projections import INTERACTIONS_SQL, interactions
from lanternfish.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()
_I = f"with i as ({INTERACTIONS_SQL}) "
_ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)


def _doubled(spark, sf_dir):
    """Interactions, the third of which arrive twice."""
    rows = interactions(spark, sf_dir)
    return rows.unionByName(rows.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 10_000_000))


@query(_I + "select seq, handle, kind, post, ts from i")
def interactions_dedup(spark, sf_dir):
    return it.first_seen(_doubled(spark, sf_dir)).select("seq", "handle", "kind", "post", _ntz("ts"))


@query(_I + "select count(*) filter (late) as n_late, count(*) as n, kind from (select kind, ts <= case when kind = 'NEW_FOLLOW' then timestamp '2024-01-10' else timestamp '2024-01-15 12:00:00' end as late from i) group by kind")
def late_rows(spark, sf_dir):
    marks = spark.sql("select 'FOLLOW' as source, timestamp '2024-01-10' as mark union all select 'NOTIF', timestamp '2024-01-15 12:00:00'")
    return it.split_late(interactions(spark, sf_dir), marks).groupBy("kind").agg(F.count_if("late").alias("n_late"), F.count("*").alias("n"))


@query(_I + ", f as (select 'FOLLOW' as source, max(ts) as mark from i where kind = 'NEW_FOLLOW' union all select 'NOTIF', max(ts) from i where kind <> 'NEW_FOLLOW') select * from f")
def scan_markers(spark, sf_dir):
    marks = spark.sql("select 'FOLLOW' as source, timestamp '2024-01-10' as mark union all select 'NOTIF', timestamp '2024-01-15 12:00:00'")
    return it.advanced(interactions(spark, sf_dir), marks).select("source", _ntz("mark"))


@query(_I + "select handle, count(*) as n, count(distinct kind) as diversity, count(distinct post) as n_posts, min(ts) as first_ts, max(ts) as last_ts, count(*) filter (kind = 'NEW_FOLLOW') as n_new_follow, count(*) filter (kind = 'REPLY') as n_reply from i group by 1")
def interaction_history(spark, sf_dir):
    rows = it.history(it.first_seen(_doubled(spark, sf_dir)))
    return rows.select("handle", "n", "diversity", "n_posts", _ntz("first_ts"), _ntz("last_ts"), "n_new_follow", "n_reply")


@query(_I + """, t as (select distinct handle, ts from i), l as (select *, row_number() over (partition by handle order by ts desc) as place from t),
w as (select handle, count(*) over (partition by handle order by ts range between current row and interval 24 hours following) as n from l where place <= 200)
select handle, max(n) as burst from w group by 1""")
def burst_24h(spark, sf_dir):
    return it.bursts(interactions(spark, sf_dir))


_PRIORITY = _I + """, r as (
    select *, len(list_distinct(list(kind) over w)) as diversity, len(list_distinct(list(post) filter (post is not null) over w)) as n_posts, count(*) filter (kind = 'NEW_FOLLOW') over w as follows,
           count(*) filter (kind = 'REPLY') over w as replies, count(*) filter (kind in ('LIKE', 'REPOST')) over w as likes
    from i window w as (partition by handle order by seq rows between unbounded preceding and current row)),
p as (select *, case when kind = 'QUOTE_POST' or (follows > 0 and diversity >= 2) or (diversity >= 2 and n_posts >= 3) or solicits then 'HIGH' when follows > 0 or replies > 0 or likes >= 2 then 'NORMAL' else 'LOW' end as priority,
    case when kind = 'NEW_FOLLOW' or (kind = 'REPLY' and solicits) then 'FULL_AUDIT' else 'LIGHT_CHECK' end as level from r)
"""


@query(_PRIORITY + "select seq, handle, priority, level from p")
def interaction_priority(spark, sf_dir):
    rows = it.priority(it.running(interactions(spark, sf_dir)))
    return rows.select("seq", "handle", "priority", it.level(F.col("kind"), F.col("solicits"), F.lit(False)).alias("level"))


@query(_PRIORITY + "select handle, case when max(level = 'FULL_AUDIT') then 'FULL_AUDIT' else 'LIGHT_CHECK' end as level, case max(case priority when 'HIGH' then 3 when 'NORMAL' then 2 else 1 end) when 3 then 'HIGH' when 2 then 'NORMAL' else 'LOW' end as priority, arg_min(kind, seq) as source_kind, count(*) as n_interactions from p group by 1")
def audit_queue(spark, sf_dir):
    rows = it.priority(it.running(interactions(spark, sf_dir))).withColumn("level", it.level(F.col("kind"), F.col("solicits"), F.lit(False)))
    return it.queue(rows).select("handle", "level", "priority", "source_kind", "n_interactions")


@query(_PRIORITY + """, q as (select handle, max(case priority when 'HIGH' then 3 when 'NORMAL' then 2 else 1 end) as r, min(seq) as opened, count(*) as n_interactions from p group by 1)
select row_number() over (order by r desc, opened, handle) as place, handle, opened, n_interactions from q order by r desc, opened, handle limit 50""")
def audit_queue_next(spark, sf_dir):
    """The 50 entries to work on next."""
    rows = it.priority(it.running(interactions(spark, sf_dir))).withColumn("level", it.level(F.col("kind"), F.col("solicits"), F.lit(False)))
    first = it.ordered_queue(it.queue(rows)).limit(50)
    rank = F.expr("case priority when 'HIGH' then 3 when 'NORMAL' then 2 else 1 end")
    place = F.row_number().over(Window.orderBy(rank.desc(), "opened", "handle")).cast("long")
    return first.select(place.alias("place"), "handle", "opened", "n_interactions")


@query(_I + """select seq, array_to_string(list_filter([case when abs(epoch_us(ts) - epoch_us(timestamp '2023-12-10')) / 86400e6 > 30 and seq % 2 = 0 then 'audit stale' end, case when seq % 11 = 0 then 'profile change (bio)' end,
    case when solicits then 'suspicious solicitation begins' end, case when seq % 13 = 0 then 'joined a newly detected network' end, case when seq % 101 = 0 then 'owner asked' end], lambda x: x is not null), '|') as triggers from i""")
def recheck_triggers(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = interactions(spark, sf_dir).withColumns(
        {
            "last_full_audit": F.when(F.col("seq") % 2 == 0, F.lit("2023-12-10").cast("timestamp")), "seen_name": none, "known_name": none, "seen_bio": F.when(F.col("seq") % 11 == 0, "new").otherwise("old"),
            "known_bio": F.lit("old"), "network_match": F.col("seq") % 13 == 0, "new_behavior": F.lit(False), "owner_request": F.col("seq") % 101 == 0,
        }
    )
    return it.triggers(rows).select("seq", F.array_join("triggers", "|").alias("triggers"))


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_tumbling(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("select start, count(*) as n from (select unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) as start from events) group by 1")
def events_sliding(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""select user_id, min(ts) as start, count(*) as n from (select *, sum(gap) over (partition by user_id order by ts, event_id) as s from (
    select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 2 hours then 0 else 1 end as gap from events)) group by user_id, s""")
def events_session(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


@query("select o_custkey as custkey, arg_max(o_orderstatus, o_orderkey) as status, max(o_orderkey) as id from orders group by 1")
def latest_adjudication(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return jobs.latest(rows, "custkey", "id").select("custkey", "status", "id")


@query("""with o as (select 'c' || o_custkey as handle, arg_max(o_orderdate, o_orderkey) as ts, arg_max(o_orderkey % 2 = 0, o_orderkey) as verified from orders group by 1)
select 'c' || c_custkey as handle, case when coalesce(ts >= timestamp '1995-06-01', false) then case when verified then 'VERIFIED' else 'FAILED_RETRY' end else 'PLANNED' end as status from customer left join o on handle = 'c' || c_custkey""")
def asof_status(spark, sf_dir):
    made = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("handle"), F.lit("1995-06-01").cast("timestamp_ntz").alias("decided_at"))
    out = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("handle"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") % 2 == 0).alias("verified"))
    return jobs.status_as_of(made, out).select("handle", "status")


@query("""with c as (select 'C' || c_custkey as handle, ['OWNER_BLOCK', 'BLOCK_CONFIRMED', 'KNOWN_SCAM_LIST', 'AUTO_BLOCK_PATTERN', 'OWNER_TRAINED'][c_custkey % 5 + 1] as tier, c_custkey % 5 as rank from customer where c_custkey % 3 > 0)
select handle, tier from c order by rank, lower(handle) limit 20""")
def plan_topn(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    tier = F.element_at(F.array(*map(F.lit, jobs.TIER_ORDER)), (F.col("c_custkey") % 5 + 1).cast("int"))
    done = c.where("c_custkey % 3 = 0").select(F.concat(F.lit(" @c"), "c_custkey").alias("handle"))
    return jobs.plan(c.select(F.concat(F.lit("C"), "c_custkey").alias("handle"), tier.alias("tier")), [done])


@query("""select case when c_custkey % 7 = 0 then 'KEPT' when c_custkey % 5 = 0 then 'VERIFIED' when c_custkey % 11 = 0 then 'GONE' when c_custkey % 5 >= 3 then 'GAVE_UP' else 'PENDING' end as state, count(*) as n from customer group by 1""")
def list_classification(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey % 7 = 0 as kept", "c_custkey % 5 = 0 as verified", "c_custkey % 11 = 0 as gone", "c_custkey % 5 as attempts")
    return jobs.classified(rows).groupBy("state").agg(F.count("*").alias("n"))


@query("""select event_id, user_id from (select *, coalesce(max(event_type = 'error') over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), false) as stopped from events) where not stopped""")
def report_cutoff(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("stop_reason", F.when(F.col("event_type") == "error", "STOP"))
    return jobs.until_stop(rows, "event_id", "user_id").select("event_id", "user_id")


@query("select event_id, in_day, in_day < 5 as may_continue from (select event_id, count(*) over (partition by user_id order by ts range between interval 24 hours preceding and current row) as in_day from events)")
def batch_pacing(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.pacing(rows).select("event_id", "in_day", "may_continue")


@query("select 'u' || user_id as handle, count(*) as attempts, arg_max(event_type, event_id) as status, max(value > 100) as no_retry from events group by 1")
def report_history(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("handle"), F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.lit("SPAM").alias("option"), "ts", (F.col("value") > 100).alias("no_retry"))
    return jobs.report_history(rows).select("handle", "attempts", "status", "no_retry")


@query("select l_linestatus as line_status, count(*) filter (ok) as n_verified, count(*) as n from (select l_linestatus, l_orderkey % 7 > 0 and l_partkey % 5 > 0 and (l_linenumber % 2 = 0 or l_suppkey % 3 = 0) and l_suppkey % 11 > 0 and l_orderkey % 3 > 0 and l_partkey % 2 = 0 as ok from lineitem) group by 1")
def enforcement_ingest(spark, sf_dir):
    tests = {"handle_reverified": "l_orderkey % 7 > 0", "decision_confirmed": "l_partkey % 5 > 0", "block_clicked": "l_linenumber % 2 = 0", "already_blocked": "l_suppkey % 3 = 0", "reloaded": "l_suppkey % 11 > 0", "shows_blocked": "l_orderkey % 3 > 0", "planned": "l_partkey % 2 = 0"}
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", *[F.expr(e).alias(n) for n, e in tests.items()])
    return rows.groupBy(F.col("l_linestatus").alias("line_status")).agg(F.count_if(jobs.verified()).alias("n_verified"), F.count("*").alias("n"))


_WILSON = "(({k})::double / ({n}) + 3.8416 / (2 * ({n})) {s} 1.96 * sqrt((({k})::double / ({n}) * (1 - ({k})::double / ({n})) + 3.8416 / (4 * ({n}))) / ({n}))) / (1 + 3.8416 / ({n}))"


@query(f"""with r as (select source, n_chars < 1500 as flagged, toxic = 1 as bad from documents join labels using (doc_id)),
c as (select source, count(*) filter (flagged and bad) as tp, count(*) filter (flagged and not bad) as fp, count(*) filter (not flagged and bad) as fn, count(*) filter (not flagged and not bad) as tn from r group by 1)
select source, tp, fp, fn, tn, round(case when tp + fp > 0 then tp / (tp + fp) end, 4) as precision, round(case when tp + fn > 0 then tp / (tp + fn) end, 4) as recall, round(case when fp + tn > 0 then fp / (fp + tn) end, 4) as fpr, round(case when fn + tp > 0 then fn / (fn + tp) end, 4) as fnr,
       case when tp + fp > 0 then round_even(greatest(0.0::double, {_WILSON.format(k="tp", n="tp + fp", s="-")}), 4) end as precision_low, case when tp + fp > 0 then round_even(least(1.0::double, {_WILSON.format(k="tp", n="tp + fp", s="+")}), 4) end as precision_high from c""")
def confusion_by_source(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.select("doc_id", "source", "n_chars").join(labels, "doc_id").select("source", (F.col("n_chars") < 1500).alias("flagged"), (F.col("toxic") == 1).alias("bad"))
    return metrics.family(rows, "source")


@query("select * from (values (0.98, 0, 188), (0.98, 1, 279), (0.98, 2, 360), (0.95, 0, 73), (0.9, 0, 35)) t(target, errors, n_needed)")
def labels_needed(spark, sf_dir):
    rows = [(t, e, metrics.labels_needed(t, e)) for t, e in ((0.98, 0), (0.98, 1), (0.98, 2), (0.95, 0), (0.9, 0))]
    return spark.createDataFrame(rows, "target double, errors int, n_needed int")


@query("select l_returnflag, l_linestatus, list_sort(list(l_quantity))[count(*) // 2 + 1] as upper_median, min(l_quantity) as least, max(l_quantity) as most, count(*) as n from lineitem group by 1, 2")
def upper_median(spark, sf_dir):
    return metrics.upper_medians(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_quantity), 4) as avg_qty, count(*) as n
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def tpch_q1(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
    join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey group by 1""")
def tpch_q5(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_discount between 0.02 and 0.09 and l_quantity < 24")
def tpch_q6(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_discount between 0.02D and 0.09D and l_quantity < 24")
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))
