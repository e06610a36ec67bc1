"""Queries over links, names, lists and the owner-trained model."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.functions import links
from lanternfish.operators import model
from lanternfish.plans.common import registry, relation
from lanternfish.plans.projections import INSTANCES_SQL, instances
from lanternfish.sources import lists
from lanternfish.sources.tables import table

QUERIES, ORACLE_SQL, query = registry()

#: Most orders that stand for an owner's answers when a model is fitted.
TRAINING_ROWS = 120


@query("select page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as n_links, list_sort(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))[1] as first_link from pages")
def link_extract(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.array_min(found).alias("first_link"))


@query(r"""
with p as (select page_id, lower(regexp_extract(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '#.*$', ''), '^([^/?]*)', 1)) as h, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '#.*$', '') as u from pages),
q as (select *, trim(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', ''), '/') as path, list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|ref|ref_src|s|t|si)='))) as q from p),
r as (select *, regexp_replace(h, '^www\.', '') as host from q)
select page_id, host || case when path <> '' then '/' || path else '' end || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as url, host as domain, 'other' as kind from r""")
def link_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", links.normalized(F.col("url")).alias("x"))
    return rows.select("page_id", "x.url", "x.domain", "x.kind")


def _watchlist(pages):
    """The pages whose number a multiple of 7 is, in turn as whole links, beginnings and domains."""
    turn = F.col("page_id") % 3
    kind = F.when(turn == 1, "prefix").otherwise("exact")
    entry = F.when(turn == 0, F.col("url")).when(turn == 1, F.regexp_replace("url", r"[?].*$", "")).otherwise(F.col("domain"))
    return pages.where("page_id % 7 = 0").select(F.col("page_id").alias("pos"), entry.alias("entry"), kind.alias("entry_type"))


@query(ORACLE_SQL["link_normalize"].replace("select page_id, host ||", ", n as (select page_id, host ||").rstrip() + r"""),
w as (select page_id as pos, case page_id % 3 when 0 then url when 1 then regexp_replace(url, '[?].*$', '') else domain end as entry, case when page_id % 3 = 1 then 'prefix' else 'exact' end as entry_type from n where page_id % 7 = 0),
m as (select page_id, url, pos, case when not regexp_matches(entry, '[/?]') then case when domain = entry then 'domain' end when entry_type = 'exact' then case when url = entry then 'exact' end when starts_with(url, entry) then 'prefix' end as how from n, w)
select page_id, pos, how from (select *, row_number() over (partition by page_id order by pos) as place from m where how is not null) where place = 1""")
def link_watch_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", links.normalized(F.col("url")).alias("x")).select("page_id", "x.*")
    found = links.watch_matches(pages.withColumnRenamed("page_id", "id"), _watchlist(pages))
    return found.select(F.col("id").alias("page_id"), "pos", "how")


@query("""with n as (select c_custkey as seq, 'C' || (c_custkey // 2) as handle, lower('C' || (c_custkey // 2)) as key from customer)
select seq, handle, case when key in (select lower('c' || s_suppkey) from supplier where s_suppkey % 5 = 0) then 'ALLOWLISTED' when (seq // 2) between 1 and 100 and (seq // 2) % 3 = 0 then 'REMOVED_BEFORE' when (seq // 2) between 1 and 100 then 'LISTED'
    when row_number() over (partition by key order by seq) > 1 then 'DUPLICATE' else 'ADDED' end as result from n""")
def list_ingest(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("C"), F.floor(F.col("c_custkey") / 2)).alias("handle"))
    old = spark.range(1, 101).select(F.concat(F.lit("@c"), "id").alias("handle"), (F.col("id") % 3 == 0).alias("tombstone"))
    allowed = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.concat(F.lit("c"), "s_suppkey").alias("handle"))
    return lists.ingested(old, new, allowed).select("seq", "handle", "result")


def _training(spark, sf_dir, rows: int = TRAINING_ROWS):
    """TRAINING_ROWS orders, by a hash of the key, as an owner's answers: the features are the lines' ids, the label the order's parity."""
    first = table(spark, sf_dir, "orders").orderBy(F.xxhash64("o_orderkey"), "o_orderkey").limit(rows).select(F.concat(F.lit("o"), "o_orderkey").alias("handle"), (F.col("o_orderkey") % 3 > 0).cast("int").alias("label"))
    found = instances(spark, sf_dir).join(F.broadcast(first.select("handle")), "handle").groupBy("handle").agg(F.array_sort(F.collect_set("feature_id")).alias("features"))
    return first.join(found, "handle", "left").select("handle", "label", F.coalesce("features", F.expr("array()").cast("array<string>")).alias("features"))


#: Weights of a model that is given, by the place of a feature in the registry.
_GIVEN = {f.feature_id: (i % 9 - 4) / 8 for i, f in enumerate(config.FEATURES)}
_GIVEN_SQL = ", ".join(f"('{f}', {w}::double)" for f, w in _GIVEN.items())


@query(f"""with i as (select distinct handle, feature_id from ({INSTANCES_SQL})), w as (select * from (values {_GIVEN_SQL}) t(feature_id, w))
select handle, round(1 / (1 + exp(-greatest(-30.0, least(30.0, -0.5 + coalesce(sum(w), 0))))), 6) as score from i left join w using (feature_id) group by 1""")
def model_scores(spark, sf_dir):
    """Scores of all orders by a given model."""
    found = instances(spark, sf_dir).groupBy("handle").agg(F.array_sort(F.collect_set("feature_id")).alias("features"))
    return found.select("handle", F.round(model.scored(F.col("features"), _GIVEN, -0.5), 6).alias("score"))


#: Scores of two owners: of the first they lie close, of the second a tenth apart.
_SCORED = {"close": "o_orderkey * 7919 % 1000 / 1024.0", "apart": "o_orderkey % 10 / 10.0"}
_THRESHOLD = "with s as (select {e}::double as score, {e} > 0.6 as block, o_orderkey % 97 = 0 as protected from orders), t as (select max(score) as top from s where not block or protected), n as (select top, (select min(score) from s, t where block and score > top) as next from t) select '{o}' as owner, round_even(case when coalesce(next - top > 0.04, false) then (top + next) / 2 else least(0.999, top + 0.02) end, 4) as threshold from n"


@query(" union all ".join(f"select * from ({_THRESHOLD.format(e=e, o=o)})" for o, e in _SCORED.items()))
def model_thresholds(spark, sf_dir):
    """The thresholds of two owners' scores, whose greatest negative or protected ones stand near to and far from the next block."""
    out = None
    for owner, e in _SCORED.items():
        s = relation(spark, sf_dir, f"select cast({e} as double) as score, cast({e} > 0.6 as int) as label, o_orderkey % 97 = 0 as protected from {{orders}}")
        one = model.threshold(s).select(F.lit(owner).alias("owner"), "threshold")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def model_gd_scores(spark, sf_dir):
    """Scores of all orders by a model of an owner's answers; tests hold the training against a plain loop."""
    rows = _training(spark, sf_dir).orderBy("handle").collect()
    weights, bias = model.fit([r["features"] for r in rows], [r["label"] for r in rows], sorted({f for r in rows for f in r["features"]}))
    found = instances(spark, sf_dir).groupBy("handle").agg(F.array_sort(F.collect_set("feature_id")).alias("features"))
    return found.select("handle", F.round(model.scored(F.col("features"), weights, bias), 6).alias("score"))


@query()
def model_loo_threshold(spark, sf_dir):
    training = _training(spark, sf_dir)
    scores = model.leave_one_out(training).withColumn("protected", F.lit(False))
    return model.threshold(scores)


@query(f"with i as ({INSTANCES_SQL}) select handle, string_agg(distinct feature_id, '|' order by feature_id) as features, count(*) as n_instances from i group by 1")
def audit_rollup(spark, sf_dir):
    rows = instances(spark, sf_dir).groupBy("handle").agg(F.concat_ws("|", F.array_sort(F.collect_set("feature_id"))).alias("features"), F.count("*").alias("n_instances"))
    return rows
