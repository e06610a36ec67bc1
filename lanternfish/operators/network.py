"""Shared facts between accounts, pairs, edges, clusters and the cluster score.

Items are rows (handle, kind, text or value, date, target). Accounts meet only where they share a fact; weak facts can't
make an edge, so accounts aren't paired by them unless the watch list is wanted. An account's facts are rows, never one list, as
an account may have any number of them: pairs are made fact by fact and what a pair shares is counted by aggregates. The
accounts of a heavy fact are dealt to slots, and each two slots meet in a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.functions import text as tx
from lanternfish.operators.components import connected_components
from lanternfish.sources.shared import met, numbered

RANK = "case strength when 'STRONG' then 3 when 'MODERATE' then 2 else 1 end"
#: Accounts of a slot of a heavy fact.
SLOT = 1_000
#: A strong fact of more accounts isn't met at.
WIDE = 50


def members(items: DataFrame) -> DataFrame:
    """One row per fact and account: fact_type, fact_key, fact_group, handle, first_date, bio, distinctiveness, topic."""
    texts = tx.fingerprints(items.where("kind in ('TEXT', 'BIO') and text <> ''"))
    topic = F.col("norm").rlike("(?iU)" + config.TOPIC) & (F.col("distinctiveness") < 60)
    texts = texts.withColumns({"topic": topic, "bio": F.col("kind") == "BIO"})
    generic = F.when(F.col("band") == "LOW", "GENERIC_TEXT").otherwise("TEXT")
    facts = F.array(
        F.struct(generic.alias("fact_type"), F.col("norm_hash").alias("fact_key"), F.concat(F.lit("TEXT:"), "norm_hash").alias("fact_group")),
        F.struct(F.lit("TEMPLATE").alias("fact_type"), F.col("template_id").alias("fact_key"), F.concat(F.lit("TEMPLATE:"), "template_id").alias("fact_group")),
    )
    wave = F.col("target").isNotNull() & (F.col("kind") == "TEXT") & F.col("date").isNotNull()
    target = F.lower("target")
    replies = texts.where(wave).select(
        "handle", F.col("date"), F.lit(False).alias("bio"), F.lit(None).cast("int").alias("distinctiveness"), F.lit(False).alias("topic"), F.lit("LOW").alias("band"),
        F.struct(F.lit("REPLY_WAVE").alias("fact_type"), F.concat_ws("|", target, F.col("date").cast("string")).alias("fact_key"), F.concat(F.lit("REPLY_WAVE:"), target).alias("fact_group")).alias("fact"),
    )
    shared = texts.select("handle", "date", "bio", "distinctiveness", "topic", "band", F.explode(facts).alias("fact"))
    value = F.trim(F.lower("text"))
    value = F.when(F.col("kind") == "SHARED_CONTACT", F.regexp_replace(F.regexp_replace(value, r"^(https?://)?(www\.)?", ""), "/+$", "")).when(
        F.col("kind") == "SHARED_DOMAIN", F.regexp_extract(value, r"^(?:[a-z]+://)?(?:www\.)?([^/?#]*)", 1)
    )
    plain = items.where("kind not in ('TEXT', 'BIO')").withColumn("v", F.coalesce(value, F.trim(F.lower("text")))).select(
        "handle", "date", F.lit(False).alias("bio"), F.lit(None).cast("int").alias("distinctiveness"), F.lit(False).alias("topic"), F.lit("LOW").alias("band"),
        F.struct(F.col("kind").alias("fact_type"), F.col("v").alias("fact_key"), F.concat_ws(":", "kind", "v").alias("fact_group")).alias("fact"),
    )
    rows = shared.unionByName(replies).unionByName(plain).select("*", "fact.*").drop("fact")
    return rows.groupBy("fact_type", "fact_key", "fact_group", "handle").agg(
        F.min("date").alias("first_date"), F.max("bio").alias("bio"), F.max("distinctiveness").alias("distinctiveness"), F.max("topic").alias("topic"), F.max("band").alias("band_")
    )


def facts(member: DataFrame) -> DataFrame:
    """Facts that two accounts or more share, with n_members and strength."""
    rows = member.groupBy("fact_type", "fact_key", "fact_group").agg(
        F.count("*").alias("n_members"), F.count("first_date").alias("n_dated"), F.datediff(F.max("first_date"), F.min("first_date")).alias("days"),
        F.max("bio").alias("bio"), F.max("distinctiveness").alias("distinctiveness"), F.max("topic").alias("topic"),
    ).where("n_members > 1")
    kind, high = F.col("fact_type"), F.col("distinctiveness") >= 60
    window = (F.col("n_dated") == F.col("n_members")) & (F.col("days") <= config.WINDOW_DAYS)
    strength = (
        F.when(kind == "GENERIC_TEXT", "WEAK")
        .when(kind == "TEXT", F.when(high & F.coalesce(window, F.lit(False)) & ~F.col("bio"), "STRONG").otherwise("MODERATE"))
        .when(kind == "TEMPLATE", F.when(F.col("distinctiveness") >= 30, "MODERATE").otherwise("WEAK"))
        .when(kind.isin("WALLET", "REFERRAL_ID", "SHARED_CONTACT", "IMAGE_REUSE"), "STRONG")
        .when(kind == "SHARED_DOMAIN", F.when(F.col("fact_key").isin(*config.COMMON_DOMAINS), "WEAK").otherwise("MODERATE"))
        .when(kind == "REPLY_WAVE", F.when(F.col("n_members") >= 3, "MODERATE").otherwise("WEAK"))
        .otherwise("WEAK")
    )
    rows = rows.withColumn("strength", strength)
    return rows.withColumn("strength", F.when(F.col("topic") & (F.col("strength") != "STRONG"), "WEAK").otherwise(F.col("strength"))).drop("n_dated", "days", "bio")


def profiles(member: DataFrame, shared: DataFrame) -> DataFrame:
    """One row per account and shared fact: handle, n, id, group, rank, text, template.

    id and group are numbers in place of names; rank is 3 for a strong, 2 for a moderate and 1 for a weak fact.
    """
    kind, names = F.col("fact_type"), ["fact_type", "fact_key", "fact_group"]
    return member.join(shared.select(*names, "n_members", "strength"), names).select(
        "handle", F.col("n_members").alias("n"), F.xxhash64(*names).alias("id"), F.xxhash64("fact_group").alias("group"), F.expr(RANK).alias("rank"),
        (kind == "TEXT").alias("text"), (kind == "TEMPLATE").alias("template"),
    )


def _met(rows: DataFrame, key: str) -> DataFrame:
    """Each two rows (key, handle) of one key as a, b and key, where a < b."""
    return met(rows, key, "handle", SLOT)


def _common(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (handle, id and others) that both of each pair (a, b) have, with a and b; sought from the account with fewer rows."""
    number = rows.groupBy("handle").agg(F.count("*").alias("k"))
    of = lambda name: number.select(F.col("handle").alias(name), F.col("k").alias(f"k_{name}"))
    fewer = F.col("k_a") <= F.col("k_b")
    sides = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    sides = sides.select("a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("handle"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("_other"))
    return sides.join(rows, "handle").drop("handle").join(rows.select(F.col("handle").alias("_other"), "id"), ["_other", "id"], "left_semi").drop("_other")


def _counted(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Rows (a, b, template and others) of pairs without the templates of those that share a text."""
    with_text = _common(rows.where("template").select("a", "b").distinct(), profile.where("text").select("handle", "id")).select("a", "b").distinct()
    return rows.where("not template").unionByName(rows.where("template").join(with_text, ["a", "b"], "left_anti"))


def _pairs(profile: DataFrame) -> DataFrame:
    """Each pair (a < b) at each fact that it has in common: a, b, id, group, rank, text, template."""
    rows = profile.select("id", "handle", F.struct("group", "rank", "text", "template").alias("fact"))
    return _met(rows, "id").select("a", "b", "id", "a_fact.*")


def pair_facts(member: DataFrame, shared: DataFrame, weak: bool = False) -> DataFrame:
    """One row per pair (a < b) and fact group: the strongest fact. A template doesn't count where the pair shares a text."""
    profile = profiles(member, shared if weak else shared.where("strength <> 'WEAK' or fact_type = 'TEXT'"))
    rows = _counted(_pairs(profile if weak else profile.where("rank > 1")), profile)
    names = shared.select(F.xxhash64("fact_type", "fact_key", "fact_group").alias("id"), "fact_type", "fact_group", "strength")
    best = F.max_by(F.struct("strength", "fact_type"), F.struct(F.expr(RANK), "fact_type"))
    return rows.select("a", "b", "id").join(names, "id").groupBy("a", "b", "fact_group").agg(best.alias("x")).select("a", "b", "fact_group", "x.strength", "x.fact_type")


def fact_classes(profile: DataFrame) -> DataFrame:
    """handle, class (the least account with the same facts) and n (of its accounts).

    Sets of facts are compared by their size and three sums of hashes, so that no row holds an account's facts.
    """
    one, other = F.xxhash64("id", "rank", "n"), F.xxhash64(F.lit(1), "n", "rank", "id")
    marks = {"size": F.count("*"), "mark": F.bit_xor(one), "digest": F.bit_xor(other), "sum": F.sum(one.cast("decimal(20,0)"))}
    marked = profile.groupBy("handle").agg(*[x.alias(name) for name, x in marks.items()])
    every = marked.groupBy(*marks).agg(F.min("handle").alias("class"), F.count("*").alias("n"))
    return marked.join(every, [*marks]).select("handle", "class", "n")


def watch(member: DataFrame, shared: DataFrame, written) -> DataFrame:
    """Pairs of accounts with facts in common that make no edge, as classes: a, b, n_pairs, n_moderate and n_weak (fact groups).

    Accounts with the same facts are one class, named by the least of them, and share the same with any other account; so one
    row stands for all pairs between two classes, or within one, where a is b. fact_classes() has their members.
    """
    profile = written(profiles(member, shared))
    size = written(fact_classes(profile).where("handle = class").select("handle", F.col("n").alias("members")))
    first = profile.join(size, "handle")
    own = first.where("members > 1").select(F.col("handle").alias("a"), F.col("handle").alias("b"), "id", "group", "rank", "text", "template")
    rows = _pairs(first).unionByName(own)
    # a group holds templates only or none, and the pair's other groups tell whether it shares a text
    groups = rows.groupBy("a", "b", "group").agg(F.max("rank").alias("rank"), F.max("text").alias("text"), F.max("template").alias("template"))
    number = lambda rank, kind: F.count_if((F.col("rank") == rank) & kind)
    plain, template = ~F.col("template"), F.col("template")
    counts = [number(r, k).alias(f"{name}{r}") for r in (1, 2, 3) for name, k in (("n", plain), ("t", template))]
    rows = groups.groupBy("a", "b").agg(F.max("text").alias("text"), *counts)
    rows = rows.withColumns({f"n{r}": F.col(f"n{r}") + F.when(F.col("text"), 0).otherwise(F.col(f"t{r}")) for r in (1, 2, 3)})
    rows = rows.where("n3 = 0 and n1 + n2 > 0").where(F.col("n2") < config.CLUSTER_MIN_MODERATE)
    rows = rows.join(size.select(F.col("handle").alias("a"), F.col("members").alias("n_a")), "a").join(size.select(F.col("handle").alias("b"), F.col("members").alias("n_b")), "b")
    pairs = F.when(F.col("a") == F.col("b"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b"))
    return rows.select("a", "b", pairs.alias("n_pairs"), F.col("n2").alias("n_moderate"), F.col("n1").alias("n_weak"))


def edges(pairs: DataFrame) -> DataFrame:
    """Pairs with a strong fact, or three moderate ones of different groups."""
    counts = pairs.groupBy("a", "b").agg(F.count_if(F.col("strength") == "STRONG").alias("n_strong"), F.count_if(F.col("strength") == "MODERATE").alias("n_moderate"))
    return counts.where((F.col("n_strong") > 0) | (F.col("n_moderate") >= config.CLUSTER_MIN_MODERATE))


def clusters(linked: DataFrame, pairs: DataFrame, written) -> DataFrame:
    """handle, cluster_id (numbered in the order of least members), component, n_evidence (fact groups over its own edges)."""
    found = connected_components(linked, written)
    names = numbered(found.select("component").distinct(), "component", "nth").select("component", F.format_string("N6-%03d", "nth").alias("cluster_id"))
    used = pairs.where("strength <> 'WEAK'").join(linked.select("a", "b"), ["a", "b"])
    groups = used.select(F.explode(F.array("a", "b")).alias("node"), "fact_group").groupBy("node").agg(F.count_distinct("fact_group").alias("n_evidence"))
    return found.join(names, "component").join(groups, "node", "left").select(F.col("node").alias("handle"), "cluster_id", "component", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def clusters_of(member: DataFrame, shared: DataFrame, written) -> DataFrame:
    """What clusters() gives of members() and facts(), without pairing the accounts of widespread strong or of very common facts.

    A strong fact links all of its accounts, so each is linked to the least of them: k - 1 links in place of k (k - 1) / 2 pairs. Two
    accounts with three moderate facts in common have one of these among all but the last two of each, rarest first; so accounts
    meet at those facts only, and a fact that very many have is met at by accounts alone that have two still more common
    ones. What else two accounts of a strong fact share adds to their evidence. The accounts of a strong fact of few (WIDE at
    most) are paired for it; for others it is any moderate fact that another account has together with the same strong one,
    and only templates, which don't count beside a common text, need the pairs of such accounts.
    """
    profile = written(profiles(member, shared.where("strength <> 'WEAK' or fact_type = 'TEXT'")))
    strong, moderate = profile.where("rank = 3"), profile.where("rank = 2")
    star = strong.groupBy("id").agg(F.min("handle").alias("b"))
    links = strong.join(star, "id").where("handle <> b").select(F.col("handle").alias("a"), "b")

    common = F.row_number().over(Window.partitionBy("handle").orderBy(F.desc("n"), F.desc("id")))
    late = moderate.select("handle", "n", "id").withColumn("place", common).where("place <= 2").select("handle", "id")
    early = moderate.select("handle", "id").join(late, ["handle", "id"], "left_anti")
    near = _met(early, "id").select("a", "b", F.lit(False).alias("strong"))
    near = near.unionByName(_met(strong.where(F.col("n") <= WIDE).select("handle", "id"), "id").select("a", "b", F.lit(True).alias("strong")))
    near = written(near.groupBy("a", "b").agg(F.max("strong").alias("strong")))
    both = written(_counted(_common(near, moderate.select("handle", "id", "group", "template")), profile).select("a", "b", "group").distinct())
    found = both.groupBy("a", "b").agg(F.count("*").alias("k")).where(F.col("k") >= config.CLUSTER_MIN_MODERATE).select("a", "b")
    edge = near.where("strong").select("a", "b").unionByName(found).distinct()
    seen = both.join(edge, ["a", "b"]).select(F.explode(F.array("a", "b")).alias("node"), "group")

    wide = strong.where(F.col("n") > WIDE).select("handle", F.col("id").alias("tie"), F.col("text").alias("tie_text"))
    tied = moderate.select("handle", "id", "group", "template").join(wide, "handle").withColumn("id", F.xxhash64("id", "tie"))
    shared_by = tied.where("not template").groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    seen = seen.unionByName(tied.where("not template").join(shared_by, "id", "left_semi").select(F.col("handle").alias("node"), "group"))
    templates = tied.where("template and not tie_text")
    named = _counted(_met(templates.select("id", "handle"), "id").withColumn("template", F.lit(True)), profile).select("id", F.explode(F.array("a", "b")).alias("node")).distinct()
    seen = seen.unionByName(named.join(templates.select("id", F.col("handle").alias("node"), "group"), ["id", "node"]).select("node", "group"))

    seen = seen.unionByName(strong.select(F.col("handle").alias("node"), "group"))
    evidence = seen.groupBy("node").agg(F.count_distinct("group").alias("n_evidence"))
    components = connected_components(links.unionByName(found), written)
    names = numbered(components.select("component").distinct(), "component", "nth").select("component", F.format_string("N6-%03d", "nth").alias("cluster_id"))
    return components.join(names, "component").join(evidence, "node", "left").select(F.col("node").alias("handle"), "cluster_id", "component", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def cluster_scores(prints: DataFrame) -> DataFrame:
    """The best cluster of each account. prints: cluster_id, pos (of the cluster), handle (an account of the cluster), kind, strength,
    has_value, dated, n_members (null if the fingerprint names none), direct (it names the account), topic.

    Topics are left out. A strong fingerprint without a value, or a same-date post without a date or two members, is moderate.
    A cluster is confirmed by a strong fingerprint or three moderate ones, if the account is named by one that isn't weak or
    none names anybody. The score is 60 a strong, 20 a moderate and 5 a weak one, each within its cap, 100 at most and
    49 for a candidate.
    """
    undated = (F.col("kind") == "IDENTICAL_POST_SAME_DATE") & (~F.col("dated") | (F.coalesce("n_members", F.lit(0)) < 2))
    grade = F.when((F.col("strength") == "STRONG") & (~F.col("has_value") | undated), "MODERATE").otherwise(F.col("strength"))
    rows = prints.where("not topic").withColumn("grade", grade)
    counts = rows.groupBy("cluster_id", "pos", "handle").agg(
        *[F.count_if(F.col("grade") == g).alias(n) for g, n in (("STRONG", "s"), ("MODERATE", "m"), ("WEAK", "w"))],
        F.max(F.col("n_members").isNotNull()).alias("named"),
        F.max(F.col("direct") & (F.col("grade") != "WEAK")).alias("linked"),
    )
    confirmed = ((F.col("s") >= 1) | (F.col("m") >= config.CLUSTER_MIN_MODERATE)) & (F.col("linked") | ~F.col("named"))
    raw = F.least(F.lit(60), 60 * F.col("s")) + F.least(F.lit(60), 20 * F.col("m")) + F.least(F.lit(15), 5 * F.col("w"))
    rows = counts.withColumn("confirmed", confirmed).withColumn("score", F.least(raw, F.when(F.col("confirmed"), 100).otherwise(config.CANDIDATE_CLUSTER_CAP)).cast("int"))
    best = F.max_by(F.struct("cluster_id", "confirmed", "score"), F.struct(F.col("confirmed").cast("int"), "score", -F.col("pos")))
    return rows.groupBy("handle").agg(best.alias("x")).select("handle", "x.*")
