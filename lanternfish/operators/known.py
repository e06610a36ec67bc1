"""The shared lists at decision time and their upkeep: checks of records, ingest with links, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.functions import links, names
from lanternfish.operators.jobs import handle_key
from lanternfish.sources.records import each_link, known, record_links
from lanternfish.sources.shared import written

BIO_KEPT, MIN_PREFIX_PATH = 400, 6


def facts(records: DataFrame) -> DataFrame:
    """handle, display_name, bio (its beginning) and links of records: what the lists are checked against, then and later."""
    return record_links(records, display_name=known(F.col("display_name")), bio=F.substring(known(F.col("bio")), 1, BIO_KEPT))


def checked(fact: DataFrame, listed: DataFrame, watchlist: DataFrame, allowed: DataFrame, exclusions: tuple[str, ...] = ()) -> DataFrame:
    """One row per account of facts: allowlisted, listed_reason, n_link_hits, first_hit, exact_chat, name_field, name_rule, phrase_hit.

    listed: handle, reason; watchlist: pos, entry, entry_type; allowed: handle. An allowed handle is neither listed nor
    an impersonation nor a phrase hit, but its links still count. The lists are joined by handle and looked up by link; neither
    is compared with every account. The facts are written first, as links are read for each kind of entry.
    """
    fact = written(fact)
    key = lambda df: df.select(handle_key(F.col("handle")).alias("key"), *[c for c in df.columns if c != "handle"])
    one = key(listed).groupBy("key").agg(F.min_by("reason", "reason").alias("reason"))
    allow = key(allowed).select("key", F.lit(True).alias("allow")).distinct()
    each = each_link(fact.withColumnRenamed("handle", "id"), "id")
    hits = links.watch_matches(each, watchlist).groupBy("id").agg(F.count("*").alias("n_link_hits"), F.min("url").alias("first_hit"), F.max("exact_chat").alias("exact_chat"))
    rows = fact.withColumn("key", handle_key(F.col("handle"))).join(one, "key", "left").join(allow, "key", "left").join(hits, F.col("handle") == F.col("id"), "left")
    free = F.col("allow").isNull()
    name = names.impersonation(F.col("handle"), F.col("display_name"), exclusions)
    chat = F.exists("links", lambda n: n["kind"].isin("telegram", "whatsapp", "zangi"))
    phrase = names.phrase_rule(names.folded(F.col("display_name")), names.folded(F.col("bio")), chat)
    rows = rows.withColumns({"name": name, "phrase": phrase})
    return rows.select(
        "handle", F.col("allow").isNotNull().alias("allowlisted"), F.when(free, F.col("reason")).alias("listed_reason"), F.coalesce("n_link_hits", F.lit(0)).alias("n_link_hits"), "first_hit",
        F.coalesce("exact_chat", F.lit(False)).alias("exact_chat"), F.when(free, F.col("name.field")).alias("name_field"), F.when(free, F.col("name.rule")).alias("name_rule"), (free & F.col("phrase")).alias("phrase_hit"),
    )


def candidates(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """seq, key, pos and the link parts that rows (seq, handle, display_name, bio, links) bring in; invalid and allowed handles bring none."""
    valid = F.coalesce(F.col("key").rlike("^[a-z0-9_]{1,15}$"), F.lit(False))
    rows = rows.withColumn("key", handle_key(F.col("handle"))).where(valid).join(allowed.select(handle_key(F.col("handle")).alias("key")), "key", "left_anti")
    fields = F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"(?U)\s+", ""))
    said = F.concat_ws("\n", F.coalesce("display_name", F.lit("")), F.coalesce("bio", F.lit("")))
    found = F.transform(F.concat(fields, links.in_text(F.col("bio")), links.chat_numbers(said)), links.normalized)
    return rows.select("seq", "key", F.posexplode(links.deduplicated(F.filter(found, lambda n: n.isNotNull()))).alias("pos", "n")).select("seq", "key", "pos", "n.*")


def link_results(found: DataFrame, watchlist: DataFrame, never: tuple[str, ...] = (), prose: tuple[str, ...] = (), no_domain: tuple[str, ...] = ()) -> DataFrame:
    """Links of candidates() with result: SKIPPED by a rule, ALREADY_PRESENT, or ADDED by the first row that brings it.

    Skipped are links of never-listed domains and below, links of prose, bare domains that are cut off or stand for many, and
    cut-off links with little path.
    """
    bare = ~F.col("url").rlike("[/?]")
    many = tuple(sorted({*no_domain, *config.CHAT_HOSTS, *config.SHORTENERS}))
    path = F.length(F.regexp_extract("url", r"^[^/]*/(.*)$", 1))
    banned = F.col("domain").isin(*never) if never else F.lit(False)
    for domain in never:
        banned = banned | F.endswith(F.col("domain"), F.lit(f".{domain}"))
    skipped = banned | (F.col("url").isin(*prose) if prose else F.lit(False)) | (bare & (F.col("truncated") | F.col("domain").isin(*many))) | (F.col("truncated") & (path < MIN_PREFIX_PATH))
    rows = found.withColumn("skipped", skipped)
    have = watchlist.select(F.col("entry").alias("url"), F.col("entry_type").alias("match_type"), F.lit(True).alias("have")).distinct()
    first = F.row_number().over(Window.partitionBy("url", "match_type", "skipped").orderBy("seq", "pos")) == 1
    result = F.when(F.col("skipped"), "SKIPPED").when(F.col("have"), "ALREADY_PRESENT").when(F.col("first"), "ADDED").otherwise("ALREADY_PRESENT")
    return rows.withColumn("first", first).join(have, ["url", "match_type"], "left").withColumn("result", result).drop("skipped", "have", "first")


def counters(accounts: DataFrame, links_found: DataFrame) -> DataFrame:
    """One row: the eight counters of an ingest, from its accounts' and links' results."""
    count = lambda *names: F.count_if(F.col("result").isin(*names))
    a = accounts.agg(
        count("ADDED").alias("accounts_added"), count("LISTED", "DUPLICATE").alias("already_present"), count("ALLOWLISTED").alias("skipped_allowlist"),
        count("REMOVED_BEFORE").alias("skipped_removed_earlier"), count("INVALID").alias("skipped_invalid"),
    )
    b = links_found.agg(count("ADDED").alias("links_added"), count("ALREADY_PRESENT").alias("links_already_present"), count("SKIPPED").alias("links_skipped"))
    return a.join(F.broadcast(b), F.lit(True))


def removed(listed: DataFrame, requests: DataFrame, day: Column) -> DataFrame:
    """The list (handle, tombstone and others) after removals (handle, reason): a listed account becomes a tombstone; unknown handles change nothing."""
    wanted = requests.select(handle_key(F.col("handle")).alias("key"), F.col("reason").alias("_why")).groupBy("key").agg(F.min("_why").alias("_why"))
    rows = listed.withColumn("key", handle_key(F.col("handle"))).join(wanted, "key", "left")
    gone = F.col("_why").isNotNull() & ~F.col("tombstone")
    changed = {"removed": F.when(gone, day).otherwise(F.col("removed")), "removed_reason": F.when(gone, F.col("_why")).otherwise(F.col("removed_reason")), "tombstone": F.col("tombstone") | gone}
    return rows.withColumns(changed).drop("key", "_why")
