"""The scouting stream in batch form: validation, late rows, dedup, history, bursts, priority, triggers, queue, light checks.

Interactions are rows (seq, handle, kind, post, ts, solicits, ...); seq is the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.sources.shared import few

#: A day in microseconds.
DAY = 86_400_000_000
KINDS = ("NEW_FOLLOW", "LIKE", "REPOST", "REPLY", "QUOTE_POST", "MENTION", "TAG", "OTHER")
KEY = ("handle", "kind", "post", "ts")


def problems(rows: DataFrame) -> DataFrame:
    """Rows with an array of what is wrong with them: handle, confirmation, kind, timestamp."""
    tests = [
        ("invalid handle", ~F.coalesce(F.regexp_replace(F.trim("handle"), "^@+", "").rlike("^[A-Za-z0-9_]{1,15}$"), F.lit(False))),
        ("handle not confirmed", ~F.coalesce("handle_confirmed", F.lit(False))),
        ("unknown interaction type", ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))),
        ("timestamp missing or invalid", F.col("ts").isNull()),
    ]
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests])))


def marker(kind: Column) -> Column:
    """Follows have a scan of their own."""
    return F.when(kind == "NEW_FOLLOW", "FOLLOW").otherwise("NOTIF")


def split_late(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows with late: not after their source's mark (source, mark) as of the batch's start."""
    marked = rows.withColumn("source", marker(F.col("kind"))).join(few(marks), "source", "left")
    return marked.withColumn("late", F.coalesce(F.col("ts") <= F.col("mark"), F.lit(False))).drop("mark")


def advanced(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The marks after the batch: the newest time of each source, never back."""
    new = rows.withColumn("source", marker(F.col("kind"))).groupBy("source").agg(F.max("ts").alias("newest"))
    return marks.join(new, "source", "full").select("source", F.greatest("mark", "newest").alias("mark"))


def first_seen(rows: DataFrame) -> DataFrame:
    """The first arrival of each interaction; a null post is another than an empty one."""
    least = F.min_by(F.struct(*rows.columns), F.col("seq"))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in KEY]).agg(least.alias("x")).select("x.*")


def history(rows: DataFrame) -> DataFrame:
    """One row per account: count, count by kind, diversity, posts, first and last time."""
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in KINDS]
    return rows.groupBy("handle").agg(
        F.count("*").alias("n"), *counts, F.count_distinct("kind").alias("diversity"), F.count_distinct("post").alias("n_posts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def bursts(rows: DataFrame) -> DataFrame:
    """The most interactions of an account, at distinct times, within any 24 hours.

    Each time opens a window and is one of its points. The times of a day are dealt to that day and the one before, as a window
    reaches into the next day; there the k-th end of a window has all points up to it but the first k - 1, so that two running sums do.
    """
    times = rows.where("ts is not null").select("handle", F.unix_micros("ts").alias("at")).distinct()
    day = F.col("at") - F.pmod("at", F.lit(DAY))
    mark = lambda day, at, end: F.struct(day.alias("day"), at.alias("at"), F.lit(end).alias("end"))
    marks = F.array(mark(day, F.col("at"), 0), mark(day - DAY, F.col("at"), 0), mark(day, F.col("at") + DAY, 1))
    order = Window.partitionBy("handle", "day").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, 0)
    counted = times.select("handle", F.inline(marks)).withColumn("n", F.sum(1 - 2 * F.col("end")).over(order) + 1)
    return counted.where("end = 1").groupBy("handle").agg(F.max("n").alias("burst"))


def running(rows: DataFrame) -> DataFrame:
    """Each row with the account's history up to it: seen kinds, posts, and counts of follows, replies, likes and reposts.

    A kind or post counts at its first row, so that running sums do, and no row holds a set of all before it.
    """
    order = Window.partitionBy("handle").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds)).over(order)
    first = lambda c: F.col(c).isNotNull() & (F.row_number().over(Window.partitionBy("handle", c).orderBy("seq")) == 1)
    rows = rows.withColumns({"_kind": first("kind"), "_post": first("post")})
    rows = rows.withColumns(
        {
            "diversity": F.count_if("_kind").over(order).cast("int"), "n_posts": F.count_if("_post").over(order).cast("int"),
            "follows": count("NEW_FOLLOW"), "replies": count("REPLY"), "likes": count("LIKE", "REPOST"),
        }
    )
    return rows.drop("_kind", "_post")


def priority(rows: DataFrame) -> DataFrame:
    """Rows of running() with the queue's priority, which orders the queue and nothing else."""
    network = F.coalesce("network_match", F.lit(False)) if "network_match" in rows.columns else F.lit(False)
    kind = F.col("kind")
    high = kind.isin("QUOTE_POST", "MENTION", "TAG") | ((F.col("follows") > 0) & (F.col("diversity") >= 2)) | ((F.col("diversity") >= 2) & (F.col("n_posts") >= 3)) | F.col("solicits") | network
    normal = (F.col("follows") > 0) | (F.col("replies") > 0) | (F.col("likes") >= 2)
    return rows.withColumn("priority", F.when(high, "HIGH").when(normal, "NORMAL").otherwise("LOW"))


def level(kind: Column, solicits: Column, triggered: Column) -> Column:
    """How deep an interaction is looked into, with the standing settings."""
    return F.when(triggered | (kind == "NEW_FOLLOW") | ((kind == "REPLY") & solicits), "FULL_AUDIT").otherwise("LIGHT_CHECK")


def triggers(rows: DataFrame) -> DataFrame:
    """Rows with an array of reasons for a new audit.

    rows: ts, last_full_audit, solicits, and what was seen against what is known (seen_name, known_name, seen_bio, known_bio), network_match,
    new_behavior, owner_request.
    """
    days = F.abs(F.unix_micros("ts") - F.unix_micros("last_full_audit")) / 86_400e6
    changed = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    tests = [
        ("audit stale", F.coalesce(days > config.STALE_FULL_DAYS, F.lit(False))),
        ("profile change (display_name)", changed("seen_name", "known_name")),
        ("profile change (bio)", changed("seen_bio", "known_bio")),
        ("suspicious solicitation begins", F.col("solicits")),
        ("joined a newly detected network", F.col("network_match")),
        ("new behavior materially changes evidence", F.col("new_behavior")),
        ("owner asked", F.col("owner_request")),
    ]
    return rows.withColumn("triggers", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests])))


def queue(rows: DataFrame) -> DataFrame:
    """One open entry per account from rows of priority() with level: greatest level and priority, first source, and their number.

    Levels only rise, and a priority is replaced by one at least as high, so that the entry doesn't depend on how rows are batched.
    """
    rank = F.expr("case priority when 'HIGH' then 3 when 'NORMAL' then 2 else 1 end")
    deep = F.expr("case level when 'FULL_AUDIT' then 2 when 'LIGHT_CHECK' then 1 else 0 end")
    return rows.groupBy("handle").agg(
        F.max_by("level", deep).alias("level"), F.max_by("priority", rank).alias("priority"), F.min_by("kind", "seq").alias("source_kind"), F.min("ts").alias("first_seen"), F.count("*").alias("n_interactions"), F.min("seq").alias("opened")
    )


def ordered_queue(entries: DataFrame) -> DataFrame:
    """Entries in the order of work: priority, then the first to be opened."""
    rank = F.expr("case priority when 'HIGH' then 3 when 'NORMAL' then 2 else 1 end")
    return entries.orderBy(rank.desc(), "opened", "handle")


def light_check(rows: DataFrame) -> DataFrame:
    """Rows (strong, features: arrays; top_score, in_network, policy_match, repurposed, listed, link_hit, phrase_hit, name_hit, owner_blocked) with the
    reasons to escalate and the result."""
    tests = [
        ("strong feature", F.size("strong") > 0),
        ("impersonation/scam/solicitation feature", F.arrays_overlap("features", F.array(*map(F.lit, config.ESCALATE_FEATURES)))),
        ("malicious score in review band", F.col("top_score") >= config.REVIEW_SCORE),
        *[(name.replace("_", " "), F.col(name)) for name in ("in_network", "policy_match", "repurposed", "listed", "link_hit", "phrase_hit", "name_hit", "owner_blocked")],
    ]
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
    return rows.withColumn("reasons", reasons).withColumn("result", F.when(F.size("reasons") > 0, "ESCALATE").otherwise("LOW_RISK"))
