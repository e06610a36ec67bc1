"""Plans, outcome reports, upserts, pacing and audit rows, as append-only tables with a view of the latest row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order of tiers in a plan, and rates of the paced job.
TIER_ORDER = ("OWNER_BLOCK", "BLOCK_CONFIRMED", "KNOWN_SCAM_LIST", "AUTO_BLOCK_PATTERN", "OWNER_TRAINED")
#: A day in microseconds.
DAY = 86_400_000_000
BATCH_SIZE, BATCH_MOST, BATCHES_A_DAY, PAUSE_MINUTES, ATTEMPTS = 20, 25, 5, 10, 3
# Keys that no stored payload may have at any depth, in any case.
SECRET_KEYS = ("password", "cookie", "cookies", "token", "auth_token", "ct0", "2fa", "otp", "session", "passkey")


def handle_key(handle: Column) -> Column:
    """Handles compare without case, blanks around or a leading @."""
    return F.lower(F.regexp_replace(F.trim(handle), "^@+", ""))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of greatest order per key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("x")).select(key, "x.*")


def inserted_or_ignored(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose keys aren't there yet, one per key."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upserted(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows replaced by new ones of the same key (one per key) and joined by the others."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def plan(candidates: DataFrame, done: list[DataFrame], n: int = BATCH_SIZE) -> DataFrame:
    """The first n candidates (handle, tier) by tier and handle that no table in done has."""
    rows = candidates.withColumn("key", handle_key(F.col("handle")))
    for other in done:
        rows = rows.join(other.select(handle_key(F.col("handle")).alias("key")), "key", "left_anti")
    rank = F.array_position(F.array(*map(F.lit, TIER_ORDER)), F.col("tier"))
    return rows.orderBy(rank, "key").limit(max(n, 1)).drop("key")


def verified(row: Column | None = None) -> Column:
    """A block counts only if all of it was seen: identity and decision confirmed, done or done before, and shown after a reload."""
    true = lambda n: F.coalesce(F.col(n), F.lit(False))
    return true("handle_reverified") & true("decision_confirmed") & (true("block_clicked") | true("already_blocked")) & true("reloaded") & true("shows_blocked") & true("planned")


def until_stop(report: DataFrame, order: str, job: str) -> DataFrame:
    """The rows of each job up to its first row with a stop_reason; that row is the last. Rows of the same order follow their arrival, where they have that column."""
    arrival = [c for c in ("arrival",) if c in report.columns]
    before = Window.partitionBy(job).orderBy(order, *arrival).rowsBetween(Window.unboundedPreceding, -1)
    return report.withColumn("stopped", F.coalesce(F.max(F.col("stop_reason").isNotNull()).over(before), F.lit(False))).where("not stopped").drop("stopped", *arrival)


def status_as_of(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Decisions (handle, decided_at) with the status of their latest outcome (handle, id, ts, verified) if it isn't older."""
    last = latest(outcomes.select("handle", "id", "ts", "verified"), "handle", "id")
    rows = decisions.join(last.withColumnRenamed("ts", "outcome_ts"), "handle", "left")
    fresh = F.coalesce(F.col("outcome_ts") >= F.col("decided_at"), F.lit(False))
    return rows.withColumn("status", F.when(fresh & F.col("verified"), "VERIFIED").when(fresh, "FAILED_RETRY").otherwise("PLANNED")).drop("id", "outcome_ts", "verified")


def classified(listed: DataFrame) -> DataFrame:
    """Accounts of a list (kept, verified, gone, attempts) with their state, in the order of precedence."""
    state = F.when(F.col("kept"), "KEPT").when(F.col("verified"), "VERIFIED").when(F.col("gone"), "GONE").when(F.col("attempts") >= ATTEMPTS, "GAVE_UP").otherwise("PENDING")
    return listed.withColumn("state", state)


def pacing(batches: DataFrame) -> DataFrame:
    """Batches (job, ts) with the number in the 24 hours up to each and whether one more may start PAUSE_MINUTES later."""
    day = Window.partitionBy("job").orderBy(F.unix_micros("ts")).rangeBetween(-DAY, 0)
    return batches.withColumn("in_day", F.count("*").over(day)).withColumn("may_continue", F.col("in_day") < BATCHES_A_DAY)


def report_history(reports: DataFrame) -> DataFrame:
    """One row per account of reports (handle, id, status, option, ts, no_retry): attempts, the last of each, and any bar on trying again."""
    last = F.max_by(F.struct("status", "option", "ts"), "id")
    return reports.groupBy("handle").agg(F.count("*").alias("attempts"), last.alias("x"), F.max("no_retry").alias("no_retry")).select("handle", "attempts", "x.*", "no_retry")


def payload_keys(payload: Column) -> Column:
    """All keys of a JSON text, at any depth, in lower case: its strings that a colon follows. Strings are read whole, one after another, so that none is sought within another."""
    strings = F.regexp_extract_all(payload, F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:?'), F.lit(0))
    return F.transform(F.filter(strings, lambda s: F.endswith(s, F.lit(":"))), lambda s: F.lower(F.regexp_extract(s, r'(?s)^"(.*)"', 1)))


def audit_events(events: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Events (stage, event, payload: a JSON text or null, handle) stamped with versions; a payload with a credential's key at any depth raises."""
    bad = F.coalesce(F.arrays_overlap(payload_keys(F.col("payload")), F.array(*map(F.lit, SECRET_KEYS))), F.lit(False))
    checked = F.when(bad, F.raise_error(F.lit("credential-like key in an audit payload"))).otherwise(F.col("payload"))
    return events.withColumn("payload", checked).withColumns({k: F.lit(v) for k, v in versions.items()})


def upgraded_events(events: DataFrame, versions: tuple[str, ...], older: str = "pre-v0.1.0") -> DataFrame:
    """Stored events with all version columns; those that an older store lacks say so."""
    missing = {v: F.lit(older) for v in versions if v not in events.columns}
    return events.withColumns(missing) if missing else events
