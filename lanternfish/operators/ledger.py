"""Plans and the ingest of their reports: blocks, reports, unblocks and the paced job over the shared list.

Tables are append-only; a report's rows carry seq, their order in the report, and batch, the plan that they answer. Handles
compare by handle_key().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions import names
from lanternfish.operators.jobs import ATTEMPTS, BATCH_MOST, BATCH_SIZE, BATCHES_A_DAY, PAUSE_MINUTES, handle_key, until_stop

# Modes of a run, reasons that pause one job only, rows and hours that are kept or waited for.
MODES = ("AUDIT_ONLY", "REVIEW_WITH_ME", "HIGH_CONFIDENCE_AUTO_CLEAN")
SOFT_STOPS, BACKOFF_HOURS, BATCHES_KEPT = ("RATE_LIMIT", "X_ERROR"), 6, 60
NOT_PLANNED = "handle was not in the planned batch: ignored"


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _problems(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in tests]))


def planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with key and planned: whether their batch's plan (batch, handle) names the handle."""
    named = plan.select("batch", handle_key(F.col("handle")).alias("key"), F.lit(True).alias("planned")).distinct()
    return rows.withColumn("key", handle_key(F.col("handle"))).join(named, ["batch", "key"], "left").withColumn("planned", F.coalesce("planned", F.lit(False)))


def enforcement_records(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Block reports, cut at each batch's first stop, as records: attempted, verified, problems, and the pause that a stop asks for.

    A block is verified only if identity and decision were confirmed, it was done or stood already, and showed after a reload.
    """
    r = planned(until_stop(rows, "seq", "batch"), plan)
    seen = _true("handle_reverified") & _true("decision_confirmed") & (_true("block_clicked") | _true("already_blocked")) & _true("reloaded") & _true("shows_blocked")
    attempted = _true("block_clicked") & F.col("planned")
    problems = _problems(
        (~F.col("planned"), NOT_PLANNED), (attempted & ~_true("reloaded"), "block clicked but page not reloaded: NOT verified"),
        (attempted & _true("reloaded") & ~_true("shows_blocked"), "reloaded but not shown as blocked"), (~_true("handle_reverified"), "handle not re-verified"),
    )
    pause = F.when(F.col("stop_reason").isin(*SOFT_STOPS), "RATE_LIMITED").when(F.col("stop_reason").isNotNull(), "SECURITY_PAUSE")
    return r.select(
        "batch", "seq", "key", attempted.alias("attempted"), (seen & F.col("planned")).alias("verified"), _true("already_blocked").alias("already_blocked"), _true("account_gone").alias("gone"),
        F.col("ts"), "stop_reason", pause.alias("pause"), problems.alias("problems"),
    )


def enforcement_status(states: DataFrame, records: DataFrame) -> DataFrame:
    """handle, status and block_ts (of the latest verified, else attempted, record) of each state; records: id, key, attempted, verified, ts."""
    last = lambda test: F.max_by(F.when(test, F.col("ts")), F.when(test, F.col("id")))
    per = records.groupBy("key").agg(F.max("attempted").alias("a"), F.max("verified").alias("v"), last(F.col("verified")).alias("vt"), last(F.col("attempted")).alias("at"))
    status = F.when(F.col("v"), "BLOCK_VERIFIED").when(F.col("a"), "BLOCK_ATTEMPTED_UNVERIFIED").otherwise("NOT_BLOCKED")
    return states.withColumn("key", handle_key(F.col("handle"))).join(per, "key", "left").select("handle", status.alias("status"), F.when(F.col("v"), F.col("vt")).otherwise(F.col("at")).alias("block_ts"))


def eligible(enforcement: Column, action: Column, mode: str) -> tuple[Column, Column]:
    """Whether an account may be blocked in a mode, and why or why not; an owner's action counts above the engine's decision."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    blocked = F.coalesce(action == "BLOCK", F.lit(False))
    if mode == "AUDIT_ONLY":
        return F.lit(False), F.lit("audit-only mode never blocks")
    if mode == "REVIEW_WITH_ME":
        return blocked, F.when(blocked, "owner chose BLOCK").otherwise("waiting for the owner")
    kept, confirmed = F.coalesce(action == "KEEP", F.lit(False)), enforcement == "BLOCK_CONFIRMED"
    why = F.when(kept, "owner chose KEEP").when(blocked, "owner chose BLOCK").when(confirmed, "BLOCK_CONFIRMED: all gates passed").otherwise(F.concat(enforcement, F.lit(": not auto-blocked")))
    return ~kept & (blocked | confirmed), why


def latest_actions(adjudications: DataFrame) -> DataFrame:
    """key and the fields of the latest adjudication (id, handle, ...) per handle."""
    fields = [c for c in adjudications.columns if c not in ("id", "handle")]
    rows = adjudications.groupBy(handle_key(F.col("handle")).alias("key")).agg(F.max_by(F.struct(*fields), "id").alias("x"))
    return rows.select("key", "x.*")


def block_plan(states: DataFrame, adjudications: DataFrame, done: DataFrame, mode: str) -> DataFrame:
    """handle, enforcement, basis of the states (handle, enforcement) that may be blocked now and aren't verified as blocked (done: key)."""
    rows = states.withColumn("key", handle_key(F.col("handle"))).join(done.select("key").distinct(), "key", "left_anti").join(latest_actions(adjudications), "key", "left")
    good, why = eligible(F.col("enforcement"), F.col("action"), mode)
    return rows.where(good).select("handle", "enforcement", why.alias("basis"))


def report_records(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Account reports, cut at each batch's first stop, as records; a row that stopped before it was submitted isn't recorded."""
    r = planned(until_stop(rows, "seq", "batch"), plan).where(F.col("stop_reason").isNull() | _true("report_submitted"))
    done = _true("handle_reverified") & _true("report_submitted") & _true("confirmed") & F.col("planned")
    gone = _true("account_gone") & ~done
    problems = _problems(
        (~F.col("planned"), NOT_PLANNED), (~_true("handle_reverified"), "handle not re-verified"), (_true("report_submitted") & ~_true("confirmed"), "submitted but not confirmed"),
        (_true("bio_link_clicked"), "a bio link was clicked (never allowed)"), (gone, "account suspended or missing: not retried"),
    )
    option = F.when(F.upper("report_option") != "", F.upper("report_option"))
    return r.select("batch", "seq", "key", F.when(done, "REPORTED").otherwise("REPORT_FAILED").alias("status"), option.alias("option"), gone.alias("no_retry"), problems.alias("problems"))


def report_option(handle: Column, display_name: Column, exclusions: tuple[str, ...] = ()) -> Column:
    return F.when(names.impersonation(handle, display_name, exclusions).isNotNull(), "IMPERSONATION").otherwise("SPAM")


def report_candidates(enforcement: DataFrame, listed: DataFrame, allowed: DataFrame, unblocked: DataFrame, adjudications: DataFrame, history: DataFrame, exclusions: tuple[str, ...] = ()) -> DataFrame:
    """key, option, attempt of listed accounts that are verified as blocked (not by an import) and may still be reported.

    Allowed, unblocked and kept ones are left out, and those reported, barred or tried ATTEMPTS times (history: handle,
    attempts, status, no_retry).
    """
    keyed = lambda df: df.select(handle_key(F.col("handle")).alias("key")).distinct()
    rows = enforcement.where("verified and not legacy").select("key").distinct()
    entry = listed.groupBy(handle_key(F.col("handle")).alias("key")).agg(F.min("display_name").alias("display_name"))
    kept = latest_actions(adjudications).where("action = 'KEEP' or unblock_requested").select("key")
    rows = rows.join(entry, "key").join(keyed(allowed).unionByName(keyed(unblocked)).unionByName(kept).distinct(), "key", "left_anti")
    past = history.select(handle_key(F.col("handle")).alias("key"), "attempts", "status", "no_retry")
    rows = rows.join(past, "key", "left").where(F.coalesce((F.col("status") != "REPORTED") & ~F.col("no_retry") & (F.col("attempts") < ATTEMPTS), F.lit(True)))
    return rows.select("key", report_option(F.col("key"), F.col("display_name"), exclusions).alias("option"), (F.coalesce("attempts", F.lit(0)) + 1).alias("attempt"))


def list_groups(listed: DataFrame, allowed: DataFrame, adjudications: DataFrame, unblocked: DataFrame, enforcement: DataFrame, outcomes: DataFrame) -> DataFrame:
    """key, pos and group of each listed account (pos, handle) for one owner: SKIPPED_KEPT, BLOCKED, GONE, GAVE_UP or PENDING, in that precedence."""
    keyed = lambda df, name: df.select(handle_key(F.col("handle")).alias("key"), F.lit(True).alias(name)).distinct()
    kept = latest_actions(adjudications).where("action = 'KEEP' or unblock_requested").select("key", F.lit(True).alias("kept"))
    rows = listed.select("pos", handle_key(F.col("handle")).alias("key"))
    for side in (keyed(allowed, "allow"), keyed(unblocked, "asked"), kept, enforcement.where("verified").select("key", F.lit(True).alias("blocked")).distinct()):
        rows = rows.join(side, "key", "left")
    rows = rows.join(outcomes.select(handle_key(F.col("handle")).alias("key"), "status", "attempts"), "key", "left")
    gave_up = (F.col("status") == "GAVE_UP") | (F.col("attempts") >= ATTEMPTS)
    group = F.when(F.coalesce("allow", "asked", "kept", F.lit(False)), "SKIPPED_KEPT").when(F.col("blocked"), "BLOCKED").when(F.col("status") == "GONE", "GONE").when(gave_up, "GAVE_UP").otherwise("PENDING")
    return rows.select("pos", "key", group.alias("group"))


def list_status(groups: DataFrame, opted_in: bool) -> DataFrame:
    """One row: how many listed accounts are in each group, whether none is pending, and whether a batch is due."""
    count = lambda name: F.count_if(F.col("group") == name)
    rows = groups.agg(F.count("*").alias("on_list"), *[count(g).alias(g.lower()) for g in ("PENDING", "BLOCKED", "SKIPPED_KEPT", "GONE", "GAVE_UP")])
    return rows.withColumns({"finished": F.col("pending") == 0, "needs_batch": F.lit(opted_in) & (F.col("pending") > 0)})


def blocked_since(outcomes: DataFrame, since: Column) -> DataFrame:
    """One row, n: the accounts that the list's job has verified as blocked since then (outcomes: status, updated_at)."""
    return outcomes.agg(F.count_if(F.col("status").isin("BLOCKED", "ALREADY_BLOCKED") & (F.col("updated_at") > since)).alias("n"))


def task_lines(plan: DataFrame, order: list[str], template: str) -> DataFrame:
    """n, line: a batch (handle, basis; few rows by nature) as the numbered lines of a task, by a format of number, handle and basis."""
    place = F.row_number().over(Window.orderBy(*order))
    return plan.withColumn("n", place).select("n", F.format_string(template, "n", handle_key(F.col("handle")), "basis").alias("line"))


def list_batch(groups: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """The next batch: the first pending accounts of the list, 1 to BATCH_MOST of them."""
    return groups.where("group = 'PENDING'").orderBy("pos", "key").limit(max(1, min(size, BATCH_MOST))).select("pos", "key")


def planned_outcomes(outcomes: DataFrame, batch: DataFrame, name: str) -> DataFrame:
    """outcomes (key, status, attempts, batch) after a batch (key) was planned: new ones are PLANNED, failed ones stay FAILED."""
    new = batch.select("key", F.lit(name).alias("_batch"))
    rows = outcomes.join(new, "key", "full")
    hit = F.col("_batch").isNotNull()
    status = F.when(hit & (F.coalesce("status", F.lit("")) != "FAILED"), "PLANNED").otherwise(F.col("status"))
    return rows.select("key", status.alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("_batch", "batch").alias("batch"))


def outcomes_after(outcomes: DataFrame, records: DataFrame) -> DataFrame:
    """outcomes (key, status, attempts) after a batch's enforcement_records(): the last record of each planned account counts."""
    mine = records.where(~F.array_contains("problems", NOT_PLANNED)).groupBy("key").agg(F.max_by(F.struct("verified", "already_blocked", "gone", "attempted", "stop_reason"), "seq").alias("x"))
    rows = outcomes.join(mine, "key", "full")
    n = F.coalesce("attempts", F.lit(0))
    stopped = F.col("x.stop_reason").isNotNull() & ~F.col("x.attempted")
    failed = ~F.col("x.verified") & ~F.col("x.gone") & ~stopped
    status = (
        F.when(F.col("x").isNull(), F.col("status")).when(F.col("x.verified"), F.when(F.col("x.already_blocked"), "ALREADY_BLOCKED").otherwise("BLOCKED")).when(F.col("x.gone"), "GONE").when(stopped, "PLANNED")
        .when(n + 1 >= ATTEMPTS, "GAVE_UP").otherwise("FAILED")
    )
    return rows.select("key", status.alias("status"), (n + F.when(F.coalesce(failed, F.lit(False)), 1).otherwise(0)).alias("attempts"))


def may_start(moments: DataFrame, batches: DataFrame) -> DataFrame:
    """For each moment (job, moment, last_ingest, backoff_until) whether a batch may be planned, or why not, and the earliest time.

    A backoff comes first, then the pause after an ingest, then the number of batches (job, planned_at) in the 24 hours before.
    Moments and batches stand in one window by time, so that a job's batches aren't joined with all of its moments.
    """
    none = lambda c: F.lit(None).cast(moments.schema[c].dataType).alias(c)
    asked = moments.select("job", "moment", "last_ingest", "backoff_until", F.lit(None).cast(batches.schema["planned_at"].dataType).alias("planned_at"))
    made = batches.select("job", *[none(c) for c in ("moment", "last_ingest", "backoff_until")], "planned_at")
    day = Window.partitionBy("job").orderBy(F.unix_micros(F.coalesce("moment", "planned_at").cast("timestamp"))).rangeBetween(-86_399_999_999, 0)
    rows = asked.unionByName(made).withColumns({"in_day": F.count("planned_at").over(day), "first": F.min("planned_at").over(day)}).where("moment is not null")
    pause_end = F.expr(f"last_ingest + interval {PAUSE_MINUTES} minutes")
    backing, pausing, full = F.col("moment") < F.col("backoff_until"), F.col("moment") < pause_end, F.col("in_day") >= BATCHES_A_DAY
    why = F.when(backing, "BACKOFF").when(pausing, "PAUSE").when(full, "DAILY_LIMIT")
    earliest = F.when(backing, F.col("backoff_until")).when(pausing, pause_end).when(full, F.expr("first + interval 24 hours"))
    return rows.select("job", "moment", why.alias("wait"), earliest.alias("earliest"))


def kept_batches(batches: DataFrame) -> DataFrame:
    """The last BATCHES_KEPT batches of each job."""
    place = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("planned_at"), F.desc("batch")))
    return batches.withColumn("place", place).where(F.col("place") <= BATCHES_KEPT).drop("place")


def unblock_requests(requests: DataFrame, blocks: DataFrame, queue: DataFrame, adjudications: DataFrame) -> DataFrame:
    """What an owner's requests (handle, words) to unblock do: the tier before, whether it disagrees, and whether the queue gets an entry.

    An account with an open entry (queue: handle, status) gets none; an account that only the owner blocked has OWNER_BLOCK
    before; without a block before there is no auto-block to disagree with.
    """
    open_ = queue.where("status in ('QUEUED', 'FAILED_RETRY')").select(handle_key(F.col("handle")).alias("key"), F.lit(True).alias("open")).distinct()
    block = blocks.groupBy(handle_key(F.col("handle")).alias("key")).agg(F.max("tier").alias("tier"))
    asked = requests.groupBy(handle_key(F.col("handle")).alias("key")).agg(F.min("words").alias("words"))
    rows = asked.join(block, "key", "left").join(open_, "key", "left").join(latest_actions(adjudications).select("key", "action"), "key", "left")
    before = F.coalesce("tier", F.when(F.col("action") == "BLOCK", "OWNER_BLOCK"))
    return rows.select(
        "key", "words", before.alias("tier_before"), F.when(before.isNotNull(), "DISAGREE").otherwise("NO_AUTO_BLOCK").alias("agreement"), F.lit("KEEP").alias("action"), F.col("open").isNull().alias("queued"),
        F.when(before.isNotNull(), F.concat(F.lit("owner asked to unblock; auto-block tier "), before)).alias("recheck_reason"),
    )


def unblock_results(rows: DataFrame, queue: DataFrame) -> DataFrame:
    """Unblock reports, cut at each batch's first stop, with result: UNBLOCKED only for a queued account that was seen unblocked after a reload."""
    queued = queue.where("status in ('QUEUED', 'FAILED_RETRY')").select(handle_key(F.col("handle")).alias("key"), F.lit(True).alias("queued")).distinct()
    r = until_stop(rows, "seq", "batch").withColumn("key", handle_key(F.col("handle"))).join(queued, "key", "left")
    good = F.coalesce("queued", F.lit(False)) & _true("handle_reverified") & _true("unblock_clicked") & _true("reloaded") & _true("shows_unblocked")
    return r.select("batch", "seq", "key", F.when(F.col("stop_reason").isNotNull(), "STOPPED").when(good, "UNBLOCKED").otherwise("FAILED_RETRY").alias("result"))


def recorded_blocks(existing: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Blocks (key, tier, status) after verdicts (key, tier, status) are recorded: one that is VERIFIED isn't planned again."""
    new = verdicts.select("key", F.col("tier").alias("_tier"), F.col("status").alias("_status"))
    rows = existing.join(new, "key", "full")
    stays = F.col("_status").isNull() | ((F.col("status") == "VERIFIED") & (F.col("_status") == "PLANNED"))
    stays = F.coalesce(stays, F.lit(False))
    return rows.select("key", F.when(stays, F.col("tier")).otherwise(F.col("_tier")).alias("tier"), F.when(stays, F.col("status")).otherwise(F.col("_status")).alias("status"))


def patched(adjudications: DataFrame, patches: DataFrame) -> DataFrame:
    """Adjudications (id, handle, record: a map) in which each handle's latest record has its patches (n, handle, patch) merged, later over earlier.

    Patches of a handle without adjudications change nothing.
    """
    names_ = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("k", "n", "v"))), lambda x: F.struct(x["k"], x["v"])))
    last = patches.select(handle_key(F.col("handle")).alias("key"), "n", F.explode("patch").alias("k", "v")).groupBy("key", "k").agg(F.max("n").alias("n"), F.max_by("v", "n").alias("v"))
    patch = last.groupBy("key").agg(names_.alias("patch"))
    rows = adjudications.withColumn("key", handle_key(F.col("handle")))
    newest = rows.groupBy("key").agg(F.max("id").alias("id"), F.lit(True).alias("newest"))
    rows = rows.join(newest, ["key", "id"], "left").join(patch, "key", "left")
    hit = F.coalesce("newest", F.lit(False)) & F.col("patch").isNotNull()
    merged = F.map_concat(F.map_filter("record", lambda k, _: ~F.map_contains_key("patch", k)), F.col("patch"))
    return rows.select("id", "handle", F.when(hit, merged).otherwise(F.col("record")).alias("record"))


def offers(instances: DataFrame, answers: DataFrame) -> DataFrame:
    """instance, ask_now, answer, answered_at, words and opted_in of each instance: its last answer (instance, id, yes, answered_at, words) to the one-time offer of the list's job.

    An owner is asked until there is an answer; a later yes or no, in whatever words, takes its place.
    """
    last = answers.where(F.col("yes").isNotNull()).groupBy("instance").agg(F.max_by(F.struct("yes", "answered_at", "words"), F.struct("answered_at", "id")).alias("x"))
    rows = instances.select("instance").distinct().join(last, "instance", "left")
    answer = F.when(F.col("x.yes"), "YES").when(~F.col("x.yes"), "NO")
    return rows.select("instance", F.col("x").isNull().alias("ask_now"), answer.alias("answer"), F.col("x.answered_at").alias("answered_at"), F.col("x.words").alias("words"), F.coalesce("x.yes", F.lit(False)).alias("opted_in"))


def resumed(pauses: DataFrame, offered: DataFrame) -> DataFrame:
    """Back-offs (instance, began, backoff_until) without those that the owner's later yes ended."""
    yes = offered.where("opted_in").select("instance", "answered_at")
    rows = pauses.join(yes, "instance", "left")
    return rows.select("instance", "began", F.when(F.coalesce(F.col("answered_at") > F.col("began"), F.lit(False)), None).otherwise(F.col("backoff_until")).alias("backoff_until"))
