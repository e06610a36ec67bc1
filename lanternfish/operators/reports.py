"""What is exported and counted: score changes, disagreements, open cases, statistics, metrics, classification, tags, second passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.operators.decisions import agreement
from lanternfish.operators.jobs import handle_key
from lanternfish.operators.ledger import latest_actions
from lanternfish.operators.metrics import labels_needed, wilson

c = F.col
BLOCKING = ("BLOCK_CANDIDATE", "BLOCK_CONFIRMED")
# Features whose presence tags an account, kinds of behaviour, checks of a second pass.
FARMING, SCAM_SIGNS = ("S001", "S018", "A003", "S012"), ("S004", "S008")
DISPROOF = (
    "real_conversations", "long_term_continuity", "older_posts", "account_predates_behavior", "duplicated_text_legit_explanation", "common_public_source_quote", "contradictory_evidence",
)
CLAIM_TARGET = 0.98


def _listed(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))


def with_actions(states: DataFrame, adjudications: DataFrame) -> DataFrame:
    """States (handle, ...) with the fields of their latest adjudication, null where there is none."""
    return states.withColumn("key", handle_key(c("handle"))).join(latest_actions(adjudications), "key", "left")


def score_changes(states: DataFrame, baseline: DataFrame) -> DataFrame:
    """handle, before, after of the states whose decision differs from a baseline's (handle, action); a pending candidate is a candidate."""
    old = baseline.select(handle_key(c("handle")).alias("key"), c("action").alias("before"))
    rows = states.withColumn("key", handle_key(c("handle"))).join(old, "key")
    return rows.where(F.regexp_replace("before", "_PENDING_2ND_PASS", "") != c("enforcement")).select("handle", "before", c("enforcement").alias("after"))


def disagreements(states: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Every adjudication (id, handle, action) of a state with how it agrees now; only those that differ, or that turned a review into a block."""
    rows = adjudications.withColumn("key", handle_key(c("handle"))).join(states.select(handle_key(c("handle")).alias("key"), "enforcement"), "key")
    rows = rows.withColumn("agreement", agreement(c("enforcement"), c("action")))
    return rows.where(c("agreement").isin("DISAGREE", "REVIEW_RESOLVED_BLOCK")).select("id", "key", "action", "enforcement", "agreement")


def unresolved(states: DataFrame, adjudications: DataFrame, rechecks: DataFrame) -> DataFrame:
    """handle, because of the flagged states that nobody has judged, and of queued rechecks (handle, reason)."""
    judged = adjudications.select(handle_key(c("handle")).alias("key")).distinct()
    rows = states.where(c("enforcement").isin("REVIEW", "BLOCK_CANDIDATE")).withColumn("key", handle_key(c("handle"))).join(judged, "key", "left_anti")
    why = F.when(c("enforcement") == "BLOCK_CANDIDATE", "second pass pending").when(c("second_pass") == "INCOMPLETE", "second pass incomplete").otherwise("awaiting owner review")
    return rows.select("handle", why.alias("because")).unionByName(rechecks.select("handle", F.concat(F.lit("deeper recheck queued: "), "reason").alias("because")))


def coverage_stats(states: DataFrame, by: str) -> DataFrame:
    """Per group: accounts, least, greatest and upper median coverage, and counts by evidence state.

    The median is found from the counts of the 101 possible scores, so that no task holds a group's accounts.
    """
    counts = states.groupBy(by, "coverage").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(by).orderBy("coverage")
    placed = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy(by))})
    middle = F.min(F.when(c("upto") > F.floor(c("total") / 2), c("coverage")))
    stats = placed.groupBy(by).agg(F.sum("n").alias("accounts"), F.min("coverage").alias("least"), F.max("coverage").alias("greatest"), middle.alias("median"))
    kinds = states.groupBy(by).agg(*[F.count_if(c("evidence_state") == k).alias(k.lower()) for k in ("SUFFICIENT", "PARTIAL", "INSUFFICIENT", "UNAVAILABLE")])
    return stats.join(kinds, by)


def completion(states: DataFrame, adjudications: DataFrame, enforcement: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row of totals: decisions, owner actions, verified and failed blocks (enforcement: key, attempted, verified), what is open, and automatic blocks by status."""
    rows = with_actions(states, adjudications)
    decided = rows.agg(
        F.count("*").alias("accounts"), *[F.count_if(c("enforcement") == e).alias(e.lower()) for e in ("KEEP", "REVIEW", *BLOCKING)],
        F.count_if((c("enforcement") != "KEEP") & c("judged").isNull()).alias("unresolved"), F.count_if(c("evidence_state").isin("INSUFFICIENT", "UNAVAILABLE")).alias("insufficient"), F.count_distinct("cluster").alias("clusters"),
    )
    latest = latest_actions(adjudications).agg(F.count_if(c("action") == "BLOCK").alias("owner_blocks"), F.count_if(c("action") == "KEEP").alias("owner_keeps"))
    per = enforcement.groupBy("key").agg(F.max("verified").alias("v"), F.max(c("attempted") | ~c("verified")).alias("tried"))
    blocked = per.agg(F.count_if(c("v")).alias("blocks_verified"), F.count_if(~c("v") & c("tried")).alias("block_failures"))
    auto = blocks.agg(*[F.count_if(c("status").isin(*s)).alias(n) for n, s in (("auto_blocked", ("VERIFIED",)), ("auto_failed", ("FAILED_RETRY",)), ("auto_pending", ("PLANNED",)))])
    for side in (latest, blocked, auto):
        decided = decided.join(F.broadcast(side), F.lit(True))
    return decided


def metric_family(states: DataFrame, adjudications: DataFrame) -> DataFrame:
    """metric, k, n, value, low, high, can_claim of each metric of decisions against the owner's latest answers.

    Blocks are measured at two points (confirmed; confirmed or candidate), natures on explicit labels alone, and scam and
    impersonation on adjudicated classifications. A metric may be claimed if its lower bound reaches CLAIM_TARGET.
    """
    rows = with_actions(states, adjudications)
    confirmed, flagged = c("enforcement") == "BLOCK_CONFIRMED", c("enforcement").isin(*BLOCKING)
    block, keep = F.coalesce(c("action") == "BLOCK", F.lit(False)), F.coalesce(c("action") == "KEEP", F.lit(False))
    labelled, bot, said = block | keep, c("nature").isin("AUTOMATION_LIKELY", "MIXED_OR_ASSISTED"), F.coalesce(c("nature_label") == "BOT_LIKELY", F.lit(False))
    natured = c("nature_label").isNotNull()
    family = {
        "BLOCK_PRECISION": (confirmed & block, confirmed & labelled), "BLOCK_RECALL": (confirmed & block, block), "BLOCK_PRECISION_FLAGGED": (flagged & block, flagged & labelled), "BLOCK_RECALL_FLAGGED": (flagged & block, block),
        "RECALL_INTO_REVIEW": ((c("enforcement") != "KEEP") & block, block), "FALSE_NEGATIVE_RATE": ((c("enforcement") == "KEEP") & block, block), "KEEP_FALSE_POSITIVE_RATE": (flagged & keep, keep),
        "BOT_DETECTION_PRECISION": (bot & said, bot & natured), "BOT_DETECTION_RECALL": (bot & said, said),
    }
    for name in ("scam", "impersonation"):
        mine, theirs = c(f"is_{name}"), c(f"adjudicated_{name}")
        right = F.coalesce(theirs, F.lit(False))
        family |= {f"{name.upper()}_PRECISION": (mine & right, mine & theirs.isNotNull()), f"{name.upper()}_RECALL": (mine & right, right)}
    counts = rows.agg(*[F.count_if(test).alias(f"{name}_{part}") for name, tests in family.items() for part, test in zip("kn", tests, strict=True)])
    each = F.array(*[F.struct(F.lit(name).alias("metric"), c(f"{name}_k").alias("k"), c(f"{name}_n").alias("n")) for name in family])
    out = counts.select(F.explode(each).alias("x")).select("x.*")
    low, high = wilson(c("k"), c("n"))
    out = out.withColumns({"value": F.when(c("n") > 0, F.bround(c("k") / c("n"), 4)), "low": low, "high": high})
    return out.withColumn("can_claim", F.coalesce(c("low") >= CLAIM_TARGET, F.lit(False)))


#: Cases without an error at which CLAIM_TARGET may be claimed.
CLAIM_LABELS = labels_needed(CLAIM_TARGET)


def classification(rows: DataFrame) -> DataFrame:
    """Rows (spam, scam, impersonation scores; automation; strong and raising: arrays of features; substantial, confirmed_network, repurposed; hints) with classification, nature and likely label."""
    has = lambda column, *ids: F.arrays_overlap(column, F.array(*map(F.lit, ids)))
    found = _listed(
        ((c("spam") >= config.REVIEW_SCORE) | has("strong", "S011"), "SPAM"), ((c("scam") >= config.REVIEW_SCORE) | has("strong", *SCAM_SIGNS), "SCAM"),
        ((c("impersonation") >= config.REVIEW_SCORE) | has("raising", "I001"), "IMPERSONATION"), (c("confirmed_network"), "COORDINATED_NETWORK"), (c("repurposed"), "REPURPOSED_ACCOUNT"),
    )
    every = F.array_distinct(F.concat(found, c("hints")))
    every = F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("NORMAL")))
    automated = c("automation") >= config.REVIEW_SCORE
    nature = F.when(automated & c("substantial"), "MIXED_OR_ASSISTED").when(automated, "AUTOMATION_LIKELY").when(c("substantial") & (c("automation") < 40), "HUMAN_LIKELY").otherwise("UNKNOWN")
    out = rows.withColumns({"classification": every, "nature": nature})
    is_ = lambda name: F.array_contains("classification", name)
    return out.withColumn("label", F.when(is_("IMPERSONATION"), "impersonation").when(is_("SCAM"), "scam").when(c("nature") == "AUTOMATION_LIKELY", "bot").when(is_("SPAM"), "spam").otherwise("uncertain"))


def calibration_tags(rows: DataFrame) -> DataFrame:
    """Rows (action, nature_label, substantial, enforcement, weaker: features below STRONG, strong, confirmed_network, second_pass, disputed, evidence_state) with tags."""
    has = lambda column, *ids: F.arrays_overlap(column, F.array(*map(F.lit, ids)))
    block, keep = F.coalesce(c("action") == "BLOCK", F.lit(False)), F.coalesce(c("action") == "KEEP", F.lit(False))
    stands = c("second_pass") != "REFUTES"
    tags = _listed(
        (F.coalesce(c("nature_label") == "HUMAN_LIKELY", F.lit(False)) | (c("substantial") & keep), "HUMAN_CONTINUITY_POSITIVE_CONTROL"),
        ((c("enforcement") == "REVIEW") & has("weaker", *FARMING), "ENGAGEMENT_FARM_REVIEW_CONTROL"), (block & c("confirmed_network"), "CONFIRMED_COORDINATED_NETWORK"),
        (block & has("strong", "I001") & stands & ~c("disputed"), "CONFIRMED_IMPERSONATION"), (block & has("strong", *SCAM_SIGNS) & stands, "CONFIRMED_SCAM"),
        (c("evidence_state").isin("INSUFFICIENT", "UNAVAILABLE"), "LOW_EVIDENCE_UNKNOWN"),
    )
    return rows.withColumn("tags", tags)


def network_view(states: DataFrame, members: DataFrame, older: DataFrame) -> DataFrame:
    """handle, cluster, evidence, older_cluster, confirmed, coordination: both kinds of network membership of each state.

    members: handle, cluster, evidence; older: handle, cluster, confirmed, score.
    """
    key = handle_key(c("handle"))
    new = members.select(key.alias("key"), "cluster", "evidence")
    old = older.select(key.alias("key"), c("cluster").alias("older_cluster"), "confirmed", "score")
    rows = states.select("handle", key.alias("key")).join(new, "key", "left").join(old, "key", "left")
    return rows.select(
        "handle", F.coalesce("cluster", F.lit("")).alias("cluster"), F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("older_cluster", F.lit("")).alias("older_cluster"),
        (c("cluster").isNotNull() | F.coalesce("confirmed", F.lit(False))).alias("confirmed"), F.coalesce("score", F.lit(0)).alias("coordination"),
    )


def second_pass_templates(scored: DataFrame, features: DataFrame, existing: DataFrame) -> DataFrame:
    """Templates for the candidates (scored: handle, action) that have no second pass yet: handle, status, verdict, features (STRONG ones that raise a score)."""
    basis = features.where("strength = 'STRONG' and raises").groupBy(handle_key(c("handle")).alias("key")).agg(F.array_sort(F.collect_set("feature_id")).alias("features"))
    rows = scored.where("action = 'BLOCK_CANDIDATE_PENDING_2ND_PASS'").withColumn("key", handle_key(c("handle"))).join(existing.select(handle_key(c("handle")).alias("key")), "key", "left_anti")
    rows = rows.join(basis, "key", "left")
    return rows.select("handle", F.lit("PENDING").alias("status"), F.lit("PENDING").alias("verdict"), F.coalesce("features", F.array().cast("array<string>")).alias("features"))


def adversarial_answers(quotes: Column) -> tuple[Column, Column]:
    """The answers that stand in where a verifier gave none: the strongest legitimate case, and what would have to be false."""
    said = F.array_join(F.transform(F.slice(quotes, 1, 2), lambda q: F.concat(F.lit("'"), q, F.lit("'"))), "; ")
    said = F.when(said == "", "the recorded evidence").otherwise(said)
    case = F.concat(F.lit("The account is a fan, parody or commentary account, or a real person quoting/joking, and "), said, F.lit(" is not meant as a real claim or solicitation."))
    false = F.concat(
        F.lit("For the block to fail, "), said, F.lit(" would have to be absent from the live account, labeled as parody/fan/unofficial, a quote from a common public source, or outweighed by real conversations and long-term personal continuity.")
    )
    return case, false


def converted_pass(rows: DataFrame) -> DataFrame:
    """Second passes of the first form in the second form: status, available and sampled kinds, checks, answers; nothing that wasn't recorded is inferred.

    rows: handle, complete, verdict, contrary, post_count, replies_sampled, older_sampled, items, threads, older_checked, human_searched, exhausted, quotes.
    """
    yes = lambda name: F.coalesce(c(name), F.lit(False))
    posts = c("post_count").isNull() | (c("post_count") > 0)
    older = posts & (yes("older_sampled") | yes("older_checked"))
    available = _listed((F.lit(True), "PROFILE_HISTORY"), (posts, "ORIGINAL_POSTS"), (posts & F.coalesce(c("replies_sampled") != 0, F.lit(True)), "REPLIES"), (older, "OLDER_CONTENT"))
    sampled = _listed((F.size("quotes") > 0, "PROFILE_HISTORY"), (F.coalesce(c("items") > 0, F.lit(False)), "ORIGINAL_POSTS"), (F.coalesce(c("threads") > 0, F.lit(False)), "REPLIES"), (yes("older_checked") & older, "OLDER_CONTENT"))
    case, false = adversarial_answers(c("quotes"))
    checks = F.when(yes("human_searched"), F.array(*map(F.lit, DISPROOF))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "handle", F.when(yes("complete"), "DONE").otherwise("PENDING").alias("status"), available.alias("available"), sampled.alias("sampled"), yes("exhausted").alias("all_examined"), checks.alias("checks_done"),
        case.alias("strongest_case"), false.alias("must_be_false"), (yes("contrary") | F.coalesce(c("verdict") == "DOWNGRADE_TO_REVIEW", F.lit(False))).alias("contrary"),
    )


def adjudication_records(rows: DataFrame) -> DataFrame:
    """Owner reactions (handle, enforcement, action, nature, disputed) as records: agreement, adjudicated enforcement and nature, and whether a recheck is queued.

    A reaction says nothing about an account's nature unless its words do (nature); a disputed label leaves it unknown.
    """
    agree = agreement(c("enforcement"), c("action"))
    nature = F.when(c("nature").isNotNull() & ~c("disputed"), c("nature")).otherwise("UNKNOWN")
    reason = F.when(c("nature").isNull(), "no explicit owner nature label").when(c("disputed"), "LABEL_AMBIGUITY").otherwise("owner explicit statement")
    out = rows.withColumns({"agreement": agree, "adjudicated": F.coalesce("action", F.lit("UNRESOLVED")), "adjudicated_nature": nature, "adjudication_reason": reason})
    queued = c("agreement") == "DISAGREE"
    return out.withColumns({"recheck_queued": queued, "recheck": F.when(queued, "PENDING").otherwise("NOT_REQUIRED")})


def nature_word(text: Column) -> Column:
    """Which plain word for the account's nature an owner used."""
    said = lambda pattern: text.rlike("(?iU)" + pattern)
    from lanternfish.operators.decisions import HUMAN_SAID

    fake = r"\b(this|that|it|account)\s*(is|'s|’s|was)\s+(definitely\s+|clearly\s+|obviously\s+)?(an?\s+)?fake(\s+account)?\b"
    return F.when(said(HUMAN_SAID), "HUMAN").when(said(fake) & ~said(r"\bbot\b"), "FAKE").when(said("automated"), "AUTOMATED").otherwise("BOT")


def shortened(text: Column, most: int = 90) -> Column:
    """The text with single blanks, and an ellipsis where it is longer."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, most - 1)), F.lit("…")))


def feature_words(features: Column, most: int = 2) -> Column:
    """The first features in an owner's words, joined by +; features without words are left out."""
    words = F.create_map(*[F.lit(x) for pair in config.FEATURE_WORDS.items() for x in pair])
    said = F.filter(F.transform(features, lambda f: F.try_element_at(words, f)), lambda w: w.isNotNull())
    return F.array_join(F.slice(said, 1, most), " + ")


def stub_states(handles: DataFrame) -> DataFrame:
    """States of listed accounts that were never audited."""
    key = handle_key(c("handle"))
    return handles.select(key.alias("handle"), F.concat(F.lit("https://x.com/"), key).alias("profile_url"), F.lit("NOT_AUDITED").alias("enforcement"), F.lit("UNKNOWN").alias("nature"))


def model_features(contributions: DataFrame, excluded: tuple[str, ...], policy: DataFrame) -> DataFrame:
    """handle, features of the owner's model: features of contributions (handle, feature_id, n, weighs) that count or weigh, and the policy's (handle, identity, rule)."""
    rows = contributions.where(~c("feature_id").isin(*excluded) & ((F.coalesce("n", F.lit(0)) != 0) | c("weighs"))).select("handle", "feature_id")
    marks = policy.select("handle", F.explode(_listed((c("identity"), "OP_IDENTITY"), (c("rule"), "OP_RULE"))).alias("feature_id"))
    return rows.unionByName(marks).groupBy("handle").agg(F.array_sort(F.collect_set("feature_id")).alias("features"))


def training_rows(states: DataFrame, adjudications: DataFrame, human: DataFrame) -> DataFrame:
    """handle, label, human, features of the states (handle, features) whose latest adjudication blocks or keeps; human: handles known as such."""
    known = human.select(handle_key(c("handle")).alias("key"), F.lit(True).alias("known")).distinct()
    rows = with_actions(states, adjudications).where(c("action").isin("BLOCK", "KEEP")).join(known, "key", "left")
    return rows.select("handle", (c("action") == "BLOCK").cast("int").alias("label"), (F.coalesce(c("nature_label") == "HUMAN_LIKELY", F.lit(False)) | F.coalesce("known", F.lit(False))).alias("human"), "features")
