"""Coverage, continuity, repurposing, second passes, decision gates and verdict tiers as column expressions over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish import config

c = F.col


def _known(name: str) -> Column:
    """Neither null nor empty."""
    return c(name).isNotNull() & (c(name).cast("string") != "")


def _says_none(name: str) -> Column:
    return F.coalesce(F.lower(name).rlike("no replies|hasn't replied|has not replied|never replied|posts blank|0 posts|no posts"), F.lit(False))


def coverage(records: DataFrame) -> DataFrame:
    """Each record with its coverage components (c_*), coverage_score and evidence_state.

    A kind of content that doesn't exist on the account counts as covered; counts that are null are unknown.
    """
    w = config.COVERAGE
    none_at_all = c("post_count") == 0
    is_none = F.coalesce(none_at_all, F.lit(False))
    half = lambda test: F.when(test, 0.5).otherwise(0.0)
    one = lambda test: F.when(test, 1).otherwise(0)
    posts = (
        F.when(is_none, w["ORIGINAL_POSTS"])
        .when(c("n_posts").isNull(), 0)
        .when((c("n_posts") == 0) & _says_none("post_summary"), w["ORIGINAL_POSTS"])
        .otherwise(w["ORIGINAL_POSTS"] * F.least(F.lit(1.0), c("n_posts") / F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce("post_count", F.lit(5))))))
    )
    replies = (
        F.when(c("n_replies").isNull(), F.when(is_none, w["REPLIES"]).otherwise(0))
        .when((c("n_replies") == 0) & (_says_none("reply_summary") | is_none), w["REPLIES"])
        .otherwise(w["REPLIES"] * F.least(F.lit(1.0), c("n_replies") / 3))
    )
    month = lambda n: F.substring(n, 1, 4).cast("int") * 12 + F.substring(n, 6, 2).cast("int")
    young = F.coalesce(month("date_collected") - month("joined") < 6, F.lit(False))
    older = F.when(c("older_sampled") | young | is_none, w["OLDER_CONTENT"]).otherwise(0)
    whole = F.coalesce((c("post_count") > 0) & (F.coalesce("n_posts", F.lit(0)) + F.coalesce("n_replies", F.lit(0)) >= c("post_count")), F.lit(False))
    parts = {
        "c_profile": w["PROFILE"] * (half(_known("display_name")) + half(c("bio").isNotNull())),
        "c_about": w["ABOUT_PAGE"] * (one(c("joined").isNotNull()) + one(_known("country")) + one(c("username_changes").isNotNull())) / 3,
        "c_posts": F.when(whole, w["ORIGINAL_POSTS"]).otherwise(posts),
        "c_replies": F.when(whole, w["REPLIES"]).otherwise(replies),
        "c_older": F.when(whole, w["OLDER_CONTENT"]).otherwise(older),
        "c_links": w["LINKS_CONTACTS"] * (half(c("any_link_known")) + half(c("website_known"))),
        "c_counts": w["COUNTS"] * (one(c("followers").isNotNull()) + one(c("following").isNotNull()) + one(c("post_count").isNotNull())) / 3,
    }
    rows = records.withColumns({n: e.cast("double") for n, e in parts.items()})
    score = F.bround(sum((c(n) for n in parts), F.lit(0.0))).cast("int")
    nothing = ~_known("display_name") & ~_known("bio") & c("post_count").isNull() & c("joined").isNull()
    gone = c("collection_status").isin("SUSPENDED", "PROTECTED", "NOT_FOUND", "NOT_LOADED") | (nothing & (c("quality") == "NONE"))
    state = F.when(gone, "UNAVAILABLE").when(score >= config.SUFFICIENT_AT, "SUFFICIENT").when(score >= config.PARTIAL_AT, "PARTIAL").otherwise("INSUFFICIENT")
    return rows.withColumns({"coverage_score": score, "evidence_state": state})


def continuity(records: DataFrame) -> DataFrame:
    """Records (human_score, has_h003, has_other_human, evidence_state) with continuity_state and substantial."""
    strong = (c("human_score") >= config.CONTRARY_HUMAN_CONTINUITY) | c("has_h003")
    state = (
        F.when(strong, "EVIDENCE_OF_HUMANITY").when(c("has_other_human"), "SOME_EVIDENCE").when(c("evidence_state").isin("SUFFICIENT", "PARTIAL"), "NO_EVIDENCE_FOUND").otherwise("NOT_SEARCHED")
    )
    return records.withColumns({"continuity_state": state, "substantial": strong})


def repurposed(records: DataFrame) -> DataFrame:
    """Records with repurposed_score, is_repurposed and compound_strong."""
    renamed = F.coalesce((c("username_changes") >= 1) & (F.substring("last_change", 1, 4).cast("int") >= F.substring("date_collected", 1, 4).cast("int")), F.lit(False))
    persona = F.concat_ws(" ", F.coalesce("display_name", F.lit("None")), F.coalesce("bio", F.lit("None"))).rlike("(?iU)" + config.PERSONA_WORDS)
    moved = c("has_d007") | F.coalesce(c("username_changes") >= 1, F.lit(False))
    dormant = c("max_year_gap") >= 2
    points = [(c("has_d007"), 50), (renamed, 10), (persona & moved, 15), (dormant, 15), (dormant & c("solicits"), 10)]
    total = sum((F.when(test, n).otherwise(0) for test, n in points), F.lit(0))
    score = F.least(F.lit(100), F.when(c("has_d007"), total).otherwise(F.least(total, F.lit(40))))
    is_it = score >= config.REPURPOSED_AT
    return records.withColumns({"repurposed_score": score.cast("int"), "is_repurposed": is_it, "compound_strong": is_it & c("malicious_strong")})


def second_pass(rows: DataFrame) -> DataFrame:
    """Second-pass records with coverage, required, missing and unverified lists, complete and result.

    rows: done, available, sampled, unobservable, basis_types, basis, verified, paraphrased, gone, checks_done (arrays of string),
    all_examined, answered, contrary (booleans).
    """
    none = F.expr("array()").cast("array<string>")
    when = lambda test, *names: F.when(test, F.array(*map(F.lit, names))).otherwise(none)
    has = lambda name, *values: F.arrays_overlap(c(name), F.array(*map(F.lit, values)))
    denom = F.array_except("available", "unobservable")
    known = F.array(*[F.lit(x) for x in ("PROFILE_HISTORY", "REPLIES", "OLDER_CONTENT", "ORIGINAL_POSTS")])
    required = F.array_union(F.array_union(F.array_intersect(known, c("available")), F.array_intersect("basis_types", "available")), when(has("available", "EXTERNAL_LINKS") & has("basis", *config.LINK_BASIS), "EXTERNAL_LINKS"))
    checks = F.concat(
        F.array(F.lit("contradictory_evidence")),
        when(has("available", "REPLIES"), "real_conversations"),
        when(has("available", "OLDER_CONTENT"), "long_term_continuity", "older_posts"),
        when(has("available", "PROFILE_HISTORY"), "account_predates_behavior"),
        when(has("basis", *config.REPEAT_BASIS), "duplicated_text_legit_explanation"),
        when(has("basis", *config.QUOTE_BASIS), "common_public_source_quote"),
    )
    out = rows.withColumns(
        {
            "pass_coverage": F.when(F.size(denom) == 0, 100).otherwise(F.bround(100.0 * F.size(F.array_intersect(F.array_intersect("sampled", "available"), denom)) / F.size(denom))).cast("int"),
            "missing": F.array_sort(F.array_except(F.array_except(required, c("sampled")), c("unobservable"))),
            "unverified": F.array_sort(F.array_union(F.array_except("basis", "verified"), F.array_intersect("basis", "paraphrased"))),
            "checks_missing": F.array_sort(F.array_except(checks, c("checks_done"))),
        }
    )
    complete = (c("all_examined") | (F.size("missing") == 0)) & (F.size("unverified") == 0) & (F.size("checks_missing") == 0) & c("answered")
    result = F.when(~c("done"), "PENDING").when(c("contrary") | (F.size("gone") > 0), "REFUTES").when(complete, "CONFIRMS").otherwise("INCOMPLETE")
    return out.withColumns({"complete": complete & c("done"), "result": result})


def decided(rows: DataFrame) -> DataFrame:
    """The outcome ladder. rows: the five malicious scores, network_coordination, human, path1, strong_groups, compound_strong, n_groups,
    strong_feature, evidence_state, complete, result, substantial, contrary, network_confirmed, review_floor."""
    top = F.greatest(*[c(s.lower()) for s in config.MALICIOUS_SCORES])
    path2 = (c("strong_groups") + F.when(c("compound_strong"), 1).otherwise(0) >= config.PATH2_MIN_STRONG_GROUPS) & (top >= config.REVIEW_SCORE)
    eligible = (c("path1") | path2) & (c("strong_groups") > 0)
    enough, against = c("evidence_state") == "SUFFICIENT", c("substantial") | c("contrary")
    outcome = (
        F.when(c("evidence_state") == "UNAVAILABLE", "UNKNOWN")
        .when(eligible & enough & c("complete") & (c("result") == "CONFIRMS") & ~against, "BLOCK_CONFIRMED")
        .when(eligible & against, "REVIEW")
        .when(eligible & (c("result") == "PENDING"), "BLOCK_CANDIDATE")
        .when(eligible & (c("result") == "REFUTES"), "REVIEW")
        .when(eligible & ~enough, "REVIEW_INSUFFICIENT_DATA")
        .when(eligible, "REVIEW")
        .when(top >= config.REVIEW_SCORE, "REVIEW")
        .when(c("strong_feature"), "REVIEW")
        .when(c("n_groups") >= config.REVIEW_MIN_MODERATE_GROUPS, "REVIEW")
        .when(c("network_confirmed") & (c("network_coordination") >= config.NETWORK_REVIEW_SCORE), "REVIEW")
        .when(c("review_floor"), "REVIEW")
        .when(c("evidence_state") == "INSUFFICIENT", "LOW_EVIDENCE_KEEP")
        .otherwise("KEEP")
    )
    nature = (
        F.when((c("automation") >= 65) & c("substantial"), "MIXED_OR_ASSISTED").when(c("automation") >= 65, "AUTOMATION_LIKELY").when(c("substantial") & (c("automation") < 40), "HUMAN_LIKELY").otherwise("UNKNOWN")
    )
    out = rows.withColumn("outcome", outcome).withColumn("nature", nature)
    enforcement = F.when(c("outcome").isin("LOW_EVIDENCE_KEEP", "UNKNOWN"), "KEEP").when(c("outcome") == "REVIEW_INSUFFICIENT_DATA", "REVIEW").otherwise(c("outcome"))
    return out.withColumn("enforcement", enforcement)


def tiers(rows: DataFrame) -> DataFrame:
    """The verdict by precedence. rows: owner_action, never_listed, enforcement, listed, exact_chat_link, features and strong (arrays of ids),
    owner_scoped, evidence_state, substantial, honest_label, refuted, name_hit, phrase_hit, link_hit, model_score, threshold, basis."""
    overlap = lambda name, values: F.arrays_overlap(c(name), F.array(*map(F.lit, values)))
    guarded = (c("evidence_state") != "UNAVAILABLE") & ~c("substantial") & ~c("honest_label") & ~c("refuted")
    strong = F.array_intersect("strong", F.array(*map(F.lit, config.STRONG_BASIS)))
    compound = overlap("features", config.PERSONA) & overlap("features", config.FUNNEL) & overlap("features", config.LURE)
    pattern_ok = guarded & c("evidence_state").isin("SUFFICIENT", "PARTIAL") & ((F.size(strong) > 0) | compound)
    solicits = F.size(F.array_except(F.array_intersect(F.array_union("features", strong), F.array(*map(F.lit, config.SOLICIT))), strong)) > 0
    i001 = F.array_contains(strong, "I001")
    pattern = (
        F.when(F.size(strong) == 0, "CELEBRITY_PERSONA_FUNNEL_SCAM")
        .when(c("owner_scoped") & (F.size(strong) == 1) & i001, "OWNER_POLICY_IDENTITY")
        .when(i001 & solicits, "CELEBRITY_IMPERSONATION_PLUS_SOLICITATION")
        .when(i001, "CELEBRITY_OR_COMPANY_IMPERSONATION")
        .when(F.array_contains(strong, "S004"), "SCAM_OR_DM_FUNNEL_SCRIPT")
        .otherwise("MALICIOUS_LINK")
    )
    companion = F.arrays_overlap(F.array_union("features", "strong"), F.array(*map(F.lit, config.LINK_COMPANIONS)))
    shared = F.when(c("name_hit"), "NAME_RULE").when(c("phrase_hit"), "PHRASE_RULE").when(c("link_hit") & companion & guarded, "WATCHLISTED_LINK_PLUS_LURE")
    trained = c("model_score").isNotNull() & (c("model_score") >= c("threshold")) & c("basis") & guarded
    tier = (
        F.when(c("owner_action") == "KEEP", None)
        .when(c("owner_action") == "BLOCK", "OWNER_BLOCK")
        .when(c("never_listed"), None)
        .when(c("enforcement") == "BLOCK_CONFIRMED", "BLOCK_CONFIRMED")
        .when(c("listed") | c("exact_chat_link"), "KNOWN_SCAM_LIST")
        .when(pattern_ok | shared.isNotNull(), "AUTO_BLOCK_PATTERN")
        .when(trained, "OWNER_TRAINED")
    )
    out = rows.withColumn("tier", tier).withColumn("pattern", F.when(c("tier") == "AUTO_BLOCK_PATTERN", F.when(pattern_ok, pattern).otherwise(shared)))
    settled = F.coalesce(c("owner_action").isin("KEEP", "BLOCK"), F.lit(False)) | c("never_listed") | c("tier").isNotNull()
    near = F.coalesce(c("model_score") >= config.HELD_FACTOR * c("threshold"), F.lit(False))
    return out.withColumn("held", ~settled & ((c("enforcement") != "KEEP") | c("link_hit") | near))


def agreement(enforcement: Column, action: Column) -> Column:
    """How an owner's action (BLOCK, KEEP or null) meets the engine's decision."""
    blocking = enforcement.isin("BLOCK_CANDIDATE", "BLOCK_CONFIRMED")
    agrees = F.when(action == "BLOCK", blocking).when(action == "KEEP", enforcement == "KEEP")
    return F.when(agrees.isNull(), "NO_OWNER_ACTION").when(agrees, "AGREE").when(enforcement == "REVIEW", F.concat(F.lit("REVIEW_RESOLVED_"), action)).otherwise("DISAGREE")


# What counts as plain words about an account's nature.
HUMAN_SAID = r"\b(real person|is human|a human|real human|actual person|not a bot)\b"
DOUBT_SAID = r"\b(maybe|probably|might|perhaps|possibly|could be|not sure)|\?|\b(not|isn't|isn’t|no|never)\s+(an?\s+)?(bot|automated)"
BOT_SAID = (
    r"\b(this|that|it|he|she|account)\s*(is|'s|’s|was)\s+(definitely\s+|clearly\s+|obviously\s+)?(an?\s+)?(bot|automated account|spambot|automated)\b|\bclearly\s+automated\b"
    r"|^\s*(an?\s+)?(bot|spambot|bot account)[\s.!]*$|\b(this|that|it|account)\s*(is|'s|’s|was)\s+(definitely\s+|clearly\s+|obviously\s+)?(an?\s+)?fake(\s+account)?\b"
)


def explicit_nature(text: Column) -> Column:
    """HUMAN_LIKELY or BOT_LIKELY if a reaction's words say so without doubt; words for a human win, a bare reaction says nothing."""
    said = lambda pattern: text.rlike("(?iU)" + pattern)
    return F.when(said(HUMAN_SAID), "HUMAN_LIKELY").when(~said(DOUBT_SAID) & said(BOT_SAID), "BOT_LIKELY")


def reaction(text: Column) -> Column:
    """KEEP or BLOCK for a reaction mark or word; any other raises."""
    word = F.lower(F.trim(text))
    known = F.when(word.isin("✅", "keep"), "KEEP").when(word.isin("❌", "block"), "BLOCK")
    return F.when(known.isNotNull() | text.isNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown reaction: "), text)))
