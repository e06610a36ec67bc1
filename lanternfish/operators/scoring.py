"""Evidence scores: best instances, contributions, corroboration, fact groups, gated scores and the action ladder.

Feature instances are rows (handle, pos, feature_id, n, n_min, fact_key); pos is the order in the record. The first step leaves
at most one row per account and feature, so that whatever the number of instances of an account, the later windows see a
bounded number of rows per account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.sources import registry

#: Instances of a task, and the buckets in which accounts are counted.
TASK_ROWS, BUCKETS = 500_000, 10_000


def effective_count() -> Column:
    """The count, else the least count, else 1."""
    return F.coalesce(F.col("n"), F.col("n_min"), F.lit(1)).cast("long")


def rejected(instances: DataFrame) -> DataFrame:
    """Instances that never count, with the reason."""
    spark = instances.sparkSession
    known = registry.features(spark).where("category <> 'NETWORK'").select("feature_id")
    bad = instances.join(F.broadcast(known), "feature_id", "left_anti")
    reason = F.when(F.col("feature_id").isin(*config.FORBIDDEN_PROXIES), "FORBIDDEN_PROXY").otherwise("UNKNOWN_OR_NETWORK_FEATURE_IN_RECORD")
    return bad.withColumn("reason", reason)


def best_instances(instances: DataFrame) -> DataFrame:
    """The instance of greatest count per account and accepted feature; the first of a tie."""
    known = registry.features(instances.sparkSession).where("category <> 'NETWORK'").select("feature_id")
    rows = instances.join(F.broadcast(known), "feature_id").withColumn("cnt", effective_count())
    best = F.max_by(F.struct("cnt", "pos", "fact_key"), F.struct(F.col("cnt"), -F.col("pos")))
    return rows.groupBy("handle", "feature_id").agg(best.alias("b")).select("handle", "feature_id", "b.cnt", "b.pos", "b.fact_key")


def contributions(best: DataFrame) -> DataFrame:
    """One row per account, feature and score: the weight after the least count, scaling and cap, rounded half to even."""
    spark = best.sparkSession
    rows = best.join(F.broadcast(registry.features(spark)), "feature_id").join(F.broadcast(registry.weights(spark)), "feature_id")
    below = F.col("cnt") < F.col("min_count")
    lower = F.when(F.col("strength") == "STRONG", "MODERATE").when(F.col("strength") == "MODERATE", "WEAK").otherwise("WEAK")
    factor = F.when(below & (F.col("strength") == "WEAK"), 0.0).when(below, 0.5).otherwise(1.0)
    extra = F.when(below, 0).otherwise(F.col("cnt") - F.col("min_count"))
    raw = F.col("base") * factor + F.when((F.col("base") > 0) & (extra > 0), F.col("per_extra") * extra).otherwise(0)
    capped = F.greatest(-F.col("cap"), F.least(F.col("cap").cast("double"), raw))
    return rows.select(
        "handle", "feature_id", "score", "category", F.coalesce("fact_key", "fact_group").alias("group"), "cnt",
        F.when(below, lower).otherwise(F.col("strength")).alias("strength"),
        F.bround(capped).cast("int").alias("weight"),
        (F.col("corroborated") | (F.coalesce(F.col("corroborated_score"), F.lit("")) == F.col("score"))).alias("needs_other"),
        (F.col("can_block") & ~below).alias("can_block"),
    )


def corroborated(rows: DataFrame) -> DataFrame:
    """Weights that need corroboration become 0 unless another group raises the same score by itself, not weakly."""
    carries = (F.col("strength") != "WEAK") & ~F.col("needs_other") & (F.col("weight") > 0)
    each = Window.partitionBy("handle", "score")
    groups = [f(F.when(carries, F.col("group"))).over(each) for f in (F.min, F.max)]
    other = F.coalesce((groups[0] != F.col("group")) | (groups[1] != F.col("group")), F.lit(False))
    lost = F.col("needs_other") & (F.col("weight") > 0) & ~other
    return rows.withColumn("weight", F.when(lost, 0).otherwise(F.col("weight")))


def chosen(rows: DataFrame) -> DataFrame:
    """Per account, score and fact group the weight of greatest size; a tie goes to the positive, then to the first feature."""
    order = Window.partitionBy("handle", "score", "group").orderBy(F.abs("weight").desc(), F.col("weight").desc(), "feature_id")
    return rows.where("weight <> 0").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def scores(picked: DataFrame) -> DataFrame:
    """One row per account and score that has evidence: value 0 to 100 after the cap on weak evidence and the two gates."""
    w, strength = F.col("weight"), F.col("strength")
    sums = picked.groupBy("handle", "score").agg(
        F.sum(w).alias("total"),
        F.sum(F.when((w > 0) & (strength == "WEAK"), w).otherwise(0)).alias("weak"),
        F.max(F.when((w > 0) & (strength == "STRONG"), 1).otherwise(0)).alias("strong"),
        F.max(F.when((w > 0) & (strength != "WEAK"), 1).otherwise(0)).alias("moderate"),
    )
    total = F.greatest(F.lit(0), F.least(F.lit(100), F.col("total") - F.greatest(F.lit(0), F.col("weak") - config.WEAK_TOTAL_CAP)))
    malicious = F.col("score").isin(*config.MALICIOUS_SCORES)
    first = F.when(malicious & (total >= config.BLOCK_SCORE) & (F.col("strong") == 0), config.BLOCK_SCORE - 1).otherwise(total)
    gated = F.when(malicious & (first >= config.REVIEW_SCORE) & (F.col("moderate") == 0), config.REVIEW_SCORE - 1).otherwise(first)
    return sums.select("handle", "score", gated.cast("int").alias("value"), (gated != total).alias("gated"))


#: The short names of scores in drivers, in their order.
SHORT = {"AUTOMATION": "AUTO", "SPAM": "SPAM", "SCAM": "SCAM", "IMPERSONATION": "IMP", "DECEPTION": "DEC", "HUMAN_CONTINUITY": "HUM"}


def drivers(picked: DataFrame, valued: DataFrame) -> DataFrame:
    """handle, drivers: for each score above 0, in order, its value and the features that make it."""
    ids = picked.where("weight <> 0").groupBy("handle", "score").agg(F.array_join(F.array_sort(F.collect_set("feature_id")), "+").alias("ids"))
    place = F.array_position(F.array(*map(F.lit, SHORT)), F.col("score"))
    short = F.element_at(F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair]), F.col("score"))
    rows = valued.where((F.col("value") > 0) & F.col("score").isin(*SHORT)).join(ids, ["handle", "score"], "left")
    text = F.concat(short, F.lit(" "), F.col("value").cast("string"), F.lit("="), F.coalesce("ids", F.lit("")))
    per = rows.groupBy("handle").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), text.alias("text")))).alias("x"))
    return per.select("handle", F.array_join(F.transform("x", lambda d: d["text"]), "; ").alias("drivers"))


def evidence(picked: DataFrame) -> DataFrame:
    """handle, strength, n_groups, features: what raises malicious scores, per strength."""
    raising = picked.where(F.col("score").isin(*config.MALICIOUS_SCORES) & (F.col("weight") > 0))
    return raising.groupBy("handle", "strength").agg(F.count_distinct("group").alias("n_groups"), F.array_join(F.array_sort(F.collect_set("feature_id")), "|").alias("features"))


def actions(contributed: DataFrame, picked: DataFrame, valued: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One row per account: top score, counts of groups, block paths and the action, by the ladder in its fixed order.

    verdicts (handle, verdict, significant_contrary) are second passes; an account without one has none.
    """
    names = [*config.MALICIOUS_SCORES, "HUMAN_CONTINUITY"]
    wide = valued.groupBy("handle").agg(*[F.coalesce(F.max(F.when(F.col("score") == s, F.col("value"))), F.lit(0)).alias(s.lower()) for s in names])
    positive = picked.where(F.col("score").isin(*config.MALICIOUS_SCORES) & (F.col("weight") > 0))
    triggers = positive.groupBy("handle").agg(
        F.count_distinct(F.when(F.col("strength") != "WEAK", F.col("group"))).alias("groups"),
        F.count_distinct(F.when(F.col("strength") == "STRONG", F.col("group"))).alias("strong_groups"),
        *[F.max(F.when((F.col("score") == s) & (F.col("strength") == "STRONG") & F.col("can_block"), 1).otherwise(0)).alias(f"trigger_{s.lower()}") for s in config.MALICIOUS_SCORES],
    )
    human = contributed.where("category = 'HUMAN' and weight <> 0").groupBy("handle").agg(
        F.max(F.when(F.col("strength") == "STRONG", 1).otherwise(0)).alias("human_strong"), F.max(F.when(F.col("strength") != "WEAK", 1).otherwise(0)).alias("human_moderate")
    )
    rows = contributed.select("handle").distinct().join(wide, "handle", "left").join(triggers, "handle", "left").join(human, "handle", "left").na.fill(0)
    if verdicts is not None:
        rows = rows.join(verdicts, "handle", "left")
    else:
        rows = rows.withColumns({"verdict": F.lit(None).cast("string"), "significant_contrary": F.lit(None).cast("boolean")})
    others = [s.lower() for s in config.MALICIOUS_SCORES if s != "AUTOMATION"]
    top = F.greatest(*[F.col(s.lower()) for s in config.MALICIOUS_SCORES])
    plain = [(F.col(s) >= config.BLOCK_SCORE) & (F.col(f"trigger_{s}") == 1) for s in others]
    any_trigger = F.greatest(*[F.col(f"trigger_{s.lower()}") for s in config.MALICIOUS_SCORES]) == 1
    automated = (F.col("automation") >= config.BLOCK_SCORE) & (F.greatest(*[F.col(s) for s in others]) >= config.REVIEW_SCORE) & any_trigger
    path1 = plain[0] | plain[1] | plain[2] | plain[3] | automated
    path2 = (F.col("strong_groups") >= config.PATH2_MIN_STRONG_GROUPS) & (top >= config.REVIEW_SCORE)
    eligible = path1 | path2
    contrary = (F.col("human_continuity") >= config.CONTRARY_HUMAN_CONTINUITY) | (F.col("human_strong") == 1) | F.coalesce("significant_contrary", F.lit(False))
    verdict = F.coalesce("verdict", F.lit(""))
    action = (
        F.when(eligible & contrary, "REVIEW")
        .when(eligible & (F.col("human_moderate") == 1) & (verdict != "CONFIRMED"), "REVIEW")
        .when(eligible & (verdict == "CONFIRMED"), "BLOCK")
        .when(eligible & (verdict == "DOWNGRADE_TO_REVIEW"), "REVIEW")
        .when(eligible, "BLOCK_CANDIDATE_PENDING_2ND_PASS")
        .when(top >= config.REVIEW_SCORE, "REVIEW")
        .when(F.col("strong_groups") > 0, "REVIEW")
        .when(F.col("groups") >= config.REVIEW_MIN_MODERATE_GROUPS, "REVIEW")
        .when(verdict == "DOWNGRADE_TO_REVIEW", "REVIEW")
        .otherwise("KEEP")
    )
    return rows.select("handle", top.alias("top_score"), F.col("groups").alias("n_groups"), F.col("strong_groups").alias("n_strong_groups"), path1.alias("path1"), path2.alias("path2"), action.alias("action"))


def dealt(instances: DataFrame) -> DataFrame:
    """Instances dealt to tasks by account, TASK_ROWS a task; so the tasks become more with the input, not greater.

    Accounts are counted in BUCKETS by a hash. A bucket of more than a task's rows, which one account fills, is aggregated
    before it is dealt: its accounts have at most a row per feature then.
    """
    spark = instances.sparkSession
    bucket = F.pmod(F.xxhash64("handle"), F.lit(BUCKETS))
    counts = {r["bucket"]: r["n"] for r in instances.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    heavy = [b for b, n in counts.items() if n > max(TASK_ROWS, 4 * total // BUCKETS)]
    rows = instances.select("handle", "pos", "feature_id", F.col("n").cast("long").alias("n"), F.col("n_min").cast("long").alias("n_min"), "fact_key")
    if heavy:
        none = F.lit(None).cast("long").alias("n_min")
        few = best_instances(rows.where(bucket.isin(heavy))).select("handle", "pos", "feature_id", F.col("cnt").alias("n"), none, "fact_key")
        rows = rows.where(~bucket.isin(heavy)).unionByName(few)
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS)), "handle")


def scored(instances: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corroborated contributions, the chosen ones and the scores; accounts are brought together once, before all else."""
    each = corroborated(contributions(best_instances(dealt(instances))))
    picked = chosen(each)
    return each, picked, scores(picked)


def derived_features(records: DataFrame, as_of: str = "date_collected") -> DataFrame:
    """Feature instances that follow from an account's own figures: handle, feature_id, n.

    records: handle, date_collected, joined, followers, following, post_count, username_changes, last_change, n_replies,
    generic_reply_ratio, n_items, original_content_ratio, reply_ratio, repost_ratio, activity_hours, near_duplicates,
    location_consistency. Unknown figures are null and give no feature.
    """
    month = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}"), F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int"))
    now, followers = month(as_of), F.greatest(F.col("followers"), F.lit(1))
    changed = (now - month("last_change")).between(0, 1)
    rules = [
        ("D001", F.col("location_consistency") == "MISMATCH", None),
        ("W001", (now - month("joined")).between(0, 2), None),
        ("W004", (F.col("following") >= 20 * followers) & (F.col("post_count") < 20), None),
        ("W006", (F.col("following") >= config.W006_MIN_FOLLOWING) & (F.col("following") >= config.W006_FOLLOW_RATIO * followers), None),
        ("W005", F.coalesce(changed, F.lit(False)) | (F.col("username_changes") >= 3), None),
        ("A004", (F.col("n_replies") >= 30) & (F.col("generic_reply_ratio") >= 0.5), None),
        ("A006", (F.col("n_items") >= 30) & (F.col("original_content_ratio") < 0.05), None),
        ("A007", (F.col("n_items") >= 30) & (F.col("reply_ratio") + F.col("repost_ratio") >= 0.9), None),
        ("A009", F.col("activity_hours") >= 20, None),
        ("A001", F.col("near_duplicates") >= 10, F.col("near_duplicates")),
        ("A002", F.col("near_duplicates").between(3, 9), F.col("near_duplicates")),
    ]
    found = [F.when(test, F.struct(F.lit(name).alias("feature_id"), (F.lit(None) if n is None else n).cast("long").alias("n"))) for name, test, n in rules]
    return records.select("handle", F.explode(F.array_compact(F.array(*found))).alias("x")).select("handle", "x.feature_id", "x.n")
