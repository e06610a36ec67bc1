"""The interaction queue's side effects: what each arrival does, seeding, routing to full audits, alerts, owner requests, settings."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.operators.jobs import handle_key
from lanternfish.operators.ledger import latest_actions

c = F.col
LEVELS = ("OFF", "LIGHT_CHECK", "FULL_AUDIT")
# How the interactions of each kind are put into words, for one and for many.
WORDS = (
    ("NEW_FOLLOW", "Followed you", "Followed you"), ("LIKE", "liked 1 recent post", "liked {} recent posts"), ("REPOST", "reposted 1 post", "reposted {} posts"), ("REPLY", "replied to you", "replied {} times"),
    ("QUOTE_POST", "quoted 1 post", "quoted {} posts"), ("MENTION", "mentioned you", "mentioned you {} times"), ("TAG", "tagged you", "tagged you {} times"), ("OTHER", "interacted", "interacted {} times"),
)


@dataclass(frozen=True)
class Settings:
    """How deep each kind of interaction is looked into, and for how many days an audit or a check holds."""

    follows: str = "FULL_AUDIT"
    replies: str = "LIGHT_CHECK"
    quotes: str = "LIGHT_CHECK"
    mentions: str = "LIGHT_CHECK"
    likes_reposts: str = "LIGHT_CHECK"
    likes: bool = True
    reposts: bool = True
    escalate_replies: bool = True
    full_days: int = 30
    light_days: int = 7
    review_flagged: bool = False

    def __post_init__(self):
        for name in ("follows", "replies", "quotes", "mentions", "likes_reposts"):
            if getattr(self, name) not in LEVELS:
                raise ValueError(f"{name} must be one of {', '.join(LEVELS)}")

    @classmethod
    def of(cls, values: dict) -> Settings:
        """Settings from a document; unknown names raise, missing ones stand as they are by default."""
        unknown = sorted(set(values) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**values)

    def level(self, kind: Column, solicits: Column) -> Column:
        deep = F.when((kind == "REPLY") & solicits, "FULL_AUDIT") if self.escalate_replies else F.lit(None).cast("string")
        own = (
            F.when(kind == "NEW_FOLLOW", self.follows).when(kind == "REPLY", self.replies).when(kind == "QUOTE_POST", self.quotes).when(kind.isin("MENTION", "TAG"), self.mentions)
            .when(kind == "LIKE", self.likes_reposts if self.likes else "OFF").when(kind == "REPOST", self.likes_reposts if self.reposts else "OFF").otherwise("LIGHT_CHECK")
        )
        return F.coalesce(deep, own)


def arrivals(rows: DataFrame, cache: DataFrame, queue: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """seq, handle, result and level of each accepted interaction (seq, handle, kind, ts, solicits, triggers: an array of reasons).

    cache: handle, last_full_audit, last_light_check, risk; queue: handle, level of open entries. An account that was audited
    lately, or lately checked as low risk, without a trigger and an open entry, only has its HISTORY_UPDATED; a kind that is
    switched off is IGNORED; the first other arrival is QUEUED and later ones are merged, ESCALATED where they go deeper. As levels
    only rise, the first queued and the first deepest arrival of an account, two aggregates, tell all.
    """
    key = handle_key(c("handle"))
    known = cache.select(key.alias("key"), "last_full_audit", "last_light_check", "risk")
    open_ = queue.select(key.alias("key"), c("level").alias("open_level"))
    days = lambda then: F.abs(F.unix_micros("ts") - F.unix_micros(then)) / 86_400e6
    recent = F.coalesce(days("last_full_audit") <= settings.full_days, F.lit(False)) | (F.coalesce(c("risk") == "LOW", F.lit(False)) & F.coalesce(days("last_light_check") <= settings.light_days, F.lit(False)))
    told = F.size("triggers") > 0
    level = F.when(told, "FULL_AUDIT").otherwise(settings.level(c("kind"), c("solicits")))
    rows = rows.withColumn("key", key).join(known, "key", "left").join(open_, "key", "left")
    rows = rows.withColumns({"quiet": recent & ~told, "level": level, "was_open": c("open_level").isNotNull()})
    rows = rows.select("seq", "handle", "key", "quiet", "level", "was_open", "open_level")
    goes = ~c("quiet") & (c("level") != "OFF")
    first = rows.groupBy("key").agg(F.min(F.when(goes, c("seq"))).alias("queued"))
    rows = rows.join(first, "key")
    merged = c("was_open") | F.coalesce(c("seq") >= c("queued"), F.lit(False))
    deepest = rows.where(merged & (c("level") == "FULL_AUDIT")).groupBy("key").agg(F.min("seq").alias("deepest"))
    rows = rows.join(deepest, "key", "left")
    rises = F.coalesce((c("seq") == c("deepest")) & (F.coalesce("open_level", F.lit("")) != "FULL_AUDIT"), F.lit(False))
    result = (
        F.when(~merged, F.when(c("quiet"), "HISTORY_UPDATED").otherwise("IGNORED")).when(~c("was_open") & (c("seq") == c("queued")), "QUEUED").when(rises, "MERGED_AND_ESCALATED").otherwise("MERGED_INTO_OPEN_ENTRY")
    )
    return rows.select("seq", "handle", result.alias("result"), "level")


def seeded(states: DataFrame, adjudications: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache rows for audited states (handle, enforcement, audited_on) that have none: a date alone counts as its noon."""
    rows = states.withColumn("key", handle_key(c("handle"))).join(cache.select(handle_key(c("handle")).alias("key")).distinct(), "key", "left_anti")
    rows = rows.join(latest_actions(adjudications).select("key", "action"), "key", "left")
    at = F.try_to_timestamp(F.when(F.length("audited_on") == 10, F.concat("audited_on", F.lit(" 12:00:00"))).otherwise(c("audited_on")))
    return rows.select("handle", at.alias("last_full_audit"), c("enforcement").alias("current_action"), c("action").alias("owner_action"))


def routed(records: DataFrame, queue: DataFrame) -> DataFrame:
    """Records (handle, ...) with audit: whether an open FULL_AUDIT entry asks for them; the others are skipped."""
    open_ = queue.where("level = 'FULL_AUDIT'").select(handle_key(c("handle")).alias("key"), F.lit(True).alias("audit")).distinct()
    return records.withColumn("key", handle_key(c("handle"))).join(open_, "key", "left").withColumn("audit", F.coalesce("audit", F.lit(False))).drop("key")


def material_change(before: Column, now: Column) -> Column:
    """Whether a classification holds something new besides NORMAL."""
    return F.size(F.array_remove(F.array_except(now, F.coalesce(before, F.array().cast("array<string>"))), "NORMAL")) > 0


def alerts(states: DataFrame, cache: DataFrame, queue: DataFrame, adjudications: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """handle, reasons of the audited states (handle, enforcement, classification) that came from the queue and call for the owner.

    cache: handle, current_action, current_classification. Nothing alerts unless the owner asked to review flagged accounts.
    """
    key = handle_key(c("handle"))
    old = cache.select(key.alias("key"), "current_action", "current_classification")
    rows = states.withColumn("key", key).join(queue.select(key.alias("key")).distinct(), "key").join(old, "key", "left").join(latest_actions(adjudications).select("key", "judged"), "key", "left")
    crossed = F.coalesce(c("current_action") == "KEEP", F.lit(True))
    reasons = F.array_compact(
        F.array(
            F.when(crossed, F.when(c("enforcement") == "REVIEW", "crossed REVIEW").otherwise(F.concat(F.lit("became "), "enforcement"))), F.when(c("judged").isNull(), "needs owner adjudication"),
            F.when(material_change(c("current_classification"), c("classification")), "classification changed"),
        )
    )
    rows = rows.where((c("enforcement") != "KEEP") & F.lit(settings.review_flagged)).withColumn("reasons", reasons)
    return rows.where(F.size("reasons") > 0).select("handle", "reasons")


def synced(states: DataFrame, cache: DataFrame, at: Column) -> DataFrame:
    """The cache (handle, current_action, last_full_audit) after audits: every audited account has its decision and the time."""
    new = states.select("handle", c("enforcement").alias("current_action"), at.alias("last_full_audit"))
    rest = cache.withColumn("key", handle_key(c("handle"))).join(states.select(handle_key(c("handle")).alias("key")).distinct(), "key", "left_anti").select("handle", "current_action", "last_full_audit")
    return rest.unionByName(new)


def owner_rechecks(queue: DataFrame, asked: DataFrame) -> DataFrame:
    """Open entries (handle, level, priority, reasons) after the owner asked (handle) for fresh audits: an entry goes to FULL_AUDIT, a new one is HIGH."""
    want = asked.select(handle_key(c("handle")).alias("key")).distinct().withColumn("asked", F.lit(True))
    rows = queue.withColumn("key", handle_key(c("handle"))).join(want, "key", "full")
    hit = F.coalesce("asked", F.lit(False))
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    return rows.select(
        F.coalesce("handle", "key").alias("handle"), F.when(hit, "FULL_AUDIT").otherwise(c("level")).alias("level"), F.coalesce("priority", F.lit("HIGH")).alias("priority"),
        F.when(hit, F.array_sort(F.array_union(reasons, F.array(F.lit("owner asked"))))).otherwise(reasons).alias("reasons"),
    )


def resolved(open_alerts: DataFrame, answers: DataFrame) -> DataFrame:
    """Alerts (id, handle, status) after answers (handle, how): an account's open ones take the answer's status."""
    how = answers.groupBy(handle_key(c("handle")).alias("key")).agg(F.min("how").alias("how"))
    rows = open_alerts.withColumn("key", handle_key(c("handle"))).join(how, "key", "left")
    return rows.select("id", "handle", F.when(c("status") == "OPEN", F.coalesce("how", "status")).otherwise(c("status")).alias("status"))


def phrase(counts: dict[str, Column]) -> Column:
    """An account's interactions in words, from its counts by kind."""
    parts = [F.when(counts[kind] == 1, one).when(counts[kind] > 1, F.replace(F.lit(many), F.lit("{}"), counts[kind].cast("string"))) for kind, one, many in WORDS]
    text = F.array_join(F.array_compact(F.array(*parts)), " + ")
    text = F.when(text == "", "Interacted with you").otherwise(text)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000))
