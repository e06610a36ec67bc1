"""Small documents of an instance and of the shared rules: list files with a fallback, watchlists, allowlists, policies, versions, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.operators.jobs import handle_key
from lanternfish.sources.lists import read_list

LINKS = "LINKS array<struct<url: string, match_type: string, domain: string, kind: string, source: string, added: string>>, NEVER_WATCHLIST_DOMAINS array<string>, PROSE_AUTOLINK_IGNORE array<string>, DOMAIN_ONLY_NEVER array<string>"
ALLOWED = "HANDLES array<string>, NAME_EXCLUSION_WORDS array<string>"
LEGACY = "ACCOUNTS array<struct<handle: string, display_name: string, evidence: string, source: string, added: string, reason: string>>, REMOVED array<struct<handle: string, reason: string, removed: string>>"
POLICY = (
    "POLICY_ID string, PROTECTED_IDENTITIES array<struct<NAME: string, ALIASES: array<string>, RULES: array<struct<RULE: string, BLOCK_ELIGIBLE: boolean>>>>, "
    "RULE_ANSWERS array<struct<QUESTION_ID: string, PATTERN: string, REQUIRED_FEATURES: array<string>, MIN_ENFORCEMENT: string, HINTS: array<string>>>"
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row of a JSON document; all its fields are null where the file is missing."""
    if not exists(spark, path):
        return spark.range(1).select(F.from_json(F.lit("{}"), schema).alias("x")).select("x.*")
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("x")).select("x.*")


def accounts(spark: SparkSession, path: str, legacy: str | None = None) -> DataFrame:
    """The entries of a list file, or, where there is none, of a legacy document with accounts and removals."""
    if exists(spark, path):
        return read_list(spark, path)
    rows = document(spark, legacy or path, LEGACY)
    kept = rows.select(F.posexplode("ACCOUNTS").alias("n", "x")).select("n", handle_key(F.col("x.handle")).alias("handle"), "x.display_name", F.col("x.evidence").alias("bio"), "x.source", "x.added", "x.reason")
    gone = rows.select(F.posexplode("REMOVED").alias("n", "x")).select("n", handle_key(F.col("x.handle")).alias("handle"), "x.removed", F.col("x.reason").alias("removed_reason"))
    every = kept.unionByName(gone, allowMissingColumns=True)
    return every.withColumn("tombstone", F.col("removed").isNotNull())


def watchlist(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, tuple[str, ...]]]:
    """pos, entry, entry_type of a watchlist's links, and its short lists of domains that are never watched, of prose, and of domains that need a path."""
    rows = document(spark, path, LINKS)
    links = rows.select(F.posexplode("LINKS").alias("pos", "x")).select("pos", F.col("x.url").alias("entry"), F.coalesce("x.match_type", F.lit("exact")).alias("entry_type"), "x.kind", "x.source", "x.added")
    one = rows.drop("LINKS").first()
    named = zip(("never", "prose", "no_domain"), one, strict=True)
    return links, {name: tuple(x.lower() for x in values or ()) for name, values in named}


def allowlist(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[str, ...]]:
    """handle of an allowlist's entries, plain or objects, and the words that names may hold."""
    rows = document(spark, path, ALLOWED)
    handles = rows.select(F.explode("HANDLES").alias("x")).select(handle_key(F.coalesce(F.get_json_object("x", "$.handle"), F.col("x"))).alias("handle"))
    return handles, tuple(rows.first()["NAME_EXCLUSION_WORDS"] or ())


def policy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An owner's policy: identities (name), enabled rules (identity, rule) that may block, and answers (name, pattern, required, least, hints)."""
    rows = document(spark, path, POLICY)
    people = rows.select(F.explode("PROTECTED_IDENTITIES").alias("p"))
    names = people.select(F.explode(F.concat(F.array("p.NAME"), F.coalesce("p.ALIASES", F.array().cast("array<string>")))).alias("name"))
    enabled = people.select(F.col("p.NAME").alias("identity"), F.explode("p.RULES").alias("r")).where("r.BLOCK_ELIGIBLE").select("identity", "r.RULE")
    answers = rows.select(F.explode("RULE_ANSWERS").alias("a")).select(
        F.col("a.QUESTION_ID").alias("name"), F.col("a.PATTERN").alias("pattern"), F.coalesce("a.REQUIRED_FEATURES", F.array().cast("array<string>")).alias("required"), F.col("a.MIN_ENFORCEMENT").alias("least"), F.col("a.HINTS").alias("hints")
    )
    return names, enabled.withColumnRenamed("RULE", "rule"), answers


def versions(spark: SparkSession, path: str) -> dict[str, str]:
    """The key: value lines of a version file; of a key's lines the first counts."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    pairs = rows.select("n", F.regexp_extract("line", r"^[-*\s]*`?([A-Za-z0-9_ ]+?)`?:\s*(.+?)\s*$", 1).alias("k"), F.regexp_extract("line", r"^[-*\s]*`?([A-Za-z0-9_ ]+?)`?:\s*(.+?)\s*$", 2).alias("v"))
    found: dict[str, str] = {}
    for r in pairs.where("k <> ''").orderBy("n").collect():
        found.setdefault(r["k"], r["v"])
    return found


def baseline(spark: SparkSession, *paths: str) -> DataFrame:
    """baseline (the file's name), handle, action of earlier result files; missing files are left out."""
    found = [p for p in paths if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], "baseline string, handle string, action string")
    rows = spark.read.option("header", True).schema("HANDLE string, ACTION string").option("enforceSchema", False).csv(found)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0).alias("baseline"), F.col("HANDLE").alias("handle"), F.col("ACTION").alias("action"))


def complete(frozen: DataFrame, states: DataFrame) -> DataFrame:
    """A frozen set joined with states by handle; a handle without a state raises."""
    key = handle_key(F.col("handle"))
    rows = frozen.withColumn("key", key).join(states.withColumn("key", key).drop("handle").withColumn("_there", F.lit(True)), "key", "left")
    checked = F.when(F.col("_there"), F.col("handle")).otherwise(F.raise_error(F.concat(F.lit("no state of "), F.col("handle"))))
    return rows.withColumn("handle", checked).drop("key", "_there")


def backfilled(states: DataFrame, features: DataFrame) -> DataFrame:
    """States (handle, features) whose features, where null, are those computed anew (handle, features); what is there stays."""
    key = handle_key(F.col("handle"))
    new = features.select(key.alias("key"), F.col("features").alias("_new"))
    return states.withColumn("key", key).join(new, "key", "left").withColumn("features", F.coalesce("features", "_new")).drop("key", "_new")
