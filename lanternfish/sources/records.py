"""Account records: JSON folders, checked and ordered, and the rows that the operators take from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions import links, schema

_BLOCK = "struct<sampled_count: long, items: array<struct<text: string, date: string, target: string>>>"
_VALUES = "array<struct<value: string>>"
RECORD = (
    f"handle string, display_name string, bio string, website string, date_collected string, provenance struct<row: long, website: string>, recent_original_posts {_BLOCK}, recent_replies {_BLOCK}, "
    f"older_activity_sample {_BLOCK}, wallet_addresses {_VALUES}, telegram_or_whatsapp_destinations {_VALUES}, referral_codes {_VALUES}, suspicious_domains {_VALUES}, links {_VALUES}, "
    "image_hashes array<string>, impersonation_features array<struct<feature_id: string, evidence: string, owner_policy_basis: struct<RULE: string>>>"
)
#: What a record must have; all else may be missing or UNKNOWN.
RULES = {"type": "object", "required": ["handle"], "properties": {"handle": {"type": "string", "pattern": "^@?[A-Za-z0-9_]{1,15}$"}}}
BLOCKS = {"recent_original_posts": "POST", "recent_replies": "REPLY", "older_activity_sample": "OLDER"}
#: Fields of values: the kind of fact that each holds.
FIELDS = {"wallet_addresses": "WALLET", "telegram_or_whatsapp_destinations": "SHARED_CONTACT", "referral_codes": "REFERRAL_ID", "suspicious_domains": "SHARED_DOMAIN"}
LAST_ROW = 1_000_000


def known(text: Column) -> Column:
    """The text, or null where it is empty or says UNKNOWN."""
    return F.when((text != "") & (text != "UNKNOWN"), text)


def read(spark: SparkSession, folder: str, rules: dict = RULES, strict: bool = False) -> DataFrame:
    """A folder of JSON records, one a file: file, record fields and problems. Strictly read, a record with problems raises.

    Fields that say UNKNOWN where the schema wants another type are null. Files are checked in parallel; their order is
    given by ordered(), not by the folder.
    """
    text = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    rows = text.select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0).alias("file"), F.from_json("value", RECORD).alias("record"), schema.checked(F.col("value"), rules).alias("problems"))
    if strict:
        fault = F.raise_error(F.concat(F.col("file"), F.lit(": "), F.array_join("problems", "; ")))
        rows = rows.withColumn("problems", F.when(F.size("problems") > 0, fault.cast("array<string>")).otherwise(F.col("problems")))
    return rows.select("file", "record.*", "problems")


def ordered(records: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Records with place: by the row of their provenance, then handle; or as an order (n, handle) names them, others behind."""
    row, key = F.coalesce(F.col("provenance.row"), F.lit(LAST_ROW)), F.lower("handle")
    if order is None:
        return records.withColumn("place", F.struct(row.alias("row"), key.alias("key")))
    first = order.groupBy(F.lower(F.regexp_replace(F.trim("handle"), "^@+", "")).alias("_key")).agg(F.min("n").alias("_n"))
    rows = records.join(first, key == F.col("_key"), "left")
    return rows.withColumn("place", F.struct(F.coalesce("_n", F.lit(2**62)).alias("n"), row.alias("row"), key.alias("key"))).drop("_key", "_n")


def iso_date(text: Column) -> Column:
    """The date at the beginning of a text; null where there is none."""
    return F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)))


def items(records: DataFrame) -> DataFrame:
    """handle, kind, value, date, target, src of everything observed in records: texts, biography, values, website, image hashes."""
    none = lambda kind: F.lit(None).cast(kind)
    item = lambda kind, value, date, target, src: F.struct(F.lit(kind).alias("kind"), value.alias("value"), date.alias("date"), target.alias("target"), F.lit(src).alias("src"))
    bare = lambda kind, value, src: item(kind, value, none("date"), none("string"), src)
    sampled = lambda src: lambda x: item("TEXT", x["text"], iso_date(x["date"]), x["target"], src)
    valued = lambda kind, field: lambda x: bare(kind, x["value"], field)
    parts = [F.transform(F.col(f"{block}.items"), sampled(src)) for block, src in BLOCKS.items()]
    parts += [F.array(bare("BIO", F.col("bio"), "BIO"))]
    parts += [F.transform(F.col(field), valued(kind, field)) for field, kind in FIELDS.items()]
    parts += [F.array(bare("SHARED_DOMAIN", F.col("provenance.website"), "website")), F.transform("image_hashes", lambda h: bare("IMAGE_REUSE", h, "image"))]
    empty = F.array().cast("array<struct<kind:string,value:string,date:date,target:string,src:string>>")
    rows = records.select("handle", F.explode(F.concat(*[F.coalesce(p, empty) for p in parts])).alias("x")).select("handle", "x.*")
    return rows.where((F.col("value") != "") & ((F.col("kind") == "TEXT") | (F.col("value") != "UNKNOWN")))


def year_gaps(records: DataFrame) -> DataFrame:
    """handle, n_years, max_gap: the greatest step between the years of sampled items in order; null with fewer than two."""
    dates = F.flatten(F.filter(F.array(*[F.transform(F.col(f"{block}.items"), lambda x: x["date"]) for block in BLOCKS]), lambda a: a.isNotNull()))
    years = F.array_sort(F.transform(F.filter(dates, lambda d: d.rlike(r"^\d{4}")), lambda d: F.substring(d, 1, 4).cast("int")))
    steps = F.zip_with(F.slice("years", 2, 1_000_000), F.slice("years", 1, F.greatest(F.size("years") - 1, F.lit(0))), lambda b, a: b - a)
    return records.select("handle", years.alias("years")).select("handle", F.size("years").alias("n_years"), F.array_max(steps).alias("max_gap"))


def record_links(records: DataFrame, **kept: Column) -> DataFrame:
    """handle, what is kept by name, and links: the distinct normalised links of a record's name, biography, website, link fields and sampled texts, 60 at most."""
    none = F.array().cast("array<string>")
    texts = [F.array("display_name", "bio", "website", F.col("provenance.website"))]
    texts += [F.transform(F.col(f), lambda x: x["value"]) for f in ("links", "telegram_or_whatsapp_destinations", "suspicious_domains")]
    texts += [F.transform(F.col(f"{block}.items"), lambda x: x["text"]) for block in BLOCKS]
    every = F.filter(F.concat(*[F.coalesce(t, none) for t in texts]), lambda t: (t != "") & (t != "UNKNOWN"))
    rows = records.select("handle", *[c.alias(name) for name, c in kept.items()], F.array_join(every, "\n\n").alias("_text"))
    found = F.filter(F.transform(F.concat(links.in_text(F.col("_text")), links.chat_numbers(F.col("_text"))), links.normalized), lambda n: n.isNotNull())
    return rows.select("handle", *kept, links.deduplicated(found).alias("links"))


def each_link(rows: DataFrame, *names: str) -> DataFrame:
    """The named columns and the parts of each link of rows. The outer form keeps Spark from looking for rows without links first, for which it would find all links two times more."""
    return rows.select(*names, F.explode_outer("links").alias("n")).where("n is not null").select(*names, "n.*")


def policy_text(records: DataFrame) -> DataFrame:
    """handle, text: what an owner's policy is matched against: handle, name, biography, sampled texts and evidence, a line each."""
    none = F.array().cast("array<string>")
    texts = [F.array("display_name", "bio", "handle"), *[F.transform(F.col(f"{block}.items"), lambda x: x["text"]) for block in BLOCKS], F.transform("impersonation_features", lambda x: x["evidence"])]
    return records.select("handle", F.array_join(F.filter(F.concat(*[F.coalesce(t, none) for t in texts]), lambda t: (t != "") & (t != "UNKNOWN")), "\n").alias("text"))


def rests_on_policy(records: DataFrame) -> DataFrame:
    """handle, policy_based: whether an identity claim rests on an owner's rule, not on a claim to be the person."""
    claim = F.exists("impersonation_features", lambda x: (x["feature_id"] == "I001") & x["owner_policy_basis"]["RULE"].isNotNull() & (x["owner_policy_basis"]["RULE"] != "CLAIM_TO_BE"))
    return records.select("handle", F.coalesce(claim, F.lit(False)).alias("policy_based"))
