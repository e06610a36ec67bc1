"""Known-account lists, watchlists, records and reports: readers and renderers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "handle string, display_name string, bio string, links array<string>, source string, added string, verified boolean, reason string, removed string, removed_reason string"


def parsed_list(lines: DataFrame) -> DataFrame:
    """Entries of a list's lines (n, value): JSON objects or bare @handles; # begins a comment, a bad line raises with its number."""
    text = F.trim("value")
    rows = lines.where(~text.startswith("#") & (text != "")).withColumn("text", text)
    bare = F.col("text").rlike("^@?[A-Za-z0-9_]{1,15}$")
    entry = F.from_json("text", ENTRY)
    good = bare | F.coalesce(F.col("text").startswith("{") & entry["handle"].isNotNull(), F.lit(False))
    error = F.raise_error(F.concat(F.lit("bad list line "), F.col("n").cast("string")))
    rows = rows.withColumn("entry", F.when(~good, error.cast(rows.select(entry).schema[0].dataType)).otherwise(entry))
    handle = F.when(bare, F.regexp_replace("text", "^@", "")).otherwise(F.col("entry.handle"))
    fields = [n.split()[0] for n in ENTRY.split(", ")[1:]]
    out = rows.select("n", handle.alias("handle"), *[F.col(f"entry.{f}").alias(f) for f in fields])
    return out.withColumn("tombstone", F.col("removed").isNotNull())


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a list file. Files are small and numbered by line within one partition."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "value"))
    return parsed_list(lines.withColumn("n", F.col("n") + 1))


def rendered_list(entries: DataFrame, updated: str, maintainer: bool = False) -> DataFrame:
    """n, value: the lines of a list: a header with counts and the date, entries by handle, then tombstones; empty fields are left out.

    Only maintainers may render the shared list; for others it raises.
    """
    if not maintainer:
        raise PermissionError("the shared list is changed by maintainers only")
    fields = [n.split()[0] for n in ENTRY.split(", ")]
    gone = F.coalesce("tombstone", F.lit(False))
    counts = entries.agg(F.count_if(~gone).alias("a"), F.count_if(gone).alias("r"))
    head = counts.select(F.struct(F.lit(0).alias("part"), F.lit("").alias("key")).alias("n"), F.format_string(f"# accounts: %d, removed: %d, updated: {updated}", "a", "r").alias("value"))
    lines = entries.select(F.struct(F.when(gone, 2).otherwise(1).alias("part"), F.lower("handle").alias("key")).alias("n"), F.to_json(F.struct(*fields)).alias("value"))
    return head.unionByName(lines).orderBy("n")


def updated_on(lines: DataFrame) -> DataFrame:
    """The date of the last comment of a list's lines (n, value) that names one."""
    dated = F.regexp_extract("value", r"^\s*#.*updated:\s*(\d{4}-\d{2}-\d{2})", 1)
    return lines.select("n", dated.alias("day")).where("day <> ''").agg(F.max_by("day", "n").alias("updated"))


def ingested(existing: DataFrame, new: DataFrame, allowed: DataFrame) -> DataFrame:
    """New rows (seq, handle, …) with what becomes of each: ADDED, or skipped as INVALID, ALLOWLISTED, REMOVED_BEFORE, LISTED or DUPLICATE.

    The first arrival of a handle counts; handles compare without case.
    """
    key = F.lower(F.regexp_replace(F.trim("handle"), "^@+", ""))
    rows = new.withColumn("key", key)
    old = existing.select(key.alias("key"), F.coalesce("tombstone", F.lit(False)).alias("tombstone")).groupBy("key").agg(F.max("tombstone").alias("tombstone"))
    rows = rows.join(old, "key", "left").join(allowed.select(key.alias("key"), F.lit(True).alias("allowed")).distinct(), "key", "left")
    first = F.row_number().over(Window.partitionBy("key").orderBy("seq")) == 1
    result = (
        F.when(~F.coalesce(F.col("key").rlike("^[a-z0-9_]{1,15}$"), F.lit(False)), "INVALID").when(F.col("allowed"), "ALLOWLISTED").when(F.col("tombstone"), "REMOVED_BEFORE").when(F.col("tombstone").isNotNull(), "LISTED").when(~first, "DUPLICATE").otherwise("ADDED")
    )
    return rows.withColumn("result", result).drop("key", "tombstone", "allowed")


def read_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of JSON records, one in a file, unknown values as null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def frozen(rows: DataFrame, key: str) -> DataFrame:
    """The rows with the hash of their canonical JSON, whose fields stand in the order of their names."""
    return rows.withColumn("sha256", F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)).orderBy(key)


def verified_frozen(rows: DataFrame) -> DataFrame:
    """Frozen rows; one that was changed raises."""
    fields = sorted(c for c in rows.columns if c != "sha256")
    same = F.sha2(F.to_json(F.struct(*fields)), 256) == F.col("sha256")
    return rows.withColumn("sha256", F.when(same, F.col("sha256")).otherwise(F.raise_error(F.lit("a frozen row was changed"))))
