"""Tables with a layout of their own: frozen sets with a tree of digests, tables upserted by buckets, tables of one owner each."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.sources.shared import written
from lanternfish.sources.stores import exists

#: Rows of a leaf block of a frozen set, about; digests that a node of its tree joins.
LEAF, FAN = 1_000, 256
BUCKETS = 256


def _hashed(rows: DataFrame) -> Column:
    """The hash of a row's canonical JSON, whose fields stand in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c != "sha256")), {"ignoreNullFields": "false"}), 256)


def leaves(rows: DataFrame, bits: int) -> DataFrame:
    """block, n (of its rows) and digest; a row's block is told by the first bits of its hash, so that blocks are of one size whatever the keys."""
    counted = rows.select(_hashed(rows).alias("sha256")).groupBy("sha256").agg(F.count("*").alias("n"))
    block = F.shiftright(F.conv(F.substring("sha256", 1, 12), 16, 10).cast("long"), 48 - bits) if bits else F.lit(0).cast("long")
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "sha256", "n")))
    return counted.groupBy(block.alias("block")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(listed, ","), 256).alias("digest"))


def root(leaf: DataFrame) -> str:
    """The digest over all leaf digests, by levels of nodes that join FAN each; that of no rows is the hash of nothing."""
    level = leaf.select("block", "digest")
    while level.limit(2).count() > 1:
        listed = F.array_sort(F.collect_list(F.concat_ws(":", F.format_string("%020d", "block"), "digest")))
        level = written(level.groupBy(F.floor(F.col("block") / FAN).alias("block")).agg(F.sha2(F.array_join(listed, ","), 256).alias("digest")))
    top = level.first()
    return top["digest"] if top else ""


def freeze(rows: DataFrame, path: str, set_id: str, sources: list[str] = (), description: str = "") -> dict:
    """Write a set once: its rows, the digests of their blocks and, last, a manifest with the digest of all. A second time raises."""
    spark = rows.sparkSession
    if exists(spark, f"{path}/manifest"):
        raise FileExistsError(f"{set_id} is frozen; make a new set")
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    kept = spark.read.parquet(f"{path}/rows")
    n = kept.count()
    bits = max(0, (n // LEAF).bit_length())
    leaves(kept, bits).write.mode("overwrite").parquet(f"{path}/blocks")
    manifest = {"set_id": set_id, "root": root(spark.read.parquet(f"{path}/blocks")), "rows": n, "bits": bits, "sources": list(sources), "description": description, "immutable": True}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def manifest_of(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def changed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """block, n, n_now of the blocks whose rows aren't those that were frozen: changed, removed or added."""
    then = spark.read.parquet(f"{path}/blocks")
    now = leaves(spark.read.parquet(f"{path}/rows"), manifest_of(spark, path)["bits"])
    both = then.join(now.select("block", F.col("n").alias("n_now"), F.col("digest").alias("digest_now")), "block", "full")
    return both.where(~F.col("digest").eqNullSafe(F.col("digest_now"))).select("block", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_now", F.lit(0)).alias("n_now"))


def load_frozen(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A frozen set's manifest and rows; a set that was touched raises and names blocks that differ."""
    manifest = manifest_of(spark, path)
    wrong = [r["block"] for r in changed_blocks(spark, path).orderBy("block").limit(20).collect()]
    if wrong or root(spark.read.parquet(f"{path}/blocks")) != manifest["root"]:
        raise ValueError(f"{manifest['set_id']} was changed after it was frozen: blocks {wrong or 'of the manifest'}")
    return manifest, spark.read.parquet(f"{path}/rows")


def bucketed(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert(path: str, new: DataFrame, key: str, buckets: int = BUCKETS) -> list[int]:
    """Put rows in place of those of the same key in a table laid out by buckets of the key; returns the buckets that were touched.

    Only these are read and written, so ten rows cost ten buckets of any table at most. Of several new rows of one key one
    is taken, the same in each run; null keys are one key. Repeating it changes nothing.
    """
    spark = new.sparkSession
    columns = new.columns
    best = F.min(F.struct(F.xxhash64(*columns), F.struct(*columns).alias("row"))).alias("x")
    fresh = written(new.groupBy(F.col(key).alias("_key")).agg(best).select("x.row.*").withColumn("bucket", bucketed(F.col(key), buckets)))
    touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())
    if exists(spark, path):
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        rest = old.join(fresh.select(F.col(key).alias("_key"), F.lit(True).alias("_new")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        fresh = written(rest.select(*columns, "bucket").unionByName(fresh))
    fresh.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)
    return touched


def slug(account: Column) -> Column:
    """An owner's name as part of a path: its letters, digits and underscores in lower case, or "owner"; never that of the starter files."""
    name = F.regexp_replace(F.lower(F.regexp_replace(F.trim(F.coalesce(account, F.lit(""))), "^@+", "")), "[^a-z0-9_]", "")
    name = F.when(name == "", "owner").otherwise(name)
    return F.when(name.startswith("_template"), F.concat(F.lit("x"), name)).otherwise(name)


class Instances:
    """Tables below a folder, each cut by the owner they belong to; an instance reads and writes its own part alone."""

    def __init__(self, spark: SparkSession, folder: str, owner: str):
        self.spark, self.folder = spark, folder
        self.instance = spark.range(1).select(slug(F.lit(owner))).first()[0]

    def write(self, name: str, rows: DataFrame) -> None:
        """Append rows to the owner's part; rows that say they are another's raise."""
        if "instance" in rows.columns:
            other = F.raise_error(F.concat(F.lit("a row belongs to "), F.col("instance")))
            rows = rows.withColumn("instance", F.when(F.col("instance").eqNullSafe(F.lit(self.instance)), F.col("instance")).otherwise(other.cast("string")))
        else:
            rows = rows.withColumn("instance", F.lit(self.instance))
        rows.write.mode("append").partitionBy("instance").parquet(f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        """The owner's rows; the filter is on the partition, so that no other file is opened."""
        return self.spark.read.parquet(f"{self.folder}/{name}").where(F.col("instance") == self.instance)

    def checked(self, df: DataFrame) -> DataFrame:
        """The plan, if each file that it scans below the folder is the owner's; else it raises."""
        mine = f"/instance={self.instance}/"
        others = [f for f in self.scanned(df) if mine not in f]
        if others:
            raise PermissionError(f"the plan reads what isn't {self.instance}'s: {others[0]}")
        return df

    def scanned(self, df: DataFrame) -> list[str]:
        """The partitions that the plan's scans keep after its partition filters, as paths."""
        found, todo = [], [df._jdf.queryExecution().sparkPlan()]
        while todo:
            node = todo.pop()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
            if node.nodeName().startswith("Scan "):
                kept = node.relation().location().listFiles(node.partitionFilters(), node.dataFilters())
                for i in range(kept.size()):
                    files = kept.apply(i).files()
                    if files.size():
                        found.append(files.apply(0).getPath().toString())
        return [f for f in found if self.folder.split(":", 1)[-1].lstrip("/") in f]
