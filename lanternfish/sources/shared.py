"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[int, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir.

    Where that is unset, a session on one machine gets a folder there; any other raises, as its machines share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.setdefault(id(spark.sparkContext), "") or tempfile.mkdtemp(prefix="shared-")
        _own[id(spark.sparkContext)] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written and read again, which cuts their lineage."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, a_task: int = 20_000) -> DataFrame:
    """The rows dealt to tasks of about that many each, for work that takes long per row: a file of short rows is few tasks by its bytes."""
    return df.repartition(max(1, -(-df.count() // a_task)))


def few(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A side that is small by nature, with a broadcast hint; more rows than that raise."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} rows where few are expected")
    return F.broadcast(df)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """The rows with their number (from 1) in the order of a column of distinct values.

    Ranges of the order are numbered by their own tasks and moved by the counts of the ranges before, of which there are few; so
    no task gets all rows.
    """
    parts = written(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return parts.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def met(rows: DataFrame, key: str, name: str, slot: int = 1_000) -> DataFrame:
    """Each two rows of one key, once: key, a and b (their names, a < b) and a_x, b_x of each other column x.

    The rows of a key are dealt to slots of about `slot` rows by a hash of the name, and each two slots meet in a cell of their
    own, so that no task gets all pairs of a key.
    """
    rest = [c for c in rows.columns if c not in (key, name)]
    slots = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.ceil(F.col("_n") / slot).cast("int").alias("_slots"))
    rows = rows.join(slots, key).withColumn("_slot", F.pmod(F.xxhash64(name), F.col("_slots")).cast("int"))
    whole = F.struct(name, *rest)
    left = rows.withColumn("_other", F.explode(F.expr("sequence(_slot, _slots - 1)"))).select(key, F.col("_slot").alias("_i"), F.col("_other").alias("_j"), whole.alias("_a"))
    right = rows.withColumn("_other", F.explode(F.expr("sequence(0, _slot)"))).select(key, F.col("_other").alias("_i"), F.col("_slot").alias("_j"), whole.alias("_b"))
    swap = F.col(f"_a.{name}") > F.col(f"_b.{name}")
    pairs = left.join(right, [key, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col(f"_a.{name}") < F.col(f"_b.{name}")))
    side = lambda one, other: F.when(swap, F.col(other)).otherwise(F.col(one))
    pairs = pairs.select(key, side("_a", "_b").alias("_a"), side("_b", "_a").alias("_b"))
    return pairs.select(key, F.col(f"_a.{name}").alias("a"), F.col(f"_b.{name}").alias("b"), *[F.col(f"_{s}.{c}").alias(f"{s}_{c}") for c in rest for s in "ab"])
