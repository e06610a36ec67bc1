"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.llm.common import small, written

#: Bits of the random sort key.
KEY_BITS = 60
#: Rows that a bucket of the sort key holds on average; a bucket is what one task sorts.
BUCKET_ROWS = 2_048
WEIGHTS = (3, 1, 2)
SIZE = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text, set apart by white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SIZE)), F.lit(0)).cast("long")


def random_key(doc_id: Column | str = "doc_id", text_hash: Column | str = "text_hash") -> Column:
    """A random but repeatable key of KEY_BITS bits from a row's doc_id (null: empty) and the hash of its text, so that rows of one doc_id differ."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in (doc_id, text_hash)])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash and size of documents (doc_id, source, text)."""
    return docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"), size_of(F.col("text")).alias("size"))


def source_targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, weight, target, budget.

    sizes: source, size. The sources by code point, null last, take the weights in turn, repeating. Their targets add up to
    share times all words; a target stops at most times its source's size and what is above is shared again by weight, which
    ends where every target is the lesser of its cap and a common level times its weight. An empty table gives no rows; if
    all sizes are 0, all targets are 0. The sources' totals, not the documents, go through one window.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    every = Window.partitionBy()
    filled = (
        ranked.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("below", F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("above", F.sum("weight").over(every) - F.sum("weight").over(level.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("full", F.col("below") + F.col("cap") / F.col("weight") * F.col("above") <= F.col("total"))
    )
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(rest / open_weight * F.col("weight"))
    return filled.withColumn("target", target).select("source", "source_size", "weight", "target", F.floor("target").cast("long").alias("budget"))


def mixed(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, key, source_size, target and taken of each row of sizes (doc_id, source, size and, if there is one, text_hash).

    Other columns are ignored. Within a source the rows stand in the order of a hash-random key, which splits into buckets of
    about BUCKET_ROWS rows, so that a source with most of the rows is sorted by many tasks. Bucket totals give each bucket's
    prefix sum, a window within the bucket each row's. With S the source's words and B its budget, every row is taken B div S
    times; the rest of the budget is cut exactly, so that the row on the cut is taken in part. Rows of null text have size 0
    and take 0; repeated rows count separately, ties of the key go by doc_id and size. Reruns agree. A null source is a source
    of its own; an empty table gives no rows.
    """
    text_hash = "text_hash" if "text_hash" in sizes.columns else F.lit("")
    keyed = written(sizes.select("doc_id", "source", "size", random_key("doc_id", text_hash).alias("key")), "sizes")
    targets = small(source_targets(keyed, share, most, weights).drop("weight"))
    bits = max(0, (keyed.count() // BUCKET_ROWS).bit_length())
    rows = keyed.withColumn("bucket", F.shiftright("key", KEY_BITS - bits))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    starts = starts.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "start")
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket"))).drop("_source", "_bucket")
    targets = targets.withColumnRenamed("source", "_source")
    placed = placed.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - epochs * F.col("source_size") - F.col("start") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.withColumn("taken", taken.cast("long")).drop("bucket", "start", "inside", "budget")


def mixed_documents(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The documents themselves as the mix holds them, repeated by epoch, with their own columns, whatever their names.

    A source's cut is a value of the random key: rows up to it are in one epoch more than the others. Documents stay whole, so
    a source's words come within one document (and its equal rows) of its budget. Only the sources' cuts, not the texts, are
    joined. Of a source whose texts have no words, every row stays once.
    """
    taken = mixed(sized(docs), share, most, weights)
    epochs = F.floor(F.col("target") / F.col("source_size"))
    cuts = taken.groupBy(F.col("source").alias("_source")).agg(
        F.max(F.when(F.col("source_size") > 0, epochs).otherwise(1)).cast("int").alias("_epochs"),
        F.max(F.when((F.col("source_size") > 0) & (F.col("taken") > epochs * F.col("size")), F.col("key"))).alias("_cut"),
    )
    cuts = small(written(cuts, "cuts", rows=docs.select("source").distinct().count()))
    named = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("_own"), random_key(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))).alias("_key"))
    copies = F.col("_epochs") + F.when(F.col("_key") <= F.col("_cut"), 1).otherwise(0)
    out = named.join(cuts, F.col("_own").eqNullSafe(F.col("_source")))
    return out.select("_row", F.explode(F.array_repeat(F.lit(1), copies))).select("_row.*")
