"""Near duplicates of normalised texts: an exact set-similarity join with a prefix filter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import text as tx
from lanternfish.sources.shared import met

THRESHOLD = 0.8
#: Sets of a slot of a run that very many have among their rarest.
SLOT = 1_000


def near_duplicates(docs: DataFrame, written: Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, near_doc, similarity (to three places) of the near duplicates among all docs (doc_id, text).

    Documents are near duplicates if the Jaccard similarity of their sets of 3-word runs is at least `threshold` before it is
    rounded. Documents of the same set are one: each has a row with the first (least doc_id) of them, and each pair of firsts
    a row, so that two documents are near duplicates if their firsts are the same or have a row. Texts without words are near
    to none.

    Sets of a similarity t share one of their |s| - ceil(t |s|) + 1 rarest runs. Runs that one set alone has come first there and
    meet nothing. Runs are compared by 64-bit hashes.
    """
    rows = written(tx.run_hashes(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("runs").alias("hash"), "runs"))
    rows = rows.where(F.size("runs") > 0)
    # a set is named by one of its rows; of the others only that name is moved, not the runs, and it is written, so that few are broadcast
    firsts = written(rows.groupBy("hash").agg(F.min("doc_id").alias("first"), F.min("row").alias("set")))
    named = rows.select("doc_id", "row", "hash").join(firsts, "hash")
    rows = rows.join(written(named.where("row <> set").select("row")), "row", "left_anti").select(F.col("row").alias("set"), "runs")
    copies = named.where(~F.col("doc_id").eqNullSafe(F.col("first")))
    copies = copies.select(F.col("first").alias("doc_id"), F.col("doc_id").alias("near_doc"), F.lit(1.0).alias("similarity")).distinct()

    postings = rows.select("set", F.size("runs").alias("size"), F.explode("runs").alias("run"))
    # how often a run is there is a map-side sum; the postings of a common one are joined with it where they are, or split by Spark
    often = written(postings.groupBy("run").agg(F.count("*").alias("n")).where("n > 1"))
    shared = postings.join(often, "run")
    shared = shared.groupBy("set", "size").agg(F.array_sort(F.collect_list(F.struct("n", "run"))).alias("shared"))
    length = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1
    prefix = F.slice("shared", 1, F.greatest(length - (F.col("size") - F.size("shared")), F.lit(0)))
    prefixes = written(shared.select("set", "size", F.explode(prefix).alias("x")).select("set", "size", "x.run"))

    alike = F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * threshold - 1e-9
    pairs = written(met(prefixes, "run", "set", SLOT).where(alike).select("a", "b").distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    sets = written(rows.join(wanted, "set", "left_semi"))
    of = lambda name: sets.select(F.col("set").alias(name), F.col("runs").alias(f"{name}_runs"))
    both = F.size(F.array_intersect("a_runs", "b_runs"))
    found = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", both.alias("both"), (F.size("a_runs") + F.size("b_runs")).alias("sum"))
    found = found.withColumn("j", F.col("both") / (F.col("sum") - F.col("both"))).where(F.col("j") >= threshold)
    first = lambda name: firsts.select(F.col("set").alias(name), F.col("first").alias(f"{name}_first"))
    found = found.join(first("a"), "a").join(first("b"), "b")
    ordered = F.col("b_first").isNull() | (F.col("a_first") <= F.col("b_first"))
    return copies.unionByName(found.select(F.when(ordered, F.col("a_first")).otherwise(F.col("b_first")).alias("doc_id"), F.when(ordered, F.col("b_first")).otherwise(F.col("a_first")).alias("near_doc"), F.bround("j", 3).alias("similarity")))
