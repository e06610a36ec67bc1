"""How filters of a corpus act together: Walsh-Hadamard sums of their failures, every order of applying them, and Shapley values.

A document's failures are a mask of bits, one for each filter. One aggregate adds up, per part and label, the 2^n signed parity
sums of the masks; their inverse is exact in integers and gives how many documents have each mask. All orders and all steps
follow from these cells, whose number doesn't depend on the documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.common import small, written

#: Runs of white space: the separators of words.
BLANKS = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"


def failures(text: Column) -> list[Column]:
    """Whether a text fails each of the filters A to D, which need no other document."""
    words = F.array_remove(F.split(text, BLANKS), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic and mask of each document; bit k of the mask is set if it fails the k-th filter.

    A document passes E if it is the first of its text. Its id is looked up together with the text, so that copies, however
    many, are spread over all tasks; their least id is a map-side aggregate.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = sum(F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(failures(text)))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own.alias("own")
    )
    rows = written(rows, "masks")
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    flag = lambda name: F.max(F.col(name) == 1).alias(name)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    rows = rows.join(firsts, ["digest", "doc_id"], "left").join(small(known), "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << 4).otherwise(0)
    no = F.lit(False)
    return rows.select("part", F.coalesce("quality", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), (F.col("own") + copy).cast("int").alias("mask"))


def parity_sums(masks: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """part, good, toxic and sums: for each set u of filters, the documents that fail an even number of u less those that fail an odd one."""
    signed = [F.sum(F.expr(f"1 - 2 * (bit_count(mask & {u}) & 1)")) for u in range(1 << filters)]
    return masks.groupBy("part", "good", "toxic").agg(F.array(*signed).alias("sums"))


def cells(sums: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """part, every, good and toxic: arrays of how many documents of the part, with these labels, have each mask."""
    last = (1 << filters) - 1
    counts = f"transform(sequence(0, {last}), m -> aggregate(sequence(0, {last}), 0L, (a, u) -> a + (1 - 2 * (bit_count(m & u) & 1)) * sums[u]) div {last + 1})"
    rows = sums.withColumn("cells", F.expr(counts))
    added = lambda kept: F.array(*(F.sum(F.when(kept, F.col("cells")[m]).otherwise(0)) for m in range(last + 1)))
    return rows.groupBy("part").agg(added(F.lit(True)).alias("every"), added(F.col("good")).alias("good"), added(F.col("toxic")).alias("toxic"))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, with counts of the part's documents, zeros included.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; other columns are ignored. Filters fail a document of under 100
    words (A), with distinct words under 80 % (B), capitals over 10 % of the characters (C), a character of #$%&*| (D), or a
    text that a smaller doc_id has (E). Null texts are empty, a null lang is the part ''. Repeated rows count separately; rows of
    one doc_id and text are none of them a copy of the other, and rows of null doc_id are no copies and have no labels. Of an
    id's repeated labels any 1 counts. Empty documents give no rows.

    kept: after this step; removed: here; redundant: failing its filter but removed earlier; unique_fails: failing no other
    filter; good_lost and toxic_lost: removed here with quality or toxic 1; shapley: removed by its filter, over all orders.
    Of the orders of n filters, a document that fails k is removed by each of these in n!/k.
    """
    n = len(FILTERS)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    rows = cells(parity_sums(masked(docs, labels))).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.expr(f"sequence(1, {n})")))
    bit = f"shiftleft(1, locate(substr(filter_order, {{}}, 1), '{FILTERS}') - 1)"
    rows = rows.withColumn("own", F.expr(bit.format("step")))
    rows = rows.withColumn("earlier", F.expr(f"aggregate(sequence(1, {n}), 0, (a, k) -> if(k < step, a | {bit.format('k')}, a))"))
    total = lambda counts, kept, each="1": F.expr(f"aggregate(sequence(0, {(1 << n) - 1}), 0L, (a, m) -> if({kept}, a + {each} * {counts}[m], a))").cast("long")
    here = "m & own != 0 and m & earlier = 0"
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("every", "m & (own | earlier) = 0").alias("kept"),
        total("every", here).alias("removed"),
        total("every", "m & own != 0 and m & earlier != 0").alias("redundant"),
        total("every", "m = own").alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("every", "m & own != 0", f"({factorial(n)} div bit_count(m))").alias("shapley"),
    )
