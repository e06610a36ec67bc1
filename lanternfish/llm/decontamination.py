"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions only.

The index holds a posting (term, doc_id, pos) for each training word that some test item holds; no query can ask for
others. It is written once, in segments that are each sorted by term, so that a lookup of rare terms reads few row groups. A test window
is k consecutive words of an item. Its words are ranked by how often the index holds them; the posting lists of its two
rarest words, each moved back by the word's place in the item, are intersected on (item, document, alignment). What is left
is few; the documents' own words are compared with the windows there, so that matches are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.llm.common import small, words, written

WINDOW = 10
#: Test items of a file of items, of their terms and of their windows.
ITEMS_A_FILE = 2_000


def windows_of(count: Column, size: int) -> Column:
    """The places at which windows of `size` words start among so many words; one shorter window if there are fewer, none if there are none."""
    return F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - size, F.lit(0))))


@dataclass
class Items:
    """Distinct test texts: texts (item, words, item_ids, size) and terms (term_id, term)."""

    texts: DataFrame
    terms: DataFrame
    window: int


def items_of(benchmark: DataFrame, window: int = WINDOW) -> Items:
    """Test items (item_id, text). Items of the same words are one, with all their ids; items without words are left out."""
    n = benchmark.count()
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    texts = rows.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    texts = written(texts.select(F.xxhash64("words").alias("item"), "words", "item_ids", F.size("words").alias("size")), "items", rows=n, a_file=ITEMS_A_FILE)
    terms = texts.select(F.explode("words").alias("term")).distinct().withColumn("term_id", F.xxhash64("term"))
    return Items(texts, written(terms, "terms", rows=n, a_file=ITEMS_A_FILE), window)


def build_index(docs: DataFrame, items: Items) -> DataFrame:
    """The written postings: term_id, doc_id, pos (from 0) of docs (doc_id, text)."""
    tokens = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    postings = tokens.join(small(items.terms), "term").select("term_id", "doc_id", "pos")
    return written(postings.sortWithinPartitions("term_id", "doc_id", "pos"), "postings", compression="zstd")


def _rarest(items: Items, index: DataFrame) -> DataFrame:
    """Pairs of the rarest places of each item's windows: item, pair, place_1, term_1, place_2, term_2, starts (of the windows that have it).

    Windows with a word that the index lacks are left out, as they occur nowhere.
    """
    found = small(index.groupBy("term_id").agg(F.count("*").alias("n")))
    places = items.texts.select("item", "size", F.posexplode("words").alias("place", "term")).withColumn("term_id", F.xxhash64("term")).join(found, "term_id")
    starts = items.texts.select("item", F.explode(windows_of(F.col("size"), items.window)).alias("start"))
    lookup = places.withColumn("start", F.explode(F.sequence(F.greatest(F.col("place") - items.window + 1, F.lit(0)), F.least(F.col("place"), F.greatest(F.col("size") - items.window, F.lit(0))))))
    width = F.least(F.col("size"), F.lit(items.window))
    rank = F.row_number().over(Window.partitionBy("item", "start").orderBy("n", "place"))
    ranked = lookup.join(starts, ["item", "start"]).withColumn("rank", rank).withColumn("complete", F.count("*").over(Window.partitionBy("item", "start")) == width)
    both = ranked.where("complete and rank <= 2").groupBy("item", "start").agg(
        *[F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"{c}_{k}") for k in (1, 2) for c in ("place", "term_id")]
    )
    both = both.withColumns({f"{c}_2": F.coalesce(f"{c}_2", f"{c}_1") for c in ("place", "term_id")})
    keys = ["item", "place_1", "term_id_1", "place_2", "term_id_2"]
    return written(both.groupBy(*keys).agg(F.array_sort(F.collect_list("start")).alias("starts")), "rarest", rows=items.texts.count(), a_file=ITEMS_A_FILE)


def candidates(items: Items, index: DataFrame, slop: int = 0) -> DataFrame:
    """doc_id, item, at (the document's word at which the item would start), starts: where the two rarest words of windows stand right.

    With slop, each of the two may stand up to so many words from its place: for every place of the rarest word, `at` is each
    of the alignments that are up to slop away, and the second word must be within slop of its place there. That is found by
    joining on blocks of slop + 1 places.
    """
    pairs = _rarest(items, index)
    first = index.join(small(pairs.withColumnRenamed("term_id_1", "term_id")), "term_id").select("doc_id", "item", (F.col("pos") - F.col("place_1")).alias("at"), "place_1", "place_2", "starts")
    lists = pairs.select(F.col("term_id_2").alias("term_id"), "item", "place_2").distinct()
    second = index.join(small(lists), "term_id").select(F.col("doc_id").alias("doc"), F.col("item").alias("item_2"), (F.col("pos") - F.col("place_2")).alias("at_2"), F.col("place_2").alias("other"))
    same = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("item") == F.col("item_2")) & (F.col("place_2") == F.col("other"))
    if slop:
        block = lambda c: F.floor(F.col(c) / (slop + 1))
        first = first.withColumn("at", F.explode(F.sequence(F.col("at") - slop, F.col("at") + slop)))
        first = first.withColumn("block", F.explode(F.array(*[block("at") + k for k in (-1, 0, 1)])))
        met = first.join(second, same & (F.col("block") == block("at_2")) & (F.abs(F.col("at") - F.col("at_2")) <= slop))
    else:
        met = first.join(second, same & (F.col("at") == F.col("at_2")))
    return met.groupBy("doc_id", "item", "at").agg(F.array_distinct(F.flatten(F.collect_set("starts"))).alias("starts"))


def matches(docs: DataFrame, items: Items, slop: int = 0) -> DataFrame:
    """Each row of docs with n_words, hits (array of start, length, item_ids: the exact places of windows) and n_hit words in any of them.

    With slop > 0, hits are proximity matches: for some place of the window, each of its words stands within slop words of its
    own; a hit is such a place, so that its words may reach beyond the document's ends, and n_hit counts the words inside.
    doc_id may be null or repeated: postings of one doc_id are looked up together and each row is compared with its own words.
    """
    index = build_index(docs, items)
    found = candidates(items, index, slop).join(small(items.texts), "item")
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("at", "starts", "words", "item_ids", "size")).alias("found")).withColumnRenamed("doc_id", "found_in")
    rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col("found_in")), "left").drop("found_in").withColumn("own", words(F.col("text")))

    def stands(c: Column, start: Column, width: Column) -> Column:
        begin = c["at"] + start
        if not slop:
            return (begin >= 0) & (F.slice(F.col("own"), F.greatest(begin, F.lit(0)) + 1, width) == F.slice(c["words"], start + 1, width))
        low = lambda k: F.greatest(begin + k - slop, F.lit(0))
        near = lambda k: F.slice(F.col("own"), low(k) + 1, F.greatest(begin + k + slop + 1 - low(k), F.lit(0)))
        return F.forall(F.sequence(F.lit(0), width - 1), lambda k: F.array_contains(near(k), F.get(c["words"], start + k)))

    def hits(c: Column) -> Column:
        width = F.least(c["size"], F.lit(items.window))
        right = F.filter(c["starts"], lambda s: stands(c, s, width))
        return F.transform(right, lambda s: F.struct((c["at"] + s).alias("start"), width.alias("length"), c["item_ids"].alias("item_ids")))

    inside = lambda h: F.filter(F.sequence(h["start"], h["start"] + h["length"] - 1), lambda p: (p >= 0) & (p < F.size("own")))
    rows = rows.withColumn("hits", F.coalesce(F.flatten(F.transform("found", hits)), F.expr("array()").cast("array<struct<start:int,length:int,item_ids:array<string>>>")))
    spots = F.array_distinct(F.flatten(F.transform("hits", inside)))
    return rows.withColumn("n_words", F.size("own").cast("long")).withColumn("n_hit", F.size(spots).cast("long")).drop("own", "found")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. A null or empty text has no words; whole texts
    are compared, however long; repeated rows of a document, and rows of null doc_id, get a row each, tested against their own
    text; items of the same words hit together, an item of null id counts as a hit without an id; without items nothing is
    contaminated, without documents there are no rows.
    """
    rows = matches(docs.select("doc_id", "text"), items_of(benchmark, window))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["item_ids"]))))
    return rows.withColumn("ids", ids).select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with their own columns, in which no window of an item occurs."""
    renamed = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    rows = matches(renamed, items_of(benchmark, window))
    # A filter would be pushed below the steps before it and compute a text's words anew for each use; a generator isn't.
    return rows.select("row", F.explode(F.when(F.col("n_hit") == 0, F.array(F.lit(1))))).select("row.*")
