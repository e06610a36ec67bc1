"""Importance resampling towards a target: hashed n-gram features, log ratios of their frequencies, Gumbel keys and the best of them.

The features of many texts are found at once in the bytes of Arrow's UTF-8 buffers. A table tells word bytes from others,
differences of neighbours give the words' ends, and the CRC-32 of all features that begin in a stretch of text advances through
its own table, one byte of each feature at a time. A feature of three words goes on from the state of that of two.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.llm.common import BYTES, bounded_batches, small, text_runs, written

BUCKETS = 10_000
LONGEST = 3
#: Bytes of a text that are taken at a time.
STRETCH = 1 << 20
#: Features of which fewer are left to advance are ended one by one.
FEW = 16
#: What is written for a byte: a word's own one lower-cased, 32 for what separates words.
LOWERED = np.frombuffer(BYTES, np.uint8)


def _crc_table() -> np.ndarray:
    """The CRC-32 of each byte, by its polynomial (fixed value 0xEDB88320, bits reflected)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def advanced(flat: np.ndarray, state: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after `length` more bytes of flat from `at`, for all states together, the longest first."""
    order = np.argsort(-length, kind="stable")
    state, at, ordered = state[order], at[order], length[order]
    active = len(ordered) - np.searchsorted(ordered[::-1], np.arange(int(ordered[0]) if len(ordered) else 0), "right")
    for k, m in enumerate(active):
        if m < FEW:
            for i in range(m):
                rest = flat[at[i] + k : at[i] + ordered[i]].tobytes()
                state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            break
        head = state[:m]
        state[:m] = CRC[(head ^ flat[at[:m] + k]) & 0xFF] ^ (head >> 8)
    out = np.empty_like(state)
    out[order] = state
    return out


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased bytes: their words joined by one space, where each word begins in that, its bytes, and its place in data.

    A word never goes over one of the breaks, places where another text begins.
    """
    inside = data != 32
    opens = inside & ~np.concatenate([[False], inside[:-1]])
    at = breaks[breaks < len(data)]
    opens[at] = inside[at]
    places = np.flatnonzero(opens)
    owner = np.cumsum(opens, dtype=np.int32)[inside] - 1
    length = np.bincount(owner, minlength=len(places)).astype(np.int64)
    begins = np.cumsum(length + 1) - length - 1
    flat = np.full(int(length.sum()) + len(places), 32, np.uint8)
    flat[np.arange(len(owner)) + owner] = data[inside]
    return flat, begins, length, places


def _features(data: np.ndarray, limits: np.ndarray, longest: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of the texts data[limits[i]:limits[i + 1]]: by number of words, the CRC-32 and the text of each feature; and each word's place."""
    flat, begins, length, places = _words(LOWERED[data], limits[:-1])
    owner = np.searchsorted(limits, places, "right") - 1
    state, first, crcs, owners = np.full(len(places), 0xFFFFFFFF, np.uint32), np.arange(len(places)), [], []
    for n in range(longest):
        if n:
            going = first + n < len(places)
            going[going] = owner[first[going] + n] == owner[first[going]]
            first, state = first[going], state[going]
        word = first + n
        state = advanced(flat, state, begins[word] - (n > 0), length[word] + (n > 0))
        crcs.append(state ^ np.uint32(0xFFFFFFFF))
        owners.append(owner[first])
    return crcs, owners, places


def _stretches(data: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, int]]:
    """CRCs of the features of one long text, STRETCH bytes at a time, and the number of words that begin there.

    The last words of a stretch begin features that go on in the next one, which begins with them.
    """
    at, size = 0, STRETCH
    while at < len(data):
        end = min(at + size, len(data))
        last = end == len(data)
        crcs, owners, places = _features(data[at:end], np.array([0, end - at]), longest)
        keep = len(places) if last else len(places) - longest
        if keep <= 0 and not last:
            size *= 2
            continue
        # the n-th list has the features of the first words in order; those of later words come again
        yield np.concatenate([x[: min(len(x), keep)] for x in crcs]), keep
        if last:
            return
        at, size = at + int(places[keep]), STRETCH


def featured(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: first and end row, words of each text, and each feature's text (counted from the first) and bucket."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for a, b in text_runs(texts):
        if b == a + 1 and offsets[b] - offsets[a] > STRETCH:
            words = 0
            for crcs, n in _stretches(whole[offsets[a] : offsets[b]], longest):
                words += n
                yield a, b, np.zeros(1, np.int64), np.zeros(len(crcs), np.int64), crcs.astype(np.int64) % buckets
            yield a, b, np.array([words]), np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        limits = (offsets[a : b + 1] - offsets[a]).astype(np.int64)
        crcs, owners, _ = _features(whole[offsets[a] : offsets[b]], limits, longest)
        yield a, b, np.bincount(owners[0], minlength=b - a), np.concatenate(owners), np.concatenate(crcs).astype(np.int64) % buckets


def feature_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of the texts each bucket has, int64 [buckets].

    Each task adds up its own texts, so at most `buckets` rows leave it, whatever its input, and as many reach the driver.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found in featured(batch.column(0).cast(pa.string()).fill_null(""), buckets, longest):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out


def gains(own: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Per bucket the log ratio of its share of the wanted features to that of the own ones, add-one smoothed, in thousandths, floored."""
    n, s_all, t_all = len(own), float(own.sum()), float(wanted.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)))) for s, t in zip(own, wanted, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of its features' gains) of each document."""
    bounded_batches(docs.sparkSession)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, number, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, b, n, owner, found in featured(batch.column(1).cast(pa.string()).fill_null(""), len(gain), longest):
                words[a:b] += n
                number[a:b] += np.bincount(owner, minlength=b - a)
                order = np.argsort(owner, kind="stable")
                sums = np.concatenate([[0], np.cumsum(gain[found[order]])])
                ends = np.searchsorted(owner[order], np.arange(b - a + 1))
                weight[a:b] += sums[ends[1:]] - sums[ends[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(number), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = 42) -> Column:
    """A document's own Gumbel noise in thousandths, floored, from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, number: int) -> DataFrame:
    """The rows (doc_id, score and others) with rank: 1 to `number` in falling order of score, ties to the smaller doc_id, null for the rest.

    Ranges of the order are numbered by their own tasks and moved by the counts of the ranges before. A random key parts rows
    that are equal in both, so that no range must hold all of them.
    """
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_tie")]
    parts = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    parts = written(parts, "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    placed = parts.withColumn("_own", own).join(small(starts), "_part")
    place = F.col("_start") + F.col("_own")
    return placed.withColumn("rank", F.when(place <= number, place)).drop("_part", "_own", "_start", "_tie")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score and rank, null for those that aren't drawn.

    docs: doc_id, text; target: text; other columns are ignored. A document's features are its runs of 1 to `longest` words,
    repeats counted; a null or empty text has none and weighs 0. The score adds Gumbel noise to the weight, so the highest
    scores are a draw without replacement. Of the documents with `least_words` words or more, `percent` percent are drawn,
    rounded down. Repeated rows count and are drawn each by itself; null ids share one noise and come last among ties. Empty
    documents give no rows, an empty target the same gain to all frequent features. Long texts are read in stretches.
    """
    gain = gains(feature_counts(docs, buckets, longest), feature_counts(target, buckets, longest))
    rows = weighed(docs, gain, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = written(rows, "weighed")
    fit = F.col("n_words") >= least_words
    number = percent * rows.where(fit).count() // 100
    none = rows.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked(rows.where(fit), number).select("doc_id", "n_words", "n_features", "weight", "score", "rank").unionByName(none)
