"""Documents linked by the Jaccard similarity of their word n-grams, and the components of these links, exactly.

Documents with the same set of n-grams are one text. The keys of universe.py put texts into buckets; two texts of the
similarity share a bucket. In each bucket the texts are compared with its first one, which joins the copies of a group at once.
Buckets that hold more than one component after that are small, mostly, and give the pairs of their texts of different
components; in large ones, these are compared in blocks of BLOCK by BLOCK texts that any number of tasks share. So every pair of
a bucket is compared or connected already, and no bucket is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm import universe
from lanternfish.llm.common import bounded_batches, small, text_runs, written
from lanternfish.llm.neardup import BLOCK, SETS_A_FILE, _by_group
from lanternfish.llm.shingles import mix, shingle_hashes
from lanternfish.operators.components import connected_components

PERCENT = 85
WORDS = 4
#: Buckets of up to so many texts give their pairs without blocks.
SMALL = 12
#: Of the keys of a text in open buckets, the least ones go with it into blocks, to tell whether a pair has met before.
KNOWN = 16
#: A-Z lower-cased, white space made a space, all else kept.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def ngram_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-grams; a text of fewer words has one of all its words, one of none has none."""
    hashes, number = shingle_hashes(texts, words, TABLE)
    ends = np.cumsum(number)
    return [np.unique(hashes[b - n : b]) for b, n in zip(ends, number, strict=True)]


def content_of(members: np.ndarray) -> int:
    """A 64-bit hash of a set, 0 for the empty one."""
    if not len(members):
        return 0
    return int((mix(mix(members).sum(keepdims=True) + np.uint64(len(members))) | np.uint64(1)).view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection is at least `percent` times the union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        texts = batch.column(column).cast(pa.string())
        for a, b in text_runs(texts):
            yield batch.slice(a, b - a), texts[a:b].to_pylist()


def keyed(rows: DataFrame, percent: int, words: int) -> DataFrame:
    """doc_id, row_key, content, n_shingles and keys of rows (doc_id, row_key, text)."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in _runs(batches, 2):
            sets = ngram_sets(texts, words)
            own = [universe.keys(x, percent) for x in sets]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))
            columns = [run.column(0), run.column(1), pa.array([content_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "content", "n_shingles", "keys"])

    return rows.mapInArrow(key, "doc_id long, row_key long, content long, n_shingles long, keys array<long>")


def _sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """content, members and sketch of the rows wanted (doc_id, row_key, content)."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _runs(batches, 2):
            sets = ngram_sets(texts, words)
            columns = [pa.array([content_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([universe.sketch(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["content", "members", "sketch"])

    asked = wanted.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).hint("shuffle_merge")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key"))
    found = rows.join(asked, same, "left_semi").mapInArrow(members, "content long, members binary, sketch binary")
    # repeated rows come together, and a row of the same id and hash is the same text
    return found.groupBy("content").agg(F.first("members").alias("members"), F.first("sketch").alias("sketch"))


def _linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts have the similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(i)] for i in (2, 3))
            keep = pa.array([similar(a, b, percent) for a, b in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    side = lambda name, members: sets.select(F.col("content").alias(name), F.col("members").alias(members))
    return pairs.join(side("b", "right"), "b").join(side("a", "left"), "a").select("a", "b", "left", "right").mapInArrow(verify, "a long, b long")


def _small_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """The pairs of texts of different components, and of near enough sizes, of small buckets (band, content, n_shingles, component)."""
    rows = buckets.groupBy("band").agg(F.collect_list(F.struct("content", "component", F.col("n_shingles").alias("size"))).alias("every"))
    rows = rows.withColumn("x", F.explode("every")).withColumn("y", F.explode("every"))
    near = 100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size")
    pairs = rows.where((F.col("x.content") < F.col("y.content")) & (F.col("x.component") != F.col("y.component")) & near)
    return pairs.select(F.col("x.content").alias("a"), F.col("y.content").alias("b")).distinct()


def _cells(buckets: DataFrame, sets: DataFrame):
    """Large buckets cut into cells: a bucket's texts are dealt to slots by hash, and each pair of slots is a cell."""
    large = buckets.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slots")).where("slots > 1")
    rows = buckets.join(small(large), "band", "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("content"), F.col("slots")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda k: F.struct(F.least(k, F.col("slot")).alias("i"), F.greatest(k, F.col("slot")).alias("j")))
    rows = rows.withColumn("cell", F.explode(other)).select("band", "cell.i", "cell.j", "slot", "content", "component", "n_shingles")
    known = buckets.groupBy("content").agg(F.slice(F.array_sort(F.collect_list("band")), 1, KNOWN).alias("known"))
    return rows.join(known, "content").join(sets.select("content", "sketch"), "content").groupBy("band", "i", "j")


def _known(table: pa.Table) -> np.ndarray:
    """int64 [texts, KNOWN], filled up with the largest value, which no comparison reaches."""
    out = np.full((table.num_rows, KNOWN), np.iinfo(np.int64).max)
    for row, x in zip(out, table.column("known").to_pylist(), strict=True):
        row[: len(x)] = x
    return out


def _linked_rest(cells, sets: DataFrame, percent: int) -> DataFrame:
    """Links between all texts of different components in a cell.

    Pairs whose sizes or sketches are too far apart aren't similar. A pair is looked at in its first bucket, as far as the known
    keys of its texts tell. Texts that have such a pair in a cell go on with their members. Two components need one link, so a
    cell stops comparing them at the first.
    """

    def candidates(band: int, i: int, j: int, table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        slot, component, size = (np.asarray(table.column(n)) for n in ("slot", "component", "n_shingles"))
        known, parity, right = _known(table), universe.folded(table.column("sketch").to_pylist()), np.flatnonzero(slot == j)
        for x in np.flatnonzero(slot == i):
            may = right[component[right] != component[x]]
            may = may[100 * np.minimum(size[may], size[x]) >= percent * np.maximum(size[may], size[x])]
            apart = np.bitwise_count(parity[may] ^ parity[x]).sum(axis=1, dtype=np.int64)
            may = may[apart <= (size[may] + size[x]) * (100 - percent) // (100 + percent)]
            before = known[x][known[x] < band]
            yield x, may[~np.isin(known[may], before).any(axis=1)]

    columns = ["slot", "content", "component", "n_shingles", "known"]

    def partners(key, table):
        band, i, j = (k.as_py() for k in key)
        seen = np.zeros(table.num_rows, bool)
        for x, may in candidates(band, i, j, table):
            seen[may] = True
            seen[x] |= len(may) > 0
        at = table.select(columns).filter(pa.array(seen))
        at = at.set_column(len(columns) - 1, "known", at.column("known").cast(pa.list_(pa.int64())))
        same = lambda v, kind: pa.array(np.full(at.num_rows, v, kind))
        for k, (name, v, kind) in enumerate((("band", band, np.int64), ("i", i, np.int32), ("j", j, np.int32))):
            at = at.add_column(k, name, same(v, kind))
        return at

    def compare(key, table):
        members = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members")]
        content, component = (np.asarray(table.column(n)) for n in ("content", "component"))
        linked, a, b = set(), [], []
        for x, may in candidates(*(k.as_py() for k in key), table):
            for y in may:
                both = (min(component[x], component[y]), max(component[x], component[y]))
                if both not in linked and similar(members[x], members[y], percent):
                    linked.add(both)
                    a.append(content[x])
                    b.append(content[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = cells.applyInArrow(partners, "band long, i int, j int, slot int, content long, component long, n_shingles long, known array<long>")
    return rows.join(sets, "content").groupBy("band", "i", "j").applyInArrow(compare, "a long, b long")


def _labelled(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """doc_id, n_shingles, row_key and label (of the component; null for a document without words) of each document."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("string").alias("text"))
    rows = written(keyed(source, percent, words), "keyed")
    texts = rows.where("content <> 0").groupBy("content")
    places = texts.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("x")).select("content", "x.doc_id", "x.row_key")
    shared = texts.agg(F.any_value("n_shingles").alias("n_shingles"), F.any_value("keys").alias("keys")).select("content", "n_shingles", F.explode("keys").alias("band"))
    leaders = written(shared.groupBy("band").agg(F.min("content").alias("leader"), F.count("*").alias("n")).where("n > 1"), "leaders")
    buckets = written(_by_group(shared, leaders), "buckets")
    wanted = written(buckets.select("content").distinct().join(places, "content"), "wanted")
    n = wanted.count()
    sets = written(_sets(source, wanted, words), "sets", rows=n, a_file=SETS_A_FILE)
    pairs = buckets.where("leader <> content").select(F.col("leader").alias("a"), F.col("content").alias("b")).distinct()
    links = written(_linked_pairs(pairs, sets, percent), "links", rows=n, a_file=SETS_A_FILE)

    def components_of(links: DataFrame) -> DataFrame:
        m = links.count()
        return written(connected_components(links, lambda df: written(df, "edges", rows=2 * m)), "components", rows=2 * m)

    found = components_of(links)
    placed = buckets.join(found, buckets["content"] == found["node"], "left").select("band", "content", "n_shingles", F.coalesce("component", "content").alias("component"))
    bands = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high").select("band", "n")
    opened = written(_by_group(placed, written(bands.withColumn("few", F.col("n") <= SMALL), "bands")), "open")
    rest = written(_linked_pairs(_small_pairs(opened.where("few"), percent), sets, percent), "links", rows=n, a_file=SETS_A_FILE)
    if opened.where("not few").limit(1).count():
        more = _linked_rest(_cells(opened.where("not few").drop("few"), sets), sets, percent)
        rest = rest.unionByName(written(more, "links", rows=n, a_file=SETS_A_FILE))
    if rest.limit(1).count():
        found = components_of(links.unionByName(rest))
    label = F.when(F.col("content") != 0, F.coalesce("component", "content"))
    return rows.drop("keys").join(found, rows["content"] == found["node"], "left").select("doc_id", "n_shingles", "row_key", label.alias("label"))


def components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles (of its set) and component_id (the least doc_id reachable by links).

    docs: doc_id, text; other columns are ignored. A document's set holds its distinct runs of `words` words, told apart by 64-bit
    hashes; one of fewer words has one run of all of them. Two documents are linked if 100 times the intersection is at least
    `percent` times the union; no link is missed. A null text, or one without words, has no runs and is linked with nothing, not
    even its copies. Rows of null doc_id link as others do and get their component's least id, null if all of its ids are; rows
    of one doc_id are documents of their own. An empty table gives no rows.
    """
    named = _labelled(docs, percent, words)
    least = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    least = written(least, "least", rows=named.count())
    alone = named.where("label is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = _by_group(named.where("label is not null"), least, "label", "row_key")
    return joined.select("doc_id", "n_shingles", F.col("least").alias("component_id")).unionByName(alone)
