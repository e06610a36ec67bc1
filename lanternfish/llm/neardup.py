"""Near-duplicate documents: BagMinHash signatures, bands, verified multiset overlap and connected classes.

Documents with the same multiset of shingles are one text. Each distinct text has a signature, whose bands put it into
buckets. In each bucket the texts are compared with the bucket's leader, the text of least hash, which is the same in most
buckets of a group; so a group of k near copies costs about k comparisons. In buckets that still hold more than one class, each
text is compared with the text of another class whose signature is most like its own. Where there is more than one class even then,
all pairs of texts of different classes are compared, in blocks of BLOCK by BLOCK texts that any number of tasks share. So
every pair of a bucket is compared or already connected, and no bucket is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm import bagminhash
from lanternfish.llm.common import WORD, bounded_batches, lowered, small, text_runs, written
from lanternfish.llm.shingles import WORDS, mix, multisets, tagged
from lanternfish.operators.components import connected_components

THRESHOLD = 0.8
#: Texts of a side of a block in which all pairs of texts of different classes are compared.
BLOCK = 1_024
#: Texts of a file of shingle sets, or of links that a task finds with them.
SETS_A_FILE = 20_000


def content_ids(owner: np.ndarray, keys: np.ndarray, counts: np.ndarray, texts: int) -> np.ndarray:
    """int64 per text: a hash of its multiset of shingles; 0 if it has none."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys + mix(counts.astype(np.uint64))))])
    bounds = np.searchsorted(owner, np.arange(texts + 1))
    ids = mix(sums[bounds[1:]] - sums[bounds[:-1]])
    return np.where(bounds[1:] > bounds[:-1], ids | np.uint64(1), np.uint64(0)).view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Runs of rows (doc_id, row_key, text), and their texts as a list."""
    for batch in batches:
        column = batch.column(2).cast(pa.string())
        for a, b in text_runs(column):
            yield batch.slice(a, b - a), column[a:b].to_pylist()


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, row_key (a hash of the row's columns) and text."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(*columns).alias("row_key"), "text")


def signed(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, row_key, content (0 for a text without words) and its bands, of rows (doc_id, row_key, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in _texts(batches):
            sets = multisets(texts, words)
            bands = bagminhash.bands(bagminhash.signatures(*sets, len(texts)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([run.column(0), run.column(1), pa.array(content_ids(*sets, len(texts))), lists], names=["doc_id", "row_key", "content", "bands"])

    return rows.mapInArrow(sign, "doc_id long, row_key long, content long, bands array<long>")


def _overlap(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sets of distinct members have the Jaccard similarity."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same >= threshold * (len(both) - same)


def _same_row(doc_id, row_key):
    """Whether a row (doc_id, row_key) is the one named by these columns; null ids are equal."""
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col("row_key") == F.col(row_key))


def _sets(keyed: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """content, its set of tagged shingles and the low bytes of its signature, of the rows wanted (doc_id, row_key, content)."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            sets = multisets(texts, words)
            low = bagminhash.signatures(*sets, len(texts)).astype(np.uint8)
            columns = [pa.array(content_ids(*sets, len(texts))), pa.array([x.tobytes() for x in tagged(texts, words)], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["content", "members", "low"])

    asked = wanted.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).hint("shuffle_merge")
    rows = keyed.join(asked, _same_row("_id", "_key"), "left_semi")
    found = rows.mapInArrow(members, "content long, members binary, low binary")
    return found.join(wanted.select("content"), "content", "left_semi").groupBy("content").agg(F.first("members").alias("members"), F.first("low").alias("low"))


def _linked_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have the similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(i)] for i in (2, 3))
            keep = pa.array([_overlap(a, b, threshold) for a, b in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    side = lambda name, members: sets.select(F.col("content").alias(name), F.col("members").alias(members))
    rows = pairs.join(side("b", "right"), "b").join(side("a", "left"), "a")
    return rows.select("a", "b", "left", "right").mapInArrow(verify, "a long, b long")


def _alike(low: np.ndarray, row: np.ndarray, threshold: float) -> np.ndarray:
    """Whether texts may have the similarity, by the low bytes of their signatures: at five standard errors, wrong once in a million."""
    return (low == row).sum(axis=1) >= low.shape[1] * (threshold - 5 * (threshold * (1 - threshold) / low.shape[1]) ** 0.5)


def _by_group(rows: DataFrame, groups: DataFrame, key: str = "band", spread: str = "content") -> DataFrame:
    """rows (key, spread and others) joined with groups (key, n, others), where no task gets all rows of a large group.

    Groups of more than BLOCK rows, which are at most one row in BLOCK, are named to the rows first (by broadcast if they are
    few); their rows are then dealt to slots by a hash of `spread`, and the group's own row goes to each of its slots.
    """
    large = groups.where(F.col("n") > BLOCK).select(F.col(key).alias("_key"), F.ceil(F.col("n") / BLOCK).cast("int").alias("_slots"))
    dealt = rows.join(small(large), F.col(key) == F.col("_key"), "left").withColumn("_slot", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_slots")), F.lit(0)).cast("int")).drop("_key", "_slots")
    slots = F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1)
    return dealt.join(groups.withColumn("_slot", F.explode(slots)), [key, "_slot"]).drop("_slot", "n")


def _cells(buckets: DataFrame, sets: DataFrame, bands: bool = True):
    """Open buckets (nth, band, content, component) cut into cells: its texts are dealt to slots by hash, and each pair of slots is a cell.

    With bands, each row has the hashes of all open buckets of its text by nth, null where that bucket is not open.
    """
    large = buckets.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slots")).where("slots > 1")
    rows = buckets.join(small(large), "band", "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("content"), F.col("slots")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda k: F.struct(F.least(k, F.col("slot")).alias("i"), F.greatest(k, F.col("slot")).alias("j")))
    rows = rows.withColumn("cell", F.explode(other)).select("nth", "band", "cell.i", "cell.j", "slot", "content", "component")
    if bands:
        own = [F.max(F.when(F.col("nth") == k, F.col("band"))) for k in range(bagminhash.BANDS)]
        rows = rows.join(buckets.groupBy("content").agg(F.array(*own).alias("bands")), "content")
    return rows.join(sets.select("content", "low"), "content").groupBy("band", "i", "j")


def _columns(table, *names):
    return [np.asarray(table.column(n)) for n in names]


def _low(table):
    return np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _bands(table):
    """int64 [texts, BANDS] and where it has no hash."""
    flat = table.column("bands").combine_chunks().flatten()
    shape = (table.num_rows, bagminhash.BANDS)
    return np.asarray(flat.fill_null(0)).reshape(shape), np.asarray(flat.is_null()).reshape(shape)


def _best_pairs(cells, threshold: float) -> DataFrame:
    """For each text of a cell the text of another class whose signature is most like its own, if they may have the similarity."""

    def best(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        slot, content, component = _columns(table, "slot", "content", "component")
        low, pairs = _low(table), set()
        for one, two in {(i, j), (j, i)}:
            right = np.flatnonzero(slot == two)
            for x in np.flatnonzero(slot == one):
                others = right[component[right] != component[x]]
                if len(others):
                    same = (low[others] == low[x]).sum(axis=1)
                    y = others[same.argmax()]
                    if _alike(low[y : y + 1], low[x], threshold)[0]:
                        pairs.add((min(content[x], content[y]), max(content[x], content[y])))
        pairs = sorted(pairs)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return cells.applyInArrow(best, "a long, b long").distinct()


def _linked_rest(cells, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between all texts of different classes in a cell that may have the similarity.

    A pair is looked at in the first band whose bucket it shares, by the hashes that made the buckets: a bucket with texts of two
    classes is open. Texts that have such a pair in a cell go on with their shingles. Two classes need one link, so a cell
    stops comparing them at the first.
    """

    def partners_of(x, right, component, low, bands, nth):
        may = right[(component[right] != component[x]) & _alike(low[right], low[x], threshold)]
        hashes, missing = (v[:, :nth] for v in bands)
        earlier = ((hashes[may] == hashes[x]) & ~missing[may] & ~missing[x]).any(axis=1)
        return may[~earlier]

    def partners(key, table):
        band, i, j = (k.as_py() for k in key)
        slot, content, component, nth = _columns(table, "slot", "content", "component", "nth")
        low, bands, right, seen = _low(table), _bands(table), np.flatnonzero(slot == j), np.zeros(len(slot), bool)
        for x in np.flatnonzero(slot == i):
            may = partners_of(x, right, component, low, bands, nth[0])
            seen[may] = True
            seen[x] |= len(may) > 0
        at = np.flatnonzero(seen)
        same = lambda v, kind: pa.array(np.full(len(at), v, kind))
        return pa.table({"nth": pa.array(nth[at]), "band": same(band, np.int64), "i": same(i, np.int32), "j": same(j, np.int32), "slot": pa.array(slot[at]), "content": pa.array(content[at]), "component": pa.array(component[at]), "bands": table.column("bands").combine_chunks().take(pa.array(at))})

    def compare(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        slot, content, component, nth = _columns(table, "slot", "content", "component", "nth")
        members = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members")]
        low, bands, right = _low(table), _bands(table), np.flatnonzero(slot == j)
        linked, a, b = set(), [], []
        for x in np.flatnonzero(slot == i):
            for y in partners_of(x, right, component, low, bands, nth[0]):
                classes = tuple(sorted((component[x], component[y])))
                if classes not in linked and _overlap(members[x], members[y], threshold):
                    linked.add(classes)
                    a.append(content[x])
                    b.append(content[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = cells.applyInArrow(partners, "nth int, band long, i int, j int, slot int, content long, component long, bands array<long>")
    return rows.join(sets, "content").groupBy("band", "i", "j").applyInArrow(compare, "a long, b long")


def _labelled(keyed: DataFrame, threshold: float, words: int) -> DataFrame:
    """doc_id, row_key and label (of the row's class; null for a text without words) of each of the rows (doc_id, row_key, text)."""
    bounded_batches(keyed.sparkSession)
    rows = written(signed(keyed, words), "signed")
    n = rows.where("content <> 0").count()
    some = lambda df, name, each=1: written(df, name, rows=each * n)
    texts = rows.where("content <> 0").groupBy("content")
    shared = texts.agg(F.any_value("bands").alias("bands")).select("content", F.posexplode("bands").alias("nth", "band"))
    places = texts.agg(F.min_by(F.struct("doc_id", "row_key"), F.coalesce("doc_id", F.lit(2**63 - 1))).alias("x")).select("content", "x.doc_id", "x.row_key")
    leaders = shared.groupBy("band").agg(F.min("content").alias("leader"), F.count("*").alias("n")).where("n > 1")
    buckets = some(_by_group(shared, some(leaders, "leaders", bagminhash.BANDS // 2)), "buckets", bagminhash.BANDS)
    wanted = some(buckets.select("content").distinct().join(places, "content"), "wanted")
    sets = written(_sets(keyed, wanted, words), "sets", rows=n, a_file=SETS_A_FILE)
    pairs = buckets.where("leader <> content").select(F.col("leader").alias("a"), F.col("content").alias("b")).distinct()
    links = written(_linked_pairs(pairs, sets, threshold), "links", rows=n, a_file=SETS_A_FILE)

    def classes_of(links: DataFrame) -> DataFrame:
        m = links.count()
        return written(connected_components(links, lambda df: written(df, "edges", rows=2 * m)), "components", rows=2 * m)

    found = classes_of(links)

    def still_open() -> DataFrame:
        placed = buckets.join(found, buckets["content"] == found["node"], "left").select("nth", "band", "content", F.coalesce("component", "content").alias("component"))
        bands = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high").select("band", "n")
        return some(_by_group(placed, some(bands, "bands", bagminhash.BANDS // 2)), "open", bagminhash.BANDS)

    for last in (False, True):
        cells = _cells(still_open(), sets, bands=last)
        more = _linked_rest(cells, sets, threshold) if last else _linked_pairs(_best_pairs(cells, threshold), sets, threshold)
        more = written(more, "links", rows=n, a_file=SETS_A_FILE)
        if more.limit(1).count():
            links = links.unionByName(more)
            found = classes_of(links)
    return rows.join(found, rows["content"] == found["node"], "left").select("doc_id", "row_key", F.when(F.col("content") != 0, F.coalesce("component", "content")).alias("label"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class).

    docs: doc_id, text; other columns are ignored. Documents are in one class if a chain of pairs with a multiset Jaccard
    similarity of `words`-word shingles of at least `threshold` joins them, among the pairs that share a band: 42 bands of 6
    registers miss a pair of similarity 0.8 once in 350,000. A text of fewer words has one shingle of all its words; a null
    text, or one without words, is a class of its own. Repeated rows are in one class; rows of null doc_id get their class's
    least doc_id, null if all of its ids are. Rows of one doc_id with different texts are different documents. An empty
    table gives no rows.
    """
    named = _labelled(_keyed(docs, "doc_id", "text"), threshold, words)
    least = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    least = written(least, "least", rows=named.count())
    alone = named.where("label is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return _by_group(named.where("label is not null"), least, "label", "row_key").select("doc_id", F.col("least").alias("class_id")).unionByName(alone)


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The documents' own rows, one of each class: that of least doc_id, nulls last; of several such rows, that of least hash.

    Classes are of texts, whatever the ids: rows of null or repeated doc_id are dropped only for another row of their class.
    Rows whose text is null or without words are all kept.
    """
    columns = docs.columns
    named = _labelled(_keyed(docs, *columns), threshold, words).where("label is not null")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("x")
    kept = named.groupBy("label").agg(first).select(F.col("x.doc_id").alias("_id"), F.col("x.row_key").alias("_key"))
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*columns).alias("row_key"))
    some = F.coalesce(lowered(F.col("row.text")), F.lit("")).rlike(WORD)
    best = rows.where(some).join(kept, _same_row("_id", "_key"), "left_semi").dropDuplicates(["doc_id", "row_key"])
    return best.unionByName(rows.where(~some)).select("row.*")
