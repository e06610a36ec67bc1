"""Approximate nearest neighbours by inner product: a forest of hash-prefix trees, kept as sorted arrays.

A vector's hash string in a tree is 64 signs of random projections, the first bit first. Vectors are scaled by the greatest
norm and get one more component that makes their norms equal, queries get 0 there; so the nearest by angle are those of the
largest inner product. A tree is one array sorted by hash string, cut into parts at bounds that a bounded sample of vectors
gives; the vectors that share the first x bits with a query are one range of it.

A search descends in all trees to the longest prefixes and then ascends in all of them at once, a bit at a time, until
the query's ranges hold about `candidates` vectors, as counted on the sample. Only the parts that a range reaches get the
query. A part is sorted in its task, ranges are found by bisection, and their vectors are scored with 16-bit components; the
best of all trees are then scored in double precision with the vectors themselves. How many candidates are needed for the
wished recall is measured, on a bounded number of queries, against brute force over all vectors. Each vector goes to one part
per tree, whatever the number of queries, so the index's shuffle is in proportion to it. Where vectors have clusters, the
ranges are a small part of them; where they have no structure at all, recall itself demands a fixed share of all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.llm.common import small, written

TREES, BITS, SEED = 16, 64, 20240607
#: Vectors that a part has on average, and those beyond which the part of one hash string is cut by another hash.
PART, LARGEST = 16_384, 262_144
#: Bytes of a part's vectors, as one task holds them, beyond which it is cut as well.
PART_BYTES = 256_000_000
#: Queries of a part that one task takes; the part's vectors go to as many tasks as it has such lots.
QUERIES = 4_096
#: Vectors of each length, about, that bounds and counts of prefixes are taken from.
SAMPLE = 32_768
#: Queries of each length measured against brute force, and the recall that the number of candidates must reach on them.
MEASURED, RECALL = 100, 0.96


def _planes(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, TREES * BITS))


def _codes(x: np.ndarray) -> np.ndarray:
    """uint64 [trees, rows]: the hash strings."""
    bits = (x @ _planes(x.shape[1]) > 0).reshape(len(x), TREES, BITS // 8, 8)
    return np.ascontiguousarray(np.packbits(bits, axis=3).reshape(len(x), TREES, 8)).view(">u8")[:, :, 0].T.astype(np.uint64)


def _entry_codes(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0, 1 - ((x / norm) ** 2).sum(axis=1)))
    return _codes(np.hstack([x / norm, rest[:, None]]))


def _query_codes(x: np.ndarray) -> np.ndarray:
    return _codes(np.hstack([x / np.sqrt((x**2).sum(axis=1, keepdims=True)), np.zeros((len(x), 1))]))


def _range(codes: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest hash string that shares the first `level` bits."""
    level = np.broadcast_to(np.asarray(level), codes.shape)
    free = np.where(level > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(level, 63).astype(np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
    free = np.where(level >= BITS, np.uint64(0), free)
    return codes & ~free, codes | free


def _by_size(batch: pa.RecordBatch, names: tuple[str, str] = ("key", "vector")) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Keys and vectors of a batch, those of one length together."""
    keys, vectors = np.asarray(batch.column(names[0])), batch.column(names[1])
    starts, flat = np.asarray(vectors.offsets), np.asarray(vectors.values)
    sizes = np.diff(starts)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), keys[rows], flat[starts[rows][:, None] + np.arange(size)[None, :]]


def usable(vectors: DataFrame, id_name: str = "vec_id") -> DataFrame:
    """id, vector (array of double) and key (a hash of the vector) of the rows that take part.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows of null id.
    """
    rows = vectors.select(F.col(id_name).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector")).where("id is not null and size(vector) > 0")
    good = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    return rows.where(good).withColumn("key", F.xxhash64("vector"))


@dataclass
class Tree:
    """Sorted arrays of the vectors of one length: sample codes by tree, and per tree the bounds of its parts, their first number and cuts."""

    norm: float
    count: int
    sample: np.ndarray
    bounds: list[np.ndarray]
    first: list[np.ndarray]
    cuts: list[np.ndarray]

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """float [rows, BITS + 1]: about how many vectors, over all trees, share 0, 1, ... 64 bits; codes: [trees, rows]."""
        out = np.zeros((codes.shape[1], BITS + 1))
        for level in range(BITS + 1):
            for tree in range(TREES):
                low, high = _range(codes[tree], level)
                out[:, level] += np.searchsorted(self.sample[tree], high, "right") - np.searchsorted(self.sample[tree], low, "left")
            if not out[:, level].any():
                break
        return out * (self.count / max(1, self.sample.shape[1]))


def _levels(counts: np.ndarray, budget: float) -> np.ndarray:
    """The longest prefix that about `budget` vectors share, over all trees; 0 if there are not so many."""
    return np.maximum(0, (counts >= budget).sum(axis=1) - 1)


class Forest:
    """The index of all usable vectors: written entries (distinct vectors with their ids) and, per length of vectors, its trees."""

    def __init__(self, vectors: DataFrame, k: int = 20):
        self.spark, self.k = vectors.sparkSession, k
        rows = usable(vectors)
        place = F.dense_rank().over(Window.partitionBy("key", "vector").orderBy("id"))
        least = rows.withColumn("place", place).where(F.col("place") <= k + 1)
        entries = least.groupBy("key", "vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        self.entries = written(entries, "entries")
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
        stats = self.entries.groupBy(F.size("vector").alias("size")).agg(F.max(norm).alias("norm"), F.count("*").alias("n")).collect()
        most = self.entries.select(F.explode("ids").alias("id")).groupBy("id").count().agg(F.max("count")).first()[0]
        #: Vectors of one id at most; so many more are kept in each step, as a query's own id leaves at the end.
        self.own = most or 1
        sample = self._sample({r["size"]: r["n"] for r in stats}, {r["size"]: r["norm"] for r in stats})
        self.trees, self.parts = {}, 0
        for r in sorted(stats, key=lambda r: r["size"]):
            self.trees[r["size"]] = self._cut(r["size"], r["norm"], r["n"], sample.get(r["size"], np.zeros((TREES, 0), np.uint64)))

    def _sample(self, counts: dict[int, int], norms: dict[int, float]) -> dict[int, np.ndarray]:
        """Sorted hash strings [trees, rows] of about SAMPLE vectors of each length, taken by a hash of the vector."""

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, keys, x in _by_size(batch):
                    chosen = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)
                    x = x[chosen.astype(np.float64) * 2.0**-53 < SAMPLE / counts[size]]
                    if len(x):
                        blob = _entry_codes(x, norms[size]).T.astype("<u8").tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([blob], pa.binary())], names=["size", "codes"])

        found: dict[int, list] = {}
        for r in self.entries.select("key", "vector").mapInArrow(codes, "size int, codes binary").toLocalIterator():
            found.setdefault(r["size"], []).append(np.frombuffer(r["codes"], "<u8").reshape(-1, TREES))
        return {size: np.sort(np.concatenate(blobs).T.astype(np.uint64), axis=1) for size, blobs in found.items()}

    def _cut(self, size: int, norm: float, count: int, sample: np.ndarray) -> Tree:
        """A length's parts: bounds at even steps of the sample; a part of more than LARGEST vectors, or PART_BYTES of them, about, is cut by a hash of the vector."""
        parts, seen = max(1, min(-(-count // PART), sample.shape[1] // 8)), sample.shape[1]
        bounds, first, cuts = [], [], []
        for codes in sample:
            at = np.unique(codes[(np.arange(1, parts) * seen) // parts]) if parts > 1 else np.zeros(0, np.uint64)
            held = np.diff(np.concatenate([[0], np.searchsorted(codes, at), [seen]])) * (count / max(1, seen))
            cut = np.maximum(1, np.ceil(held / min(LARGEST, max(1, PART_BYTES // (8 * size))))).astype(np.int64)
            bounds.append(at)
            cuts.append(cut)
            first.append(self.parts + np.cumsum(cut) - cut)
            self.parts += int(cut.sum())
        return Tree(norm, count, sample, bounds, first, cuts)

    def _index(self) -> DataFrame:
        """part, code, entry, scale and points (16-bit components) of each entry in each tree."""
        trees = self.trees

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, keys, x in _by_size(batch):
                    tree = trees[size]
                    codes = _entry_codes(x, tree.norm)
                    top = np.abs(x).max(axis=1)
                    points = np.round(x / top[:, None] * 32767).astype("<i2")
                    raw = pa.array([p.tobytes() for p in points], pa.binary())
                    for t in range(TREES):
                        part = np.searchsorted(tree.bounds[t], codes[t], "right")
                        number = tree.first[t][part] + (keys.view(np.uint64) % tree.cuts[t][part].astype(np.uint64)).astype(np.int64)
                        columns = [pa.array(number.astype(np.int32)), pa.array(codes[t].view(np.int64)), pa.array(keys), pa.array((top / 32767).astype(np.float32)), raw]
                        yield pa.RecordBatch.from_arrays(columns, names=["part", "code", "entry", "scale", "points"])

        return self.entries.select("key", "vector").mapInArrow(place, "part int, code long, entry long, scale float, points binary")

    def _asked(self, points: DataFrame, budgets: dict[int, float]) -> DataFrame:
        """part, low, high (hash strings), point and q (its vector) for each part that one of a query's ranges reaches."""
        trees = self.trees

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, keys, x in _by_size(batch):
                    if size not in trees:
                        continue
                    tree, codes = trees[size], _query_codes(x)
                    level = _levels(tree.counts(codes), budgets[size])
                    raw = pa.array([v.tobytes() for v in (x / np.abs(x).max(axis=1, keepdims=True)).astype("<f4")], pa.binary())
                    for t in range(TREES):
                        low, high = _range(codes[t], level)
                        a, b = (np.searchsorted(tree.bounds[t], v, "right") for v in (low, high))
                        begin = tree.first[t][a]
                        number = tree.first[t][b] + tree.cuts[t][b] - begin
                        row = np.repeat(np.arange(len(x)), number)
                        part = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                        columns = [pa.array(part.astype(np.int32)), pa.array(low.view(np.int64)[row]), pa.array(high.view(np.int64)[row]), pa.array(keys[row]), raw.take(pa.array(row))]
                        yield pa.RecordBatch.from_arrays(columns, names=["part", "low", "high", "point", "q"])

        return points.mapInArrow(place, "part int, low long, high long, point long, q binary")

    def _budgets(self, points: DataFrame) -> dict[int, float]:
        """The fewest candidates per length, of a growing row of numbers, that reach RECALL on at most MEASURED queries."""
        k, trees = self.k, self.trees
        place = F.row_number().over(Window.partitionBy(F.size("vector")).orderBy(F.xxhash64("key"), "key"))
        chosen = points.withColumn("place", place).where(F.col("place") <= MEASURED).collect()
        asked = {}
        for size in sorted({len(r["vector"]) for r in chosen} & set(trees)):
            rows = sorted((r for r in chosen if len(r["vector"]) == size), key=lambda r: (r["key"], r["vector"]))
            x = np.array([r["vector"] for r in rows])
            asked[size] = (np.array([r["key"] for r in rows]), x, _query_codes(x))

        def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {}
            for batch in batches:
                for size, keys, x in _by_size(batch):
                    if size not in asked:
                        continue
                    own, q, codes = asked[size]
                    scores = q @ x.T
                    scores[own[:, None] == keys[None, :]] = -np.inf
                    at = np.argsort(-scores, axis=1)[:, :k]
                    shared, mine = np.zeros(at.shape, np.int64), _entry_codes(x, trees[size].norm)
                    for t in range(TREES):
                        differ = mine[t][at] ^ codes[t][:, None]
                        shared = np.maximum(shared, BITS - np.where(differ >> np.uint64(32) > 0, 32 + np.frexp((differ >> np.uint64(32)).astype(np.float64))[1], np.frexp((differ & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]))
                    new = np.stack([np.take_along_axis(scores, at, 1), shared])
                    both = np.concatenate([best[size], new], axis=2) if size in best else new
                    best[size] = np.take_along_axis(both, np.argsort(-both[:1], axis=2)[:, :, :k], 2)
            for size, (score, shared) in best.items():
                at = np.repeat(np.arange(len(score)), score.shape[1])
                columns = [pa.array(np.full(len(at), size, np.int32)), pa.array(at.astype(np.int32)), pa.array(score.ravel()), pa.array(shared.ravel().astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["size", "nth", "score", "shared"])

        found = self.entries.select("key", "vector").mapInArrow(truth, "size int, nth int, score double, shared int").where("score > double('-inf')")
        rank = F.row_number().over(Window.partitionBy("size", "nth").orderBy(F.desc("score"), F.desc("shared")))
        rows = found.withColumn("rank", rank).where(F.col("rank") <= k).select("size", "nth", "shared").collect()
        budgets = {}
        for size, (_, _, codes) in asked.items():
            counts = trees[size].counts(codes)
            mine = [(r["nth"], r["shared"]) for r in rows if r["size"] == size]
            nth, shared = np.array([m[0] for m in mine], np.int64), np.array([m[1] for m in mine])
            budget = float((k + 1) * TREES)
            while len(mine) and budget < counts[:, 0].max() and (shared >= _levels(counts, budget)[nth]).mean() < RECALL:
                budget *= 1.15
            budgets[size] = budget
        return budgets

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score: the k nearest found of each usable row of queries (vec_id, embedding), not itself.

        Nearest first, ties by the smaller vec_id; all other vectors, if there are fewer. Only vectors of the query's own length
        are its candidates; every length has its trees. A query need not be in the index. A vec_id on several rows is several
        vectors of that id, none of which is returned to its own id; repeated rows are one. An empty index or query table
        gives no rows. Other columns are ignored.
        """
        k, most = self.k, self.k + self.own
        asked = written(usable(queries).distinct(), "queries")
        points = written(asked.select("key", "vector").distinct(), "points")
        self.budgets = self._budgets(points)
        ranges = written(self._asked(points, self.budgets), "ranges")
        lots = ranges.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("lots")).where("lots > 1")
        lots = small(written(lots, "lots"))
        index = self._index().join(lots, "part", "left").withColumn("lot", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1))).drop("lots")
        ranges = ranges.join(lots.withColumnRenamed("lots", "cut"), "part", "left").withColumn("lot", F.pmod(F.xxhash64("point"), F.coalesce("cut", F.lit(1))).cast("int")).drop("cut")

        def nearest(table: pa.Table, wanted: pa.Table) -> pa.Table:
            out = [[], [], []]
            if table.num_rows and wanted.num_rows:
                codes = np.asarray(table.column("code")).view(np.uint64)
                order = np.argsort(codes, kind="stable")
                codes, entry, scale = codes[order], np.asarray(table.column("entry"))[order], np.asarray(table.column("scale"))[order]
                points = np.frombuffer(b"".join(table.column("points").to_pylist()), "<i2").reshape(len(order), -1)[order].astype(np.float32)
                q = np.frombuffer(b"".join(wanted.column("q").to_pylist()), "<f4").reshape(wanted.num_rows, -1)
                low = np.searchsorted(codes, np.asarray(wanted.column("low")).view(np.uint64), "left")
                high = np.searchsorted(codes, np.asarray(wanted.column("high")).view(np.uint64), "right")
                names = np.asarray(wanted.column("point"))
                for i in np.flatnonzero(high > low):
                    score = (points[low[i] : high[i]] @ q[i]) * scale[low[i] : high[i]]
                    at = np.argpartition(-score, most + 3)[: most + 4] if len(score) > most + 4 else np.arange(len(score))
                    for part, value in zip(out, (np.full(len(at), names[i]), entry[low[i] + at], score[at]), strict=True):
                        part.append(value)
            columns = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, (np.int64, np.int64, np.float32), strict=True)]
            return pa.table({n: pa.array(c) for n, c in zip(("point", "entry", "score"), columns, strict=True)})

        found = index.groupBy("part", "lot").cogroup(ranges.groupBy("part", "lot")).applyInArrow(nearest, "point long, entry long, score float")
        found = found.groupBy("point", "entry").agg(F.max("score").alias("score"))
        order = Window.partitionBy("point").orderBy(F.desc("score"), "entry")
        pairs = written(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2 * most).select("point", "entry"), "pairs")
        scored = pairs.join(self.entries.select(F.col("key").alias("entry"), F.col("vector").alias("other"), "ids"), "entry")
        scored = scored.join(points.select(F.col("key").alias("point"), "vector"), "point").where(F.size("vector") == F.size("other"))
        score = F.aggregate(F.zip_with("vector", "other", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        each = scored.select("point", "vector", score.alias("score"), F.explode("ids").alias("vec_id"))
        order = Window.partitionBy("point", "vector").orderBy(F.desc("score"), "vec_id")
        each = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        best = each.groupBy("point", "vector").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
        mine = asked.select(F.col("id").alias("query_id"), "key", F.col("vector").alias("v")).join(best, (F.col("key") == F.col("point")) & (F.col("v") == F.col("vector")))
        others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
        return mine.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
