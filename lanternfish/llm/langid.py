"""Language identification in two steps: the language family first, then the language within it.

A text's features are the square roots of the shares of its hashed byte 2-, 3- and 4-grams, taken from its lower-cased words;
they have length 1. Families are groups of languages whose mean features are alike. Between each two families, and between
each two languages of a family, stands a linear support vector machine of its own; the family, and then the language in
it, that wins most of its duels is predicted, ties by the sum of margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.llm.common import BYTES, bounded_batches, small, text_runs

BUCKETS, ORDERS = 8_192, (2, 3, 4)
#: Documents per language that a model is fitted on at most, in the order of a hash of doc_id.
PER_LANGUAGE = 1_000
#: Documents of a side of a duel that it is fitted on at most, the same share of each of the side's languages.
PER_SIDE = 2_000
PENALTY, STEPS = 1e-4, 150
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """Whether the document is kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(texts: list[str]) -> np.ndarray:
    """float32 [texts, BUCKETS]; a text without grams has zeros."""
    raw = [b" " + x.encode("utf-8", "surrogatepass") + b" " for x in texts]
    data = np.frombuffer(b"".join(raw).translate(BYTES), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw), dtype=np.int64) * BUCKETS, [len(x) for x in raw])
    counts = np.zeros(len(raw) * BUCKETS, np.int64)
    gram = np.zeros(len(data), np.uint32)
    for k in range(max(ORDERS)):
        gram = gram[: len(data) - k] * np.uint32(257) + data[k:] if k else data.copy()
        if k + 1 in ORDERS:
            inside = owner[: len(gram)] == owner[k:]
            blank = (data[: len(gram)] == 32) & (data[1 : len(gram) + 1] == 32) if k else data == 32
            at = (gram * np.uint32(2654435761) + np.uint32(k) * np.uint32(40503)) >> np.uint32(32 - 13)
            counts += np.bincount((owner[: len(gram)] + at)[inside & ~blank], minlength=len(counts))
    counts = counts.reshape(len(raw), BUCKETS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias of a linear SVM with squared hinge loss, by accelerated gradient steps; y is 1 or -1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, z, t = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32), 1.0
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ z[:-1] + z[-1])) * y * share
        gradient = np.concatenate([PENALTY * z[:-1] - 2 * (slack @ x), [-2 * slack.sum()]]).astype(np.float32)
        new, next_t = z - gradient / (4 + PENALTY), (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + np.float32((t - 1) / next_t) * (new - w), new, next_t
    return w


def families_of(means: np.ndarray) -> list[list[int]]:
    """Groups of like rows: average-linkage clusters, cut at the widest gap between merges; one row alone is a family."""
    groups = [[i] for i in range(len(means))]
    if len(groups) < 3:
        return groups
    near = means @ means.T
    steps = []
    while len(groups) > 1:
        best = max(((np.mean([near[i, j] for i in a for j in b]), m, n) for (m, a), (n, b) in combinations(enumerate(groups), 2)), key=lambda x: (x[0], -x[1], -x[2]))
        steps.append((best[0], [list(g) for g in groups]))
        groups[best[1]] = sorted(groups[best[1]] + groups.pop(best[2]))
    gaps = [steps[i][0] - steps[i + 1][0] for i in range(len(steps) - 1)]
    return steps[int(np.argmax(gaps)) + 1][1]


@dataclass
class Model:
    """languages, families (lists of places in languages) and the duels: level and sides (of families, or languages) with weights."""

    languages: list[str]
    families: list[list[int]]
    duels: list[tuple[int, int, int]]
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score from 0 to 1; UNDETERMINED and 0 for a null text or one without letters."""
        lettered = [i for i, x in enumerate(texts) if x and (any(map(str.isalpha, x[:64])) or any(map(str.isalpha, x)))]
        out, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not lettered or not self.languages:
            return out, score
        x = features([texts[i] for i in lettered])
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1] if len(self.weights) else np.zeros((len(x), 0))

        def winner(level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
            votes, sums, least = np.zeros((len(x), size)), np.zeros((len(x), size)), np.full((len(x), size), 9.0)
            for k, (at, a, b) in enumerate(self.duels):
                if at == level:
                    for side, m in ((a, margins[:, k]), (b, -margins[:, k])):
                        votes[:, side] += m > 0
                        sums[:, side] += m
                        least[:, side] = np.minimum(least[:, side], m)
            best = (votes * 1e6 + sums).argmax(axis=1)
            return best, least[np.arange(len(x)), best]

        family, sure = winner(0, len(self.families))
        language = np.zeros(len(x), np.int64)
        for f, members in enumerate(self.families):
            votes, own = winner(f + 1, len(members))
            mine = family == f
            language[mine], sure[mine] = np.asarray(members)[votes[mine]], np.minimum(sure[mine], own[mine])
        for i, k, s in zip(lettered, language, sure, strict=True):
            out[i], score[i] = self.languages[k], 1 / (1 + np.exp(-2 * s))
        return out, score

    def identified(self, docs: DataFrame) -> DataFrame:
        """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text); whole texts are read, other columns ignored.

        A null text, or one without letters, is UNDETERMINED with score 0. A null doc_id is not held out; repeated rows get a row
        each, with the same prediction; equal votes and margins go to the language first by name; an empty table gives no rows.
        """

        def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(2).cast(pa.string())
                for a, b in text_runs(texts, 1_000):
                    languages, score = self.predict(texts[a:b].to_pylist())
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(languages, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

        rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
        return rows.mapInArrow(identify, "doc_id long, held_out boolean, lang_pred string, score double")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of docs (doc_id, text, lang; other columns are ignored) that aren't held out, at most `per_language` of each language.

    They are the first by a hash of doc_id and text among a share of the language's documents in which twice as many are to be
    expected, so that no task gets all documents of a large language. Rows with a null id, lang or text, or a text without words, teach nothing. With one language it is always predicted, with
    none every text is undetermined. Rows of a repeated doc_id are documents of their own, equal rows one document.
    The driver holds the sparse features of the chosen documents; a duel's matrix has at most 2 x PER_SIDE rows.
    """
    bounded_batches(docs.sparkSession)
    usable = docs.select("doc_id", "lang", "text").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.withColumn("key", F.xxhash64("doc_id", "text"))
    share = usable.groupBy("lang").agg((2.0 * per_language / F.count("*")).alias("share"))
    few = usable.select("key", "lang").join(small(share), "lang").where(F.pmod("key", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))
    chosen = few.select("key", "lang").distinct().withColumn("place", place).where(F.col("place") <= per_language).select("key", "lang")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            for a, b in text_runs(texts, 200):
                rows = features([x or "" for x in texts[a:b].to_pylist()])
                at = [np.flatnonzero(row).astype(np.int32) for row in rows]
                columns = [pa.array([x.tobytes() for x in at], pa.binary()), pa.array([row[x].tobytes() for row, x in zip(rows, at, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *columns], names=["lang", "at", "share"])

    rows = usable.join(small(chosen), ["key", "lang"], "left_semi").dropDuplicates(["key", "lang"]).select("lang", "text")
    found = sorted((r for r in rows.mapInArrow(learn, "lang string, at binary, share binary").toLocalIterator() if r["at"]), key=lambda r: (r["lang"], r["at"], r["share"]))
    languages = sorted({r["lang"] for r in found})
    of = {name: [r for r in found if r["lang"] == name] for name in languages}

    def dense(some: list) -> np.ndarray:
        x = np.zeros((len(some), BUCKETS), np.float32)
        for i, r in enumerate(some):
            x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["share"], np.float32)
        return x

    def duel(left: list[int], right: list[int]) -> np.ndarray:
        """The machine between two groups of languages; rows sorted by their content are taken at even steps."""
        sides = [[r for k in side for r in of[languages[k]][:: -(-len(of[languages[k]]) * len(side) // PER_SIDE)]] for side in (left, right)]
        return fit_svm(dense(sides[0] + sides[1]), np.repeat(np.asarray([1, -1], np.float32), [len(x) for x in sides]))

    means = np.array([dense(of[name]).mean(axis=0) for name in languages]) if languages else np.zeros((0, BUCKETS))
    means = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    families = families_of(means)
    duels, weights = [], []
    for a, b in combinations(range(len(families)), 2):
        duels.append((0, a, b))
        weights.append(duel(families[a], families[b]))
    for f, members in enumerate(families):
        for a, b in combinations(range(len(members)), 2):
            duels.append((f + 1, a, b))
            weights.append(duel([members[a]], [members[b]]))
    return Model(languages, families, duels, np.array(weights, np.float32).reshape(len(duels), BUCKETS + 1))
