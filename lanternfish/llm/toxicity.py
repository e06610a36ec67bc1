"""Toxicity by cumulative-link ordinal regression over sparse word features.

The features of a text are its words and the first 4 to 6 letters of its longer words. Labels say toxic or not and may give a
severity grade of 1, 2 or 3. Where they give none, a toxic document's grade is which third of the labelled toxic documents it
is in by how often the words that mark toxic documents occur in it; grades 2 and 3 then hold no more than these words. One weight per word is shared by all thresholds: P(grade > k) = sigmoid(w . x - t_k) with t_0 <= t_1 <= t_2
and x = log(1 + count). The expected severity is the sum of these, 0 to 3; a document is rejected if P(grade > 0) >= 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.common import BYTES, bounded_batches, text_runs, words, written

GRADES = 3
#: Labelled documents a model is fitted on at most, taken in the order of a hash of doc_id.
SAMPLE = 10_000
PREFIXES = (4, 5, 6)
#: How far a feature's share of toxic documents must be from its share of clean ones, in standard errors of the log ratio. A
#: word nearer to that than chance has no weight: what it says is lost, on purpose, as it is noise in a sample of this size.
LEAST_Z = 2.9
L2, STEPS, RATE = 1e-5, 400, 0.3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_ordinal(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the cumulative-link model, by Adam on the mean log loss with an L2 penalty."""
    n = len(grade)
    w, t = np.zeros(features), np.log(1 / np.clip([(grade > k).mean() for k in range(GRADES)], 1e-3, 1 - 1e-3) - 1)
    state = np.concatenate([w, t])
    m, v = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        w, t = state[:features], state[features:]
        eta = np.bincount(doc, w[feature] * value, n)
        above = np.concatenate([np.ones((n, 1)), _sigmoid(eta[:, None] - t[None, :]), np.zeros((n, 1))], axis=1)
        slope = above * (1 - above)
        own = np.maximum(above[np.arange(n), grade] - above[np.arange(n), grade + 1], 1e-9)
        by_eta = -(slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / own / n
        by_t = [(np.where(grade == k + 1, slope[:, k + 1], 0) - np.where(grade == k, slope[:, k + 1], 0)) @ (1 / own) / n for k in range(GRADES)]
        gradient = np.concatenate([np.bincount(feature, by_eta[doc] * value, features) + L2 * w, by_t])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        state = state - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        state[features:] = np.maximum.accumulate(state[features:])
    return state[:features], state[features:]


def features_of(word: str) -> list[str]:
    """The word itself, marked by $, and its beginnings, marked by *."""
    return [word + "$", *[word[:k] + "*" for k in PREFIXES if len(word) > k]]


@dataclass
class Model:
    """Features with their weights, and the thresholds between grades."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def counted(self, texts: list[str | None]) -> list[Counter]:
        """How often each feature of the model occurs in each text."""
        split = [(x or "").encode("utf-8", "surrogatepass").translate(BYTES).split() for x in texts]
        known = {}
        for word in set().union(*split):
            if found := [f for f in features_of(word.decode("utf-8", "surrogatepass")) if f in self.weights]:
                known[word] = found
        return [Counter(f for w in row if w in known for f in known[w]) for row in split]

    def above(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) for each text and k; a null text has no words."""
        eta = np.array([sum(self.weights[f] * np.log1p(n) for f, n in sorted(row.items())) for row in self.counted(texts)], float)
        return _sigmoid(eta[:, None] - self.thresholds[None, :])

    def graded(self, docs: DataFrame) -> DataFrame:
        """doc_id, severity (expected grade, 0 to 3), grade (the most likely one) and toxic, of each row of docs (doc_id, text).

        Other columns are ignored. A null or empty text has no features and gets what the thresholds alone say; a very long one is
        read whole; of equally likely grades the least counts; rows of null or repeated doc_id get a row each; an empty table
        gives none.
        """

        def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).cast(pa.string())
                for a, b in text_runs(texts):
                    above = self.above(texts[a:b].to_pylist())
                    each = np.hstack([np.ones((b - a, 1)), above]) - np.hstack([above, np.zeros((b - a, 1))])
                    columns = [batch.column(0)[a:b], pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "grade", "toxic"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(grade, "doc_id long, severity double, grade int, toxic boolean")

    def kept(self, docs: DataFrame) -> DataFrame:
        """The rows of docs, with all their columns, that are not rejected: P(grade > 0) < 0.5 by their own text, null or repeated ids or not."""
        at = docs.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).cast(pa.string())
                for a, b in text_runs(texts):
                    yield batch.slice(a, b - a).filter(pa.array(self.above(texts[a:b].to_pylist())[:, 0] < 0.5))

        return docs.mapInArrow(keep, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of at most `sample` labelled documents (labels: doc_id, toxic 0/1 and, if it has that column, severity 1 to 3).

    Rows with a null doc_id or label are left out, a doc_id labelled twice is toxic if either label is and has the greater
    severity, and documents of a repeated doc_id count separately. With no labels, no documents, or none of one kind, nothing
    is rejected. The features are all those of the labelled documents that pass LEAST_Z, so the sample bounds them, too.
    """
    bounded_batches(docs.sparkSession)
    severity = F.col("severity").cast("int") if "severity" in labels.columns else F.lit(None).cast("int")
    named = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.max(severity).alias("severity"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", "severity")
    rows = written(found.repartition(8, "doc_id", "text"), "labelled")
    totals = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count("*").alias("n")).first()
    toxic, clean = totals["toxic"], totals["n"] - totals["toxic"]
    if not toxic or not clean:
        return Model({}, np.full(GRADES, 35.0))
    starts = [F.transform(F.filter("words", lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in PREFIXES]
    named = rows.select("toxic", F.array_distinct(words(F.col("text"))).alias("words"))
    seen = named.select("toxic", F.explode(F.array_distinct(F.concat(F.transform("words", lambda w: F.concat(w, F.lit("$"))), *starts))).alias("feature"))
    seen = seen.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    ratio = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    scored = seen.withColumn("z", ratio / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))).where(F.abs("z") >= LEAST_Z)
    picked = {r["feature"]: r["z"] for r in sorted(scored.collect(), key=lambda r: r["feature"])}
    index = {f: i for i, f in enumerate(picked)}
    selected = Model(dict.fromkeys(picked, 0.0), np.zeros(GRADES))

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [sorted((index[f], n) for f, n in row.items()) for row in selected.counted(batch.column(1).to_pylist())]
            lists = [pa.array([[x[k] for x in row] for row in counts], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *lists], names=["doc_id", "toxic", "severity", "feature", "n"])

    table = rows.mapInArrow(design, "doc_id long, toxic int, severity int, feature array<int>, n array<int>").collect()
    table = sorted(table, key=lambda r: (r["doc_id"], r["feature"], r["n"]))
    doc = np.repeat(np.arange(len(table)), [len(r["feature"]) for r in table])
    feature = np.array([f for r in table for f in r["feature"]], np.int64)
    n = np.array([k for r in table for k in r["n"]], float)
    label = np.array([r["toxic"] for r in table], np.int64)
    marks = np.array([f.endswith("$") and z > 0 for f, z in picked.items()], float)
    hits = np.bincount(doc, n * marks[feature], len(table))
    cuts = np.quantile(hits[label == 1], [1 / 3, 2 / 3])
    given = np.array([min(GRADES, max(1, r["severity"])) if r["severity"] is not None else 0 for r in table])
    grade = np.where(label == 1, np.where(given > 0, given, 1 + (hits > cuts[0]) + (hits > cuts[1])), 0)
    weights, thresholds = fit_ordinal(doc, feature, np.log1p(n), grade, len(index))
    return Model(dict(zip(picked, weights.tolist(), strict=True)), thresholds)
