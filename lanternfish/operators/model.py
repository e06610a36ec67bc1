"""The owner-trained model: class-weighted logistic regression of a fixed number of steps, leave-one-out scores, threshold, folds.

Training rows are one owner's answers, so a group's rows fit in one task by nature; owners, and held-out rows, are groups.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the training.
STEPS, RATE, PENALTY, MARGIN = 400, 0.5, 0.3, 0.02
MIN_BLOCKS, MIN_KEEPS = 20, 3
# Features that never speak for a block.
NON_POSITIVE = tuple(f"H{i:03d}" for i in range(1, 20))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[Iterable[str]], labels: list[int], vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Weights by feature and the bias, to four places. Both classes weigh the same in sum; the bias isn't penalised."""
    at = {f: i for i, f in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for i, row in enumerate(rows):
        x[i, [at[f] for f in row if f in at]] = 1
    y = np.asarray(labels, float)
    n, positive = len(y), y.sum()
    share = np.where(y == 1, n / (2 * max(1, positive)), n / (2 * max(1, n - positive)))
    w, bias = np.zeros(len(vocabulary)), 0.0
    barred = np.asarray([f in NON_POSITIVE for f in vocabulary], bool)
    for _ in range(STEPS):
        error = share * (sigmoid(x @ w + bias) - y)
        w = w - RATE * (error @ x / n + PENALTY / n * w)
        bias -= RATE * error.sum() / n
        w[barred] = np.minimum(w[barred], 0)
    return {f: round(float(v), 4) for f, v in zip(vocabulary, w, strict=True)}, round(float(bias), 4)


def scored(features: Column, weights: dict[str, float], bias: float) -> Column:
    """The model's probability for an array of features, as a built-in expression."""
    table = F.create_map(*[F.lit(v) for kv in sorted(weights.items()) for v in kv]) if weights else F.expr("map()").cast("map<string,double>")
    total = F.aggregate(features, F.lit(float(bias)), lambda acc, f: acc + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def contributions(features: Column, weights: dict[str, float], k: int = 3) -> Column:
    """The k features that speak most for a block."""
    table = F.create_map(*[F.lit(v) for kv in sorted(weights.items()) for v in kv])
    found = F.transform(features, lambda f: F.struct((-F.coalesce(F.try_element_at(table, f), F.lit(0.0))).alias("w"), f.alias("feature")))
    return F.transform(F.slice(F.array_sort(F.filter(found, lambda x: x["w"] < 0)), 1, k), lambda x: x["feature"])


def leave_one_out(training: DataFrame) -> DataFrame:
    """owner, handle, score of each training row (owner, handle, features, label) by a model of all other rows of its owner.

    One owner's answers are few and a task's group; owners are scored in parallel. Without an owner column all rows are one
    owner's. Each row is held out by itself, also where a handle has several.
    """
    rows = training if "owner" in training.columns else training.withColumn("owner", F.lit("owner"))

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("handle", kind="stable", ignore_index=True)
        scores = []
        for i, own in enumerate(pdf["features"]):
            rest = pdf.drop(index=i)
            weights, bias = fit(list(rest["features"]), list(rest["label"]), sorted({f for row in rest["features"] for f in row}))
            scores.append(float(sigmoid(bias + sum(weights.get(f, 0.0) for f in own))))
        return pd.DataFrame({"owner": key[0], "handle": pdf["handle"], "label": pdf["label"].astype("int32"), "score": scores})

    return rows.select("owner", "handle", "features", "label").groupBy("owner").applyInPandas(each, "owner string, handle string, label int, score double")


def threshold(scores: DataFrame) -> DataFrame:
    """One row: the threshold of scores (score, label, protected).

    It stands a margin above the best negative or protected row, or half way to the next positive one if that is farther.
    """
    top = scores.agg(F.coalesce(F.max(F.when((F.col("label") == 0) | F.col("protected"), F.col("score"))), F.lit(0.5)).alias("top"))
    rows = scores.join(F.broadcast(top), F.lit(True)).groupBy("top").agg(F.min(F.when((F.col("label") == 1) & (F.col("score") > F.col("top")), F.col("score"))).alias("next"))
    low = F.least(F.lit(0.999), F.col("top") + MARGIN)
    middle = (F.col("top") + F.col("next")) / 2
    return rows.select(F.bround(F.when(F.coalesce(F.col("next") - F.col("top") > 2 * MARGIN, F.lit(False)), middle).otherwise(low), 4).alias("threshold"))


def stratified_folds(labels: list[int], k: int = 5, seed: int = 7) -> list[int]:
    """The fold of each row: the rows of each class are shuffled by the seed and dealt in turn."""
    shuffle, out = random.Random(seed), [0] * len(labels)
    for value in (1, 0):
        rows = [i for i, y in enumerate(labels) if y == value]
        shuffle.shuffle(rows)
        for place, i in enumerate(rows):
            out[i] = place % k
    return out


def training_hash(rows: list[tuple]) -> str:
    """Eight digits that change with the training rows (handle, label, human, features), whatever their order."""
    text = "\n".join("|".join((str(h).lower(), str(y), str(p), ",".join(sorted(f)))) for h, y, p, f in sorted(rows, key=lambda r: (str(r[0]).lower(), r[1])))
    return hashlib.sha256(text.encode()).hexdigest()[:8]


def refitted(training: DataFrame, model: dict | None = None, force: bool = False) -> dict:
    """The owner's model after the answers (handle, label, human, features) so far: the old one unless they changed.

    A new model counts its refits and names the hash of its rows. It is inactive with too few answers, or if no block of the
    owner's clears the threshold that no keep and no human does. The rows are one owner's answers, few by nature.
    """
    rows = sorted(((r["handle"], r["label"], r["human"], r["features"]) for r in training.collect()), key=lambda r: (r[0].lower(), r[1]))
    sha = training_hash(rows)
    if model and model["training_sha8"] == sha and not force:
        return model
    labels = [r[1] for r in rows]
    new = {"refit": (model or {}).get("refit", 0) + 1, "training_sha8": sha, "n_block": sum(labels), "n_keep": len(labels) - sum(labels), "active": False, "why_inactive": "too few answers"}
    if not active(labels):
        return new
    features = [r[3] for r in rows]
    vocabulary = lambda some: sorted({f for row in some for f in row})
    scores = []
    for i, own in enumerate(features):
        rest = features[:i] + features[i + 1 :]
        weights, bias = fit(rest, labels[:i] + labels[i + 1 :], vocabulary(rest))
        scores.append(float(sigmoid(bias + sum(weights.get(f, 0.0) for f in own))))
    barred = [s for s, (_, y, human, _) in zip(scores, rows, strict=True) if not y or human]
    top = max(barred, default=0.5)
    above = [s for s, y in zip(scores, labels, strict=True) if y and s > top]
    limit = round((top + min(above)) / 2 if above and min(above) - top > 2 * MARGIN else min(0.999, top + MARGIN), 4)
    caught = sum(1 for s, y in zip(scores, labels, strict=True) if y and s >= limit)
    weights, bias = fit(features, labels, vocabulary(features))
    return new | {"active": caught > 0, "why_inactive": None if caught else "no owner block clears the threshold", "weights": weights, "bias": bias, "threshold": limit, "caught": caught}


def active(labels: list[int]) -> bool:
    """Whether there are answers enough to use a model."""
    return sum(labels) >= MIN_BLOCKS and len(labels) - sum(labels) >= MIN_KEEPS


def cross_validated(rows: list[Iterable[str]], labels: list[int], protected: list[bool], k: int = 5) -> list[tuple[int, float, bool]]:
    """Nested folds: (fold, score, flagged) of each row by a model and a threshold of the other folds alone.

    The threshold of a fold comes from leave-one-out scores within the other folds, so that no row is scored by a model that saw it.
    """
    folds, out = stratified_folds(labels, k), [(0, 0.0, False)] * len(rows)

    def score(train: list[int], i: int) -> float:
        weights, bias = fit([rows[j] for j in train], [labels[j] for j in train], sorted({f for j in train for f in rows[j]}))
        return float(sigmoid(bias + sum(weights.get(f, 0.0) for f in rows[i])))

    for fold in sorted(set(folds)):
        train = [i for i, f in enumerate(folds) if f != fold]
        inner = {i: score([j for j in train if j != i], i) for i in train}
        top = max((s for i, s in inner.items() if not labels[i] or protected[i]), default=0.5)
        above = [s for i, s in inner.items() if labels[i] and s > top]
        limit = (top + min(above)) / 2 if above and min(above) - top > 2 * MARGIN else min(0.999, top + MARGIN)
        for i in (i for i, f in enumerate(folds) if f == fold):
            s = score(train, i)
            out[i] = (fold, s, s >= round(limit, 4))
    return out


def backtest(predictions: DataFrame, by: str) -> DataFrame:
    """predictions (tier, flagged, label, human) per tier: recall on blocks, false positives on keeps and on accounts labelled human."""
    keep, block = F.col("label") == 0, F.col("label") == 1
    rows = predictions.groupBy(by).agg(
        F.count_if(block).alias("n_blocks"), F.count_if(block & F.col("flagged")).alias("n_caught"), F.count_if(keep & F.col("flagged")).alias("n_false"), F.count_if(F.col("human") & F.col("flagged")).alias("n_false_human")
    )
    return rows.withColumn("recall", F.when(F.col("n_blocks") > 0, F.bround(F.col("n_caught") / F.col("n_blocks"), 4)))


def backtest_lists(predictions: DataFrame, by: str) -> DataFrame:
    """tier, handle and what is wrong with each prediction: a block that was missed, or a keep or an unrated human that was flagged."""
    label, flagged = F.col("label"), F.col("flagged")
    what = F.when((label == 1) & ~flagged, "MISSED_BLOCK").when((label == 0) & flagged, "FLAGGED_KEEP").when(label.isNull() & flagged & F.col("human"), "FLAGGED_HUMAN")
    return predictions.withColumn("what", what).where("what is not null").select(by, "handle", "what")


def never_rated(states: DataFrame, model: dict) -> DataFrame:
    """handle, score of the unrated states (handle, features) that the model would flag at its threshold; none if it is inactive."""
    if not model["active"]:
        return states.limit(0).select("handle", F.lit(0.0).alias("score"))
    rows = states.select("handle", scored(F.col("features"), model["weights"], model["bias"]).alias("score"))
    return rows.where(F.col("score") >= model["threshold"])


def missed_fixtures(fixtures: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The fixtures (handle, tier: null for any) that must be blocked but aren't, or not by that tier (verdicts: handle, auto_block, tier)."""
    rows = fixtures.withColumnRenamed("tier", "wanted").join(verdicts, "handle", "left")
    good = F.coalesce("auto_block", F.lit(False)) & F.coalesce(F.col("wanted") == F.col("tier"), F.col("wanted").isNull())
    return rows.where(~good).select("handle", "wanted", "tier")
