"""Predictions of language and toxicity beside loops that know only the fitted weights."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lanternfish.llm import langid, toxicity
from lanternfish.llm.common import read

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {65 + i: 97 + i for i in range(26)}
ODD = [(None, None), (9_001, ""), (9_002, " 12 !"), (9_003, "é"), (9_004, "Der Hund und die Katze " * 300), (9_004, "the dog"), (9_005, "日本語 の text")]


def plain_language(model, text):
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = [b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in f" {text} ".encode()]
    counts = Counter()
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            if data[i] == 32 == data[i + 1]:
                continue
            gram = 0
            for b in data[i : i + n]:
                gram = (gram * 257 + b) % 2**32
            counts[((gram * 2654435761 + (n - 1) * 40503) % 2**32) >> 19] += 1
    total = sum(counts.values())
    margin = [sum(w[f] * math.sqrt(c / total) for f, c in counts.items()) + w[-1] for w in np.asarray(model.weights, float)]

    def winner(level, size):
        votes, sums, least = [0] * size, [0.0] * size, [9.0] * size
        for (at, a, b), m in zip(model.duels, margin):
            if at == level:
                for side, v in ((a, m), (b, -m)):
                    votes[side] += v > 0
                    sums[side] += v
                    least[side] = min(least[side], v)
        best = max(range(size), key=lambda k: (votes[k], sums[k], -k))
        return best, least[best]

    family, sure = winner(0, len(model.families))
    own, also = winner(family + 1, len(model.families[family]))
    return model.languages[model.families[family][own]], 1 / (1 + math.exp(-2 * min(sure, also)))


def test_language_by_a_plain_loop(spark):
    d = read(spark, SF, "documents").select("doc_id", "text", "lang")
    model = langid.fit(d)
    assert len(model.languages) == 4 and sorted(x for f in model.families for x in f) == [0, 1, 2, 3]
    rows = d.select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    got = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in model.identified(rows).collect())
    want = Counter((r["doc_id"], *(lambda p: (p[0], round(p[1], 3)))(plain_language(model, r["text"]))) for r in rows.collect())
    close = sum((got & want).values())
    assert close >= sum(want.values()) - 2  # a score may be rounded to the other side
    assert Counter((a, b) for a, b, _ in got.elements()) == Counter((a, b) for a, b, _ in want.elements())


def test_a_repeated_id_stays_within_the_bound(spark):
    """Rows of one id are chosen as others are; equal rows count once."""
    one = next(i for i in range(10) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(one, f"the number {i} of many rows", "en") for i in range(400)] + [(one, "the same row", "en")] * 400 + [(i, f"la maison {i} est belle", "fr") for i in range(400) if i % 2]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    real = langid.fit_svm
    langid.fit_svm = lambda x, y: seen.append(len(y)) or real(x, y)
    try:
        model = langid.fit(d, per_language=50)
    finally:
        langid.fit_svm = real
    assert model.languages == ["en", "fr"] and seen and max(seen) <= 100


def plain_severity(model, text):
    counts = Counter()
    for w in WORD.findall((text or "").translate(LOWER)):
        for f in [w + "$", *(w[:k] + "*" for k in toxicity.PREFIXES if len(w) > k)]:
            if f in model.weights:
                counts[f] += 1
    eta = sum(model.weights[f] * math.log1p(n) for f, n in counts.items())
    above = [1 / (1 + math.exp(-max(-500.0, min(500.0, eta - t)))) for t in model.thresholds]
    each = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
    return round(sum(above), 6), each.index(max(each)), above[0] >= 0.5


def test_toxicity_by_a_plain_loop(spark):
    d = read(spark, SF, "documents").select("doc_id", "text")
    model = toxicity.fit(d, read(spark, SF, "labels"))
    assert model.weights and list(model.thresholds) == sorted(model.thresholds)
    rows = d.unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    got = Counter((r["doc_id"], round(r["severity"], 6), r["grade"], r["toxic"]) for r in model.graded(rows).collect())
    assert got == Counter((r["doc_id"], *plain_severity(model, r["text"])) for r in rows.collect())
    kept = Counter(r["doc_id"] for r in model.kept(rows).collect())
    assert kept == Counter(r["doc_id"] for r in rows.collect() if not plain_severity(model, r["text"])[2])
    assert 0 < sum(kept.values()) < rows.count() and rows.where(F.col("text").isNull()).count() == 1
