"""Importance resampling, the filter audit and the Jaccard join against brute force, and their defined results for odd rows."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanternfish.llm import interactions, jaccard, resampling, universe
from lanternfish.llm.common import read

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, bucket int, weight double, rank long, part string, keys string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def table(spark, rows):
    """Documents (doc_id, text, lang), with extra columns whose names clash with those inside operators."""
    return spark.createDataFrame([(*r, "s", 1, 1.0, 1, "x", "k") for r in rows], DOC)


def odd_texts(seed=0, number=60):
    rng = random.Random(seed)
    vocabulary = ["Wort", "éa", "b", "of", "x1", "NAÏVE", "日本", "ä", "CAPS", "9"]
    out = [None, "", " \t\n", "one", "one two", "One, TWO; three", "\x0b\x0c\r", "#", "ALL CAPS HERE", "a" * 5_000, "  ", "💡 text"]
    for _ in range(number):
        out.append(rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))))
    return out


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[p : p + n]) for n in (1, 2, 3) for p in range(len(w) - n + 1)], len(w)


def brute_resampled(rows, target):
    own, wanted = np.zeros(10_000, int), np.zeros(10_000, int)
    for counts, texts in ((own, [t for _, t in rows]), (wanted, target)):
        for text in texts:
            for g in grams(text)[0]:
                counts[zlib.crc32(g.encode()) % 10_000] += 1
    gain = [math.floor(1000 * math.log((t + 1.0) * (own.sum() + 10_000.0) / ((s + 1.0) * (wanted.sum() + 10_000.0)))) for s, t in zip(own, wanted)]
    out = []
    for i, text in rows:
        found, n = grams(text)
        weight = sum(gain[zlib.crc32(g.encode()) % 10_000] for g in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    drawn = fit[: 5 * len(fit) // 100]
    return sorted([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in fit[len(drawn) :] + [r for r in out if r[1] < 20]], key=str)


def test_resampling_of_odd_rows(spark):
    texts = odd_texts()
    rows = [(None if i % 17 == 5 else i % 50, t) for i, t in enumerate(texts + texts[20:40])]
    docs = table(spark, [(i, t, None) for i, t in rows])
    target = spark.createDataFrame([(1, "Wort of wort 9"), (2, None), (3, "")], "item_id int, text string")
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = resampling.resampled(docs, target).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == brute_resampled(rows, [r["text"] for r in target.collect()])
    assert resampling.resampled(docs.limit(0), target).count() == 0
    none = resampling.resampled(docs, target.limit(0)).collect()
    assert len(none) == len(rows) and all(r["n_features"] == 0 or r["weight"] != 0 for r in none)


def test_long_texts_in_stretches(monkeypatch):
    monkeypatch.setattr(resampling, "STRETCH", 64)
    rng = random.Random(1)
    for text in ["a b", " ".join(rng.choice(["word", "é", "of", "x" * 90]) for _ in range(200)), "y" * 700, "," * 300, ("z" * 200 + " ") * 5 + "!" * 90]:
        monkeypatch.setattr(resampling, "text_runs", lambda texts: [(k, k + 1) for k in range(len(texts))])
        found, words = [], 0
        for _, _, n, _, buckets in resampling.featured(pa.array(["before", text])[1:]):
            found += buckets.tolist()
            words += int(n[0])
        want, number = grams(text)
        assert sorted(found) == sorted(zlib.crc32(g.encode()) % 10_000 for g in want) and words == number


def test_crc_of_bytes():
    rng = np.random.default_rng(2)
    flat = rng.integers(0, 256, 5_000, np.uint8)
    at, length = rng.integers(0, 3_000, 200), np.concatenate([rng.integers(0, 40, 190), rng.integers(0, 1_900, 10)])
    got = resampling.advanced(flat, np.full(200, 0xFFFFFFFF, np.uint32), at, length) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(flat[a : a + n].tobytes()) for a, n in zip(at, length)]


def test_ranks_of_equal_rows(spark):
    rows = spark.range(40).select((F.col("id") % 3).alias("doc_id"), F.lit(7).cast("long").alias("score"))
    got = resampling.ranked(rows, 25).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 26))
    assert [r["doc_id"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [0] * 14 + [1] * 11


def brute_audit(rows, labels):
    marks = {}
    for i, quality, toxic in labels:
        if i is not None:
            a, b = marks.get(i, (False, False))
            marks[i] = (a or quality == 1, b or toxic == 1)
    docs = []
    for i, text, lang in rows:
        text = text or ""
        w = BLANK.findall(text)
        copy = i is not None and any(o is not None and o < i and (t or "") == text for o, t, _ in rows)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": copy}
        docs.append((lang or "", {x for x in "ABCDE" if fails[x]}, *marks.get(i, (False, False))))
    out = {}
    for part in {d[0] for d in docs}:
        mine, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = mine, []
            for step, x in enumerate(order, 1):
                removed, kept = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
                total[x] += len(removed)
                out[part, "".join(order), step] = [len(kept), len(removed), sum(x in d[1] for d in gone), sum(d[1] == {x} for d in mine), sum(d[2] for d in removed), sum(d[3] for d in removed), x]
                gone, left = gone + removed, kept
        for key, row in out.items():
            if key[0] == part:
                row[6] = total[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_of_odd_rows(spark):
    texts = odd_texts(3, 80) + [" ".join(f"w{k}" for k in range(120))] * 5
    rows = [(None if k % 13 == 4 else k % 70, t, [None, "", "en", "de"][k % 4]) for k, t in enumerate(texts + texts[30:50])]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(60)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None)]
    known = spark.createDataFrame([(*r, "extra") for r in labels], "doc_id long, quality int, toxic int, lang string")
    got = {tuple(r[:3]): tuple(r[3:]) for r in interactions.audited(table(spark, rows), known).collect()}
    assert got == brute_audit(rows, labels)
    without = {tuple(r[:3]): tuple(r[3:]) for r in interactions.audited(table(spark, rows), known.limit(0)).collect()}
    assert without == brute_audit(rows, [])
    assert interactions.audited(table(spark, rows).limit(0), known).count() == 0


def test_parity_sums_invert(spark):
    masks = spark.range(500).select(F.lit("p").alias("part"), (F.col("id") % 2 == 0).alias("good"), F.lit(False).alias("toxic"), (F.col("id") * F.col("id") % 32).cast("int").alias("mask"))
    row = interactions.cells(interactions.parity_sums(masks)).first()
    want = np.bincount([k * k % 32 for k in range(500)], minlength=32)
    assert row["every"] == want.tolist() and row["good"] == np.bincount([k * k % 32 for k in range(0, 500, 2)], minlength=32).tolist() and row["toxic"] == [0] * 32


def shingle_set(text):
    w = BLANK.findall((text or "").translate(LOWER))
    return {tuple(w[p : p + 4]) for p in range(max(1, len(w) - 3))} if w else set()


def brute_components(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted([(i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))], key=str)


def near_texts(seed, groups=12):
    """Groups of texts at various distances from one another, many near the threshold; a passage that half of them share."""
    rng = random.Random(seed)
    vocabulary, passage, out = [f"w{k}" for k in range(3_000)], " ".join(f"p{k}" for k in range(30)), []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 9, 12, 20, 45, 120, 400]))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 45))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w) + (" " + passage if rng.random() < 0.3 else ""))
    return out


@pytest.mark.parametrize("few", [jaccard.SMALL, 1])
def test_jaccard_join_of_odd_rows(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "SMALL", few)
    texts = odd_texts(5, 30) + near_texts(6)
    rows = [(None if k % 23 == 7 else k % 150, t) for k, t in enumerate(texts + texts[:30])]
    docs = table(spark, [(i, t, "en") for i, t in rows])
    got = jaccard.components(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)
    assert jaccard.components(docs.limit(0)).count() == 0


def test_jaccard_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = list(enumerate(near_texts(8, 16)))
    got = jaccard.components(table(spark, [(i, t, "en") for i, t in rows])).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_similar_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    met = 0
    for size in [*range(2, 70), 100, 141, 200, 316, 700]:
        for _ in range(12):
            other = int(rng.integers(size, universe.most_partner(size, percent) + 1))
            same = -(-percent * (size + other) // (100 + percent))
            if same > size or same == other:
                continue
            pool = np.unique(rng.integers(0, 1 << 63, size + other).astype(np.uint64))
            rng.shuffle(pool)
            a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[:same], pool[size : size + other - same]]))
            assert jaccard.similar(a, b, percent)
            assert len(np.intersect1d(universe.keys(a, percent), universe.keys(b, percent)))
            parity = universe.folded([universe.sketch(a), universe.sketch(b)])
            assert np.bitwise_count(parity[0] ^ parity[1]).sum() <= len(a) + len(b) - 2 * same <= universe.most_apart(len(a), len(b), percent)
            met += 1
    assert met > 300


def test_weak_keys_of_sets_that_run_out():
    """Sets whose members fall into few segments still share a key, if only a weak one."""
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 1 << 63, 200_000).astype(np.uint64)
    low, upto = universe.limits(4, 85)
    segments, _ = universe.allocation(4, 85)
    crowded = pool[universe.mix(pool ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(segments) < 2]
    for _ in range(50):
        some = rng.choice(crowded, low + 3, replace=False)
        a, b = np.sort(some[:-1]), np.sort(some[1:])
        assert jaccard.similar(a, b, 85) and len(np.intersect1d(universe.keys(a, 85), universe.keys(b, 85)))


def test_queries_have_whole_results(spark):
    from lanternfish.llm import queries

    n = read(spark, SF, "documents").count()
    assert queries.op11_importance_resampling(spark, SF).count() == n == queries.op13_jaccard_join(spark, SF).count()
