"""More of the corpus operators: brute force for proximity, search and solvers, real licence texts, odd rows, and the whole pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lanternfish.llm import ann, common, decontamination, langid, license_texts, licenses, mixing, neardup, tokencount, tokens, toxicity
from test_llm import DOC, brute_classes, brute_contamination, docs, words

ODD = "doc_id long, text string, lang string, source string, n_chars long, known string, _kept int, bucket int, start long, inside long, label int, row string"


def odd(spark, *rows):
    """Documents (doc_id, text) with columns that clash with names inside operators."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 2, 3, 4, 5, "r") for i, t in rows], ODD)


def brute_proximity(text, item, slop, size=10):
    own, w, inside = words(text), words(item), set()
    for a in range(max(1, len(w) - size + 1)) if w else ():
        part = w[a : a + size]
        for begin in range(-len(w) - slop, len(own) + slop + 1):
            if all(any(0 <= p < len(own) and own[p] == x for p in range(begin + k - slop, begin + k + slop + 1)) for k, x in enumerate(part)):
                inside |= {p for p in range(begin, begin + len(part)) if 0 <= p < len(own)}
    return len(inside)


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_is_complete(spark, slop):
    rng = random.Random(slop)
    texts = ["red green blue", "red green x blue", "red green blue red", "green red blue", "blue", "", None] + [" ".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(40)]
    for item in ("red green blue", "a b c", "a b c d a b c d a b c d"):
        found = decontamination.matches(docs(spark, *texts), decontamination.items_of(spark.createDataFrame([(1, item)], "item_id long, text string")), slop=slop)
        got = {r["doc_id"]: r["n_hit"] for r in found.collect()}
        assert got == {i: brute_proximity(t, item, slop) for i, t in enumerate(texts)}


def test_decontamination_of_odd_rows(spark):
    items = [(None, "some phrase here"), (2, "other words"), (2, "other words"), (3, "OTHER, words!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None, "so some phrase here"), (None, "clean"), (None, "other words"), (5, "other words"), (5, "clean"), (5, "other words")]
    got = decontamination.contamination(odd(spark, *rows), bench).collect()
    want = [(i, *b[:2]) for (i, _), b in zip(rows, brute_contamination([t for _, t in rows], items), strict=True)]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"]) for r in got), key=repr) == sorted(want, key=repr)
    assert decontamination.contamination(odd(spark), bench).count() == 0
    kept = decontamination.decontaminated(odd(spark, *rows), bench)
    assert kept.columns == odd(spark).columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "clean"), (5, "clean")]


def test_svm_solves_its_problem(monkeypatch):
    """No direction lowers the squared hinge loss any more, and separable sides are separated."""
    monkeypatch.setattr(langid, "STEPS", 3_000)
    rng = np.random.default_rng(0)
    x = np.abs(rng.standard_normal((80, langid.BUCKETS))[:, :20]).astype(np.float32)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.2 * x[:, 1] > x[:, 2], 1, -1).astype(np.float32)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def loss(w):
        return (share * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) ** 2).sum() + langid.PENALTY / 2 * (w[:-1] ** 2).sum()

    w = langid.fit_svm(x, y).astype(float)
    best = w.copy()
    for _ in range(4000):
        slack = np.maximum(0, 1 - y * (x @ best[:-1] + best[-1])) * y * share
        best -= 0.3 * np.concatenate([langid.PENALTY * best[:-1] - 2 * slack @ x, [-2 * slack.sum()]])
    assert loss(w) <= loss(best) * 1.05 + 1e-4 and ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.95


def test_ordinal_gradient_is_zero_at_the_end():
    """The likelihood can't be raised by moving a weight or threshold, and true parameters are found again."""
    rng = np.random.default_rng(2)
    n = 4_000
    value = rng.random((n, 2))
    eta = 3 * value[:, 0] - 2 * value[:, 1]
    grade = (eta[:, None] + rng.logistic(size=(n, 1)) > np.array([0.5, 1.5, 2.5])[None, :]).sum(axis=1)
    doc, feature = np.repeat(np.arange(n), 2), np.tile([0, 1], n)
    w, t = toxicity.fit_ordinal(doc, feature, value.ravel(), grade, 2)

    def loss(w, t):
        above = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(t[None, :] - (value @ w)[:, None])), np.zeros((n, 1))])
        return -np.log(above[np.arange(n), grade] - above[np.arange(n), grade + 1]).mean()

    assert np.allclose(w, [3, -2], atol=0.4) and np.allclose(t, [0.5, 1.5, 2.5], atol=0.3)
    for k in range(5):
        for step in (-0.02, 0.02):
            state = np.concatenate([w, t])
            state[k] += step
            assert loss(state[:2], state[2:]) > loss(w, t) - 1e-6


def test_language_of_odd_rows(spark):
    rows = [(i, "the cat sat on the mat") for i in range(6)] + [(None, "the cat"), (3, "the cat sat on the mat")]
    model = langid.fit(odd(spark, *rows))
    got = model.identified(odd(spark, *rows))
    assert [r["lang_pred"] for r in got.collect()] == ["en"] * 8 and got.where("doc_id is null and not held_out").count() == 1
    assert model.identified(odd(spark)).count() == 0


def test_grades_given_by_labels(spark):
    """Given severities, not word counts, make the grades; a doc_id labelled twice has the greater one."""
    texts = ["vile " + "word " * 20 if i % 4 == 1 else "awful awful awful thing" if i % 4 == 2 else "calm words of peace" for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 in (1, 2)), 3 if i % 4 == 1 else 1 if i % 4 == 2 else None) for i in range(200)] + [(0, None, None), (None, 1, 2), (1, 1, 1)], "doc_id long, toxic int, severity int")
    d = odd(spark, *enumerate(texts))
    got = {r["doc_id"]: r["grade"] for r in toxicity.fit(d, labels).graded(d).collect()}
    assert got == {i: 3 if i % 4 == 1 else 1 if i % 4 == 2 else 0 for i in range(200)}
    none = toxicity.fit(odd(spark), labels)
    assert none.graded(d).where("toxic").count() == 0 and none.graded(odd(spark)).count() == 0 and none.kept(d).columns == d.columns
    one_sided = toxicity.fit(d, labels.where("toxic = 1"))
    assert one_sided.kept(d).count() == 200


def brute_nearest(rows, asked, k=20):
    out = {}
    for q, v in asked:
        scores = [(-float(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v)]
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("kind", ["uniform", "clustered", "hot"])
def test_search_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "PART", 128)
    monkeypatch.setattr(ann, "QUERIES", 32)
    rng = np.random.default_rng(3)
    if kind == "uniform":
        x = rng.standard_normal((1500, 24))
    else:
        middle = rng.standard_normal((30, 24)) * 3
        place = rng.integers(0, 30, 1500) if kind == "clustered" else np.where(rng.random(1500) < 0.34, 0, rng.integers(0, 30, 1500))
        x = middle[place] + rng.standard_normal((1500, 24)) * (0.5 if kind == "clustered" else 0.1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    outside = [(10_000 + i, (x[i] + rng.standard_normal(24) * 0.1).tolist()) for i in range(0, 1500, 20)]
    forest = ann.Forest(v)
    for asked in ([r for r in rows if r[0] % 20 == 0], outside):
        best, got = brute_nearest(rows, asked), {}
        for r in forest.search(spark.createDataFrame(asked, "vec_id long, embedding array<double>")).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert set(got) == set(best) and all([n for n, *_ in sorted(g)] == list(range(1, 21)) for g in got.values())
        assert np.mean([len({i for _, i, _ in got[q]} & set(best[q])) / 20 for q in best]) >= 0.9
        assert all(abs(s - np.dot(x[i], dict(asked)[q])) < 1e-9 for q, g in got.items() for _, i, s in g)


def test_search_of_odd_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(60)] + [(60, rng.standard_normal(5).tolist()), (61, rng.standard_normal(5).tolist()), (None, [1.0] * 4)]
    rows += [(7, rng.standard_normal(4).tolist()) for _ in range(30)] + [rows[0]] * 30
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.Forest(v).search(v).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[60] == [61] and got[61] == [60]
    assert all(len(got[i]) >= 20 and i not in got[i] for i in range(60))
    other = [(i, w) for i, w in rows[:-30] if i is not None and len(w) == 4]
    assert got[3] == brute_nearest(other, [rows[3]])[3]


def test_token_counts_of_odd_rows(spark):
    model = tokencount.Unigram({"▁a": -1.0, "b": -2.0, "▁ab": -1.5})
    rows = [(1, "ab ab"), (1, "ab ab"), (None, "a b"), (2, None), (3, "")]
    got = tokencount.counted(odd(spark, *rows), model).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr) == sorted([(1, 2), (1, 2), (None, 5), (2, 0), (3, 0)], key=repr)
    assert tokencount.counted(odd(spark), model).count() == 0


def wrapped(text, mark, width=70):
    lines, row = [], ""
    for word in text.replace("\n", " \n ").split(" "):
        if word == "\n" or len(row) + len(word) > width:
            lines.append(row)
            row = "" if word == "\n" else word
        else:
            row = f"{row} {word}".strip()
    return "\n".join(f"{mark} {x}" for x in [*lines, row])


def test_license_headers_and_tags(spark):
    by = {(a, b): c for a, b, c in license_texts.TEMPLATES}
    code = "\nimport os\n\ndef main():\n    return os.getcwd()\n" * 5
    files = {f"{k}/src/{i}.py": (wrapped(by[i, "header"], k) + code, i) for i in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0") for k in ("#", "//", " *")}
    full = {i: [c for a, b, c in license_texts.TEMPLATES if (a, b) == (i, "text")][0] for i in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "0BSD", "BSL-1.0", "Unlicense")}
    files |= {f"full/{i}/LICENSE": (f"Copyright (c) 2020 Someone\n\n{t}\n", i) for i, t in full.items()}
    files |= {f"inline/{i}.c": (wrapped(t, "//") + code, i) for i, t in full.items()}
    files |= {"tag/a.py": ("# SPDX-License-Identifier: MIT\n" + code, "MIT"), "tag/b.py": ("# SPDX-License-Identifier: BSD-3-Clause OR  ISC\n" + code, "BSD-3-Clause OR ISC"), "tag/h.py": (wrapped(by["Apache-2.0", "header"], "#"), "Apache-2.0")}
    files |= {"tag/none.py": (code, None), "prose.txt": ("The licence of the house was read to any person without a copy. " * 50, None)}
    rows = [(p, t, 1) for p, (t, _) in files.items()]
    got = {r["path"]: r for r in licenses.scanned(spark.createDataFrame(rows, "path string, text string, license int")).collect()}
    assert {p: r["own_license"] for p, r in got.items()} == {p: i for p, (_, i) in files.items()}
    assert got["tag/none.py"]["license"] is None  # a header, even a whole file of it, grants nothing
    assert all(r["inherited_from"] is None for r in got.values())


def test_licenses_of_odd_rows(spark):
    mit = license_texts.TEMPLATES[1][2]
    rows = [("d/LICENSE", mit), ("d/LICENSE", mit), ("d/LICENSE", "nothing"), ("d/x", None), ("d/x", ""), (None, mit), (None, None), ("d/long", "word " * 100_000 + "\n" + mit), ("top", "x"), ("LICENSE", mit), ("e/f/g/y", "x")]
    got = [tuple(r) for r in licenses.scanned(spark.createDataFrame(rows, "path string, text string")).collect()]
    want = [("d/LICENSE", "MIT", 1.0, "MIT", None)] * 2 + [("d/LICENSE", None, None, "MIT", "d"), ("d/x", None, None, "MIT", "d"), ("d/x", None, None, "MIT", "d"), (None, "MIT", 1.0, "MIT", None), (None, None, None, None, None)]
    want += [("d/long", "MIT", 1.0, "MIT", None), ("top", None, None, "MIT", ""), ("LICENSE", "MIT", 1.0, "MIT", None), ("e/f/g/y", None, None, "MIT", "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert licenses.scanned(spark.createDataFrame([], "path string, text string")).count() == 0


def test_heavy_terms_lose_no_unit(spark):
    """With every word heavy the result is the same."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.concat_ws("/", "source", "doc_id").alias("path"), "text")
    def every(weights, threshold):
        return sorted({r["term"] for r in weights})

    plain = sorted(map(tuple, licenses.scanned(d).collect()), key=repr)
    kept, licenses.heavy_terms = licenses.heavy_terms, every
    try:
        assert sorted(map(tuple, licenses.scanned(d).collect()), key=repr) == plain
    finally:
        licenses.heavy_terms = kept


def test_mixing_of_odd_rows(spark):
    d = spark.createDataFrame([(None, f"a b {i % 50}", None, None, 0, "k", i, i, i, i, i, "r") for i in range(400)] + [(1, "w", "en", "b", 0, "k", 0, 0, 0, 0, 0, "r")] * 200, ODD)
    keys = {r["key"] for r in mixing.mixed(mixing.sized(d)).collect()}
    assert len(keys) == 51  # rows of one id have as many keys as texts
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns and abs(out.select(F.sum(mixing.size_of(F.col("text")))).first()[0] - 1.5 * (1200 + 200)) <= 24 + 200
    assert {r["bucket"] for r in out.where("doc_id is null").collect()} <= set(range(400))
    assert mixing.mixed_documents(d.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    a, b = (" ".join(f"w{i}" for i in rng.integers(0, 500, 100)) for _ in range(2))
    rows = [(1, a), (None, a + " more"), (2, b), (2, b), (2, a), (3, None), (None, "!")]
    kept = neardup.deduplicated(odd(spark, *rows))
    assert kept.columns == odd(spark).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, a), (2, b), (3, None), (None, "!")], key=repr)
    assert neardup.deduplicated(odd(spark)).count() == 0


def test_large_buckets_are_dealt(spark, monkeypatch):
    """Buckets of many times BLOCK texts, with several classes near the threshold, equal brute force."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(3):
        base = [f"w{i}" for i in rng.integers(0, 2000, 150)]
        for k in range(40):
            other = [*base]
            for p in rng.choice(150, k % 4, replace=False):
                other[p] = f"x{rng.integers(0, 9)}"
            texts.append(" ".join(other))
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, *texts)).collect()} == brute_classes(texts)


def test_tokens_of_another_vocabulary(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, out = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "t")
    assert not tokens.cuttable(path) and tokens.cuttable(public_tokenizers.path("word_bpe_49k.json"))
    texts, plain = ["Hello,  World\n\n it's 42 ", "", None, "é ü 漢字 " * 1000, "Hello,  World\n\n it's 42 "], Tokenizer.from_file(path)
    tokens.write(odd(spark, *[(None if i == 4 else i, t) for i, t in enumerate(texts)]), out, path)
    got = sorted(((r["doc_id"], r["ids_crc32"]) for r in tokens.checksums(spark, out).collect()), key=repr)
    want = [(None if i == 4 else i, zlib.crc32(np.asarray([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in enumerate(texts)]
    assert got == sorted(want, key=repr)


def test_token_files(spark, tmp_path):
    """Ids are dictionary-encoded, metadata delta-encoded, row groups bounded, pages indexed, and a filter reads few rows."""
    import public_tokenizers

    out = str(tmp_path / "t")
    tokens.write(docs(spark, *["some words of text " * 50] * 3000), out, public_tokenizers.path("word_bpe_49k.json"))
    file = next(f for f in (tmp_path / "t").glob("*.parquet") if pq.ParquetFile(f).metadata.num_rows)
    meta = pq.ParquetFile(file).metadata
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        assert group.total_byte_size <= tokens.ROW_GROUP * 1.1
        for c in range(group.num_columns):
            column = group.column(c)
            kind = "RLE_DICTIONARY" if column.path_in_schema.startswith("ids") else "DELTA_BINARY_PACKED"
            assert kind in column.encodings and column.has_offset_index and column.has_column_index, column.path_in_schema
    assert tokens.read(spark, out, "doc_id", "n_tokens", doc_ids=[7, 2999]).count() == 2


def test_words_of_every_character(spark):
    """Lower-casing changes A-Z alone, whatever other characters stand in the text, and words are what the pattern finds."""
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"Ab{c}C d" for c in points[:0x600] + points[0x600::37]] + ["".join(points[i : i + 50]) for i in range(0, len(points), 50)] + ["", " ", "A", "ΑΣ ΣΑ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).select("t", common.words(F.col("t")).alias("w")).collect()
    assert all(r["w"] == words(r["t"]) for r in rows)


def test_no_broadcast_of_few_but_large_rows(spark):
    rows = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert common.fits(rows) and not common.fits(rows, size=5_000) and not common.fits(rows, rows=9)


def test_pipeline_run(spark):
    """All five stages, each against brute force or its own operator on its input; then run() over the table."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    d = stages["decontamination"](spark, stages["minhash_neardup"](spark, stages["toxicity"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), sf), sf)
    d = common.written(d, "test")
    mixed = common.written(stages["mixing"](spark, d, sf), "test")
    assert mixed.columns == d.columns
    sizes = {r["source"]: (r["target"], r["size"]) for r in mixing.mixed(mixing.sized(d)).groupBy("source").agg(F.first("target").alias("target"), F.max("size").alias("size")).collect()}
    for r in mixed.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect():
        assert abs(r["n"] - sizes[r["source"]][0]) <= sizes[r["source"]][1]
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    want = Counter((r["doc_id"], zlib.crc32(np.asarray([*encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in mixed.collect())
    out = stages["token_output"](spark, mixed, sf).orderBy("start").collect()
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in out) == want
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out) and [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out]).tolist()[:-1]]
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_pipeline_stages_on_odd_and_empty_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = [(None, "one clean text of some words", None, None, None), (None, None, None, None, None), (3, "", "en", "s", 0), (3, "another clean text that is here", "en", "s", 0)] * 2
    for table in (rows, []):
        d = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            d = common.written(stage(spark, d, sf), name)
        assert d.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and (d.count() > 0) == bool(table)


assert DOC
