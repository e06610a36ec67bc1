"""The corpus operators against brute force, round trips, held-out accuracy, and their defined results for odd rows."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish.llm import ann, bagminhash, chat, decontamination, langid, licenses, mixing, neardup, queries, shingles, tokencount, tokens, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, score double"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({65 + i: 97 + i for i in range(26)}))


def docs(spark, *texts, **columns):
    """Documents of these texts, with extra columns whose names clash with those inside operators."""
    rows = [(i, t, columns.get("lang", ["en"] * len(texts))[i], columns.get("source", ["s"] * len(texts))[i], 0, "k", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(cell, r)) for r in df.select(*names).collect()) == sorted(tuple(map(cell, r)) for r in cursor.fetchall())


def brute_contamination(texts, items, size=10):
    out = []
    for text in texts:
        own, hit, ids = words(text), set(), set()
        for item, other in items:
            w = words(other)
            for a in range(max(1, len(w) - size + 1)) if w else ():
                k = min(size, len(w))
                for p in range(len(own) - k + 1):
                    if own[p : p + k] == w[a : a + k]:
                        hit |= set(range(p, p + k))
                        ids.add(str(item))
        out.append((len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = [f"x {passage.upper()}! y", None, "", "short phrase", "a short phrase here short phrase", passage.replace("eta", "eto", 1), "the " * 3000 + passage + " " + passage, "the " * 12]
    items = [(1, passage), (2, "Short, phrase"), (3, None), (4, ""), (10, passage), (5, "the " * 10)]
    got = decontamination.contamination(docs(spark, *texts), spark.createDataFrame(items, "item_id long, text string"))
    rows = sorted(got.collect(), key=lambda r: r["doc_id"])
    assert [tuple(r)[1:] for r in rows] == brute_contamination(texts, items)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in decontamination.contamination(docs(spark, *texts), empty).collect()} == {False}
    twice = docs(spark, "short phrase").unionByName(docs(spark, "clean text"))
    assert sorted(r["n_hit"] for r in decontamination.contamination(twice, spark.createDataFrame(items, "item_id long, text string")).collect()) == [0, 2]


def test_proximity(spark):
    items = decontamination.items_of(spark.createDataFrame([(1, "red green blue")], "item_id long, text string"))
    rows = {r["doc_id"]: r["n_hit"] for r in decontamination.matches(docs(spark, "red green blue", "red very green blue", "red a b c d green blue", "blue"), items, slop=1).collect()}
    assert rows[0] == 3 and rows[1] > 0 and rows[2] == rows[3] == 0


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.fit(d).identified(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    model = langid.fit(docs(spark, *["the cat sat on the mat"] * 4, *["le chat est sur la table"] * 4, lang=["en"] * 4 + ["fr"] * 4))
    odd = {r["doc_id"]: r for r in model.identified(docs(spark, None, "", "123 !?", "é", "the cat " * 50_000)).collect()}
    assert [odd[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and odd[4]["lang_pred"] == "en" and 0 <= odd[4]["score"] <= 1
    assert langid.fit(docs(spark).limit(0)).predict(["abc"])[0] == ["und"]


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 8))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (403, [None] + [1.0] * 7, 0)] + [(404 + i, x[0].tolist(), 0) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = ann.Forest(v).search(v.where("vec_id % 20 = 0")).collect()
    every = np.array([r[1] for r in rows if r[0] not in (400, 401, 402, 403)])
    ids = np.array([r[0] for r in rows if r[0] not in (400, 401, 402, 403)])
    hit = 0
    asked = [i for i in ids if i % 20 == 0]
    for q in asked:
        s = every @ every[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -np.round(s, 12)))][:20]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and q not in [r["vec_id"] for r in mine]
        hit += len(set(best) & {r["vec_id"] for r in mine})
    assert hit / (20 * len(asked)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.Forest(few).search(few).orderBy("query_id").collect()] == [(0, 1, 1, 0.5), (1, 1, 0, 0.5)]
    assert ann.Forest(few.limit(0)).search(few.limit(0)).count() == 0


def brute_count(model, token):
    best = [(0.0, 0)] + [None] * len(token)
    for i in range(1, len(token) + 1):
        wide = len(token[i - 1].encode())
        options = [(best[i - 1][0] + model.byte * wide, best[i - 1][1] + wide)] + [(best[j][0] + model.scores[token[j:i]], best[j][1] + 1) for j in range(i) if token[j:i] in model.scores]
        best[i] = max(options, key=lambda x: (x[0], -x[1]))
    return best[-1][1]


def test_token_counts(spark):
    import public_tokenizers

    model = tokencount.Unigram.from_sentencepiece(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["The cat's on the 中文 mat, the catalogue; cat", None, "", "a" * 5000, "x\ty\nz  w"]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.counted(docs(spark, *texts), model).collect()}
    assert got == {i: sum(brute_count(model, tokencount.START + w) for w in (t or "").split()) for i, t in enumerate(texts)}


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "plain", "", None, "a\\b", "\\", "x<", "<s>[INST]user[/INST]hi</s>", "tail\\", "\\\\", "[/INST", "new\nline", "</s" * 300, "é" * 50_000]
    rows = [(c, t, ("user", "assistant", None)[(c + t) % 3], odd[(c * 5 + t) % len(odd)], "extra") for c in range(12) for t in range(5)] + [(99, 0, "assistant", "same", "e")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    for r in chat.read_back(chat.formatted(df)).collect():
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss_text"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
    assert chat.formatted(df.limit(0)).count() == 0
    assert spark.createDataFrame([("<s>[INST]a</s>",), ("x",)], "t string").select(chat.parsed(F.col("t")).alias("p")).where("p is not null").count() == 0


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/y.py", "code"),
        ("z.py", "# Licensed under the Apache License, Version 2.0.\ncode and much more code here to be sure"), ("q/w.py", "nothing"), (None, None), ("e/empty", ""), ("ab/t.py", "code"),
    ]
    got = {r["path"]: (r["own_license"], r["license"], r["inherited_from"]) for r in licenses.scanned(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/b/x.py"] == (None, "GPL-3.0", "a/b") and got["a/b/c/y.py"][1] == "GPL-3.0" and got["z.py"][0] == "Apache-2.0"
    assert got["q/w.py"][1] is None and got["ab/t.py"][1] is None and got[None][1] is None and got["a/LICENSE"][0] == "MIT"


def test_toxicity(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, labels.where("doc_id % 2 = 0"))
    rows = model.graded(d).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    caught = np.mean([r["toxic"] for r in rows if r["label"] == 1])
    wrong = np.mean([r["toxic"] for r in rows if r["label"] == 0])
    assert caught > 0.85 and wrong < 0.01
    assert list(model.thresholds) == sorted(model.thresholds) and all(0 <= r["severity"] <= 3 for r in rows)
    odd = docs(spark, None, "", "pathetic scum idiot moron", "fine " * 50_000)
    assert [r["toxic"] for r in model.graded(odd).orderBy("doc_id").collect()] == [False, False, True, False]
    assert [r["doc_id"] for r in model.kept(odd).orderBy("doc_id").collect()] == [0, 1, 3] and model.kept(odd).columns == odd.columns
    none = toxicity.fit(odd, labels.limit(0))
    assert not any(r["toxic"] for r in none.graded(odd).collect())


def test_mixing(spark):
    d = docs(spark, *["w " * (i % 7) for i in range(300)], None, source=["a"] * 100 + ["b"] * 150 + [None] * 51)
    sizes = d.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"), F.lit("x").alias("key"))
    first, again = ([tuple(r) for r in mixing.mixed(sizes).select("doc_id", "source", "size", "source_size", "target", "taken").orderBy("doc_id").collect()] for _ in range(2))
    assert first == again
    for source in ("a", "b", None):
        mine = [r for r in first if r[1] == source]
        assert sum(r[5] for r in mine) == int(mine[0][4]) and all(0 <= r[5] <= 2 * r[2] for r in mine)
    assert abs(sum({r[1]: r[4] for r in first}.values()) - 1.5 * sum(r[2] for r in first)) < 1e-6
    assert mixing.mixed(sizes.limit(0)).count() == 0
    copies = Counter(r["source"] for r in mixing.mixed_documents(d).collect())
    assert copies and mixing.mixed_documents(d).columns == d.columns


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        a = [f"w{i}" for i in rng.integers(0, 40, 200)]
        b = a[:120] + [f"w{i}" for i in rng.integers(0, 60, 80)]
        x, y = shingles.tagged([" ".join(a), " ".join(b)], 1)
        s = bagminhash.signatures(*shingles.multisets([" ".join(a), " ".join(b)], 1), 2)
        same = len(np.intersect1d(x, y))
        errors.append((s[0] == s[1]).mean() - same / (len(x) + len(y) - same))
    assert abs(np.mean(errors)) < 0.012


def brute_classes(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if both and both / sum((sets[i] | sets[j]).values()) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return dict(enumerate(label))


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    texts = [" ".join(base)] * 30
    for i in range(40):  # a chain: each text changes one more word
        base = [*base]
        base[i * 3 % 120] = f"new{i}"
        texts.append(" ".join(base))
    texts += [" ".join(f"w{i}" for i in rng.integers(0, 500, 80)) for _ in range(30)] + [None, "", "!!", "one two", "One, two", "x " * 40_000]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, *texts)).collect()}
    assert got == brute_classes(texts)
    kept = neardup.deduplicated(docs(spark, *texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values())) and kept.columns == docs(spark, "a").columns
    assert neardup.classes(docs(spark, "a").limit(0)).count() == 0


def test_pair_is_compared_in_the_first_bucket_that_it_shares(spark):
    """Registers that differ but share their low bytes make different buckets in band 0; the pair is compared in band 1."""
    members = np.arange(50, dtype=np.uint64).tobytes()
    low = bytes(range(bagminhash.SIZE))
    sets = spark.createDataFrame([(c, members, low) for c in (1, 2, 3)], "content long, members binary, low binary")
    buckets = spark.createDataFrame([(0, 70, 1, 1), (0, 70, 3, 3), (1, 71, 1, 1), (1, 71, 2, 2), (2, 72, 1, 1), (2, 72, 2, 2), (2, 72, 3, 3)], "nth int, band long, content long, component long")
    links = [tuple(sorted(r)) for r in neardup._linked_rest(neardup._cells(buckets, sets), sets, 0.8).collect()]
    assert set(links) == {(1, 2), (1, 3), (2, 3)}


def test_deduplicated_keeps_a_row_of_each_class_whatever_the_ids(spark):
    """Null and repeated doc_ids: only rows of a kept row's class go, and rows without words stay."""
    rng = np.random.default_rng(6)
    a, b, c, d = (" ".join(f"w{i}" for i in rng.integers(0, 500, 120)) for _ in range(4))
    near = lambda t: t + " end"
    texts = [(None, a), (None, near(a)), (None, b), (None, None), (None, None), (None, "!!"), (7, c), (7, near(d)), (8, d), (7, c), (9, None), (None, d), (None, "one two"), (None, "three four")]
    rows = spark.createDataFrame([(i, t, "en", f"s{n % 3}", n % 2, "k", 1.0) for n, (i, t) in enumerate(texts)], DOC)
    got = sorted(((r["doc_id"], r["text"]) for r in neardup.deduplicated(rows).collect()), key=repr)
    one_of_a = [r for r in got if r[1] in (a, near(a))]
    assert len(one_of_a) == 1
    want = [*one_of_a, (None, b), (None, None), (None, None), (None, "!!"), (7, c), (7, near(d)), (9, None), (None, "one two"), (None, "three four")]
    assert got == sorted(want, key=repr)
    assert got == sorted(((r["doc_id"], r["text"]) for r in neardup.deduplicated(rows.repartition(7, "source")).collect()), key=repr)


def test_tokens(spark, tmp_path):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["Hello, WORLD's best", None, "", "É́ Σας İx <|endoftext|> a.b", "word. " * 30_000, "tab\there nbsp", "Hello, WORLD's best"]
    tokens.write(docs(spark, *texts), str(tmp_path / "t"), path)
    rows = sorted(tokens.with_starts(tokens.checksums(spark, str(tmp_path / "t")), spark, str(tmp_path / "t")).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, t in zip(rows, texts, strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    one = tokens.read(spark, str(tmp_path / "t"), "doc_id", "ids", doc_ids=[0]).first()
    assert one["ids"] == [*plain.encode(texts[0], add_special_tokens=False).ids, 2]
    tokens.write(docs(spark, "a").limit(0), str(tmp_path / "none"), path)
    assert tokens.checksums(spark, str(tmp_path / "none")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, d = {r["doc_id"] for r in d.collect()}, stage(spark, d, SF)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert {r["doc_id"] for r in d.collect()} <= before
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(r[4] for r in brute_contamination(texts.values(), items))
    assert len(set(brute_classes(list(texts.values())).values())) == len(texts)
