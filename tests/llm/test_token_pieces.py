"""Texts cut to pieces before they are encoded: the ids are the library's, and a worker learns a piece once for all of its tasks."""

import json
import random
from types import SimpleNamespace

import numpy as np
import pytest

from lanternfish.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts, path=PATH):
    return [x.ids for x in tokens._tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def ids_of(encoder, texts):
    ids, ends = encoder.encoded(texts)
    assert len(ends) == len(texts) + 1 and ends[0] == 0 and ends[-1] == len(ids)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def asked(encoder, texts):
    """What the encoder asks of its vocabulary for these texts."""
    whole, seen = encoder.tokenizer, []
    model = SimpleNamespace(tokenize=lambda x: seen.append(x) or whole.model.tokenize(x))
    encoder.tokenizer = SimpleNamespace(model=model, encode_batch_fast=lambda x, **k: seen.extend(x) or whole.encode_batch_fast(x, **k))
    ids_of(encoder, texts)
    encoder.tokenizer = whole
    return seen


@pytest.mark.parametrize("cache", [tokens.CACHE, 50])
def test_pieces_of_every_kind(monkeypatch, cache):
    """Marks behind letters of one, two and more bytes, behind what is no letter, in added tokens and under combining marks."""
    monkeypatch.setattr(tokens, "CACHE", cache)
    rng, encoder = random.Random(8), tokens.Encoder(PATH)
    parts = ["word", "Word", "é", "É", "ß", "ø", "ė", "ŷ", "ǃ", "ȿ", "ɏ", "×", "÷", "€", "ﬁ", "漢", "۰", "α", "á", "́", "≠", "̸", "'", "'s", "'re", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "|"]
    parts += [*tokens.MARKS, " ", " ", " ", "\n", "\t", "\r\n", "\xa0", " ", "\x00", "7", "42", "Σ", "İ", "😀"]
    for _ in range(40):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
        assert ids_of(encoder, texts) == library_ids(texts)
    assert ids_of(encoder, []) == [] and ids_of(encoder, ["", ""]) == [[], []]


def test_every_letter_before_marks():
    texts = [f"x{chr(c)}.{chr(c)}, {chr(c)}-a" for c in range(0x20, 0x3000)]
    assert ids_of(tokens.Encoder(PATH), texts) == library_ids(texts)


def test_tasks_of_a_worker_learn_a_piece_once():
    encoder, words = tokens.encoder(PATH), [f"qz{chr(97 + i)}{chr(97 + j)}é" for i in range(26) for j in range(26)]
    assert encoder is tokens.encoder(PATH)
    assert sorted(asked(encoder, [" ".join(words)])) == sorted(w.encode().decode("latin-1").translate(encoder.letters) for w in words)
    again = [", ".join(words), "!\n".join(w.title() for w in words)]
    assert set(asked(encoder, again)) == {",", "!"}
    assert asked(encoder, again) == [] and ids_of(encoder, again) == library_ids(again)


def test_seldom_met_pieces_leave_memory(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 400)
    encoder = tokens.Encoder(PATH)
    for k in range(30):
        texts = [" ".join(["often", "met", *(f"{k}x{i}" for i in range(100))])]
        assert ids_of(encoder, texts) == library_ids(texts) and len(encoder.pieces) <= 400
        assert len(encoder.pieces) == len(encoder.met) == len(encoder.ends) - 1 and encoder.ends[-1] == len(encoder.ids)
    assert asked(encoder, ["often met"]) == []
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    long = ["often met", "x" * 100_000, "met", "yz" * 50_000]
    assert ids_of(encoder, long) == library_ids(long) and encoder.pieces.nbytes + encoder.ids.nbytes <= 20_000 and asked(encoder, ["often met"]) == []


@pytest.mark.parametrize("end_id", [None, 7])
def test_end_of_each_document(spark, tmp_path, end_id):
    texts, path = ["", "a, b", None, "", "c"], str(tmp_path / "t")
    tokens.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, PATH, end_id)
    end = [] if end_id is None else [end_id]
    got = [(r["doc_id"], r["n_tokens"], list(r["ids"])) for r in tokens.read(spark, path).orderBy("doc_id").collect()]
    assert got == [(k, len(x) + len(end), [*x, *end]) for k, x in enumerate(library_ids([t or "" for t in texts]))]


@pytest.mark.parametrize("change", [{"content": "two words"}, {"content": "dr.who"}, {"content": "<|cut|>", "lstrip": True}])
def test_added_tokens_that_a_cut_would_break(tmp_path, change):
    rules = json.load(open(PATH, encoding="utf-8"))
    rules["added_tokens"].append({**rules["added_tokens"][0], "id": 49408, **change})
    path = str(tmp_path / "more.json")
    json.dump(rules, open(path, "w", encoding="utf-8"))
    texts = ["these two words of dr.who and  <|cut|> more", "", "two words"]
    assert not tokens.cuttable(path)
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(path)(texts)]
    assert got == library_ids(texts, path) and any(49408 in x for x in got)
