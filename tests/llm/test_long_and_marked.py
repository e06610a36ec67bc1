"""Texts that once broke operators: capitals under combining marks, very long runs of comment lines and of licence tags."""

import subprocess
import sys
import unicodedata
from pathlib import Path

import pytest

from lanternfish.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = "word_bpe_49k.json"


def library_ids(texts):
    return [x.ids for x in tokens._tokenizer(public_tokenizers.path(VOCABULARY)).encode_batch_fast(texts, add_special_tokens=False)]


def own_ids(texts):
    import numpy as np

    return [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(public_tokenizers.path(VOCABULARY))(texts)]


def test_every_cased_letter_under_every_mark():
    """The vocabulary composes characters before it lower-cases them."""
    every = list(map(chr, range(0x1F00)))
    marks = [c for c in every if unicodedata.category(c)[0] == "M"]
    letters = [c for c in every if c.lower() != c or c.upper() != c]
    assert len(marks) > 500 and len(letters) > 1_000
    common = [m for m in marks if m < "Ͱ"]
    for k in range(0, len(letters), 100):
        some = letters[k : k + 100]
        texts = [" ".join(f"{c}{m}" for m in (marks if k < 200 else common)) for c in some] + [f"X{c}{m}y, " for c in some for m in common]
        assert own_ids(texts) == library_ids(texts)


def test_marks_in_words_of_both_cases():
    import random

    rng = random.Random(4)
    pieces = ["T̈", "J̌", "H̱", "W̊", "Y̊", "ẗ", "Å", "É", "ß", "Straße", "́", " ", " ", "\n", ",", "HELLO", "x", "가", "İ", "Σ", "<|", "9", "'s"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(6_000)]
    assert own_ids(texts) == library_ids(texts)


LONG = """
import sys
sys.path.insert(0, {root!r})
import duckdb
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from lanternfish.llm import licenses
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
lines = {{m: "\\n".join(m + " filler" for _ in range(200_000)) + "\\n\\ncode\\n" for m in ("#", "//", "*", "--", ";")}}
text = "Licensed under the MIT License."
rows = [(m, x + m + " one\\n" + m + " " + text + "\\nend") for m, x in lines.items()] + [("tags", "SPDX-License-Identifier: MIT" + " OR MIT" * 20_000), ("none", None)] + [(f"other{{k}}", f"plain words of file {{k}}") for k in range(60)]
docs = spark.createDataFrame(rows, "path string, text string")
sizes = [r[0] for r in docs.orderBy("path").select(F.size(F.regexp_extract_all("text", F.lit(licenses.BLOCKS), F.lit(0)))).collect()]
con = duckdb.connect()
con.execute("create table files (path varchar, text varchar)")
con.executemany("insert into files values (?, ?)", rows)
theirs = [r[0] if r[0] is not None else -1 for r in con.execute("select len(regexp_extract_all(text, ?)) from files order by path", [licenses.BLOCKS.replace("(?md)", "(?m)").replace("+\\0", "").removesuffix("+")]).fetchall()]
assert [-1 if s is None else s for s in sizes] == theirs, (sizes, theirs)
found = {{r["path"]: r["own_license"] for r in licenses.scanned(docs).collect()}}
short = {{k: v and v[:60] for k, v in found.items()}}
assert all(found[m] == "MIT" for m in lines), short
assert found["tags"].startswith("MIT OR MIT") and found["none"] is None
print("whole")
"""


def test_licenses_of_very_long_comments(tmp_path):
    """In a JVM of its own, whose code isn't compiled yet: a frame of the stack for each line would end it."""
    script = LONG.format(root=str(Path(__file__).resolve().parents[2]), shared=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and done.stdout.strip().endswith("whole"), done.stderr[-3000:]
