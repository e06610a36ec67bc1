"""Names and rules against texts, and links against a watchlist, beside plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lanternfish.functions import links
from lanternfish.operators import review


def test_mentions_equal_a_loop(spark):
    rng = random.Random(1)
    pieces = ["Ann", "ann", "O'Neil", "X Corp.", "@acme", "Große", "GROSSE", "Ωμέγας", "ΩΜΈΓΑΣ", "of", "the", "\\E", "a.b", "!!", "über", "ÜBER", "x", "-foo", "foo", "日本", "Ann-Marie"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "", "  ", "\n", ",", "-"]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", None]
    names = sorted({rng.choice(pieces) + rng.choice([" ", "", "-"]) + rng.choice(pieces) for _ in range(60)} | set(pieces))
    names = [n.strip() for n in names]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {(r["id"], r["name"]) for r in review.mentions(rows, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    stands = F.regexp_like("text", F.concat(F.lit(r"(?iU)(?<!\w)"), F.concat(F.lit(r"\Q"), F.replace("name", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), F.lit(r"(?!\w)")))
    want = {(r["id"], r["name"]) for r in rows.crossJoin(spark.createDataFrame([(n,) for n in names], "name string")).where(stands).select("id", "name").collect()}
    assert got == want and len(want) > 200


def test_many_names_have_no_nested_loop(spark):
    names = spark.range(100_000).select(F.concat(F.lit("Person "), F.col("id")).alias("name"))
    rows = spark.createDataFrame([(1, "person 77 and PERSON 99999, person 100000"), (2, "nobody")], "id long, text string")
    found = review.mentions(rows, names)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["id"], r["name"]) for r in found.collect()} == {(1, "Person 77"), (1, "Person 99999")}


@pytest.mark.parametrize("pattern", ["licen[sc]e", "a|b", "(foo|bar)bazaar", "x{3}yes", "colou?rs", r"\bscam\w+now", "ab", "(a(b)c)+free money", "[abc", "end.*here$", "STRASSE", "ab{2,3}cde?fgh"])
def test_gates_lose_no_text(spark, pattern):
    rng = random.Random(pattern)
    words = ["license", "LICENCE", "a", "fooBazaar", "xxxyes", "colour", "colors", "scam_now", "ab", "abcfree MONEY", "end and here", "straße", "abbcdfgh", "abbbcdefgh", "…"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(120)]
    rows = spark.createDataFrame([(i, t, []) for i, t in enumerate(texts)], "id long, text string, features array<string>")
    try:
        re.compile(pattern)
    except re.error:
        return
    rules = spark.createDataFrame([("r", pattern, [])], "name string, pattern string, required array<string>")
    want = {r["id"] for r in rows.where(F.col("text").rlike("(?iU)" + pattern)).collect()}
    assert {r["id"] for r in review.rule_hits(rows, rules).collect()} == want


def test_rules_ask_for_features(spark):
    rows = spark.createDataFrame([(1, "worthless", ["S005"]), (2, "worthless", []), (3, None, ["S005"])], "id long, text string, features array<string>")
    rules = spark.createDataFrame([("q", "worth", ["S005", "S010"]), ("any", ".", [])], "name string, pattern string, required array<string>")
    assert sorted((r["id"], r["name"]) for r in review.rule_hits(rows, rules).collect()) == [(1, "any"), (1, "q"), (2, "any")]


def test_prefixes_by_their_lengths(spark):
    long = "t.me/" + "a" * 1_990
    watch = spark.createDataFrame([(1, "t.me/abcdef", "prefix"), (2, "t.me/abcdefghijkl", "exact"), (3, "x.com/q", "prefix"), (4, long[:1_000], "prefix"), (5, "bare.com", "exact")], "pos int, entry string, entry_type string")
    rows = spark.createDataFrame([(1, long, "t.me", "telegram", False), (2, "t.me/abcdefgh", "t.me", "telegram", False), (3, "t.me/abcdefghij", "t.me", "telegram", True), (4, "y.com/q", "y.com", "web", False), (5, "bare.com/x", "bare.com", "web", True)], "id int, url string, domain string, kind string, truncated boolean")
    got = {r["id"]: (r["pos"], r["how"]) for r in links.watch_matches(rows, watch).collect()}
    assert got == {1: (4, "prefix"), 2: (1, "prefix"), 3: (2, "prefix"), 5: (5, "domain")}


def test_names_of_very_many_labels_and_lines(spark):
    """Chains of labels, and of lines, that would take a frame of the stack each."""
    from lanternfish.functions import text as tx

    texts = ["a." * 4_000 + "zz", "see example.com.\nshop.example.org/deal", "x.com/begin\n" + "word\n" * 4_000 + "end…", "x.com/begin\n" + "word\n" * 4_000 + "end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r for r in rows.select("id", links.in_text(F.col("t")).alias("l"), tx.skeleton(F.lower("t")).alias("s")).collect()}
    assert got[1]["l"] == ["shop.example.org/deal", "example.com"]
    assert got[2]["l"] == ["x.com/begin" + "word" * 4_000 + "end…"] and got[3]["l"] == ["x.com/begin"]
    assert got[0]["s"]
