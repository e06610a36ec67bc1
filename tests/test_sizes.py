"""Steps whose tasks must not grow with the input."""

from pyspark.sql import functions as F

from lanternfish.functions import links
from lanternfish.functions import text as tx
from lanternfish.operators import known, neartexts, scoring
from lanternfish.plans import text as text_plans
from lanternfish.sources import records
from lanternfish.sources.shared import spread, written


def test_instances_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks hold about as many instances each; an account of very many has a row per feature before it is dealt."""
    monkeypatch.setattr(scoring, "TASK_ROWS", 100)
    ids = ["S012", "A001", "D001"]
    rows = [(f"h{n % 300}", n, ids[n % 3], n % 5, None, None) for n in range(900)] + [("hot", n, ids[n % 3], n % 7 + 1, None, f"K{n % 2}") for n in range(600)]
    df = spark.createDataFrame(rows, "handle string, pos long, feature_id string, n long, n_min long, fact_key string")
    dealt = scoring.dealt(df)
    assert dealt.rdd.getNumPartitions() == 15 and dealt.where("handle = 'hot'").count() == 3
    assert max(map(len, dealt.rdd.glom().collect())) < 200
    want = sorted(map(str, scoring.best_instances(df).collect()))
    assert sorted(map(str, scoring.best_instances(dealt).collect())) == want


def test_watchlist_entries_of_one_domain_meet_a_link_once(spark):
    """Entries that repeat are one, the first; else each link meets all entries of its domain."""
    watch = spark.createDataFrame([(n, "a.com", "exact" if n % 2 else "prefix") for n in range(5, 50)] + [(3, "b.com/x", "prefix"), (2, "b.com/x", "prefix")], "pos long, entry string, entry_type string")
    found = spark.createDataFrame([(n, f"a.com/{n}", "a.com", "other", False) for n in range(20)] + [(30, "b.com/x/y", "b.com", "other", False)], "id long, url string, domain string, kind string, truncated boolean")
    rows = links.watch_matches(found, watch).collect()
    assert {(r["id"], r["pos"], r["how"]) for r in rows} == {(n, 5, "domain") for n in range(20)} | {(30, 2, "prefix")} and len(rows) == 21
    listed = links.first_entries(watch)
    assert listed.count() == 2


def counted(spark):
    """A function of strings that changes nothing, and how often it was called."""
    seen = spark.sparkContext.accumulator(0)

    def same(text):
        seen.add(1)
        return text

    return F.udf(same), seen


def test_facts_of_records_are_found_once(spark):
    """The lists are checked with links that were found once, not once more for each kind of entry."""
    same, seen = counted(spark)
    none = spark.createDataFrame([], "handle string, reason string")
    watch = spark.createDataFrame([(1, "a.com", "exact"), (2, "b.com/xx", "prefix")], "pos long, entry string, entry_type string")
    rows = spark.createDataFrame([(f"h{n}", "x", f"see a.com/{n} and b.com/xx{n}" if n % 2 else "words") for n in range(40)], "handle string, display_name string, bio string")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], records.RECORD).schema if f.name not in rows.columns]
    whole = rows.select("handle", "display_name", same("bio").alias("bio"), *rest)
    got = {r["handle"]: r["n_link_hits"] for r in known.checked(known.facts(whole), none, watch, none.select("handle")).collect()}
    assert got == {f"h{n}": 2 * (n % 2) for n in range(40)}
    assert seen.value == 40


def test_links_are_not_sought_to_filter_records(spark):
    """Each link of a record is a row, and no filter before it finds the links another time."""
    rows = spark.createDataFrame([("a", "x.com y.com"), ("b", ""), ("c", None)], "handle string, text string")
    found = records.each_link(rows.select("handle", F.transform(links.in_text(F.col("text")), links.normalized).alias("links")), "handle")
    assert sorted((r["handle"], r["url"]) for r in found.collect()) == [("a", "x.com"), ("a", "y.com")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("regexp_extract_all" in step for step in plan.splitlines()) == 1


def test_spread_rows_are_tasks_by_their_number(spark):
    rows = spread(spark.range(1_000, numPartitions=1), 100)
    assert rows.rdd.getNumPartitions() == 10 and max(map(len, rows.rdd.glom().collect())) <= 110
    assert spread(spark.range(0)).rdd.getNumPartitions() == 1


def test_sets_of_words_are_made_once(spark):
    """Pairs of documents join sets that were written; no text is read or normalised for them again."""
    plan = text_plans.text_jaccard_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" not in plan.lower() and "regexp" not in plan


def test_runs_of_words(spark):
    """Runs and their hashes against a plain loop; a run doesn't copy the words of its text."""
    texts = ["", "one", "one two", "one two three", "a b c a b c a", " ".join(str(n % 50) for n in range(500))]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n long, text string")
    made = rows.select("n", tx.shingles(F.col("text")).alias("runs"), F.transform(tx.shingles(F.col("text")), lambda r: F.xxhash64(r)).alias("want"))
    for r, h in zip(sorted(made.collect()), sorted(tx.run_hashes(rows).select("n", "runs").collect()), strict=True):
        words = texts[r["n"]].split()
        assert r["runs"] == list(dict.fromkeys(" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1)))) * bool(words)
        assert h["runs"] == sorted(r["want"])
    assert "slice" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_cheap_searches_find_what_the_whole_ones_found(spark):
    """Which characters go to Python, for all of them; and links with letters beyond ASCII that count as letters of a link."""
    points = spark.range(1, 0x110000).where("id not between 55296 and 57343").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    odd = F.col("c").rlike(r"[^\x00-\x7E\xA1-\xA7\xA9\xAB-\xAC\xAE\xB0-\xB1\xB6\xB7\xBB\xBF-\u017E]")
    assert points.where(tx.needs_python(F.col("c")) != odd).count() == 0 and points.where(odd).count() > 1_000_000
    texts = {"visit gift.\u0131o/a now": "visit <url> now", "más que. mañana": "más que mañana", "los años www.x": "los años <url>", "a.com": "<url>"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.skeleton(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in rows.collect()} == texts


def test_runs_of_texts_are_not_moved_to_find_copies(spark):
    """Copies are told by hashes and numbers of rows; no aggregate takes the runs of a text. Rows that repeat, and one id of two texts, count as before."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df)

    long = " ".join(f"w{n}" for n in range(40))
    rows = [(1, long), (1, long), (2, long), (2, long + " end"), (3, "other words of another text"), (4, "other words of another text"), (None, long), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, neartexts.near_duplicates(docs, kept).select("doc_id", "near_doc", "similarity").collect()))
    assert got == sorted(f"Row(doc_id={a}, near_doc={b}, similarity={s})" for a, b, s in [(1, 2, 1.0), (1, None, 1.0), (3, 4, 1.0), (1, 2, 0.974)])
    assert len(plans) > 3 and not any("first(runs" in p for p in plans)
