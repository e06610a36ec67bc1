"""Literals of the rubric's rules, and invariants."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.functions import links, names
from lanternfish.functions import text as tx
from lanternfish.operators import decisions, jobs, metrics, model, network, scoring
from lanternfish.operators.components import connected_components
from lanternfish.sources import lists, sinks
from lanternfish.sources.shared import written
from lanternfish.streaming import scouting

INSTANCE = "handle string, pos long, feature_id string, n long, n_min long, fact_key string"


def score(spark, *instances):
    """Scores and action of one account of (feature_id, n) instances."""
    rows = [("a", i, f, n, None, None) for i, (f, n) in enumerate(instances)]
    each, picked, valued = scoring.scored(spark.createDataFrame(rows, INSTANCE))
    return {r["score"]: r["value"] for r in valued.collect()}, scoring.actions(each, picked, valued).first()


def test_registry():
    assert len(config.FEATURES) == 60
    human = [f for f in config.FEATURES if f.category == "HUMAN"]
    assert not any(s in ("SPAM", "SCAM", "DECEPTION") for f in human for s in f.weights)


def test_worked_scores(spark):
    values, row = score(spark, ("A002", None), ("S003", 5))
    assert (values["SPAM"], row["n_groups"]) == (30, 1)
    values, row = score(spark, ("I002", None), ("I003", None), ("I004", None))
    assert values["IMPERSONATION"] == 89
    assert score(spark, ("D001", None))[0].get("DECEPTION", 0) == 0
    assert score(spark, ("D001", None), ("D002", None))[0]["DECEPTION"] == 50
    values, row = score(spark, ("I001", None))
    assert (values["IMPERSONATION"], row["action"]) == (90, "BLOCK_CANDIDATE_PENDING_2ND_PASS")
    assert score(spark, ("S004", 1))[1]["action"] == "KEEP"


def test_weak_evidence_never_reaches_review(spark):
    weak = [(f.feature_id, 50) for f in config.FEATURES if f.strength == "WEAK" and f.category != "NETWORK"]
    values, _ = score(spark, *weak)
    assert all(v < config.REVIEW_SCORE for s, v in values.items() if s in config.MALICIOUS_SCORES)


def test_forbidden_ids_count_nothing(spark):
    rows = spark.createDataFrame([("a", 0, "FP_RACE", None, None, None), ("a", 1, "N001", None, None, None)], INSTANCE)
    assert {r["reason"] for r in scoring.rejected(rows).collect()} == {"FORBIDDEN_PROXY", "UNKNOWN_OR_NETWORK_FEATURE_IN_RECORD"}
    assert scoring.best_instances(rows).count() == 0


def test_scores_do_not_depend_on_partitions(spark):
    rows = [(f"h{i % 5}", i, config.FEATURES[i * 7 % 60].feature_id, i % 9 + 1, None, None) for i in range(200)]
    one = scoring.scored(spark.createDataFrame(rows, INSTANCE).coalesce(1))[2]
    many = scoring.scored(spark.createDataFrame(rows[::-1], INSTANCE).repartition(7))[2]
    assert sorted(one.collect()) == sorted(many.collect())


@pytest.mark.parametrize(
    ("link", "url", "kind"),
    [
        ("HTTPS://www.T.me/XYZ/?utm_source=a", "t.me/xyz", "telegram"), ("https://api.whatsapp.com/send?phone=+1%20555", "wa.me/1555", "whatsapp"), ("m.youtube.com/watch?v=1", "youtube.com/watch?v=1", "other"),
        ("https://example.com/A/b?z=1&a=2&ref=q#f", "example.com/A/b?a=2&z=1", "other"), ("zangi.com/dl/123456", "services.zangi.com/dl/123456", "zangi"), ("bit.ly/Q", "bit.ly/Q", "shortener"),
    ],
)
def test_links(spark, link, url, kind):
    found = spark.createDataFrame([(link,)], "link string").select(links.normalized(F.col("link")).alias("x")).first()["x"]
    assert (found["url"], found["kind"]) == (url, kind)


def test_odd_links(spark):
    rows = [("t.me/abc…", ("t.me/abc", "t.me", "telegram", True, "prefix")), ("no link", None), (None, None), ("x.org/a_(b)).", ("x.org/a_(b)", "x.org", "other", False, "exact")), ("x.org/a.).)", ("x.org/a", "x.org", "other", False, "exact"))]
    rows += [("https://u:p@Www.X.org:80/?q=%zz&a=~*", ("x.org?a=~%2A&q=%25zz", "x.org", "other", False, "exact")), ("t.me/s/@Name/", ("t.me/name", "t.me", "telegram", False, "exact")), ("ftp", None)]
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, link string").select("i", links.normalized(F.col("link")).alias("x")).orderBy("i").collect()
    assert [r["x"] and tuple(r["x"]) for r in got] == [r[1] for r in rows]


def test_links_in_text(spark):
    texts = {
        "https://\nt.me/OFFICIAL_NAME_\nPART_TWO\n…": ["https://t.me/OFFICIAL_NAME_PART_TWO…"], "t.me/full\nword": ["t.me/full"], "see http://x.org/a?b=c and (y.io), ok": ["http://x.org/a?b=c", "y.io"],
        "t.me/a…\nrest…": ["t.me/a…"], "x.org/a\nmore\n\nend…": ["x.org/a"], "no links. none": [], "": [], "wow t.me… x": ["t.me…"],
    }
    got = {r["t"]: r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", links.in_text(F.col("t")).alias("x")).collect()}
    assert got == texts


def test_link_columns(spark):
    rows = spark.createDataFrame([("call zangi: 3415158270 now",), (None,)], "text string")
    assert [r[0] for r in rows.select(links.chat_numbers(F.coalesce("text", F.lit("")))).collect()] == [["services.zangi.com/dl/3415158270"], []]
    found = spark.createDataFrame([("t.me/abcd…",), ("t.me/abcdef",), ("t.me/abcdef",)], "link string").select(links.normalized(F.col("link")).alias("x"))
    kept = found.agg(F.collect_list("x").alias("x")).select(links.deduplicated(F.col("x")).alias("x")).first()["x"]
    assert [x["url"] for x in kept] == ["t.me/abcdef"]


def test_names(spark):
    rules = {
        "Elon Musk": "contains 'elonmusk'", "iam_elon": "'elon' with a claim prefix", "3lon": "'elon'", "3l0n x": "'elon'", "Tesla CEO": "contains 'teslaceo'", "muskceo": "'musk' with elon/tesla/spacex/ceo", "Gabriel Ontiveros": None,
        "melody": None, "watermelon": None, "watermelon musk": None, "elonfan": "'elon' + other words", "myelonteam": "'elon' with a role/claim word", "Ｅlоn": "'elon'", "é1ón": "'elon'", "": None, None: None,
    }
    got = spark.createDataFrame([(x,) for x in rules], "n string").select("n", names.impersonates(F.col("n"), ("watermelon",)).alias("r"), names.folded(F.col("n")).alias("f")).collect()
    assert {r["n"]: r["r"] for r in got} == rules
    assert {r["n"]: r["f"] for r in got}["Ｅlоn"] == "elon"
    one = spark.createDataFrame([("@plain", "Elon Musk"), ("@elonx", "y"), ("a", "UNKNOWN")], "h string, d string").select(names.impersonation(F.col("h"), F.col("d")).alias("x")).collect()
    assert [r["x"] and (r["x"]["field"], r["x"]["value"]) for r in one] == [("DISPLAY_NAME", "Elon Musk"), ("HANDLE", "elonx"), None]


def test_text(spark):
    rows = spark.createDataFrame([("Good  Morning",), ("Get 5 million $100 at https://www.x.io/a?utm_source=b 😀 @me",), (None,)], "text string")
    got = tx.fingerprints(rows).collect()
    assert [r["norm"] for r in got] == ["good morning", "get 5 million $100 at x.io/a @me", ""]
    assert [r["band"] for r in got][::2] == ["LOW", "LOW"] and got[0]["distinctiveness"] == 5
    assert rows.select(tx.skeleton(tx.normalized(F.col("text")))).collect()[1][0] == "get <num> illion <num> at <url> <user>"


def test_network(spark):
    long = "this very particular sentence about seventeen purple elephants dancing slowly across frozen northern harbours"
    day = datetime.date(2024, 1, 1)
    items = spark.createDataFrame([("a", "TEXT", long, day, None), ("b", "TEXT", long, day, None), ("c", "TEXT", "other words", day, None), ("c", "WALLET", " 0xAB ", None, None), ("d", "WALLET", "0xab", None, None)], "handle string, kind string, text string, date date, target string")
    member = written(network.members(items))
    pairs = written(network.pair_facts(member, network.facts(member)))
    rows = {r["handle"]: r for r in network.clusters(network.edges(pairs), pairs, written).collect()}
    assert rows["a"]["cluster_id"] == rows["b"]["cluster_id"] != rows["c"]["cluster_id"] == rows["d"]["cluster_id"]
    assert rows["a"]["n_evidence"] == 1 and not [p for p in pairs.collect() if p["fact_type"] == "TEMPLATE"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), written).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_gates_fail_one_by_one(spark):
    good = dict(automation=0, spam=0, scam=95, impersonation=0, deception=0, network_coordination=0, path1=True, strong_groups=1, compound_strong=False, n_groups=1, strong_feature=True, evidence_state="SUFFICIENT", complete=True, result="CONFIRMS", substantial=False, contrary=False, network_confirmed=False, review_floor=False)
    cases = [({}, "BLOCK_CONFIRMED"), ({"contrary": True}, "REVIEW"), ({"substantial": True}, "REVIEW"), ({"complete": False}, "REVIEW"), ({"result": "REFUTES"}, "REVIEW"), ({"evidence_state": "PARTIAL"}, "REVIEW_INSUFFICIENT_DATA"), ({"result": "PENDING"}, "BLOCK_CANDIDATE"), ({"evidence_state": "UNAVAILABLE"}, "UNKNOWN")]
    for change, outcome in cases:
        row = decisions.decided(spark.createDataFrame([tuple((good | change).values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'int'}" for k, v in good.items()))).first()
        assert row["outcome"] == outcome, change


def test_nature_words(spark):
    said = [("this is a bot", "BOT_LIKELY"), ("maybe a bot", None), ("not a bot", "HUMAN_LIKELY"), ("fake", None), ("that's a fake account", "BOT_LIKELY"), ("block", None), (None, None)]
    rows = spark.createDataFrame(said, "text string, want string").select("want", decisions.explicit_nature(F.col("text")).alias("got"))
    assert all(r["want"] == r["got"] for r in rows.collect())


def test_metrics():
    assert metrics.labels_needed(0.98) == 188


def test_model_against_a_plain_loop():
    rows, labels = [["S005", "I003"], ["S005"], ["H003"], ["A002", "H003"]] * 8, [1, 1, 0, 0] * 8
    vocabulary = sorted({f for r in rows for f in r})
    weights, bias = model.fit(rows, labels, vocabulary)
    w, b = dict.fromkeys(vocabulary, 0.0), 0.0
    n, pos = len(rows), sum(labels)
    for _ in range(400):
        gw, gb = dict.fromkeys(vocabulary, 0.0), 0.0
        for r, y in zip(rows, labels, strict=True):
            e = (n / (2 * pos) if y else n / (2 * (n - pos))) * (1 / (1 + np.exp(-(b + sum(w[f] for f in r)))) - y)
            gb += e
            for f in r:
                gw[f] += e
        for f in vocabulary:
            w[f] -= 0.5 * (gw[f] / n + 0.3 / n * w[f])
            if f.startswith("H"):
                w[f] = min(w[f], 0.0)
        b -= 0.5 * gb / n
    assert {f: round(v, 4) for f, v in w.items()} == pytest.approx(weights, abs=2e-4) and round(b, 4) == pytest.approx(bias, abs=2e-4)
    assert weights["H003"] <= 0
    mixed = [1, 0, 1, 1, 0, 1, 0, 1, 1, 0, 1, 0]
    folds = model.stratified_folds(mixed)
    for value in (0, 1):
        dealt = [folds[i] for i, y in enumerate(mixed) if y == value]
        assert max(dealt.count(k) for k in range(5)) - min(dealt.count(k) for k in range(5)) <= 1
    assert folds == [3, 3, 0, 1, 0, 4, 4, 2, 0, 1, 1, 2] and folds != model.stratified_folds(mixed, seed=8)


def test_jobs(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(jobs.upserted(old, new, "k").collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(jobs.inserted_or_ignored(old, new, ["k"]).collect()) == [("c", 4)]
    events = spark.createDataFrame([("S", "E", '{"Password": 1}', "h")], "stage string, event string, payload string, handle string")
    with pytest.raises(Exception, match="credential"):
        jobs.audit_events(events, {"ENGINE_VERSION": "1"}).collect()


def test_lists(spark, tmp_path):
    (tmp_path / "list").write_text('# updated: 2024\n@one\n{"handle": "two", "removed": "2024-01-01"}\n')
    got = {r["handle"]: r["tombstone"] for r in lists.read_list(spark, str(tmp_path / "list")).collect()}
    assert got == {"one": False, "two": True}
    (tmp_path / "bad").write_text("ok_name\nnot a handle!\n")
    with pytest.raises(Exception, match="bad list line 2"):
        lists.read_list(spark, str(tmp_path / "bad")).collect()
    frozen = lists.frozen(spark.createDataFrame([(1, "x")], "id int, v string"), "id")
    assert lists.verified_frozen(frozen).count() == 1
    with pytest.raises(Exception, match="changed"):
        lists.verified_frozen(frozen.withColumn("v", F.lit("y"))).collect()


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", "y"], {"p": True, "q": False})], "h string, tags array<string>, flags map<string,boolean>")
    manifest = sinks.export({"rows": rows}, str(tmp_path), {"ENGINE_VERSION": "1"}).first()
    assert manifest["bytes"] > 0 and spark.read.option("header", True).csv(f"{tmp_path}/rows").first()["tags"] == "x|y"


def test_scouting_replay_changes_nothing(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = spark.createDataFrame([(1, "a", "LIKE", "p", at(1), False), (2, "a", "LIKE", "p", at(1), False), (3, "b", "REPLY", None, at(2), False)], scouting.SCHEMA)
    scout = scouting.Scout(spark, str(tmp_path / "taken"))
    for batch in (0, 0, 1):
        scout.ingest(rows, batch)
    assert sorted(r["seq"] for r in scout.accepted().collect()) == [1, 3]
    scout.ingest(spark.createDataFrame([(4, "a", "LIKE", "q", at(2), False), (5, "a", "LIKE", "q", at(3), False)], scouting.SCHEMA), 2)
    assert sorted(r["seq"] for r in scout.accepted().collect()) == [1, 3, 5]


def test_stream_equals_batch(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [(i, f"h{i % 3}", ("LIKE", "REPLY")[i % 2], f"p{i}", at(i % 20), False) for i in range(20)]
    spark.createDataFrame(rows, scouting.SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scouting.SCHEMA).parquet(str(tmp_path / "in"))
    scout = scouting.Scout(spark, str(tmp_path / "taken"))
    scout.start(stream, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert scout.accepted().count() == 20


def test_scout_batches(spark, tmp_path):
    """Late and repeated rows go, marks are per source, replays change nothing."""
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    scout = scouting.Scout(spark, str(tmp_path / "s"))
    batch = lambda *rows: spark.createDataFrame([(i, "h", k, "p", t, False) for i, (k, t) in enumerate(rows)], scouting.SCHEMA)
    first = batch(("LIKE", at(5)), ("LIKE", at(5)), ("NEW_FOLLOW", at(3)), ("LIKE", None))
    scout.ingest(first, 0)
    assert scout.accepted().count() == 2
    scout.ingest(batch(("LIKE", at(4)), ("LIKE", at(6)), ("NEW_FOLLOW", at(4))), 1)
    scout.ingest(first, 0)
    scout.ingest(first, 7)
    assert sorted((r["kind"], r["ts"].hour) for r in scout.accepted().collect()) == [("LIKE", 5), ("LIKE", 6), ("NEW_FOLLOW", 3), ("NEW_FOLLOW", 4)]
    assert {r["source"]: r["mark"].hour for r in scout.marks().collect()} == {"NOTIF": 6, "FOLLOW": 4}


def test_stateful_history(spark, tmp_path):
    """Keyed state over two micro-batches equals the batch operators."""
    from lanternfish.operators import interactions as it
    from lanternfish.streaming import queue

    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [(i, f"h{i % 3}", ("LIKE", "REPLY", "TAG")[i % 4 % 3], f"p{i % 5}" if i % 6 else None, at(i * 7), False) for i in range(40)]
    spark.createDataFrame(rows[:25], scouting.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scouting.SCHEMA).parquet(str(tmp_path / "in"))
    query = lambda: queue.histories(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out" / str(n)))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query().awaitTermination(90)
    spark.createDataFrame(rows[25:], scouting.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert query().awaitTermination(90)
    got = {r["handle"]: (r["n"], r["diversity"], r["n_posts"], r["burst"]) for r in spark.read.parquet(str(tmp_path / "out" / "1")).collect()}
    df = spark.createDataFrame(rows, scouting.SCHEMA)
    burst = {r["handle"]: r["burst"] for r in it.bursts(df).collect()}
    assert got == {r["handle"]: (r["n"], r["diversity"], r["n_posts"], burst[r["handle"]]) for r in it.history(df).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_without_pairs(spark, seed):
    """Clusters by links to the least member equal those by all pairs, on random strong and moderate facts and templates."""
    import random

    from lanternfish.sources.shared import written

    rng, rows, facts = random.Random(seed), [], []
    for n in range(40):
        kind = rng.choice(["TEXT", "TEMPLATE", "WALLET", "SHARED_DOMAIN", "REPLY_WAVE"])
        strength = "STRONG" if kind == "WALLET" or (kind == "TEXT" and n % 3 == 0) else "MODERATE" if n % 7 else "WEAK"
        group = f"{kind}:{n % 9 if kind == 'REPLY_WAVE' else n}"
        who = rng.sample(range(30), rng.choice([2, 2, 3, 12]) if kind != "WALLET" else 2)
        rows += [(kind, str(n), group, f"h{w:02}") for w in who]
        facts.append((kind, str(n), group, len(who), strength))
    member = spark.createDataFrame(rows, "fact_type string, fact_key string, fact_group string, handle string")
    shared = spark.createDataFrame(facts, "fact_type string, fact_key string, fact_group string, n_members int, strength string")
    pairs = written(network.pair_facts(member, shared))
    want = sorted(map(tuple, network.clusters(network.edges(pairs), pairs, written).collect()))
    assert want and sorted(map(tuple, network.clusters_of(member, shared, written).collect())) == want


def test_shown_fingerprints(spark):
    """The first 25 texts of a group, a null one too; empty texts take no place and texts of one number follow as texts."""
    from lanternfish.functions import text as tx

    rows = [("a", n, f"text number {n}") for n in range(30)] + [("a", 3, "a text before"), ("a", 1, ""), ("a", 2, None), (None, None, "last"), (None, 7, "only @me"), ("b", None, None)]
    frame = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(5)
    got = {(r["source"], r["place"]): r for r in tx.shown_fingerprints(frame).collect()}
    want = [f"text number {n}" for n in range(3)] + ["a text before"] + [f"text number {n}" for n in range(3, 24)]
    assert [got["a", n]["text"] for n in range(1, 26)] == want and len(got) == 27
    assert (got[None, 1]["text"], got[None, 2]["text"]) == ("only @me", "last")
    every = {r["text"]: r for r in tx.fingerprints(frame).collect()}
    names = ("exact_hash", "norm_hash", "template_id", "distinctiveness")
    assert all([r[n] for n in names] == [every[r["text"]][n] for n in names] for r in got.values())


def test_interaction_problems(spark):
    from lanternfish.operators import interactions as it

    at = datetime.datetime(2024, 1, 1)
    rows = [("@Good_1", True, "LIKE", at), ("bad handle", True, "LIKE", at), ("a", None, "LIKE", at), ("a", True, "WAVE", at), (None, False, None, None)]
    got = it.problems(spark.createDataFrame(rows, "handle string, handle_confirmed boolean, kind string, ts timestamp")).collect()
    assert [len(r["problems"]) for r in got] == [0, 1, 1, 1, 4]


def test_light_check(spark):
    from lanternfish.operators import interactions as it

    flags = ("in_network", "policy_match", "repurposed", "listed", "link_hit", "phrase_hit", "name_hit", "owner_blocked")
    rows = [([], ["W001"], 64, *[False] * 8), (["A001"], [], 0, *[False] * 8), ([], ["S005"], 65, *[True] * 8)]
    got = it.light_check(spark.createDataFrame(rows, "strong array<string>, features array<string>, top_score int, " + ", ".join(f"{f} boolean" for f in flags))).collect()
    assert [(r["result"], len(r["reasons"])) for r in got] == [("LOW_RISK", 0), ("ESCALATE", 1), ("ESCALATE", 10)]


def test_reactions_and_phrases(spark):
    from lanternfish.operators import decisions

    told = spark.createDataFrame([("✅",), (" Block ",), (None,)], "r string").select(decisions.reaction(F.col("r")).alias("x")).collect()
    assert [r["x"] for r in told] == ["KEEP", "BLOCK", None]
    with pytest.raises(Exception, match="unknown reaction"):
        spark.createDataFrame([("maybe",)], "r string").select(decisions.reaction(F.col("r"))).collect()
    rows = [("kindly  SEND me a follow-request", "claim your prize", False, True), ("Kindly send me a follow request", "hello", False, False), ("Kindly send me a follow request", "hello", True, True), ("x", "dm me, claim your prize", True, False)]
    got = spark.createDataFrame(rows, "n string, b string, chat boolean, want boolean").select("want", names.phrase_rule(names.folded(F.col("n")), names.folded(F.col("b")), F.col("chat")).alias("x")).collect()
    assert all(r["x"] == r["want"] for r in got)


def test_contributions(spark):
    weights = {"A": 0.5, "B": -0.2, "C": 0.9, "D": 0.1, "E": 0.3}
    got = spark.createDataFrame([(["A", "B", "C", "D", "E"],), (["B", "Z"],), ([],)], "f array<string>").select(model.contributions(F.col("f"), weights)).collect()
    assert [r[0] for r in got] == [["C", "A", "E"], [], []]


def test_windowed_counts(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m)
    rows = [(1, "h", "LIKE", "p", at(5), False), (2, "h", "LIKE", "p", at(5), False), (3, "h", "LIKE", "q", at(50), False), (4, "g", "REPLY", "p", at(70), False)]
    spark.createDataFrame(rows, scouting.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = scouting.windowed(spark.readStream.schema(scouting.SCHEMA).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("windowed_counts").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)
    got = {(r["window"]["start"].hour, r["kind"]): r["n"] for r in spark.table("windowed_counts").collect()}
    assert got == {(0, "LIKE"): 2, (1, "REPLY"): 1}


def test_schema(spark):
    from lanternfish.functions import schema

    rules = {"type": "object", "required": ["handle"], "properties": {"handle": {"type": "string", "pattern": "^[a-z]+$"}, "n": {"anyOf": [{"const": "UNKNOWN"}, {"type": "integer", "minimum": 0}]}, "xs": {"type": "array", "items": {"$ref": "#/defs/x"}}}, "defs": {"x": {"enum": ["a"]}}}
    docs = ['{"handle": "ok", "n": 3, "xs": ["a"], "more": 1}', '{"handle": "NO", "n": -1, "xs": ["b"]}', "{", None, '{"n": true}']
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").select("i", schema.checked(F.col("d"), rules).alias("p")).orderBy("i").collect()
    assert [len(r["p"]) for r in rows] == [0, 3, 1, 0, 2]


def test_cross_validation_keeps_folds_apart():
    rows, labels = [["S005", "I003"], ["S004"], ["H003"], ["A002"]] * 6, [1, 1, 0, 0] * 6
    out = model.cross_validated(rows, labels, [False] * 24)
    assert all(not flagged for (_, _, flagged), y in zip(out, labels, strict=True) if not y) and sum(f for _, _, f in out) > 0


def test_policy(spark):
    from lanternfish.operators import review

    inst = spark.createDataFrame([("a", 1, "I001", "me", "PRIZE"), ("a", 2, "I001", "me", "CLAIM_TO_BE"), ("a", 3, "S005", None, None)], "handle string, pos long, feature_id string, identity string, rule string")
    off = spark.createDataFrame([], "identity string, rule string")
    assert [r["feature_id"] for r in review.regraded(inst, off).orderBy("pos").collect()] == ["I001", "S005", "I002"]
    on = spark.createDataFrame([("me", "PRIZE")], "identity string, rule string")
    assert {r["feature_id"] for r in review.regraded(inst, on).collect()} == {"I001", "S005"}
    assert review.rule_change_problems(3, 2, True, True, True, False) == []


def test_near_duplicates_of_all_documents(spark):
    """Every pair of documents that near_duplicate of the reference takes has a row or the same first document."""
    import random

    from lanternfish.operators import neartexts
    from lanternfish.sources.shared import written

    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(60)]
        for k in range(6):
            changed = [*base]
            for _ in range(k % 4):
                changed[rng.randrange(60)] = f"n{rng.randrange(99)}"
            texts.append(" ".join(changed))
    rng.shuffle(texts)
    texts += ["a very common line"] * 5 + ["A very  common line", None, "", " ", "one two", "one two three", "a b a b a b a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def runs(text):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = [runs(t) for t in texts]
    first = [sets.index(s) for s in sets]
    want = {(f, i, 1.0) for i, f in enumerate(first) if f != i and sets[i]}
    for i in sorted(set(first)):
        for k in sorted(set(first)):
            if i < k and sets[i] and sets[k] and (j := len(sets[i] & sets[k]) / len(sets[i] | sets[k])) >= 0.8:
                want.add((i, k, round(j, 3)))
    got = [tuple(r) for r in neartexts.near_duplicates(rows, written).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(k - i > 1 and i % 2 for i, k, j in want if j < 1)


def test_training_rows_are_bounded_and_not_a_prefix_of_the_key(spark):
    from lanternfish.plans import lists as plans

    sf = "/root/testdata/sf0.001"
    keys = sorted(r["o_orderkey"] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect())
    taken = [int(r["handle"][1:]) for r in plans._training(spark, sf).collect()]
    assert len(taken) == plans.TRAINING_ROWS and max(taken) > keys[len(keys) // 2]
    assert len(plans._training(spark, sf, 30).collect()) == 30
