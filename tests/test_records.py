"""Records, shared documents, list upkeep, ledger, scouting, control: files and odd rows that queries don't show."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.functions import schema
from lanternfish.operators import control, jobs, known, ledger, model, reports, review, scouting
from lanternfish.sources import lists, records, sinks, stores


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_record_folder(spark, tmp_path):
    item = {"text": "t.me/name", "date": "2024-01-02", "target": "X"}
    write(tmp_path / "b.json", {"handle": "Beta", "bio": "UNKNOWN", "recent_replies": {"sampled_count": 1, "items": [item]}, "recent_original_posts": "UNKNOWN", "provenance": {"row": 2}, "more": 1})
    write(tmp_path / "a.json", {"handle": "alpha", "bio": "call zangi 3415158270", "wallet_addresses": [{"value": "0xA"}, {"value": "UNKNOWN"}], "image_hashes": ["h"], "provenance": {"row": 2, "website": "http://x.org/"}})
    write(tmp_path / "c.json", {"handle": "not a handle"})
    write(tmp_path / "d.json", "{")
    write(tmp_path / "ignored.txt", "x")
    rows = records.read(spark, str(tmp_path))
    assert {r["file"]: len(r["problems"]) for r in rows.collect()} == {"a.json": 0, "b.json": 0, "c.json": 1, "d.json": 1}
    with pytest.raises(Exception, match="c.json|d.json"):
        records.read(spark, str(tmp_path), strict=True).select("problems").collect()
    good = rows.where(F.size("problems") == 0)
    assert [r["handle"] for r in records.ordered(good).orderBy("place").collect()] == ["alpha", "Beta"]
    order = spark.createDataFrame([(1, "@BETA"), (2, "nobody")], "n long, handle string")
    assert [r["handle"] for r in records.ordered(good, order).orderBy("place").collect()] == ["Beta", "alpha"]
    found = {(r["handle"], r["kind"], r["value"], str(r["date"]), r["src"]) for r in records.items(good).collect()}
    assert found == {
        ("Beta", "TEXT", "t.me/name", "2024-01-02", "REPLY"), ("alpha", "BIO", "call zangi 3415158270", "None", "BIO"), ("alpha", "WALLET", "0xA", "None", "wallet_addresses"),
        ("alpha", "SHARED_DOMAIN", "http://x.org/", "None", "website"), ("alpha", "IMAGE_REUSE", "h", "None", "image"),
    }
    links = {r["handle"]: [x["url"] for x in r["links"]] for r in records.record_links(good).collect()}
    assert links == {"Beta": ["t.me/name"], "alpha": ["x.org", "services.zangi.com/dl/3415158270"]}
    assert records.items(good.limit(0)).count() == 0


def test_policy_based_claims(spark):
    rows = spark.createDataFrame([("a", [("I001", "e", ("CLAIM_TO_BE",))]), ("b", [("I001", "e", ("OWN_ORG",)), ("S001", "", None)]), ("c", None), ("d", [("I002", "", ("OWN_ORG",))])], "handle string, impersonation_features array<struct<feature_id: string, evidence: string, owner_policy_basis: struct<RULE: string>>>")
    assert {r["handle"]: r["policy_based"] for r in records.rests_on_policy(rows).collect()} == {"a": False, "b": True, "c": False, "d": False}


def test_shared_documents(spark, tmp_path):
    watch = write(tmp_path / "watch.json", {"LINKS": [{"url": "t.me/a"}, {"url": "x.org/b", "match_type": "prefix"}], "NEVER_WATCHLIST_DOMAINS": ["X.com"]})
    links, names = stores.watchlist(spark, watch)
    assert [(r["entry"], r["entry_type"]) for r in links.orderBy("pos").collect()] == [("t.me/a", "exact"), ("x.org/b", "prefix")]
    assert names == {"never": ("x.com",), "prose": (), "no_domain": ()}
    assert stores.watchlist(spark, str(tmp_path / "none"))[0].count() == 0
    handles, words = stores.allowlist(spark, write(tmp_path / "allow.json", {"HANDLES": ["@One", {"handle": "Two", "why": "x"}], "NAME_EXCLUSION_WORDS": ["melon"]}))
    assert sorted(r["handle"] for r in handles.collect()) == ["one", "two"] and words == ("melon",)
    legacy = write(tmp_path / "old.json", {"ACCOUNTS": [{"handle": "@A", "evidence": "e"}], "REMOVED": [{"handle": "B", "reason": "r", "removed": "2024-01-01"}]})
    old = {r["handle"]: (r["bio"], r["tombstone"]) for r in stores.accounts(spark, str(tmp_path / "none"), legacy).collect()}
    assert old == {"a": ("e", False), "b": (None, True)}
    assert stores.accounts(spark, write(tmp_path / "list", "@one\n"), legacy).count() == 1
    assert stores.versions(spark, write(tmp_path / "VERSION.md", "# Versions\n- `ENGINE`: 1.2\nRULES: 3 \nENGINE: 9\n")) == {"ENGINE": "1.2", "RULES": "3"}
    people, enabled, answers = stores.policy(spark, write(tmp_path / "policy.json", {"PROTECTED_IDENTITIES": [{"NAME": "P", "ALIASES": ["Q"], "RULES": [{"RULE": "R", "BLOCK_ELIGIBLE": True}, {"RULE": "S", "BLOCK_ELIGIBLE": False}]}], "RULE_ANSWERS": [{"QUESTION_ID": "q1", "PATTERN": "win"}]}))
    assert {r["name"] for r in people.collect()} == {"P", "Q"} and [r["rule"] for r in enabled.collect()] == ["R"] and answers.first()["required"] == []
    rows = stores.baseline(spark, write(tmp_path / "base.csv", "HANDLE,ACTION\na,KEEP\n"), str(tmp_path / "gone.csv")).collect()
    assert [tuple(r) for r in rows] == [("base.csv", "a", "KEEP")]


def test_list_upkeep(spark):
    entries = spark.createDataFrame([("b", None, None, False), ("A", None, None, False), ("z", "2024-01-01", "r", True)], "handle string, removed string, removed_reason string, tombstone boolean")
    full = entries.select("*", *[F.lit(None).cast("string").alias(n) for n in ("display_name", "bio", "source", "added", "verified", "reason")], F.lit(None).cast("array<string>").alias("links"))
    with pytest.raises(PermissionError):
        lists.rendered_list(full, "2024-02-01")
    lines = [r["value"] for r in lists.rendered_list(full, "2024-02-01", maintainer=True).collect()]
    assert lines[0] == "# accounts: 2, removed: 1, updated: 2024-02-01" and [json.loads(x)["handle"] for x in lines[1:]] == ["A", "b", "z"]
    numbered = spark.createDataFrame([(1, "# updated: 2023-01-01"), (2, "@x updated: 2025-01-01"), (3, "# updated: 2024-02-01")], "n int, value string")
    assert lists.updated_on(numbered).first()["updated"] == "2024-02-01"
    gone = known.removed(entries, spark.createDataFrame([("@a", "asked"), ("none", "x"), ("z", "again")], "handle string, reason string"), F.lit("2024-03-01"))
    assert {r["handle"]: (r["tombstone"], r["removed"]) for r in gone.collect()} == {"b": (False, None), "A": (True, "2024-03-01"), "z": (True, "2024-01-01")}


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "handle string, tags array<string>")
    out = str(tmp_path / "out")
    manifest = sinks.export({"states": rows}, out, {"V": "1"})
    kept = manifest.collect()
    assert all(len(r["sha256"]) == 64 and r["V"] == "1" for r in kept) and spark.read.option("header", True).csv(f"{out}/states").count() == 2
    same = spark.createDataFrame(kept, manifest.schema)
    assert sinks.verified_export(same, out).where("not same").count() == 0
    victim = next((tmp_path / "out" / "states").glob("*.csv"))
    victim.with_name(f".{victim.name}.crc").unlink(missing_ok=True)
    victim.write_text("changed")
    assert sinks.verified_export(same, out).where("not same").count() == 1
    sinks.audit_log(rows, str(tmp_path / "log"), {"RUN": "r1"})
    assert spark.read.json(str(tmp_path / "log")).groupBy("type").count().count() == 2
    sinks.results(rows, str(tmp_path / "res"), ["handle"])
    assert spark.read.option("header", True).csv(str(tmp_path / "res" / "results")).columns == ["handle"]


def test_keys_are_guarded_at_any_depth(spark):
    def stored(payload):
        events = spark.createDataFrame([("s", "e", payload, "h")], "stage string, event string, payload string, handle string")
        return jobs.audit_events(events, {"V": "1"}).collect()

    for bad in ('{"a": {"password": 1}}', '[{"b": [{"Token" : 1}]}]', '{"x\\"y": {"ct0": 2}}'):
        with pytest.raises(Exception, match="credential"):
            stored(bad)
    for good in ('{"a": "password"}', '{"a": "\\"password\\": 1"}', '{"passwords_seen": 1}', None, "{}", '{"note": "token: \\\\"}'):
        assert len(stored(good)) == 1
    older = spark.createDataFrame([("e", "1")], "event string, A string")
    assert jobs.upgraded_events(older, ("A", "B")).first().asDict() == {"event": "e", "A": "1", "B": "pre-v0.1.0"}


def test_frozen_sets_are_complete(spark):
    frozen = spark.createDataFrame([("A", 1)], "handle string, label int")
    assert stores.complete(frozen, spark.createDataFrame([("a", "KEEP")], "handle string, enforcement string")).first()["enforcement"] == "KEEP"
    with pytest.raises(Exception, match="no state of A"):
        stores.complete(frozen, spark.createDataFrame([("b", "KEEP")], "handle string, enforcement string")).collect()
    states = spark.createDataFrame([("a", None), ("b", ["S001"])], "handle string, features array<string>")
    new = spark.createDataFrame([("A", ["I001"]), ("b", ["X"])], "handle string, features array<string>")
    assert {r["handle"]: r["features"] for r in stores.backfilled(states, new).collect()} == {"a": ["I001"], "b": ["S001"]}


def test_each_row_is_held_out_by_itself(spark):
    rows = [("x", "h", ["S001"], 1), ("x", "h", ["H001"], 0), *[("x", f"p{i}", ["S001", "I002"], 1) for i in range(6)], *[("x", f"n{i}", ["H001"], 0) for i in range(6)], ("y", "h", ["S001"], 1), ("y", "k", [], 0)]
    got = model.leave_one_out(spark.createDataFrame(rows, "owner string, handle string, features array<string>, label int")).collect()
    assert len(got) == len(rows)
    mine = sorted(r["score"] for r in got if r["owner"] == "x" and r["handle"] == "h")
    assert mine[0] < 0.5 < mine[1]


def test_refit(spark):
    rows = [(f"b{i}", 1, False, ["S004", "I001"]) for i in range(22)] + [(f"k{i}", 0, i == 0, ["H001"]) for i in range(4)]
    training = spark.createDataFrame(rows, "handle string, label int, human boolean, features array<string>")
    first = model.refitted(training)
    assert first["active"] and first["refit"] == 1 and first["caught"] == 22
    assert model.refitted(training.repartition(3), first) is first
    assert model.refitted(training, first, force=True)["refit"] == 2
    assert not model.refitted(training.limit(5))["active"]
    same = spark.createDataFrame([(h, y, p, ["W001"]) for h, y, p, _ in rows], training.schema)
    assert model.refitted(same)["why_inactive"] == "no owner block clears the threshold"


def test_ledger_on_empty_and_odd_rows(spark):
    plan = spark.createDataFrame([("b1", "@A")], "batch string, handle string")
    flags = "handle_reverified boolean, decision_confirmed boolean, block_clicked boolean, already_blocked boolean, reloaded boolean, shows_blocked boolean, account_gone boolean, ts string, stop_reason string"
    rows = spark.createDataFrame([(1, "b1", "a", *[None] * 9), (2, "b1", None, *[None] * 8, "CAPTCHA"), (3, "b1", "a", *[True] * 6, False, "t", None)], f"seq long, batch string, handle string, {flags}")
    got = ledger.enforcement_records(rows, plan).orderBy("seq").collect()
    assert [(r["seq"], r["verified"], r["pause"]) for r in got] == [(1, False, None), (2, False, "SECURITY_PAUSE")]
    assert ledger.enforcement_records(rows.limit(0), plan).count() == 0
    with pytest.raises(ValueError, match="unknown mode"):
        ledger.eligible(F.lit("KEEP"), F.lit(None), "OTHER")
    groups = spark.createDataFrame([(i, f"h{i}", "PENDING") for i in range(40)], "pos int, key string, group string")
    assert ledger.list_batch(groups, 100).count() == 25 and ledger.list_batch(groups, 0).count() == 1


def test_settings(spark):
    with pytest.raises(ValueError, match="unknown settings"):
        scouting.Settings.of({"color": 1})
    with pytest.raises(ValueError, match="replies"):
        scouting.Settings.of({"replies": "SOMETIMES"})
    rows = spark.createDataFrame([(k, s) for k in ("REPLY", "LIKE", "REPOST", "TAG", "NEW_FOLLOW", "OTHER") for s in (False, True)], "kind string, s boolean")
    levels = {(r["kind"], r["s"]): r["l"] for r in rows.select("kind", "s", scouting.Settings(reposts=False, mentions="OFF").level(F.col("kind"), F.col("s")).alias("l")).collect()}
    assert levels["REPLY", True] == "FULL_AUDIT" and levels["REPLY", False] == "LIGHT_CHECK" and levels["REPOST", False] == "OFF" and levels["TAG", True] == "OFF" and levels["OTHER", False] == "LIGHT_CHECK"


def test_quiet_by_default(spark):
    states = spark.createDataFrame([("a", "REVIEW", ["SPAM"])], "handle string, enforcement string, classification array<string>")
    cache = spark.createDataFrame([], "handle string, current_action string, current_classification array<string>")
    queue = spark.createDataFrame([("A",)], "handle string")
    judged = spark.createDataFrame([], "id long, handle string, judged boolean")
    assert scouting.alerts(states, cache, queue, judged).count() == 0
    loud = scouting.alerts(states, cache, queue, judged, scouting.Settings(review_flagged=True)).first()
    assert loud["reasons"] == ["crossed REVIEW", "needs owner adjudication", "classification changed"]


def test_control_document(spark, tmp_path):
    run = control.Control("mine", "REVIEW_WITH_ME").discovered(["a", "b", "a"], False).marked("a", needs_owner=True).discovered(["c"], True)
    assert run.batch(5) == ["b", "c"] and run.stopped("CAPTCHA").batch(5) == [] and run.waiting == ("a",)
    path = str(tmp_path / "control.json")
    assert control.Control.load(spark, path, "mine") is None
    run.save(spark, path)
    run.marked("b").save(spark, path)
    assert control.Control.load(spark, path, "mine") == run.marked("b")
    with pytest.raises(PermissionError):
        control.Control.load(spark, path, "theirs")
    at = datetime.datetime(2024, 1, 1)
    runs = spark.createDataFrame([("mine", "r1", at, None, 1, 9), ("mine", "r2", at, at, 9, 9), ("theirs", "r3", at, None, 1, 9)], "instance string, run_id string, started_at timestamp, finished_at timestamp, done int, total int")
    assert [r["run_id"] for r in control.resumable(runs, "mine").collect()] == ["r1"]
    assert len(control.registry_stamp()) == 16 and set(control.stamps(X="1")) == {"ENGINE_VERSION", "REGISTRY_SHA256", "X"}


def test_texts(spark):
    states = spark.createDataFrame([("@A", "REVIEW", "spam", "too  many words " * 20), ("b", "KEEP", "uncertain", None)], "handle string, enforcement string, label string, reason string")
    cards = [r[0] for r in states.select(control.review_card(*map(F.col, ("handle", "enforcement", "label", "reason")))).collect()]
    assert cards[0].startswith("@a\nREVIEW (spam)\nWhy: too many words") and "…" in cards[0] and "Why: \n" in cards[1]
    assert control.progress(states, 5).first()["text"] == "2 of 5 checked: 1 keep, 1 review, 0 candidates, 0 confirmed"
    blocks = spark.createDataFrame([("VERIFIED", "2024-01-02"), ("PLANNED", "2024-01-02")], "status string, updated_at string")
    assert control.daily_summary(blocks, F.lit("2024-01-01")).first()["text"] == "1 blocked, 0 to try again, 0 to unblock"
    assert control.daily_summary(blocks, F.lit("2024-01-03")).count() == 0
    assert reports.CLAIM_LABELS == 188


def test_policy_outcome(spark):
    matches = spark.createDataFrame([("a", "IDENTITY", "P"), ("a", "RULE", "q1"), ("b", "RULE", "q2"), ("c", "IDENTITY", "P")], "handle string, kind string, name string")
    answers = spark.createDataFrame([("q1", "REVIEW_FLOOR", "YES", "SPAM"), ("q2", "REVIEW_FLOOR", "NO", "SCAM")], "name string, effect string, answer string, classification string")
    got = {r["handle"]: (r["identities"], r["with_feature"], r["rules"], r["review_floor"], r["hints"]) for r in review.policy_outcome(matches, answers, spark.createDataFrame([("a",)], "handle string")).collect()}
    assert got == {"a": (["P"], True, ["q1"], True, ["SPAM"]), "b": ([], False, ["q2"], False, []), "c": (["P"], False, [], False, [])}


def test_enumerations_and_words(spark):
    rows = spark.createDataFrame([("KEEP", ["SPAM"]), ("MAYBE", ["SPAM", "ODD"]), (None, None)], "enforcement string, classification array<string>")
    found = schema.enumerated(rows, {"enforcement": "enforcement", "classification": "classification"}, config.ENUMERATIONS)
    assert [len(r["problems"]) for r in found.collect()] == [0, 2, 0]
    said = spark.createDataFrame([(["X", "S004", "S005", "S006"],), ([],)], "f array<string>").select(reports.feature_words(F.col("f"))).collect()
    assert [r[0] for r in said] == ["sends the same scam script to many people + pushes people to DM it", ""]


def test_list_status_and_tasks(spark):
    groups = spark.createDataFrame([(1, "a", "PENDING"), (2, "b", "GONE")], "pos int, key string, group string")
    row = ledger.list_status(groups, True).first()
    assert (row["on_list"], row["pending"], row["gone"], row["finished"], row["needs_batch"]) == (2, 1, 1, False, True)
    assert ledger.list_status(groups.where("pos = 2"), True).first()["finished"]
    outcomes = spark.createDataFrame([("BLOCKED", "2024-02-01"), ("GONE", "2024-02-01"), ("ALREADY_BLOCKED", "2023-01-01")], "status string, updated_at string")
    assert ledger.blocked_since(outcomes, F.lit("2024-01-01")).first()["n"] == 1
    plan = spark.createDataFrame([("@B", "why"), ("A", "why not")], "handle string, basis string")
    assert [r["line"] for r in ledger.task_lines(plan, ["basis"], "%d. @%s: %s").orderBy("n").collect()] == ["1. @b: why", "2. @a: why not"]


def test_model_and_backtest_files(spark, tmp_path):
    rows = [(f"b{i}", 1, False, ["S004"]) for i in range(22)] + [(f"k{i}", 0, False, ["H001"]) for i in range(4)]
    training = spark.createDataFrame(rows, "handle string, label int, human boolean, features array<string>")
    fitted = model.refitted(training)
    sinks.model_files(fitted, training, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m" / "model")).first()["threshold"] == fitted["threshold"]
    assert {r["training_sha8"] for r in spark.read.json(str(tmp_path / "m" / "training")).collect()} == {fitted["training_sha8"]}
    unrated = spark.createDataFrame([("x", ["S004"]), ("y", ["H001"])], "handle string, features array<string>")
    assert [r["handle"] for r in model.never_rated(unrated, fitted).collect()] == ["x"]
    assert model.never_rated(unrated, fitted | {"active": False}).count() == 0
    fixtures = spark.createDataFrame([("x", "OWNER_TRAINED"), ("y", None), ("z", None)], "handle string, tier string")
    verdicts = spark.createDataFrame([("x", True, "BLOCK_CONFIRMED"), ("y", True, "OWNER_TRAINED")], "handle string, auto_block boolean, tier string")
    assert sorted(r["handle"] for r in model.missed_fixtures(fixtures, verdicts).collect()) == ["x", "z"]
    tested = model.backtest(spark.createDataFrame([("A", True, 1, False), ("A", True, 0, True), ("B", False, 1, False)], "tier string, flagged boolean, label int, human boolean"), "tier")
    sinks.backtest_files(tested, unrated.select("handle"), str(tmp_path / "b"))
    lines = next((tmp_path / "b" / "markdown").glob("*.txt")).read_text().splitlines()
    assert lines[0].startswith("| tier |") and [x.split(" | ")[0] for x in lines[2:]] == ["| A", "| B"]
    assert [(r["tier"], r["n_caught"], r["n_false"], r["n_false_human"]) for r in tested.orderBy("tier").collect()] == [("A", 1, 1, 1), ("B", 0, 0, 0)]
