"""Proposed changes of rules and the numbers of labels that claims need."""

from lanternfish.operators import metrics, review


def test_cases_needed_equal_a_loop(spark):
    rows = [(t, e) for t in (0.5, 0.8, 0.9, 0.95, 0.98, 0.995) for e in (0, 1, 2, 5, 20, 100)]
    got = metrics.cases_needed(spark.createDataFrame(rows, "target double, errors int")).collect()
    assert [(r["n_needed"], r["target"]) for r in got] == [(metrics.labels_needed(t, e), t) for t, e in rows]


def test_rule_changes(spark):
    proposals = spark.createDataFrame([(1, False, "1", "2", 3), (2, True, "1", "2", 1), (3, True, "1", "1", 0), (4, None, None, "2", None)], "proposal int, changes_weights boolean, current_version string, new_version string, n_tests int")
    examples = [(p, h, r, d) for p in (1, 2) for h, r, d in (("a", 1, "X"), ("A", 2, "X"), ("b", 1, "COLLECTION_FAILURE"), ("c", 1, None))] + [(3, "a", 1, "X"), (4, "a", None, None), (4, "b", 1, None), (4, "c", 1, None)]
    examples = spark.createDataFrame(examples, "proposal int, handle string, round int, diagnosis string")
    frozen = spark.createDataFrame([("s1",), ("s2",), ("s2",)], "set_id string")
    reruns = spark.createDataFrame([(p, s) for p in (1, 2, 4) for s in ("s2", "s1", "old")] + [(3, "s2")], "proposal int, set_id string")
    got = {r["proposal"]: r for r in review.rule_changes(proposals, examples, frozen, reruns).collect()}
    assert got[1]["accepted"] and got[1]["n_examples"] == 3 and got[1]["n_rounds"] == 2
    assert got[2]["problems"] == ["weights may not change for a collection failure"]
    assert got[3]["problems"] == ["fewer than 3 examples", "one round only", "no version bump", "no regression tests", "reruns missing"] and got[3]["missing"] == ["s1"]
    assert got[4]["problems"] == ["no regression tests"] and got[4]["n_rounds"] == 2
    assert all(r["problems"][-1] == "a job is live" for r in review.rule_changes(proposals, examples, frozen, reruns, live_job=True).collect())
    assert review.rule_changes(proposals, examples, frozen.limit(0), reruns).where("size(missing) > 0").count() == 0
