"""Pairs, watch pairs and clusters of accounts by shared facts, against all pairs."""

import itertools
import random
from collections import defaultdict

import pytest

from lanternfish.operators import network
from lanternfish.sources.shared import written


def random_facts(seed, accounts=30):
    rng, rows, facts = random.Random(seed), [], []
    for n in range(45):
        kind = rng.choice(["TEXT", "TEMPLATE", "WALLET", "SHARED_DOMAIN", "REPLY_WAVE", "GENERIC_TEXT"])
        strength = "STRONG" if kind == "WALLET" or (kind == "TEXT" and n % 3 == 0) else "WEAK" if kind == "GENERIC_TEXT" or n % 7 == 0 else "MODERATE"
        group = f"{'TEXT' if kind == 'GENERIC_TEXT' else kind}:{n % 9 if kind in ('REPLY_WAVE', 'GENERIC_TEXT', 'TEXT') else n}"
        who = rng.sample(range(accounts), rng.choice([2, 2, 3, 12]) if kind != "WALLET" else 2)
        rows += [(kind, str(n), group, f"h{w:02}") for w in who]
        facts.append((kind, str(n), group, len(who), strength))
    # accounts with the same facts as others
    for twin, of in (("t1", "h03"), ("t2", "h03"), ("t3", "h08")):
        mine = [r for r in rows if r[3] == of]
        rows += [(*r[:3], twin) for r in mine]
    count = defaultdict(int)
    for r in rows:
        count[r[:3]] += 1
    return rows, [(*f[:3], count[f[:3]], f[4]) for f in facts]


def brute_pairs(rows, facts):
    """pair -> fact group -> greatest rank, of all facts, templates left out beside a text."""
    rank = {f[:3]: {"STRONG": 3, "MODERATE": 2, "WEAK": 1}[f[4]] for f in facts}
    who = defaultdict(set)
    for r in rows:
        who[r[:3]].add(r[3])
    pairs = defaultdict(list)
    for fact, members in who.items():
        for a, b in itertools.combinations(sorted(members), 2):
            pairs[a, b].append(fact)
    out = {}
    for pair, shared in pairs.items():
        text = any(f[0] == "TEXT" for f in shared)
        best = defaultdict(int)
        for f in shared:
            if not (text and f[0] == "TEMPLATE"):
                best[f[2]] = max(best[f[2]], rank[f])
        out[pair] = dict(best)
    return out


@pytest.mark.parametrize("seed,slot", [(1, 1_000), (2, 3)])
def test_pairs_and_watch(spark, monkeypatch, seed, slot):
    monkeypatch.setattr(network, "SLOT", slot)
    rows, facts = random_facts(seed)
    member = spark.createDataFrame(rows, "fact_type string, fact_key string, fact_group string, handle string")
    shared = spark.createDataFrame(facts, "fact_type string, fact_key string, fact_group string, n_members int, strength string")
    want = brute_pairs(rows, facts)
    rank = {"STRONG": 3, "MODERATE": 2, "WEAK": 1}
    for weak in (False, True):
        got = {(r["a"], r["b"], r["fact_group"]): rank[r["strength"]] for r in network.pair_facts(member, shared, weak).collect()}
        assert got == {(*p, g): n for p, groups in want.items() for g, n in groups.items() if weak or n > 1}
    edge = lambda groups: 3 in groups.values() or list(groups.values()).count(2) >= 3
    of = defaultdict(set)
    for r in rows:
        of[r[3]].add(r[:3])
    least = {h: min(o for o in of if of[o] == of[h]) for h in of}
    classes = defaultdict(lambda: [0, 0, 0])
    for (a, b), groups in want.items():
        if groups and not edge(groups):
            row = classes[tuple(sorted((least[a], least[b])))]
            row[:] = row[0] + 1, list(groups.values()).count(2), list(groups.values()).count(1)
    assert {(r["a"], r["b"]): [r["n_pairs"], r["n_moderate"], r["n_weak"]] for r in network.watch(member, shared, written).collect()} == dict(classes)
    assert {r["handle"]: r["class"] for r in network.fact_classes(network.profiles(member, shared)).collect()} == least


@pytest.mark.parametrize("seed,slot", [(3, 1_000), (4, 2), (5, 4)])
def test_clusters_meet_at_rare_facts(spark, monkeypatch, seed, slot):
    monkeypatch.setattr(network, "SLOT", slot)
    rows, facts = random_facts(seed)
    member = spark.createDataFrame(rows, "fact_type string, fact_key string, fact_group string, handle string")
    shared = spark.createDataFrame(facts, "fact_type string, fact_key string, fact_group string, n_members int, strength string")
    pairs = written(network.pair_facts(member, shared))
    want = network.clusters(network.edges(pairs), pairs, written).collect()
    assert sorted(map(tuple, network.clusters_of(member, shared, written).collect())) == sorted(map(tuple, want))


def test_a_very_common_fact_is_no_meeting_place(spark, monkeypatch):
    """A moderate fact of every account joins no pairs: it is among the last two of each."""
    rows = [("SHARED_DOMAIN", "all", "SHARED_DOMAIN:all", f"h{n:03}") for n in range(400)]
    rows += [("SHARED_DOMAIN", str(n // 2), f"SHARED_DOMAIN:{n // 2}", f"h{n:03}") for n in range(400)]
    member = spark.createDataFrame(rows, "fact_type string, fact_key string, fact_group string, handle string")
    facts = [("SHARED_DOMAIN", "all", "SHARED_DOMAIN:all", 400, "MODERATE")] + [("SHARED_DOMAIN", str(n), f"SHARED_DOMAIN:{n}", 2, "MODERATE") for n in range(200)]
    shared = spark.createDataFrame(facts, "fact_type string, fact_key string, fact_group string, n_members int, strength string")
    met, real = [], network._met
    monkeypatch.setattr(network, "_met", lambda rows, key: met.append(rows.count()) or real(rows, key))
    assert network.clusters_of(member, shared, written).count() == 0 and not any(met)


def test_near_texts_with_a_run_in_every_document(spark, monkeypatch):
    """A run that all documents share, some with nothing but common runs, against all pairs."""
    from lanternfish.functions import text as tx
    from lanternfish.operators import neartexts
    from pyspark.sql import functions as F

    monkeypatch.setattr(neartexts, "SLOT", 3)
    rng = random.Random(7)
    texts = []
    for n in range(60):
        own = [rng.choice(["red", "green", "blue", "gray", "pink"]) for _ in range(rng.randint(0, 9))]
        texts.append("all of us share this line " + " ".join(own) + (" and this one too" if n % 3 == 0 else ""))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select("doc_id", F.array_distinct(tx.shingles(tx.normalized(F.col("text")))).alias("runs")).collect()
    sets = {r["doc_id"]: frozenset(r["runs"]) for r in rows}
    first = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    want = {(first[s], i) for i, s in sets.items() if first[s] != i}
    for a, b in itertools.combinations(sorted(first.values()), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            want.add((a, b))
    got = {(r["doc_id"], r["near_doc"]) for r in neartexts.near_duplicates(docs, written).collect()}
    assert got == want and len(want) > 5


def test_accounts_of_many_facts_are_rows(spark):
    """Four accounts with 5,000 facts each: no row holds the facts of an account, and the counts are right."""
    rows = [("SHARED_DOMAIN", str(n), f"SHARED_DOMAIN:{n}", f"h{(n + side) % 4}") for n in range(10_000) for side in (0, 1)]
    member = spark.createDataFrame(rows, "fact_type string, fact_key string, fact_group string, handle string")
    shared = spark.createDataFrame([(*r[:3], 2, "MODERATE") for r in rows[::2]], "fact_type string, fact_key string, fact_group string, n_members int, strength string")
    assert not any(kind.startswith("array") for _, kind in network.profiles(member, shared).dtypes)
    assert network.pair_facts(member, shared).count() == 10_000
    assert {(r["handle"], r["component"], r["n_evidence"]) for r in network.clusters_of(member, shared, written).collect()} == {(f"h{n}", "h0", 5_000) for n in range(4)}
    assert network.watch(member, shared, written).count() == 0


@pytest.mark.parametrize("seed,wide", [(3, 2), (5, 1), (6, 4)])
def test_clusters_of_widespread_strong_facts(spark, monkeypatch, seed, wide):
    monkeypatch.setattr(network, "WIDE", wide)
    rows, facts = random_facts(seed)
    member = spark.createDataFrame(rows, "fact_type string, fact_key string, fact_group string, handle string")
    shared = spark.createDataFrame(facts, "fact_type string, fact_key string, fact_group string, n_members int, strength string")
    pairs = written(network.pair_facts(member, shared))
    want = network.clusters(network.edges(pairs), pairs, written).collect()
    assert sorted(map(tuple, network.clusters_of(member, shared, written).collect())) == sorted(map(tuple, want))
