"""Owner policy, short reasons, confidence, first-form second passes, failure diagnosis and the rule-change gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.functions.text import let
from lanternfish.sources.shared import few

c = F.col

# The phrases of short reasons, in the order in which they win, and features that are named without a quote.
PHRASES = (
    ("I001", "Presents itself as a real public figure"), ("S004", "Sends the same scam script to many people"), ("S008", "Links to a known malicious site"), ("S011", "Adult-cam link in its profile"),
    ("I005", "Claims to act for a public figure"), ("I002", "Claims a role with a public figure or company"), ("I003", "Uses a public figure's name or look"), ("S016", "Investment or money pitch"),
    ("S006", "Crypto giveaway pitch"), ("S010", "Pushes people to off-platform chat"), ("S005", "Pushes people to DM it"), ("S013", "Cold openers to strangers"), ("S012", "Prize or money bait"),
    ("S009", "Repeats the same promo post"), ("S001", "Engagement-bait posts"), ("S018", "Follow-bait posts"), ("A001", "Same reply sent to many accounts"), ("D007", "Old account turned into a new persona"),
    ("D003", "False status claims"), ("D006", "Admits to a disguised account"),
)
UNQUOTED = ("S011", "S008", "D007")
NOTHING_READ, NO_SIGNS = "Almost nothing could be read on this profile.", "No strong warning signs found."
MIN_ITEMS, MIN_THREADS, MIN_SUPPORT = 20, 3, 3


def _first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), 1, n), " ")


def short_reasons(contributions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """handle, reason of each outcome (handle, outcome): the first phrase whose feature raises a score (handle, feature_id, evidence, weight)."""
    spark = outcomes.sparkSession
    order = spark.createDataFrame([(f, p, i) for i, (f, p) in enumerate(PHRASES)], "feature_id string, phrase string, place int")
    hits = contributions.where("weight > 0").join(F.broadcast(order), "feature_id").groupBy("handle").agg(F.min_by(F.struct("feature_id", "phrase", "evidence"), "place").alias("x"))
    quoted = F.concat(c("x.phrase"), F.lit(': "'), _first_words(F.coalesce("x.evidence", F.lit("")), 8), F.lit('"'))
    text = F.when(c("x.feature_id").isin(*UNQUOTED), F.concat("x.phrase", F.lit("."))).otherwise(quoted)
    none = F.when(c("outcome").isin("LOW_EVIDENCE_KEEP", "UNKNOWN"), NOTHING_READ).otherwise(NO_SIGNS)
    return outcomes.join(hits, "handle", "left").select("handle", F.when(c("x").isNotNull(), _first_words(text, 20)).otherwise(none).alias("reason"))


def confidence(quality: Column, n_known: Column, n_groups: Column, confirmed: Column, contrary: Column, top: Column) -> Column:
    """How much the evidence carries: a base and a cap by its quality, more for known fields, groups and a confirming pass."""
    grade = lambda *v: F.when(quality == "LOW", v[1]).when(quality == "MEDIUM", v[2]).when(quality == "HIGH", v[3]).otherwise(v[0])
    plus = F.when(confirmed, 10).otherwise(0)
    value = grade(5, 25, 45, 65) + 20 * n_known / 15 + 5 * F.least(F.lit(3), n_groups) + plus - F.when(contrary & (top >= 40), 10).otherwise(0)
    return F.bround(F.greatest(F.lit(0.0), F.least(grade(20, 55, 75, 90) + plus, value, F.lit(100.0)))).cast("int")


def diagnosed(rows: DataFrame) -> DataFrame:
    """Why the engine and the owner differ, first hit. rows: action, disputed, enforcement, evidence_state, g1, g2, g3, g6, result, rule_hit, strong_feature,
    top_score, n_groups, capped, weak."""
    blocking = c("enforcement").isin("BLOCK_CANDIDATE", "BLOCK_CONFIRMED")
    agrees = F.when(c("action") == "BLOCK", blocking).otherwise(c("enforcement").isin("KEEP", "REVIEW"))
    basis = c("g1") & c("g2")
    failure = (
        F.when(c("action").isNull(), None)
        .when(c("disputed"), "LABEL_AMBIGUITY")
        .when(agrees, None)
        .when(c("action") == "KEEP", F.when(c("human_evidence"), "SCORING_FAILURE").otherwise("LABEL_AMBIGUITY"))
        .when(c("evidence_state").isin("INSUFFICIENT", "UNAVAILABLE"), "COLLECTION_FAILURE")
        .when(basis & ((c("result") == "REFUTES") | ~c("g6")), "LABEL_AMBIGUITY")
        .when(basis & (c("result").isin("INCOMPLETE", "PENDING") | ~c("g3")), "COLLECTION_FAILURE")
        .when(c("rule_hit"), "LABEL_AMBIGUITY")
        .when(c("strong_feature") & (c("enforcement") == "REVIEW"), "DECISION_THRESHOLD_FAILURE")
        .when((c("top_score") >= config.REVIEW_SCORE) | (c("n_groups") >= 2), "DECISION_THRESHOLD_FAILURE")
        .when(c("capped") | c("weak"), "SCORING_FAILURE")
        .when(c("evidence_state") == "PARTIAL", "COLLECTION_FAILURE")
        .otherwise("FEATURE_EXTRACTION_FAILURE")
    )
    return rows.withColumn("failure", failure)


def first_form_pass(rows: DataFrame) -> DataFrame:
    """Second passes of the first form with problems and the effective verdict.

    rows: complete, verdict, contrary (true, false or null), items, threads, exhausted, visible_items, visible_threads, older_checked, quotes_verified,
    human_searched, domains, repeated, network (true, false or null for not applicable), claims_identity, claim_quoted.
    """
    yes = lambda n: F.coalesce(c(n), F.lit(False))
    whole = yes("exhausted") & (c("visible_items") < MIN_ITEMS)
    items = F.coalesce((c("items") >= MIN_ITEMS) | (whole & (c("items") >= c("visible_items"))), F.lit(False))
    threads = F.coalesce((c("threads") >= MIN_THREADS) | (whole & (c("visible_threads") < MIN_THREADS) & (c("threads") >= c("visible_threads"))), F.lit(False))
    tests = [
        ("too few items", items), ("too few threads", threads), ("older content not checked", yes("older_checked")), ("quotes not verified", yes("quotes_verified")),
        ("contrary evidence not searched", yes("human_searched")), *[(f"{n} not verified", F.coalesce(c(n), F.lit(True))) for n in ("domains", "repeated", "network")],
        ("identity claim not quoted", ~yes("claims_identity") | yes("claim_quoted")),
    ]
    out = rows.withColumn("problems", F.array_compact(F.array(*[F.when(~test, F.lit(name)) for name, test in tests])))
    pending = ~yes("complete") | F.coalesce(c("verdict"), F.lit("PENDING")).isin("PENDING")
    verdict = (
        F.when(pending, "PENDING").when(yes("contrary") | (c("verdict") == "DOWNGRADE_TO_REVIEW"), "DOWNGRADE_TO_REVIEW")
        .when((c("verdict") == "CONFIRMED") & F.coalesce(~c("contrary"), F.lit(False)) & (F.size("problems") == 0), "CONFIRMED").otherwise("INCONCLUSIVE")
    )
    return out.withColumn("effective_verdict", verdict)


def regraded(instances: DataFrame, enabled: DataFrame) -> DataFrame:
    """Identity claims that rest on an owner's rule (identity, rule) which isn't enabled become affiliation claims, behind the others."""
    rows = instances.join(few(enabled.select("identity", "rule", F.lit(True).alias("on"))), ["identity", "rule"], "left")
    moved = (c("feature_id") == "I001") & c("rule").isNotNull() & (c("rule") != "CLAIM_TO_BE") & c("on").isNull()
    return rows.withColumns({"feature_id": F.when(moved, "I002").otherwise(c("feature_id")), "pos": F.when(moved, c("pos") + 1_000_000_000).otherwise(c("pos"))}).drop("on")


def _folded(text: Column) -> Column:
    """Text of which equal letters, whatever their case, are the same."""
    return F.translate(F.lower(F.upper(text)), "ς", "σ")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_folded(text), r"(?U)\W+"), "")


def _phrases(every: Column, lengths: list[int]) -> Column:
    """The distinct runs of so many words, joined by blanks."""
    run = lambda words, n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return let(every, lambda words: F.array_distinct(F.flatten(F.array(*[run(words, n) for n in lengths]))))


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id and name of each name that stands in a text (id, text) as words of its own, whatever its case; any number of names.

    A name is looked up by its words among the runs of as many words of the texts, an equality join; what is between the words
    is compared where that finds it. Names without a word, which no text of words leads to, may be few.
    """
    rows = names.select("name").distinct().withColumn("words", _words(c("name")))
    worded = rows.where(F.size("words") > 0).select("name", F.array_join("words", " ").alias("phrase"), F.size("words").alias("n"))
    lengths = sorted(r["n"] for r in few(worded.select("n").distinct()).collect())
    met = texts.select("id", "text")
    literal = F.concat(F.lit(r"\Q"), F.replace("name", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    stands = F.regexp_like("text", F.concat(F.lit(r"(?iU)(?<!\w)"), literal, F.lit(r"(?!\w)")))
    out = met.join(few(rows.where(F.size("words") == 0).select("name")), stands).select("id", "name") if rows.where(F.size("words") == 0).limit(1).count() else None
    if lengths:
        found = met.select("id", F.explode(_phrases(_words(c("text")), lengths)).alias("phrase")).join(worded, "phrase").select("id", "name")
        found = found.join(met, "id").where(stands).select("id", "name")
        out = found if out is None else found.unionByName(out)
    return out if out is not None else met.join(names.select("name").limit(0), F.lit(True)).select("id", "name")


#: Characters of a pattern that stand for themselves, once all else is cut away.
_GROUP, _STOP = r"\([^()]*\)[*?+]?(?:\{[^}]*\})?", "\u0001"
#: Most rules that have no three letters in a row which each match needs.
UNGATED = 1_000


def gate(pattern: Column) -> Column:
    """Three characters, folded, that stand in a row in every text which a pattern matches; null where none are known."""
    cut = F.regexp_replace(pattern, r"\\.(?:\{[^}]*\})?", _STOP)
    cut = F.regexp_replace(cut, r"\[[^\]]*\](?:\{[^}]*\})?", _STOP)
    for _ in range(3):
        cut = F.regexp_replace(cut, _GROUP, _STOP)
    open_ = cut.rlike(r"[()|\[\]]")
    cut = F.regexp_replace(F.regexp_replace(cut, r".(?:[*?]|\{[^}]*\})", _STOP), r"[.^$+]", _STOP)
    runs = F.filter(F.split(_folded(cut), _STOP), lambda x: F.length(x) >= 3)
    return F.when(~open_ & (F.size(runs) > 0), F.substring(F.sort_array(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))), asc=False)[0]["x"], 1, 3))


def rule_hits(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """id and name of each rule (name, pattern, required) that a text (id, text, features) meets.

    A rule goes only to texts that hold its gate, an equality join on the gates among the texts' runs of three characters. An
    owner's rules are few by nature; those without a gate may be UNGATED at most.
    """
    gated = rules.withColumn("gate", gate(c("pattern")))
    rest = gated.where("gate is null").select("name", "pattern", "required").limit(UNGATED + 1).collect()
    if len(rest) > UNGATED:
        raise ValueError(f"more than {UNGATED} rules that any text may meet")
    met = F.expr("text rlike concat('(?iU)', pattern) and (size(required) = 0 or arrays_overlap(required, features))")
    asked = [r["gate"] for r in few(gated.where("gate is not null").select("gate").distinct()).collect()]
    threes = F.array_intersect(F.regexp_extract_all(_folded(c("text")), F.lit("(?s)(?=(...))"), F.lit(1)), F.array(*map(F.lit, asked)).cast("array<string>"))
    pairs = texts.select("id", F.explode(threes).alias("gate")).join(gated.where("gate is not null"), "gate").select("id", "name", "pattern", "required")
    out = pairs.join(texts.select("id", "text", "features"), "id").where(met).select("id", "name")
    if rest:
        every = F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.lit(r["pattern"]).alias("pattern"), F.array(*map(F.lit, r["required"])).cast("array<string>").alias("required")) for r in rest])
        out = out.unionByName(texts.withColumn("rule", F.explode(every)).select("id", "text", "features", "rule.*").where(met).select("id", "name"))
    return out


def policy_matches(texts: DataFrame, identities: DataFrame, answers: DataFrame) -> DataFrame:
    """handle, kind (IDENTITY or RULE), name of each policy row that an account's text meets.

    texts: handle, text, features; identities: name; answers: name, pattern, required (features, of which one is needed; empty: none).
    """
    rows = texts.withColumn("id", F.xxhash64("handle", "text", F.array_join(F.array_sort("features"), "|")))
    ids = rows.select("id", "handle")
    distinct = rows.select("id", "text", "features").dropDuplicates(["id"])
    who = mentions(distinct, identities).join(ids, "id").select("handle", F.lit("IDENTITY").alias("kind"), "name")
    return who.unionByName(rule_hits(distinct, answers).join(ids, "id").select("handle", F.lit("RULE").alias("kind"), "name"))


def policy_outcome(matches: DataFrame, answers: DataFrame, impersonating: DataFrame) -> DataFrame:
    """handle, identities, with_feature, rules, review_floor, hints of policy_matches().

    answers: name, effect, answer, classification; impersonating: handles with a feature of impersonation. A matched rule that was
    answered YES gives its hint, and with the effect REVIEW_FLOOR keeps the account at least under review.
    """
    told = matches.join(answers.select("name", "effect", "answer", "classification"), "name", "left")
    yes = (c("kind") == "RULE") & (c("answer") == "YES")
    names = lambda kind: F.array_sort(F.collect_set(F.when(c("kind") == kind, c("name"))))
    rows = told.groupBy("handle").agg(
        names("IDENTITY").alias("identities"), names("RULE").alias("rules"), F.coalesce(F.max(yes & (c("effect") == "REVIEW_FLOOR")), F.lit(False)).alias("review_floor"),
        F.array_sort(F.collect_set(F.when(yes, c("classification")))).alias("hints"),
    )
    marked = impersonating.select("handle", F.lit(True).alias("marked")).distinct()
    rows = rows.join(marked, "handle", "left")
    return rows.select("handle", "identities", (F.coalesce("marked", F.lit(False)) & (F.size("identities") > 0)).alias("with_feature"), "rules", "review_floor", "hints")


def rule_change_problems(n_examples: int, n_rounds: int, bumped: bool, tests_pass: bool, reruns_done: bool, live_job: bool) -> list[str]:
    """What stands against a change of rules; nothing if it may go in."""
    tests = [("fewer than 3 examples", n_examples >= MIN_SUPPORT), ("one round only", n_rounds >= 2), ("no version bump", bumped), ("tests fail", tests_pass), ("reruns missing", reruns_done), ("a job is live", not live_job)]
    return [name for name, good in tests if not good]


def rule_changes(proposals: DataFrame, examples: DataFrame, frozen: DataFrame, reruns: DataFrame, live_job: bool = False) -> DataFrame:
    """proposal, n_examples, n_rounds, missing (frozen sets without a rerun), problems and accepted of each proposed change of rules.

    proposals: proposal, changes_weights, current_version, new_version, n_tests; examples: proposal, handle, round, diagnosis; frozen:
    set_id (few by nature); reruns: proposal, set_id. Examples count once for each handle, whatever its case. Weights don't
    change for evidence that wasn't collected.
    """
    support = examples.groupBy("proposal").agg(
        F.count_distinct(F.lower(F.coalesce("handle", F.lit("")))).alias("n_examples"), (F.count_distinct("round") + F.max(c("round").isNull()).cast("long")).alias("n_rounds"),
        F.max(F.coalesce(c("diagnosis") == "COLLECTION_FAILURE", F.lit(False))).alias("uncollected"),
    )
    sets = F.array(*[F.lit(r["set_id"]) for r in few(frozen.select("set_id").distinct()).orderBy("set_id").collect()]).cast("array<string>")
    run = reruns.groupBy("proposal").agg(F.collect_set("set_id").alias("run"))
    rows = proposals.join(support, "proposal", "left").join(run, "proposal", "left")
    rows = rows.withColumns({"n_examples": F.coalesce("n_examples", F.lit(0)), "n_rounds": F.coalesce("n_rounds", F.lit(0)), "missing": F.array_except(sets, F.coalesce("run", F.array().cast("array<string>")))})
    tests = [
        (f"fewer than {MIN_SUPPORT} examples", c("n_examples") >= MIN_SUPPORT), ("one round only", c("n_rounds") >= 2),
        ("weights may not change for a collection failure", ~(F.coalesce("changes_weights", F.lit(False)) & F.coalesce("uncollected", F.lit(False)))),
        ("no version bump", F.coalesce((c("new_version") != "") & ~c("new_version").eqNullSafe(c("current_version")), F.lit(False))), ("no regression tests", F.coalesce(c("n_tests") > 0, F.lit(False))),
        ("reruns missing", F.size("missing") == 0), ("a job is live", F.lit(not live_job)),
    ]
    rows = rows.withColumn("problems", F.array_compact(F.array(*[F.when(~good, F.lit(name)) for name, good in tests])))
    return rows.select("proposal", "n_examples", "n_rounds", "missing", "problems", (F.size("problems") == 0).alias("accepted"))
