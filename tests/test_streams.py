"""The queue and the pace of a job as streams with typed state, against their batch forms, for any cut into micro-batches."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lanternfish.operators import interactions as it
from lanternfish.operators import ledger
from lanternfish.operators import scouting as batch
from lanternfish.streaming import queue

ROWS = "seq long, handle string, kind string, post string, ts timestamp, solicits boolean, triggers array<string>"
AT = datetime.datetime(2024, 1, 20)


def interactions(seed, number=120):
    rng = random.Random(seed)
    rows = []
    for seq in range(number):
        solicits = rng.random() < 0.05
        rows.append((seq, rng.choice(["@A", "a", "b", "C", "d", "e"]), rng.choice(it.KINDS), rng.choice([None, "p1", "p2", "p3", "p4"]), AT + datetime.timedelta(minutes=rng.randint(0, 9_000)), solicits, ["suspicious solicitation begins"] if solicits else []))
    return rows


def run(spark, frames, folder, made):
    """The output of a stream that gets the frames one after another, each as a micro-batch of a new start from one checkpoint."""
    schema = frames[0].schema
    for n, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        query = made(stream).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
        assert query.awaitTermination(120) and query.exception() is None
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("cuts", [[120], [1, 30, 31, 120]])
def test_queue_equals_batch(spark, tmp_path, cuts):
    rows = interactions(len(cuts))
    cache = spark.createDataFrame([("A", AT, None, None), ("b", None, AT, "LOW"), ("c", AT - datetime.timedelta(days=90), AT, "HIGH")], "handle string, last_full_audit timestamp, last_light_check timestamp, risk string")
    opened = spark.createDataFrame([("D", "LIGHT_CHECK", "HIGH")], "handle string, level string, priority string")
    settings = batch.Settings(likes=False)
    frames = [spark.createDataFrame(rows[a:b], ROWS) for a, b in zip([0, *cuts], cuts)]
    got = run(spark, frames, str(tmp_path), lambda s: queue.arrivals(s, cache, opened, settings))
    want = batch.arrivals(spark.createDataFrame(rows, ROWS), cache, opened, settings)
    assert sorted(map(tuple, got.select("seq", "handle", "result", "level").collect())) == sorted(map(tuple, want.collect()))
    entries = {r["key"]: r for r in queue.open_entries(spark, f"{tmp_path}/check").collect()}
    queued = {batch_key(r["handle"]) for r in want.where("result not in ('HISTORY_UPDATED', 'IGNORED')").collect()}
    assert queued <= set(entries) <= queued | {"d"}
    assert queue.state(spark, f"{tmp_path}/check", "kinds").count() > 10


def batch_key(handle):
    return handle.lstrip("@").lower()


def test_queue_without_a_cache(spark, tmp_path):
    """With nothing known every arrival is queued or merged, and the entries are those of the batch queue."""
    rows = [(a, b.lstrip("@").lower(), *rest) for a, b, *rest in interactions(9)]
    frames = [spark.createDataFrame(rows[a : a + 40], ROWS) for a in (0, 40, 80)]
    got = run(spark, frames, str(tmp_path), queue.arrivals)
    ranked = it.priority(it.running(spark.createDataFrame(rows, ROWS))).withColumn("level", it.level(F.col("kind"), F.col("solicits"), F.size("triggers") > 0))
    assert {r["seq"]: r["priority"] for r in got.collect()} == {r["seq"]: r["priority"] for r in ranked.collect()}
    columns = ["level", "priority", "source_kind", "first_seen", "n_interactions"]
    own = queue.open_entries(spark, f"{tmp_path}/check").select("key", *columns).collect()
    assert sorted(map(tuple, own)) == sorted(map(tuple, it.queue(ranked).select("handle", *columns).collect()))


class Held:
    """A state variable of one key that counts how often the machine calls it."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def _call(self, name, value=None):
        self.calls.append(name)
        self.held = self.held if value is None else value
        return self.held

    def __getattr__(self, name):
        return {"get": lambda: self._call(name), "update": lambda v: self._call(name, v), "put": lambda v: self._call(name, v)}[name]


class Several(Held):
    def __getattr__(self, name):
        return (lambda: iter(self._call(name) or ())) if name == "get" else super().__getattr__(name)


class States:
    """What a machine's init() is given."""

    def __init__(self):
        self.calls = []

    def getValueState(self, name, schema):  # noqa: N802
        return Held(self.calls)

    def getListState(self, name, schema):  # noqa: N802
        return Several(self.calls)


@pytest.mark.parametrize("number", [1, 50, 2_500])
def test_calls_of_the_state_are_few_for_any_number_of_rows(number):
    """Each is a round trip to the JVM; there were two for each post of an account."""
    machine, states = queue.QueueMachine(batch.Settings()), States()
    machine.init(states)
    rows = [(("a", n, "@A", "LIKE", f"p{n}", n, 1)) for n in reversed(range(number))]
    for _ in range(2):
        out = list(machine.handleInputRows(("a",), iter(rows), None))
        assert [n for made in out for n in made.seq] == list(range(number)) and len(out) == -(-number // queue.CHUNK)
        assert len(states.calls) <= 7
        states.calls.clear()
    assert machine.posts.held == ([f"p{n}" for n in range(min(number, queue.POSTS_ASKED))],)
    assert machine.kinds.held == [("LIKE", 2 * number)] and machine.entry.held[4] == 2 * number


def test_an_account_of_many_rows_and_rows_without_time_or_kind(spark, tmp_path):
    """One account's rows are more than are given at once; rows of others have no time or no kind. The state keeps three posts of many."""
    many = [(n, "@A", it.KINDS[n % 8], f"p{n % 700}", AT + datetime.timedelta(minutes=n), n % 97 == 0, []) for n in range(2_300)]
    odd = [(3_000, "b", "LIKE", None, None, False, []), (3_001, "b", None, "p1", AT, None, None), (3_002, "c", None, "p1", datetime.datetime(1970, 1, 1), False, []), (3_003, "c", "LIKE", "p1", AT, False, []), (3_004, "e", "LIKE", "p", None, False, []), (3_005, "d", None, None, AT, False, [])]
    cache = spark.createDataFrame([("b", AT, None, None), ("E", AT, AT, "LOW")], "handle string, last_full_audit timestamp, last_light_check timestamp, risk string")
    opened = spark.createDataFrame([], "handle string, level string, priority string")
    rows = spark.createDataFrame(many + odd, ROWS)
    got = run(spark, [rows], str(tmp_path), lambda s: queue.arrivals(s, cache, opened)).select("seq", "handle", "result", "level", "priority").collect()
    want = batch.arrivals(rows.fillna(False, ["solicits"]).withColumn("triggers", F.coalesce("triggers", F.array().cast("array<string>"))), cache, opened)
    assert sorted(tuple(r)[:4] for r in got) == sorted(map(tuple, want.collect())) and len(got) == 2_306
    ranked = it.priority(it.running(rows.fillna(False, ["solicits"])))
    assert {r["seq"]: r["priority"] for r in got} == {r["seq"]: r["priority"] for r in ranked.collect()}
    entries = {r["key"]: r for r in queue.open_entries(spark, f"{tmp_path}/check").collect()}
    assert entries["a"]["n_interactions"] == 2_300 and entries["a"]["first_seen"] == AT and entries["c"]["first_seen"] == datetime.datetime(1970, 1, 1)
    posts = queue.state(spark, f"{tmp_path}/check", "posts").select("key.key", "value.first").collect()
    assert {r["key"]: r["first"] for r in posts} == {"a": ["p0", "p1", "p2"], "b": ["p1"], "c": ["p1"], "e": ["p"]}


def test_a_stream_of_which_only_the_state_is_asked(spark, tmp_path):
    """Its rows are not written, and the state is the same."""
    spark.createDataFrame(interactions(4), ROWS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
    whole, one = queue.run_once(stream(), queue.arrivals)
    none, other = queue.run_once(stream(), queue.arrivals, kept=False)
    assert whole.count() == 120 and none is None and not Path(other).with_name("out").exists()
    assert sorted(map(str, queue.open_entries(spark, one).collect())) == sorted(map(str, queue.open_entries(spark, other).collect()))


@pytest.mark.parametrize("cuts", [[90], [20, 21, 60, 90]])
def test_pace_equals_batch(spark, tmp_path, cuts):
    rng = random.Random(5)
    rows = []
    for n in range(90):
        at = AT + datetime.timedelta(minutes=n * 37, microseconds=rng.randint(0, 999_999))
        job = rng.randint(1, 3)
        if rng.random() < 0.5:
            rows.append((job, at, None, None, None))
        else:
            rows.append((job, at, n, at - datetime.timedelta(minutes=rng.choice([4, 40])) if n % 3 else None, at + datetime.timedelta(hours=rng.choice([-2, 2])) if n % 7 == 0 else None))
    schema = "job long, at timestamp, id long, last_ingest timestamp, backoff_until timestamp"
    frames = [spark.createDataFrame(rows[a:b], schema) for a, b in zip([0, *cuts], cuts)]
    frames.append(spark.createDataFrame([(99, AT + datetime.timedelta(days=60), None, None, None)], schema))
    got = run(spark, frames, str(tmp_path), queue.paced).collect()
    every = spark.createDataFrame(rows, schema)
    moments = every.where("id is not null").select("job", F.col("at").alias("moment"), "last_ingest", "backoff_until")
    batches = every.where("id is null").select("job", F.col("at").alias("planned_at"), F.lit(0).alias("batch"))
    want = ledger.may_start(moments, batches).collect()
    assert sorted(((r["job"], r["moment"], r["wait"], r["earliest"]) for r in got), key=lambda r: r[:2]) == sorted(((r["job"], r["moment"], r["wait"], r["earliest"]) for r in want), key=lambda r: r[:2])
    assert {r["wait"] for r in want} >= {None, "BACKOFF", "PAUSE"}
    left = queue.state(spark, f"{tmp_path}/check", "batches")
    assert left.where("key.job <> 99").count() == 0
