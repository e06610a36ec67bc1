"""The interaction queue and the pace of a job as state machines of a stream, with typed state by key on RocksDB.

A micro-batch reads and writes only the keys that it touches. The queue keeps of an account its cache, open entry, kinds with
their numbers and first posts; a history keeps all posts, as a map looked up by key; a job's batches leave its state by
event-time timers. The rows of one key in one micro-batch are put in order in memory; a trigger's maxFilesPerTrigger bounds them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lanternfish.operators.jobs import handle_key
from lanternfish.operators.ledger import BATCHES_A_DAY, PAUSE_MINUTES
from lanternfish.operators.scouting import LEVELS, Settings
from lanternfish.sources.shared import shared_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PRIORITIES = ("LOW", "NORMAL", "HIGH")
#: Instants are microseconds since 1970 inside the machines.
CACHE = "last_full_audit long, last_light_check long, risk string"
ENTRY = "level string, priority string, source_kind string, first_seen long, n_interactions long, opened long"
#: Results go by the column, at most CHUNK of a key in a row: a row by itself costs the worker much more.
ARRIVALS = "seq array<long>, handle array<string>, result array<string>, level array<string>, priority array<string>"
RESULTS = Row("seq", "handle", "result", "level", "priority")
CHUNK = 1_000
#: What an interaction tells by itself, as one number: its level, whether there is a trigger, whether its priority is HIGH anyway.
MARKS = [(level, told, urgent) for urgent in (False, True) for told in (False, True) for level in LEVELS]
#: Posts that a priority asks for: from the third on, more change nothing.
POSTS_ASKED = 3
ANSWERS = "job long, id long, moment long, wait string, earliest long"
DAY_US, DAY_MS = 86_400_000_000, 86_400_000


def on_rocks(spark: SparkSession) -> None:
    """Have the session's streams keep their state in RocksDB, which this state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class QueueMachine(StatefulProcessor):
    """What each accepted interaction does to its account's history and open entry.

    A call of the state is a round trip to the JVM, which takes as long as many rows do. So their number for a key in a
    micro-batch is fixed: entry, kinds and posts are read and written whole, and of posts only the first POSTS_ASKED are kept.
    """

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle) -> None:
        self.cache = handle.getValueState("cache", CACHE)
        self.entry = handle.getValueState("entry", ENTRY)
        self.kinds = handle.getListState("kinds", "kind string, n long")
        self.posts = handle.getValueState("posts", "first array<string>")

    def handleInitialState(self, key, row, timerValues) -> None:
        self.cache.update((row.last_full_audit, row.last_light_check, row.risk))
        if row.open_level is not None:
            self.entry.update((row.open_level, row.open_priority, None, None, 0, None))

    def _recent(self, cache, at: int) -> bool:
        within = lambda then, days: None not in (then, at) and abs(at - then) <= days * DAY_US
        return cache is not None and (within(cache[0], self.settings.full_days) or cache[2] == "LOW" and within(cache[1], self.settings.light_days))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        entry = self.entry.get()
        cache = self.cache.get() if entry is None else None
        entry = entry and list(entry)
        kinds, posts = dict(self.kinds.get()), list((self.posts.get() or ([],))[0])
        met, out = len(posts), []
        # By place: a field of a Row is sought by its name each time.
        for _, seq, handle, kind, post, ts, mark in sorted(rows, key=itemgetter(1)):
            level, told, urgent = MARKS[mark]
            if kind is not None:
                kinds[kind] = kinds.get(kind, 0) + 1
            if len(posts) < POSTS_ASKED and post is not None and post not in posts:
                posts.append(post)
            if urgent or len(kinds) >= 2 and ("NEW_FOLLOW" in kinds or len(posts) >= POSTS_ASKED):
                priority = "HIGH"
            else:
                priority = "NORMAL" if "NEW_FOLLOW" in kinds or "REPLY" in kinds or kinds.get("LIKE", 0) + kinds.get("REPOST", 0) >= 2 else "LOW"
            if entry is None and not told and self._recent(cache, ts):
                result = "HISTORY_UPDATED"
            elif entry is None and level == "OFF":
                result = "IGNORED"
            elif entry is None:
                result, entry = "QUEUED", [level, priority, kind, ts, 1, seq]
            else:
                result = "MERGED_INTO_OPEN_ENTRY"
                if level != entry[0] and LEVELS.index(level) > LEVELS.index(entry[0]):
                    result, entry[0] = "MERGED_AND_ESCALATED", level
                if priority != entry[1] and PRIORITIES.index(priority) > PRIORITIES.index(entry[1]):
                    entry[1] = priority
                entry[2] = entry[2] or kind
                if entry[3] is None or ts is not None and ts < entry[3]:
                    entry[3] = ts
                entry[4] += 1
                if entry[5] is None:
                    entry[5] = seq
            out.append((seq, handle, result, level, priority))
            if len(out) == CHUNK:
                yield RESULTS(*zip(*out))
                out = []
        if out:
            yield RESULTS(*zip(*out))
        if kinds:
            self.kinds.put(list(kinds.items()))
        if len(posts) > met:
            self.posts.update((posts,))
        if entry is not None:
            self.entry.update(tuple(entry))


def arrivals(stream: DataFrame, cache: DataFrame | None = None, queue: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """seq, handle, result, level and priority of each interaction of a stream (seq, handle, kind, post, ts, solicits, triggers).

    cache (handle, last_full_audit, last_light_check, risk) and queue (handle, level, priority of open entries), if given, are
    the state that the stream starts with; later starts from the same checkpoint go on with its own. However the rows are cut
    into micro-batches in the order of seq, the results are those of operators.scouting.arrivals over all of them.
    """
    on_rocks(stream.sparkSession)
    network = F.coalesce("network_match", F.lit(False)) if "network_match" in stream.columns else F.lit(False)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    kind, solicits, told = F.col("kind"), F.coalesce("solicits", F.lit(False)), F.coalesce(F.size("triggers") > 0, F.lit(False))
    urgent = F.coalesce(kind.isin("QUOTE_POST", "MENTION", "TAG"), F.lit(False)) | solicits | network
    level = F.when(told, "FULL_AUDIT").otherwise(settings.level(kind, solicits))
    mark = F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1 + told.cast("int") * len(LEVELS) + urgent.cast("int") * 2 * len(LEVELS)
    rows = stream.select(handle_key(F.col("handle")).alias("key"), "seq", "handle", "kind", "post", micros("ts").alias("ts"), mark.cast("int").alias("mark"))
    start = None
    if cache is not None or queue is not None:
        spark = stream.sparkSession
        cache = cache if cache is not None else spark.createDataFrame([], "handle string, last_full_audit timestamp, last_light_check timestamp, risk string")
        queue = queue if queue is not None else spark.createDataFrame([], "handle string, level string, priority string")
        known = cache.groupBy(handle_key(F.col("handle")).alias("key")).agg(*(F.max(micros(n)).alias(n) for n in ("last_full_audit", "last_light_check")), F.max("risk").alias("risk"))
        opened = queue.groupBy(handle_key(F.col("handle")).alias("key")).agg(F.max(F.struct(F.col("level") == "FULL_AUDIT", "level", "priority")).alias("x"))
        start = known.join(opened, "key", "full").select("key", "last_full_audit", "last_light_check", "risk", F.col("x.level").alias("open_level"), F.col("x.priority").alias("open_priority")).groupBy("key")
    made = rows.groupBy("key").transformWithState(QueueMachine(settings), ARRIVALS, "Append", "None", start)
    return made.select(F.inline(F.arrays_zip(*made.columns)))


def state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A state variable of the stream with that checkpoint after its last micro-batch: key and value, or key and an entry of the map or list."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def open_entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The queue of a stream of arrivals(): key and the open entry of each account, read back from its state."""
    return state(spark, checkpoint, "entry").select("key.key", "value.*").withColumn("first_seen", F.timestamp_micros("first_seen"))


#: Times that an account's burst is counted on.
TIMES_KEPT = 200
HISTORY = "handle string, n long, by_kind string, diversity long, n_posts long, burst long, last_us long"


def _burst(times: list[int]) -> int:
    """The most of the ascending times within any 24 hours."""
    most, first = 0, 0
    for last, t in enumerate(times):
        while t - times[first] > DAY_US:
            first += 1
        most = max(most, last - first + 1)
    return most


class HistoryMachine(StatefulProcessor):
    """An account's history: counts by kind, the posts it touched, and its latest distinct times."""

    def init(self, handle) -> None:
        self.kinds = handle.getMapState("kinds", "kind string", "n long")
        self.posts = handle.getMapState("posts", "post string", "seq long")
        self.times = handle.getListState("times", "at long")
        self.totals = handle.getValueState("totals", "posts long, newest long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kinds = {k[0]: v[0] for k, v in self.kinds.iterator()}
        posts, newest = self.totals.get() if self.totals.exists() else (0, 0)
        before, times, met = dict(kinds), {t[0] for t in self.times.get()} if self.times.exists() else set(), set()
        for row in rows:
            kinds[row.kind] = kinds.get(row.kind, 0) + 1
            times.add(row.at)
            newest = max(newest, row.at)
            if len(times) > 4 * TIMES_KEPT:
                times = set(sorted(times)[-TIMES_KEPT:])
            if row.post is not None and row.post not in met:
                met.add(row.post)
                if not self.posts.containsKey((row.post,)):
                    self.posts.updateValue((row.post,), (row.seq,))
                    posts += 1
        for kind, n in kinds.items():
            if before.get(kind) != n:
                self.kinds.updateValue((kind,), (n,))
        latest = sorted(times)[-TIMES_KEPT:]
        self.times.put([(t,) for t in latest])
        self.totals.update((posts, newest))
        counts = json.dumps(kinds, sort_keys=True)
        yield Row(handle=key[0], n=sum(kinds.values()), by_kind=counts, diversity=len(kinds), n_posts=posts, burst=_burst(latest), last_us=newest)


def histories(stream: DataFrame) -> DataFrame:
    """Per account, after each micro-batch that touches it: interactions, counts by kind, diversity, posts, burst and latest time so far."""
    on_rocks(stream.sparkSession)
    rows = stream.select("handle", "seq", "kind", "post", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("handle").transformWithState(HistoryMachine(), HISTORY, "Update", "None")


class PaceMachine(StatefulProcessor):
    """Whether a job may plan a batch at a moment, told when the watermark has reached it, so that no batch before is missing."""

    def init(self, handle) -> None:
        self.handle = handle
        self.batches = handle.getMapState("batches", "planned long", "n long")
        self.asked = handle.getMapState("asked", "due long, id long", "moment long, last_ingest long, backoff_until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            due = -(-row.at // 1_000)
            if row.id is None:
                held = self.batches.getValue((row.at,))[0] if self.batches.containsKey((row.at,)) else 0
                self.batches.updateValue((row.at,), (held + 1,))
                self.handle.registerTimer(due + DAY_MS + 1)
            else:
                self.asked.updateValue((due, row.id), (row.at, row.last_ingest, row.backoff_until))
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((tuple(k), tuple(v)) for k, v in self.asked.iterator() if k[0] <= now)
        planned = sorted((k[0], v[0]) for k, v in self.batches.iterator())
        for asked, (moment, last_ingest, backoff_until) in due:
            self.asked.removeKey(asked)
            day = [(t, n) for t, n in planned if moment - DAY_US < t <= moment]
            wait = earliest = None
            if backoff_until is not None and moment < backoff_until:
                wait, earliest = "BACKOFF", backoff_until
            elif last_ingest is not None and moment < last_ingest + PAUSE_MINUTES * 60_000_000:
                wait, earliest = "PAUSE", last_ingest + PAUSE_MINUTES * 60_000_000
            elif sum(n for _, n in day) >= BATCHES_A_DAY:
                wait, earliest = "DAILY_LIMIT", day[0][0] + DAY_US
            yield Row(job=key[0], id=asked[1], moment=moment, wait=wait, earliest=earliest)
        for t, _ in planned:
            if -(-t // 1_000) + DAY_MS + 1 <= now:
                self.batches.removeKey((t,))


def paced(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """job, id, moment, wait and earliest of each moment of a stream, as operators.ledger.may_start has them.

    stream: job, at, id (of a moment; null for a planned batch), last_ingest, backoff_until. Moments are answered when the
    watermark, `late` behind the newest time, has passed them; rows behind it are dropped. A job's batches are kept for the
    24 hours in which they count.
    """
    on_rocks(stream.sparkSession)
    rows = stream.withColumn("clock", F.col("at").cast("timestamp")).withWatermark("clock", late)
    rows = rows.select("job", "clock", "id", *(F.unix_micros(F.col(n).cast("timestamp")).alias(n) for n in ("at", "last_ingest", "backoff_until")))
    out = rows.groupBy("job").transformWithState(PaceMachine(), ANSWERS, "Append", "EventTime")
    return out.withColumns({n: F.timestamp_micros(n) for n in ("moment", "earliest")})


def run_once(stream: DataFrame, made: Callable[[DataFrame], DataFrame], kept: bool = True) -> tuple[DataFrame | None, str]:
    """The rows that a stream gives until its source is read to the end, and its checkpoint, both in the shared folder.

    Without kept no rows are written or returned, for streams of which only the state is asked.
    """
    spark = stream.sparkSession
    folder = shared_path(spark, "stream")
    out = made(stream)
    writer = out.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True)
    (writer.format("parquet").option("path", f"{folder}/out") if kept else writer.format("noop")).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out") if kept else None, f"{folder}/check"
