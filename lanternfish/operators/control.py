"""A run's control document: discovery, what is done, pauses; version stamps; and the texts that an owner reads.

The document is one small JSON object per instance; it is replaced whole, and instances never share one.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.operators.jobs import handle_key
from lanternfish.operators.reports import shortened

ENGINE_VERSION = "1.1.0"


def registry_stamp() -> str:
    """A hash of the feature registry, which changes with any of its values."""
    rows = [asdict(f) for f in config.FEATURES]
    return hashlib.sha256(json.dumps(rows, sort_keys=True).encode()).hexdigest()[:16]


def stamps(**more: str) -> dict[str, str]:
    """The versions that rows of the audit log bear."""
    return {"ENGINE_VERSION": ENGINE_VERSION, "REGISTRY_SHA256": registry_stamp(), **more}


@dataclass(frozen=True)
class Control:
    """One instance's run: who it is for, in which mode, what was found and done, and whether it is paused."""

    instance: str
    mode: str
    order: tuple[str, ...] = ()
    complete: bool = False
    done: tuple[str, ...] = ()
    waiting: tuple[str, ...] = ()
    paused: str | None = None

    def discovered(self, handles: list[str], complete: bool) -> Control:
        """New handles behind those known, each once."""
        return replace(self, order=tuple(dict.fromkeys((*self.order, *handles))), complete=complete)

    def batch(self, n: int) -> list[str]:
        """The first n handles that aren't done; none while the run is paused."""
        done = set(self.done)
        return [] if self.paused else [h for h in self.order if h not in done][: max(0, n)]

    def marked(self, handle: str, needs_owner: bool = False) -> Control:
        """The handle is done; it waits for the owner or no longer does."""
        return self.all_marked([handle], [handle] if needs_owner else [])

    def all_marked(self, handles: list[str], needs_owner: list[str] = ()) -> Control:
        """A batch of handles is done at once; of these, some wait for the owner."""
        mine = set(handles)
        waiting = (*(h for h in self.waiting if h not in mine), *dict.fromkeys(needs_owner))
        return replace(self, done=tuple(dict.fromkeys((*self.done, *handles))), waiting=waiting)

    def stopped(self, reason: str | None) -> Control:
        """Paused for a reason, or running again."""
        return replace(self, paused=reason)

    def save(self, spark: SparkSession, path: str) -> None:
        """Replace the document: it is written beside and then renamed over the old one in one step, so that a reader, or a run after a crash, meets one or the other."""
        hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
        place = hadoop.fs.Path(path)
        beside = place.suffix(".new")
        out = place.getFileSystem(conf).create(beside, True)
        out.write(bytearray(json.dumps(asdict(self), ensure_ascii=False).encode()))
        out.close()
        over = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
        over[0] = getattr(hadoop.fs.Options, "Rename").OVERWRITE
        qualified = lambda p: p.getFileSystem(conf).makeQualified(p)
        hadoop.fs.FileContext.getFileContext(qualified(place).toUri(), conf).rename(qualified(beside), qualified(place), over)

    @classmethod
    def load(cls, spark: SparkSession, path: str, instance: str) -> Control | None:
        """The document, null if there is none; another instance's raises."""
        from lanternfish.sources.stores import exists

        if not exists(spark, path):
            return None
        values = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        known = {f: values[f] for f in cls.__dataclass_fields__ if f in values}
        if known["instance"] != instance:
            raise PermissionError(f"the run belongs to {known['instance']}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})


def resumable(runs: DataFrame, instance: str) -> DataFrame:
    """run_id, started_at, done, total of the instance's unfinished runs (instance, run_id, started_at, finished_at, done, total), newest first."""
    return runs.where((F.col("instance") == instance) & F.col("finished_at").isNull()).select("run_id", "started_at", "done", "total").orderBy(F.desc("started_at"), "run_id")


def review_card(handle: Column, enforcement: Column, label: Column, reason: Column) -> Column:
    """What an owner sees of a flagged account."""
    return F.concat(F.lit("@"), handle_key(handle), F.lit("\n"), enforcement, F.lit(" ("), label, F.lit(")\nWhy: "), shortened(reason), F.lit("\nKEEP   BLOCK   MORE DETAILS"))


def progress(states: DataFrame, total: int) -> DataFrame:
    """One row, text: how far a run is and what it found."""
    counts = states.agg(F.count("*").alias("n"), *[F.count_if(F.col("enforcement") == e).alias(e) for e in ("KEEP", "REVIEW", "BLOCK_CANDIDATE", "BLOCK_CONFIRMED")])
    return counts.select(F.format_string(f"%d of {total} checked: %d keep, %d review, %d candidates, %d confirmed", "n", "KEEP", "REVIEW", "BLOCK_CANDIDATE", "BLOCK_CONFIRMED").alias("text"))


def daily_summary(blocks: DataFrame, since: Column) -> DataFrame:
    """text of what was blocked, failed or asked back since then (blocks: status, updated_at); no row where nothing happened."""
    recent = blocks.where(F.col("updated_at") > since).agg(*[F.count_if(F.col("status").isin(*s)).alias(n) for n, s in (("blocked", ("VERIFIED",)), ("failed", ("FAILED_RETRY",)), ("undone", ("UNBLOCK_REQUESTED", "UNBLOCKED")))])
    return recent.where("blocked + failed + undone > 0").select(F.format_string("%d blocked, %d to try again, %d to unblock", "blocked", "failed", "undone").alias("text"))
