"""The scouting stream: micro-batches with event-time marks, exact dedup and keyed history.

Each micro-batch drops rows not after their source's mark as of its start, which all rows taken before are, appends the others
and moves the marks. A batch that is replayed, after a failure or by hand, changes nothing. History is
kept as appended rows and read as an aggregate, or as keyed state by streaming.queue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.operators import interactions as it

SCHEMA = "seq long, handle string, kind string, post string, ts timestamp, solicits boolean"
MARKS = "source string, mark timestamp"


class Scout:
    """A folder with the appended interactions and, beside them, the marks that each batch reached."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str, schema: str) -> DataFrame:
        rows = self.spark.read.schema(schema + ", batch long").option("recursiveFileLookup", True)
        try:
            return rows.parquet(f"{self.folder}/{name}")
        except Exception as e:  # the folder comes with the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema + ", batch long")

    def accepted(self) -> DataFrame:
        """All interactions taken so far."""
        return self._table("rows", SCHEMA)

    def marks(self, before: int | None = None) -> DataFrame:
        """The newest time of each source, after all batches or before one: a few rows per batch, never the interactions themselves."""
        rows = self._table("marks", MARKS)
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows.groupBy("source").agg(F.max("mark").alias("mark"))

    def ingest(self, rows: DataFrame, batch: int) -> None:
        """Take one micro-batch, whose number is above those before; running it again, also with the same number, has no effect.

        An interaction that was taken before is not after its source's mark, so the marks tell late and repeated rows alike,
        and no batch reads what earlier ones took. Rows without a time are rejected before.
        """
        fresh = it.split_late(rows.where("ts is not null"), self.marks(before=batch)).where("not late").select(*rows.columns)
        mine = f"batch={batch}-rows"
        it.first_seen(fresh).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/rows/{mine}")
        taken = self.accepted().where(F.col("batch") == batch).withColumn("source", it.marker(F.col("kind")))
        reached = taken.groupBy("source").agg(F.max("ts").alias("mark")).withColumn("batch", F.lit(batch).cast("long"))
        reached.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks/{mine}")

    def start(self, stream: DataFrame, checkpoint: str):
        """Take a stream of SCHEMA rows; returns the streaming query."""
        return stream.writeStream.foreachBatch(lambda df, n: self.ingest(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of distinct interactions per window and kind, with a watermark."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(list(it.KEY))
    return rows.groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"))

