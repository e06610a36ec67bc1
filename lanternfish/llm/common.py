"""What the corpus operators share: words, shared work folders and size-checked broadcasts."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.sources.shared import shared_path

#: A word of lower-cased text: neither ASCII punctuation, nor white space, nor an ASCII control character.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same as a table for bytes.translate: A-Z lower-cased, what separates words made a space.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Most rows a side may have to be broadcast; larger sides are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Most bytes that it may have.
BROADCAST_BYTES = 64_000_000
#: Rows of a file of a table of short rows.
ROWS_A_FILE = 1_000_000
#: Bytes of text that a Python operator holds as arrays at a time.
RUN_BYTES = 1_000_000
#: Bytes of a batch of rows on its way to Python.
BATCH_BYTES = 8_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased and all other characters kept; lower() does that where no other character has, or in a newer Unicode may have, a lower case."""
    others = text.rlike(r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^A-Z]]")
    return F.when(others, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """The words of a text in order; none for a null. They are what stands between separators, as splitting is much cheaper than extracting."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def bounded_batches(spark: SparkSession) -> None:
    """Have rows go to Python in batches of BATCH_BYTES at most, however long the rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the folder that driver and executors share."""
    return shared_path(spark, name)


def written(df: DataFrame, name: str, rows: int | None = None, a_file: int = ROWS_A_FILE, **options: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage is cut and survives lost executors.

    Where a bound on the number of rows is known, there are no more files than rows / a_file ask for, so that a small table
    isn't hundreds of tiny files. That is for rows that come from a shuffle: the tasks behind it are as many as the files.
    """
    path = new_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // a_file)))
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the side has no more than so many rows, and no more than about so many bytes (of its columns as JSON)."""
    whole = F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("size")
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), whole).first()
    return seen["n"] <= rows and (seen["size"] or 0) <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if its rows and bytes are few, else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df, rows) else df


def text_runs(texts: pa.Array, most: int = 20_000, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `size` bytes of text, a longer text alone, and of `most` rows at most."""
    sizes = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, "right")))
        yield at, (upto := min(upto, at + most))
        at = upto
