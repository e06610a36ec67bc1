"""The corpus pipeline: toxic documents go, near duplicates and contaminated documents go, sources are mixed, tokens are written.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lanternfish.llm import decontamination, mixing, neardup, tokens, toxicity
from lanternfish.llm.common import new_path, read, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled ones doesn't reject."""
    return toxicity.fit(docs, read(spark, sf_dir, "labels")).kept(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of least doc_id."""
    return neardup.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def with_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; documents of later epochs are rows of their own."""
    return mixing.mixed_documents(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the token files."""
    path = new_path(spark, "tokens")
    tokens.write(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    rows = tokens.with_starts(tokens.checksums(spark, path), spark, path)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_neardup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", with_target_weights),
    ("token_output", as_tokens),
]

#: Toxicity and tokens are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
