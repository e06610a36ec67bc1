"""The feature registry as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanternfish import config


def features(spark: SparkSession) -> DataFrame:
    """One row per feature of the registry."""
    rows = [(f.feature_id, f.category, f.per_extra, f.cap, f.strength, f.corroborated, f.corroborated_score, f.can_block, f.fact_group, f.min_count) for f in config.FEATURES]
    return spark.createDataFrame(
        rows, "feature_id string, category string, per_extra int, cap int, strength string, corroborated boolean, corroborated_score string, can_block boolean, fact_group string, min_count int"
    )


def weights(spark: SparkSession) -> DataFrame:
    """One row per feature and score: the base weight."""
    return spark.createDataFrame([(f.feature_id, s, w) for f in config.FEATURES for s, w in f.weights.items()], "feature_id string, score string, base int")


def features_sql() -> str:
    """The registry as a VALUES list for other engines."""
    text = lambda v: "null" if v is None else f"'{v}'"
    rows = [f"('{f.feature_id}', '{f.category}', {f.per_extra}, {f.cap}, '{f.strength}', {f.corroborated}, {text(f.corroborated_score)}, {f.can_block}, '{f.fact_group}', {f.min_count})" for f in config.FEATURES]
    return f"(values {', '.join(rows)}) r(feature_id, category, per_extra, cap, strength, corroborated, corroborated_score, can_block, fact_group, min_count)"


def weights_sql() -> str:
    rows = [f"('{f.feature_id}', '{s}', {w})" for f in config.FEATURES for s, w in f.weights.items()]
    return f"(values {', '.join(rows)}) w(feature_id, score, base)"
