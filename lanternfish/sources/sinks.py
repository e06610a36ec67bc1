"""Result writers: flat audit rows, export bundles with a manifest, immutable sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flattened(states: DataFrame) -> DataFrame:
    """Array columns joined by |, map columns as the names that are true."""
    out = []
    for field in states.schema.fields:
        kind = field.dataType.typeName()
        if kind == "array":
            out.append(F.concat_ws("|", F.col(field.name).cast("array<string>")).alias(field.name))
        elif kind == "map":
            out.append(F.concat_ws("|", F.array_sort(F.map_keys(F.map_filter(field.name, lambda _, v: v)))).alias(field.name))
        else:
            out.append(F.col(field.name))
    return states.select(*out)


def export(datasets: dict[str, DataFrame], folder: str, versions: dict[str, str]) -> DataFrame:
    """Write each dataset as CSV with a header, and return the manifest: dataset, file, bytes and sha256 of each file, and versions.

    Hashes are of the files as they were written; nothing is computed twice and each file is read by one task.
    """
    out = None
    for name, df in datasets.items():
        spark, path = df.sparkSession, f"{folder}/{name}"
        flattened(df).write.mode("errorifexists").option("header", True).csv(path)
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
        rows = files.select(F.lit(name).alias("dataset"), F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumns({k: F.lit(v) for k, v in versions.items()})


def verified_export(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest's rows with same: whether the file still has its hash; a file that is gone has not."""
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    now = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.sha2("content", 256).alias("_now"))
    return manifest.join(now, "file", "left").withColumn("same", F.coalesce(F.col("_now") == F.col("sha256"), F.lit(False))).drop("_now")


#: The datasets of an export, and what they are written as.
DATASETS = {
    "full_account_audit": "csv", "full_account_state": "json", "owner_adjudications": "csv", "score_changes": "csv", "block_verification_log": "csv", "network_clusters": "json",
    "unresolved_cases": "csv", "evidence_coverage_stats": "json", "disagreement_cases": "csv", "calibration_updates": "json", "metrics": "json", "summary_report": "text",
}
#: Rows of a file of an export, which bounds what one task reads to hash it.
ROWS_A_FILE = 1_000_000


def _file_hashes(spark, folder: str, names: list[str]) -> DataFrame:
    """dataset, file, bytes and sha256 of each data file below the folder's datasets."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load([f"{folder}/{n}" for n in names])
    place = F.regexp_extract("path", "([^/]*)/([^/]*)$", 1)
    return files.select(place.alias("dataset"), F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def bundle(datasets: dict[str, DataFrame], folder: str, versions: dict[str, str]) -> DataFrame:
    """Write all DATASETS of an export, and last a manifest beside them: dataset, file, bytes, sha256 and versions.

    A dataset that is missing or unknown, and a folder that has an export, raise. summary_report is one text column. Files
    without a byte, which tasks without rows may leave, aren't in the manifest.
    """
    wrong = sorted(set(DATASETS) ^ set(datasets))
    if wrong:
        raise ValueError(f"missing or unknown datasets: {', '.join(wrong)}")
    for name, kind in DATASETS.items():
        rows = flattened(datasets[name]) if kind == "csv" else datasets[name]
        writer = rows.write.mode("errorifexists").option("maxRecordsPerFile", ROWS_A_FILE)
        (writer.option("header", True) if kind == "csv" else writer).format(kind).save(f"{folder}/{name}")
    spark = datasets["metrics"].sparkSession
    manifest = _file_hashes(spark, folder, list(DATASETS)).withColumns({k: F.lit(v) for k, v in versions.items()})
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).json(f"{folder}/manifest")


def changed_files(spark, folder: str) -> DataFrame:
    """dataset and file of a bundle that aren't as the manifest has them: changed, gone, or added since."""
    then = spark.read.schema("dataset string, file string, sha256 string").json(f"{folder}/manifest")
    now = _file_hashes(spark, folder, list(DATASETS)).select("dataset", "file", F.col("sha256").alias("now"))
    return then.join(now, ["dataset", "file"], "full").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("dataset", "file")


def audit_log(states: DataFrame, folder: str, header: dict[str, str]) -> None:
    """Write states as JSON lines of type account, and one of type run with the header's fields."""
    spark = states.sparkSession
    run = spark.range(1).select(F.to_json(F.struct(F.lit("run").alias("type"), *[F.lit(v).alias(k) for k, v in sorted(header.items())])).alias("value"))
    rows = states.select(F.to_json(F.struct(F.lit("account").alias("type"), *states.columns)).alias("value"))
    run.unionByName(rows).write.mode("errorifexists").text(folder)


def results(states: DataFrame, folder: str, columns: list[str]) -> None:
    """Write the named columns, and beside them all columns, as CSV with a header."""
    flat = flattened(states)
    flat.select(*columns).write.mode("errorifexists").option("header", True).csv(f"{folder}/results")
    flat.write.mode("errorifexists").option("header", True).csv(f"{folder}/results_full")


def model_files(model: dict, training: DataFrame, folder: str) -> None:
    """Write a fitted model as a JSON document and its training rows, which name it, as JSON lines."""
    import json

    spark = training.sparkSession
    text = json.dumps(model, ensure_ascii=False, sort_keys=True)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/model")
    training.withColumn("training_sha8", F.lit(model["training_sha8"])).write.mode("overwrite").json(f"{folder}/training")


def backtest_files(summary: DataFrame, flagged: DataFrame, folder: str, by: str = "tier") -> None:
    """Write a backtest's rows per tier as JSON, its flagged accounts as CSV, and a table of both to read as Markdown."""
    summary.write.mode("overwrite").json(f"{folder}/backtest")
    flagged.write.mode("overwrite").option("header", True).csv(f"{folder}/flagged")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("n/a")) for c in summary.columns]), F.lit(" |"))
    head = summary.sparkSession.createDataFrame([(0, "", "| " + " | ".join(summary.columns) + " |"), (1, "", "|" + "---|" * len(summary.columns))], "part int, key string, value string")
    rows = summary.select(F.lit(2).alias("part"), F.col(by).cast("string").alias("key"), line.alias("value"))
    head.unionByName(rows).orderBy("part", "key").select("value").coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")
