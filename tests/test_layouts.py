"""Frozen sets, bucketed upserts, owners' tables and ISO instants."""

import datetime
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lanternfish.functions.instants import instant
from lanternfish.sources import layouts


def test_frozen_set_names_the_block_that_differs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layouts, "LEAF", 8)
    monkeypatch.setattr(layouts, "FAN", 4)
    rows = spark.range(300).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), "id")).alias("v"))
    rows = rows.unionByName(rows.where("id < 3"))
    path = str(tmp_path / "set")
    manifest = layouts.freeze(rows, path, "s1", ["a"])
    assert manifest["rows"] == 303 and layouts.load_frozen(spark, path)[1].count() == 303
    with pytest.raises(FileExistsError):
        layouts.freeze(rows, path, "s1")
    again = layouts.freeze(rows.orderBy(F.desc("id")), str(tmp_path / "other"), "s2")
    assert again["root"] == manifest["root"]
    base = rows.collect()
    for changed in (base[1:], base + [base[-1]], base[:5] + [(5, "other")] + base[6:], base + [(1_000, None)]):
        spark.createDataFrame(changed, rows.schema).write.mode("overwrite").parquet(f"{path}/rows")
        wrong = layouts.changed_blocks(spark, path).collect()
        assert 1 <= len(wrong) <= 2
        with pytest.raises(ValueError, match=str(min(r["block"] for r in wrong))):
            layouts.load_frozen(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    assert layouts.load_frozen(spark, path)[0] == manifest
    assert layouts.freeze(rows.limit(0), str(tmp_path / "none"), "s3")["root"] == ""


def test_upsert_touches_few_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2_000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    assert layouts.upsert(path, rows, "k") == list(range(256))
    times = lambda: {p.name: max(os.stat(f).st_mtime_ns for f in p.iterdir()) for p in Path(path).iterdir() if p.is_dir()}
    before = times()
    new = spark.range(10).select(F.concat(F.lit("k"), F.col("id") * 399).alias("k"), F.lit(-1).cast("long").alias("v"))
    touched = layouts.upsert(path, new, "k")
    after = times()
    assert len(touched) <= 10 and {f"bucket={b}" for b in touched} == {p for p in after if before.get(p) != after[p]}
    want = {f"k{i}": (-1 if i % 399 == 0 and i < 3_990 else i) for i in range(2_000)} | {f"k{i * 399}": -1 for i in range(10)}
    read = lambda: {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert read() == want and spark.read.parquet(path).count() == len(want)
    layouts.upsert(path, new.unionByName(new), "k")
    assert read() == want and spark.read.parquet(path).count() == len(want)


def test_an_instance_reads_its_own(spark, tmp_path):
    folder = str(tmp_path)
    mine, theirs = layouts.Instances(spark, folder, "@Ann"), layouts.Instances(spark, folder, "Bob!")
    mine.write("audits", spark.createDataFrame([(1, "a")], "id int, v string"))
    theirs.write("audits", spark.createDataFrame([(2, "b")], "id int, v string"))
    assert [r["id"] for r in mine.checked(mine.read("audits")).collect()] == [1]
    assert all("/instance=ann/" in f for f in mine.scanned(mine.read("audits"))) and len(mine.scanned(mine.read("audits"))) == 1
    joined = mine.read("audits").join(theirs.read("audits").select("id", F.col("v").alias("w")), "id", "full")
    with pytest.raises(PermissionError):
        mine.checked(joined)
    with pytest.raises(PermissionError):
        mine.checked(spark.read.parquet(f"{folder}/audits"))
    with pytest.raises(Exception, match="belongs to bob"):
        mine.write("audits", spark.createDataFrame([(3, "bob")], "id int, instance string"))


def test_slugs(spark):
    rows = spark.createDataFrame([("@Ann_1",), ("  @B.o-b ",), ("",), (None,), ("__é",), ("_template",), ("_Template2",)], "x string")
    assert [r[0] for r in rows.select(layouts.slug(F.col("x"))).collect()] == ["ann_1", "bob", "owner", "owner", "__", "x_template", "x_template2"]


def test_instants(spark):
    utc = datetime.timezone.utc
    texts = {
        "2024-05-06": (2024, 5, 6), "2024-05-06T07:08": (2024, 5, 6, 7, 8), "2024-05-06 07:08:09.5": (2024, 5, 6, 7, 8, 9, 500_000), "2024-05-06T07:08:09Z": (2024, 5, 6, 7, 8, 9),
        "2024-05-06T07:08:09.123456789+02:00": (2024, 5, 6, 5, 8, 9, 123_456), "2024-05-06T07:08:09-0330": (2024, 5, 6, 10, 38, 9), "2024-05-06T07+05": (2024, 5, 6, 2), " 2024-02-29T23:59:59,25+01 ": (2024, 2, 29, 22, 59, 59, 250_000),
        "2024-02-30": None, "2024-5-6": None, "yesterday": None, "": None, "2024-05-06T25:00": None, "2024": None, None: None, "12:30": None, "2024-05-06T07:08:09 UTC": None,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["us"] for r in rows.select("t", F.unix_micros(instant(F.col("t"))).alias("us")).collect()}
    micros = lambda v: None if v is None else (datetime.datetime(*v, tzinfo=utc) - datetime.datetime(1970, 1, 1, tzinfo=utc)) // datetime.timedelta(microseconds=1)
    assert got == {t: micros(v) for t, v in texts.items()}


def test_export_bundle(spark, tmp_path):
    from lanternfish.sources import sinks

    out = str(tmp_path / "export")
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "handle string, classes array<string>")
    sets = {name: rows.select("handle") if kind == "text" else rows for name, kind in sinks.DATASETS.items()}
    with pytest.raises(ValueError, match="metrics"):
        sinks.bundle({k: v for k, v in sets.items() if k != "metrics"}, out, {})
    manifest = sinks.bundle(sets, out, {"ENGINE": "1"}).collect()
    assert {r["dataset"] for r in manifest} == set(sinks.DATASETS) and {r["ENGINE"] for r in manifest} == {"1"}
    assert all(len(r["sha256"]) == 64 and r["bytes"] > 0 for r in manifest if r["dataset"] != "summary_report")
    assert sinks.changed_files(spark, out).count() == 0
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.bundle(sets, out, {})
    victim = next(f for f in Path(out, "metrics").glob("part-*") if f.stat().st_size)
    for crc in Path(out, "metrics").glob(".part-*.crc"):
        crc.unlink()
    victim.write_text('{"handle": "other"}\n')
    assert [r["dataset"] for r in sinks.changed_files(spark, out).collect()] == ["metrics"]
    victim.unlink()
    Path(out, "metrics", "part-new.json").write_text("{}\n")
    assert sorted(r["file"] for r in sinks.changed_files(spark, out).collect()) == sorted([victim.name, "part-new.json"])
