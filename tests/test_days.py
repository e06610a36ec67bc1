"""Windows of 24 hours end at the microsecond."""

from pyspark.sql import functions as F

from lanternfish.operators import interactions as it
from lanternfish.operators import jobs

TIMES = ["2024-01-01 10:00:00.400000", "2024-01-02 10:00:00.300000", "2024-01-02 10:00:00.400000", "2024-01-02 10:00:00.400001"]


def test_pacing(spark):
    rows = spark.createDataFrame([("j", n, t) for n, t in enumerate(TIMES)], "job string, n int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r["n"]: r["in_day"] for r in jobs.pacing(rows).collect()} == {0: 1, 1: 2, 2: 3, 3: 3}


def test_bursts(spark):
    rows = spark.createDataFrame([("a", TIMES[0]), ("a", TIMES[2]), ("b", TIMES[0]), ("b", TIMES[3])], "handle string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r["handle"]: r["burst"] for r in it.bursts(rows).collect()} == {"a": 2, "b": 1}


def test_bursts_of_more_than_200_times(spark):
    """Old bursts count, however many times follow, across midnights and before 1970; repeated times count once."""
    import random

    rng, day = random.Random(5), 86_400_000_000
    times = {
        "old": [-3 * day + n for n in range(400)] * 2 + [n * day * 2 for n in range(1, 300)],
        "dense": [n * 60_000_000 for n in range(5_000)],
        **{f"r{i}": [rng.randrange(-3, 4) * day + rng.choice([0, 1, day - 1, rng.randrange(day)]) for _ in range(300)] for i in range(3)},
    }
    rows = spark.createDataFrame([(h, t) for h in times for t in times[h]], "handle string, at long").select("handle", F.timestamp_micros("at").alias("ts"))
    most = lambda ts: max(sum(t <= u <= t + day for u in ts) for t in ts)
    want = {h: most(set(ts)) for h, ts in times.items() if h != "dense"} | {"dense": 24 * 60 + 1}
    assert {r["handle"]: r["burst"] for r in it.bursts(rows).collect()} == want and want["old"] == 400


def test_stops_with_one_number_follow_arrival(spark):
    rows = spark.createDataFrame([("b", 1, 0, "x", None), ("b", 2, 2, "y", "STOP"), ("b", 2, 1, "z", "STOP"), ("b", 2, 3, "w", "STOP")], "batch string, seq int, arrival int, handle string, stop_reason string")
    assert {r["handle"] for r in jobs.until_stop(rows, "seq", "batch").collect()} == {"x", "z"}


def test_unblock_results_of_tied_lines(spark, tmp_path):
    """Every line stops, many have one number: the first of these in the file is all of a batch, in each run (SQL leaves open which it is)."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lanternfish.plans import catalog

    sf = "/root/testdata/sf0.001"
    line = pq.read_table(f"{sf}/lineitem.parquet")
    tied = line.set_column(line.column_names.index("l_orderkey"), "l_orderkey", pa.array([97 * (n // 1500) + 5 for n in range(len(line))], line.schema.field("l_orderkey").type))
    pq.write_table(tied, tmp_path / "lineitem.parquet")
    (tmp_path / "supplier.parquet").symlink_to(f"{sf}/supplier.parquet")
    want = {}
    for r in tied.select(["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"]).to_pylist():
        seq = r["l_orderkey"] * 10 + r["l_linenumber"]
        if r["l_suppkey"] not in want or seq < want[r["l_suppkey"]][0]:
            want[r["l_suppkey"]] = seq, f"acct{r['l_partkey'] % 1500 + 1}"
    got = catalog.queries()["unblock_results"](spark, str(tmp_path)).collect()
    assert {r["batch"]: (r["seq"], r["key"]) for r in got} == want and len(got) == len(want)
