"""Key floods, stall gaps (vs brute force), consumer lag, latest-N per key."""

from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from healthwatch.operators import security as sec
from healthwatch.operators import telemetry as tm
from healthwatch.sources import events as ev


def test_denylist_flood_threshold(spark):
    rows = [("PT-ATTACKER-0000",)] * 6 + [("PT-0001",)] * 40
    df = spark.createDataFrame(rows, "patient_id string")
    r = sec.denylist_flood(df).first()
    assert r["event_count"] == 6 and r["is_flood"]
    df5 = spark.createDataFrame([("PT-ATTACKER-0000",)] * 5, "patient_id string")
    assert not sec.denylist_flood(df5).first()["is_flood"]


def test_hot_key_with_a_third_of_rows(spark):
    rows = [("HOT",)] * 400 + [(f"K{i}",) for i in range(800)]
    r = {x["patient_id"]: x for x in sec.hot_keys(spark.createDataFrame(rows, "patient_id string")).collect()}
    assert r["HOT"]["is_hot"] and abs(r["HOT"]["share"] - 1 / 3) < 1e-4
    assert not r["K1"]["is_hot"]


def test_burst_windows(spark):
    t0 = datetime(2024, 1, 1, 0, 0, 0)
    rows = [("A", t0 + timedelta(milliseconds=40 * i)) for i in range(60)] + [("B", t0)]
    df = spark.createDataFrame(rows, "patient_id string, ts timestamp")
    r = {x["patient_id"]: x for x in sec.burst_rate(df).collect()}
    assert r["A"]["is_burst"] and r["A"]["max_events"] >= 50 and not r["B"]["is_burst"]


def _brute_gaps(ts, gap):
    ts = sorted(ts)
    return [(a, b) for a, b in zip(ts, ts[1:]) if (b - a).total_seconds() > gap]


def test_stall_gaps_match_brute_force(spark):
    t0 = datetime(2024, 1, 1)
    offs = [0, 10, 29.999, 59.999, 90, 120.000001, 150.000001, 400, 401, 431, 461.5, 10_000]
    ts = [t0 + timedelta(seconds=s) for s in offs]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp")
    got = sorted((r["gap_start"], r["gap_end"]) for r in tm.stall_gaps(df, 30).collect())
    assert got == _brute_gaps(ts, 30)


def test_stall_gaps_per_key(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0), ("a", t0 + timedelta(seconds=100)), ("b", t0 + timedelta(seconds=5)),
            ("b", t0 + timedelta(seconds=20))]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    got = tm.stall_gaps(df, 30, keys=["k"]).collect()
    assert [(r["k"], r["gap_seconds"]) for r in got] == [("a", 100.0)]


def test_empty_batches(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0,), (t0 + timedelta(seconds=95),)], "ts timestamp")
    assert tm.empty_batches(df, 30).count() == 2


def test_consumer_lag_rules(spark):
    rows = [("t", 0, 5, 10), ("t", 1, -1, 7), ("t", 2, -1, 0)]
    df = spark.createDataFrame(rows, "topic string, partition_id int, committed long, high long")
    assert tm.consumer_lag(df).first()["consumer_lag"] == 12


def test_latest_n_per_key_with_salt_matches_window(spark):
    rows = [("HOT", i) for i in range(3000)] + [(f"k{i % 7}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long")
    got = sorted(ev.latest_n(df, ["t"], 5, by=["k"], salt=8).collect())
    w = Window.partitionBy("k").orderBy(F.col("t").desc())
    ref = sorted(df.withColumn("r", F.row_number().over(w)).filter("r <= 5").drop("r").collect())
    assert got == ref


def test_stall_gaps_across_super_buckets(spark):
    t0 = datetime(2024, 1, 1)
    offs = [0, 50, 51, 300, 86390, 86410, 86500, 3 * 86400 + 7, 3 * 86400 + 20, 3 * 86400 + 95]
    ts = [t0 + timedelta(seconds=s) for s in offs]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp")
    for sup in (60, 3600, 86400):
        got = sorted((r["gap_start"], r["gap_end"]) for r in tm.stall_gaps(df, 30, super_seconds=sup).collect())
        assert got == _brute_gaps(ts, 30), sup


def test_burst_windows_equal_spark_sliding_windows(spark):
    import random
    rnd = random.Random(3)
    t0 = datetime(2024, 1, 1)
    rows = [(rnd.choice("ABC"), t0 + timedelta(milliseconds=rnd.randint(0, 20_000))) for _ in range(600)]
    df = spark.createDataFrame(rows, "patient_id string, ts timestamp")
    ours = sorted((r["patient_id"], r["window_start"], r["event_count"])
                  for r in sec.burst_windows(df, events=1, seconds=3, slide_seconds=1).collect())
    ref = sorted((r["patient_id"], r["w"]["start"], r["n"]) for r in
                 df.groupBy("patient_id", F.window("ts", "3 seconds", "1 second").alias("w"))
                   .agg(F.count(F.lit(1)).alias("n")).collect())
    assert ours == ref


def test_decode_events_presence_and_corrupt(spark):
    rows = [('{"event_id":"a","heart_rate":72.5,"spo2":null}',), ('{"event_id":"b","heart_rate":8',), ("",)]
    df = spark.createDataFrame(rows, "raw string")
    ok = ev.decode_events(df).collect()
    assert len(ok) == 1 and ok[0]["heart_rate"] == 72.5 and ok[0]["keys"] == ["event_id", "heart_rate", "spo2"]
    allrows = ev.decode_events(df, keep_corrupt=True).collect()
    assert sum(r["_corrupt"] is not None for r in allrows) >= 1
    assert ev.corrupt_count(df).first()["corrupt_rows"] == 2


def test_iot_projection_with_insert_time(spark):
    df = spark.createDataFrame([("PT-1", 80.0, 97.0, datetime(2024, 1, 1), "x")],
                               "patient_id string, heart_rate double, spo2 double, ts timestamp, ward string")
    out = ev.with_insert_time(ev.iot_projection(df))
    assert out.columns == ["patient_id", "heart_rate", "spo2", "timestamp", "inserted_at"]
    assert out.first()["inserted_at"] is not None
