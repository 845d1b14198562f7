"""Isolation forest properties and the streaming detector loop."""

import pytest
from pyspark.sql import functions as F

from healthwatch.operators import forest as fo
from healthwatch.operators import baseline as bl
from healthwatch.sources import fixtures as fx
from healthwatch.streaming import pipeline as sp

from conftest import SF_SMOKE

FEATS = ["a", "b"]


def _data(spark, n=400):
    rows = [(i, float((i * 37) % 101) / 10, float((i * 53) % 97) / 10) for i in range(n)]
    rows.append((n, 500.0, -400.0))                         # planted outlier
    return spark.createDataFrame(rows, "id long, a double, b double")


def test_forest_ranks_planted_outlier_first(spark):
    out = fo.isolation_forest(_data(spark), FEATS, row_id="id")
    top = out.orderBy("score").first()
    assert top["id"] == 400 and top["is_anomaly"]
    frac = out.filter("is_anomaly").count() / out.count()
    assert 0.02 <= frac <= 0.08


def test_forest_same_seed_same_scores(spark):
    a = sorted(fo.isolation_forest(_data(spark, 200), FEATS, row_id="id").select("id", "score").collect())
    b = sorted(fo.isolation_forest(_data(spark, 200), FEATS, row_id="id").select("id", "score").collect())
    assert a == b


def test_forest_needs_twenty_rows(spark):
    out = fo.isolation_forest(_data(spark, 10), FEATS)
    assert out.filter(F.col("score").isNotNull()).count() == 0
    assert out.first()["details"] == "Insufficient data"


def test_c_factor():
    assert fo.c_factor(1) == 0.0 and fo.c_factor(2) == 1.0
    assert abs(fo.c_factor(256) - 10.2444) < 1e-3


@pytest.mark.slow
def test_stream_detect_appends_alerts(spark):
    base, _ = fx.split_base_inc(fx.vitals(spark, SF_SMOKE))
    stream = fx.vitals_from_events(sp.read_table_stream(spark, SF_SMOKE, "events"))
    out = sp.stream_detect(stream, bl.fit_baseline(base), bl.baseline_histogram(base))
    dets = {r["detector"] for r in out.collect()}
    assert "zscore" in dets and "schema_entropy" in dets
    assert out.select("batch_id").distinct().count() >= 1


def test_stream_window_stats_complete(spark):
    s = sp.event_time(fx.vitals_from_events(sp.read_table_stream(spark, SF_SMOKE, "events")))
    out = sp.run_to_table(sp.window_stats(s, "1 day"), "test-window")
    assert out.agg(F.sum("events")).first()[0] == 1000


def test_stream_stall_state_across_batches(spark, tmp_path):
    from datetime import datetime, timedelta
    from healthwatch.streaming.stall import stream_stall_gaps
    t0 = datetime(2024, 1, 1)
    files = [
        [("a", 0), ("a", 10), ("b", 5)],
        [("a", 100), ("a", 110)],            # gap a: 10 -> 100 spans the batch boundary
        [("a", 500), ("a", 505)],            # watermark passes b's 5 + 30: b goes idle
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame([(k, t0 + timedelta(seconds=s)) for k, s in rows], "k string, ts timestamp") \
             .coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    src = (spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1)
                .option("recursiveFileLookup", "true").parquet(str(tmp_path)))
    out = sp.run_to_table(stream_stall_gaps(sp.event_time(src, delay="0 seconds"), "k"), "stall-test", mode="append")
    rows = {(r["k"], r["kind"], r["gap_seconds"]) for r in out.collect()}
    assert ("a", "gap", 90.0) in rows and ("a", "gap", 390.0) in rows
    assert any(k == "b" and kind == "idle" for k, kind, _ in rows)


def test_stream_latest_n_across_batches(spark, tmp_path):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    for i in range(3):
        spark.createDataFrame([(f"e{i}-{k}", t0 + timedelta(minutes=7 * k + i)) for k in range(10)],
                              "event_id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    src = (spark.readStream.schema("event_id string, ts timestamp").option("maxFilesPerTrigger", 1)
                .option("recursiveFileLookup", "true").parquet(str(tmp_path)))
    got = sorted(r["event_id"] for r in sp.stream_latest_n(src, ["ts", "event_id"], 5, name="ln-test").collect())
    allrows = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path))
    ref = sorted(r["event_id"] for r in allrows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(5).collect())
    assert got == ref


@pytest.mark.slow
def test_pandas_functions_run_outside_the_repo(tmp_path):
    """Python workers import the package shipped with addPyFile, not the
    caller's working directory."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r})\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled','false')"
            f".config('spark.checkpoint.dir', {str(tmp_path / 'ck')!r}).getOrCreate()\n"
            "import __spark_entry__ as se\n"
            "print('rows', se.queries()['isolation_forest'](s, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0 and "rows " in out.stdout, out.stderr[-2000:]
