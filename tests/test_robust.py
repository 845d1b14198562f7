"""Defined results for bad input, restarts and left-over tables."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from healthwatch import session
from healthwatch.operators import metrics as mt
from healthwatch.operators import triage as tr
from healthwatch.sources import events as ev
from healthwatch.sources import fixtures as fx
from healthwatch.streaming import pipeline as sp


def test_decode_bad_numbers_and_repeated_keys(spark):
    df = spark.createDataFrame([('{"event_id":"a","heart_rate":"abc","spo2":97}',), ('{"spo2":1,"spo2":2}',), ("{",), ('{"spo2":null}',)], "raw string")
    rows = ev.decode_events(df).collect()
    assert [(r["heart_rate"], r["spo2"], r["keys"]) for r in rows] == [
        (None, 97.0, ["event_id", "heart_rate", "spo2"]), (None, 2.0, ["spo2"]), (None, None, ["spo2"])]
    kept = ev.decode_events(df, keep_corrupt=True)
    assert [r["_corrupt"] for r in kept.collect()] == [None, None, "{", None]


def test_decode_parses_each_text_once(spark):
    df = spark.createDataFrame([("{}",)], "raw string")
    plan = ev.decode_events(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_align_keeps_rows_with_bad_values(spark):
    df = spark.createDataFrame([("e", "not a number")], "event_id string, spo2 string")
    assert ev.align_to_schema(df, ev.SINK_SCHEMA).first()["spo2"] is None


def test_jsonl_skips_malformed_lines(spark):
    path = tempfile.mkdtemp(prefix="hw-jsonl-")
    with open(os.path.join(path, "a.jsonl"), "w") as f:
        f.write('{"a": 1}\n\nnot json\n{"a": 2, "b": "x"}\n')
    assert [tuple(r) for r in ev.read_jsonl(spark, path, "a long, b string").collect()] == [(1, None), (2, "x")]
    assert ev.read_jsonl(spark, path).count() == 2
    assert ev.malformed_lines(spark, path).first()["corrupt_rows"] == 1


def test_two_fixes_for_one_incident(spark):
    inc = spark.createDataFrame([("i", 5.0), ("j", 6.0)], "log_id string, mttr_seconds double")
    fixes = spark.sql("SELECT 'i' AS log_id, TIMESTAMP '2024-01-01 00:00:00' AS fault_start, TIMESTAMP '2024-01-01 00:01:00' AS fix_end "
                      "UNION ALL SELECT 'i', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 00:02:00'")
    assert sorted(map(tuple, mt.backfill_mttr(inc, fixes).collect())) == [("i", 120.0), ("j", 6.0)]


def test_empty_evaluation(spark):
    ev0 = spark.createDataFrame([], "run long, fault_type string, detectors_fired string, remediation_success boolean, mttr_seconds double")
    r = mt.evaluation_overall(ev0).first()
    assert r["total"] == 0 and r["detection_pct"] is None


def test_action_plan_keeps_every_alert(spark):
    alerts = spark.createDataFrame([("databricks_warehouse_monitor", 1), ("latency", 2), ("isolation_forest", 3), ("ks_test", 4), ("zscore", 5)],
                                   "detector string, priority int")
    plan = [(r["action_code"], r["action"]) for r in tr.action_plan(alerts).orderBy("step").collect()]
    assert plan == [("A", tr.ACTIONS["zscore"][2]), ("E", tr.ACTIONS["latency"][2]), ("Z", "no repair rule: inspect isolation_forest")]


def test_texts_reach_both_sides_of_every_rule(spark):
    from healthwatch.functions import fields as fd
    from healthwatch.operators import audit as au
    df = spark.createDataFrame([(s,) for s in fx.STATEMENTS], "sql string")
    reasons = {r["reason"] for r in au.audit_sql(df).collect()}
    assert reasons >= {reason for _, reason in fd.BLOCKED_SQL} | {au.APPROVED_REASON, au.EMPTY_REASON}
    changed = df.select((au.clean_statement(F.col("sql")) != F.col("sql")).alias("c")).agg(F.count_if("c")).first()[0]
    assert 0 < changed < len(fx.STATEMENTS)


def test_scratch_tables_are_removed(spark):
    path = os.path.join(session.checkpoint_dir(spark).removeprefix("file:"), "tables")
    count = lambda: len(os.listdir(path)) if os.path.isdir(path) else 0
    before = count()
    with session.scratch_tables(spark):
        assert session.write_table(spark.range(3), "temporary").count() == 3
        assert count() == before + 1
    assert count() == before


def test_missing_shared_folder_is_an_error_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_stream_reads_directory_tables_and_restarts(spark, tmp_path):
    from healthwatch.operators import baseline as bl
    base, inc = fx.split_base_inc(fx.vitals(spark, "/root/testdata/sf0.001"))
    stats, hist = bl.fit(base, quantiles=False)
    folder, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    inc.repartition(3).write.parquet(f"{folder}/vitals.parquet")
    run = lambda: sp.stream_detect(sp.read_table_stream(spark, folder, "vitals", max_files=1), stats, hist, out=out, checkpoint=ckpt)
    first = run()
    assert first.select("batch_id").distinct().count() == 3
    rows = sorted(map(str, first.collect()))
    assert sorted(map(str, run().collect())) == rows                       # nothing new: nothing is written twice
    inc.limit(200).repartition(1).write.mode("append").parquet(f"{folder}/vitals.parquet")
    again = run()
    assert again.select("batch_id").distinct().count() == 4
    assert set(rows) < set(map(str, again.collect()))
