"""Nearest documents, heavy hitters, rule tables, keyed log, variant decode,
forest draws and telemetry alerts."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from healthwatch.operators import alerts as al
from healthwatch.operators import bucket_log as bk
from healthwatch.operators import forest as fo
from healthwatch.operators import metrics as mt
from healthwatch.operators import nearest as nr
from healthwatch.operators import rules as rl
from healthwatch.operators import security as sec
from healthwatch.operators import telemetry as tm
from healthwatch.operators import triage as tr
from healthwatch.sources import events as ev


# ------------------------------------------------------------------ nearest
def _brute(q, d, k):
    dist = ((q[:, None, :] - d[None, :, :]) ** 2).sum(-1)
    return [[(int(i), round(float(dist[r, i]), 9)) for i in np.lexsort((np.arange(len(d)), dist[r]))[:k]] for r in range(len(q))]


def _found(spark, q, d, k, **kw):
    qs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query int, embedding array<double>")
    ds = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(d)], "doc_id int, embedding array<double>")
    out = {}
    for r in nr.nearest_docs(qs, ds, k, **kw).collect():
        out.setdefault(r["query"], []).append((r["rank"], r["doc_id"], round(r["distance"], 9)))
    return [[(i, x) for _, i, x in sorted(out.get(n, []))] for n in range(len(q))]


def test_nearest_matches_brute_force_over_many_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 6
    d = np.round(centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)), 2)
    d[5] = d[700]                                             # a tie
    q = np.vstack([d[rng.integers(0, 900, 40)], rng.normal(size=(20, 8)) * 8])
    assert _found(spark, q, d, 5, cell_docs=40) == _brute(q, d, 5)
    assert _found(spark, q, d[:3], 5) == _brute(q, d[:3], 5)  # fewer documents than asked for


def test_nearest_leaves_out_unusable_rows(spark):
    qs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0])], "id int, v array<double>")
    ds = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, None]), ("c", None), ("d", [1.0, 1.0])], "doc_id string, v array<double>")
    got = [(r["id"], r["rank"], r["doc_id"], r["distance"]) for r in nr.nearest_docs(qs, ds, 3, "v").orderBy("rank").collect()]
    assert got == [(1, 1, "a", 1.0), (1, 2, "d", 1.0)]
    assert nr.nearest_docs(qs, ds.limit(0), 3, "v").count() == 0


def test_nearest_with_100000_documents(spark):
    docs = spark.range(100_000).repartition(4).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda j: (
        F.pmod(F.xxhash64("id", j), F.lit(2000)) / 10.0)).alias("embedding"))
    queries = docs.filter("doc_id % 9973 = 0").select(F.col("doc_id").alias("query"), "embedding")
    d = np.array([r["embedding"] for r in docs.orderBy("doc_id").collect()])
    want = dict(zip(range(0, 100_000, 9973), _brute(d[::9973], d, 4)))
    got = {}
    for r in nr.nearest_docs(queries, docs, 4).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["doc_id"], round(r["distance"], 9)))
    assert {q: [(i, x) for _, i, x in sorted(v)] for q, v in got.items()} == want


def test_block_products_keep_ties_and_exact_distances():
    q, d = np.array([[0.0, 0.0], [1e6, 1e6]]), np.array([[1.0, 0], [0, 1.0], [1e6, 1e6 + 1e-3], [-1.0, 0]])
    at, doc, dist = nr.best_of_block(q, d, np.array([3, 1, 2, 0]), 2)
    assert list(zip(at.tolist(), doc.tolist())) == [(0, 3), (0, 1), (1, 2), (1, 1)]
    assert dist[2] == pytest.approx(1e-6, rel=1e-3)


# ------------------------------------------------------------- heavy hitters
def test_heavy_hitters_are_exact_among_ten_million_keys(spark):
    n = 10_000_000
    df = spark.range(n).select(F.when(F.col("id") % 10 < 3, F.lit("hot")).when(F.col("id") % 100 == 3, F.lit("warm"))
                               .otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("patient_id"))
    got = {r["patient_id"]: (r["event_count"], r["share"], r["is_hot"]) for r in sec.heavy_hitters(df, 0.2, floor=0.005).collect()}
    assert got == {"hot": (n * 3 // 10, 0.3, True), "warm": (n // 100, 0.01, False)}
    plan = sec.heavy_hitters(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(patient_id" not in plan.split("BroadcastExchange")[-1]


def test_heavy_hitters_edges(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 1 + [(None,)] * 6, "patient_id string")
    assert [(r["patient_id"], r["event_count"], r["is_hot"]) for r in sec.heavy_hitters(df).collect()] == [("a", 3, True)]
    assert sec.heavy_hitters(df.limit(0)).count() == 0
    assert sec.heavy_hitters(df.filter("patient_id = 'a'"), 1.0).count() == 0     # more than the share, not equal to it
    with pytest.raises(ValueError):
        sec.heavy_hitters(df, 0.1, floor=0.2)


# -------------------------------------------------------------------- rules
def _alerts(spark, names):
    return spark.createDataFrame([(n, i, 1, f"d{i}") for i, n in enumerate(names)], "detector string, priority int, signal_count long, detail string")


def test_a_rule_is_added_as_a_row(spark):
    alerts = _alerts(spark, ["zscore", "disk_full", "DB_Latency_high"])
    plan = [(r["action_code"], r["action"]) for r in tr.action_plan(alerts).orderBy("step").collect()]
    assert plan == [("A", "impute impossible vitals with jitter"), ("E", "alert the on-call team"), ("Z", "no repair rule: inspect disk_full")]
    more = rl.default_rules(spark).unionByName(spark.createDataFrame([
        ("action", "disk", False, True, 0, "G", 1, "free space"), ("goal", "disk", False, False, 9, None, None, "space is free"),
        ("component", "disk_full", True, False, 9, None, None, "Host,Volume"), ("log", "[DISK]", False, False, 0, "disk", None, None)], rl.SCHEMA))
    assert ("G", "free space") in [(r["action_code"], r["action"]) for r in tr.action_plan(alerts, rules=more).collect()]
    assert "space is free" in tr.completion_goals(alerts, rules=more).first()[0]
    packet = tr.crisis_packet(alerts, rules=more).first()
    assert {"Host", "Volume"} <= set(packet["affected_components"].split(",")) and packet["signals"][1]["detail"] == "d1"
    from healthwatch.functions.predicates import classify_log_lines
    lines = spark.createDataFrame([("SUCCESS [DISK] ",), ("x",), (" ",)], "line string")
    assert [r["category"] for r in classify_log_lines(lines, rules=more).orderBy("line").collect()] == ["disk", "plain"]


def test_joined_rules_equal_inlined_ones(spark):
    rows = rl.default_rows() + [("action", f"pattern{i:04d}", i % 3 == 0, i % 2 == 0, 50 - i % 7, f"C{i}", i, f"t{i}") for i in range(300)]
    rows += [("action", "", False, False, 0, "X", 0, "x"), ("action", None, False, False, 0, "X", 0, "x")]
    rules = spark.createDataFrame(rows, rl.SCHEMA)
    names = ["pattern0003", "xpattern0004", "PATTERN0004 and pattern0010", "pattern0006x", "zscore", "Zscore", "", None, "zscore", "stall pattern0008", "p"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, detector string")
    both = [{r["i"]: r["rule"] for r in rl.with_rule(df, rules, "action", "detector", inline=k).collect()} for k in (1000, 1)]
    assert both[0] == both[1] and len(both[0]) == len(names)
    assert both[0][0]["code"] == "C3" and both[0][1]["code"] == "C4" and both[0][5]["code"] == "A" and both[0][3] is None and both[0][10] is None


# ---------------------------------------------------------------- keyed log
def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(os.path.join(path, "data")) for f in names if f.endswith(".parquet")}


def test_update_rewrites_only_the_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(4000).select(F.concat(F.lit("INC-"), "id").alias("log_id"), F.lit(None).cast("double").alias("mttr_seconds"),
                                    F.timestamp_seconds(F.col("id")).alias("fault_start"), F.timestamp_seconds(F.col("id") + 90).alias("fix_end"))
    bk.write_log(rows, path, "log_id", buckets=128)
    before = _files(path)
    fixes = rows.filter("cast(substring(log_id, 5) as long) % 1000 = 7").select("log_id", "fault_start", "fix_end")
    touched = mt.backfill_log(spark, path, fixes)
    assert 1 <= len(touched) <= 4 and before <= _files(path) and len(_files(path) - before) <= 2 * len(touched)
    used = {f for f in bk.read_log(spark, path).inputFiles()}
    assert len(used) == len(before) and sum(os.path.join("", f.split("/data/")[1]) in "\n".join(before) for f in used) == len(before) - len(touched)
    got = {r["log_id"]: r["mttr_seconds"] for r in bk.read_log(spark, path).collect()}
    assert len(got) == 4000 and {k for k, v in got.items() if v == 90.0} == {f"INC-{n}" for n in (7, 1007, 2007, 3007)}
    assert bk.read_log(spark, path, version=0).filter("mttr_seconds is not null").count() == 0
    bk.append(rows.limit(3).withColumn("log_id", F.concat(F.lit("NEW-"), "log_id")), path)
    assert bk.read_log(spark, path).count() == 4003
    assert bk.update(spark, path, fixes.limit(0).withColumn("mttr_seconds", F.lit(1.0)), ["mttr_seconds"]) == []


def test_keyed_log_cases(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0), ("b", None)], "log_id string, mttr_seconds double")
    bk.write_log(rows, path, "log_id", buckets=2)
    bk.update(spark, path, spark.createDataFrame([("a", 9.0), ("a", 8.0), ("zz", 1.0), (None, 7.0)], rows.schema), ["mttr_seconds"])
    assert sorted(((r[0] or "", r[1] or 0) for r in bk.read_log(spark, path).collect())) == [("", 3.0), ("a", 9.0), ("a", 9.0), ("b", 0)]
    empty = str(tmp_path / "empty")
    bk.write_log(rows.limit(0), empty, "log_id")
    assert bk.read_log(spark, empty).count() == 0
    with pytest.raises(FileNotFoundError):
        bk.read_log(spark, str(tmp_path / "none"))


# ------------------------------------------------------------------ variant
def test_variant_keys_types_and_malformed_text(spark):
    texts = ['{"event_id":"e","spo2":null,"heart_rate":"x","ward":"ICU","extra":[1]}', '{"spo2":97}', "[1,2]", "3", "{bad", None, "{}"]
    got = ev.decode_variant(spark.createDataFrame([(t,) for t in texts], "raw string")).collect()
    assert [r["keys"] for r in got] == [["event_id", "extra", "heart_rate", "spo2", "ward"], ["spo2"], []]
    assert got[0]["spo2"] is None and got[0]["heart_rate"] is None and got[0]["ward"] == "ICU" and got[1]["spo2"] == 97.0
    assert got[0]["key_types"]["spo2"] == "VOID" and got[0]["key_types"]["extra"].startswith("ARRAY")


def test_json_null_counts_as_present(spark):
    from healthwatch.functions import fields as fd
    known = ",".join(f'"{k}":1' for k in fd.EVENT_FIELDS if k != "spo2")
    texts = [f'{{{known},"spo2":null,"diagnosis_code":"d"}}'] * 3 + [f'{{{known},"diagnosis_code":"d"}}'] * 2
    batch = ev.decode_variant(spark.createDataFrame([(t,) for t in texts], "raw string")).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    stats = spark.createDataFrame([("heart_rate", 80.0, 10.0)], "field string, mean double, std double")
    hist = spark.createDataFrame([("heart_rate", 80.0, 5)], "field string, value double, n long")
    got = {r["detector"]: (r["signal_count"], r["detail"]) for r in al.detect_all(batch, stats, hist, presence="json").collect()}
    assert got["schema_entropy"] == (2, "extra:diagnosis_code,missing:spo2")


# ------------------------------------------------------------------- forest
def test_forest_draws_do_not_depend_on_partitioning_and_skip_incomplete_rows(spark):
    rows = [(i, float((i * 37) % 101), float((i * 53) % 97)) for i in range(500)] + [(900, None, 1.0), (901, float("nan"), 2.0), (902, 5000.0, -4000.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    one = {r["id"]: (r["score"], r["is_anomaly"]) for r in fo.isolation_forest(df.coalesce(1), ["a", "b"], row_id="id", keep=300).collect()}
    many = {r["id"]: (r["score"], r["is_anomaly"]) for r in fo.isolation_forest(df.repartition(7), ["a", "b"], row_id="id", keep=300).collect()}
    assert one == many and one[900] == (None, False) and one[901] == (None, False)
    assert min((v[0], k) for k, v in one.items() if v[0] is not None)[1] == 902


def test_value_at_rank_matches_a_sort(spark, monkeypatch):
    monkeypatch.setattr(fo, "FEW", 5)
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=700).tolist(), [1.0] * 50, [1.0] * 30 + [2.0] * 30, [1e-9 * k for k in range(40)] + [1e9], [-0.5]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for rank in {0, len(values) // 3, len(values) - 1}:
            assert fo.value_at_rank(df, "v", rank) == sorted(values)[rank]
        assert fo.quantile_cut(df, "v", 0.05) == pytest.approx(np.quantile(values, 0.05))


def test_latest_verdict_breaks_ties(spark):
    rows = [("2024-01-01", float(i % 13), float(i % 7)) for i in range(60)] + [("2024-01-02", 1.0, 2.0), ("2024-01-02", 3.0, 1.0), ("2024-01-02", 3.0, 4.0)]
    df = spark.createDataFrame(rows, "ts string, a double, b double")
    last = fo.analyze_latest(df, ["a", "b"]).collect()
    assert len(last) == 1 and (last[0]["a"], last[0]["b"]) == (3.0, 4.0)


# ---------------------------------------------------------------- telemetry
def test_a_run_of_empty_batches_is_one_row_however_long(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:00:10",), ("9999-01-01 00:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    runs = [(r["batches"]) for r in tm.batch_gaps(df, 1).orderBy("gap_start").collect()]
    assert runs[0] == 9 and runs[1] > 2 * 10 ** 11
    near = df.filter("ts < '2025-01-01'")
    assert [str(r["batch_start"])[-2:] for r in tm.empty_batches(near, 1).orderBy("batch_start").collect()] == [f"{s:02d}" for s in range(1, 10)]


def test_empty_batches_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(tm, "CALENDAR", 3)
    df = spark.createDataFrame([(0,), (50,), (51,), (60,)], "s int").select(F.timestamp_seconds("s").alias("ts"))
    got = sorted(int(r["batch_start"].timestamp()) for r in tm.empty_batches(df, 1).collect())
    assert got == [*range(1, 50), *range(52, 60)]


def test_command_line_stream_writes_and_resumes(spark, tmp_path):
    """Two runs over the same folder and checkpoint: nothing is written twice."""
    from healthwatch import cli
    from healthwatch.operators import baseline as bl
    from healthwatch.sources import fixtures as fx
    from conftest import SF_SMOKE
    v = fx.vitals(spark, SF_SMOKE)
    base, inc = fx.split_base_inc(v)
    stats, hist = bl.fit(base)
    stats.write.parquet(str(tmp_path / "base" / "stats"))
    hist.write.parquet(str(tmp_path / "base" / "histogram"))
    inc.coalesce(1).write.parquet(str(tmp_path / "in" / "events.parquet"))
    args = ["stream", "--folder", str(tmp_path / "in"), "--baseline", str(tmp_path / "base"), "--once", "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "ck")]
    cli.main(args)
    first = spark.read.parquet(str(tmp_path / "out")).count()
    cli.main(args)
    assert first > 0 and spark.read.parquet(str(tmp_path / "out")).count() == first
