"""Unit cases of the detectors (z-score, KS, schema distance) plus edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from healthwatch.functions.fields import NUMERIC_FIELDS
from healthwatch.operators import baseline as bl
from healthwatch.operators import ks
from healthwatch.operators import schema_drift as sd
from healthwatch.operators import zscore as zs

SCHEMA = ("event_id string, patient_id string, ward string, heart_rate double, bp_systolic double, "
          "bp_diastolic double, spo2 double, temperature_c double, respiratory_rate double, ts string")


def normal_rows(n, start=0):
    rows = []
    for i in range(start, start + n):
        rows.append((f"e{i}", f"PT-{i % 50:04d}", "ICU", 60.0 + (i * 7) % 41, 90.0 + (i * 11) % 51,
                     60.0 + (i * 5) % 31, 95.0 + (i * 3) % 6, 36.1 + ((i * 13) % 18) / 10, 12.0 + (i * 17) % 9,
                     "2024-01-01"))
    return rows


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(normal_rows(500), SCHEMA)


def test_baseline_stats_match_numpy(spark, base):
    import numpy as np
    stats = {r["field"]: r for r in bl.fit_baseline(base).collect()}
    hr = np.array([r[3] for r in normal_rows(500)], dtype=float)
    assert stats["heart_rate"]["mean"] == round(float(hr.mean()), 4)
    assert stats["heart_rate"]["std"] == round(float(hr.std()), 4)
    assert stats["heart_rate"]["p25"] == round(float(np.percentile(hr, 25)), 4)
    assert stats["heart_rate"]["p75"] == round(float(np.percentile(hr, 75)), 4)
    assert stats["heart_rate"]["n_samples"] == 500


def test_zscore_flags_impossible_heart_rate(spark, base):
    ev = spark.createDataFrame([("x", "PT-1", "ICU", 300.0, 120.0, 80.0, 98.0, 36.8, 16.0, "t")], SCHEMA)
    r = zs.zscore_flags(ev, bl.fit_baseline(base)).first()
    assert r["is_anomalous"] and "heart_rate" in r["anomalous_fields"]


def test_zscore_normal_not_flagged(spark, base):
    ev = spark.createDataFrame(normal_rows(20, 1000), SCHEMA)
    assert zs.zscore_summary(zs.zscore_flags(ev, bl.fit_baseline(base))).first()["flagged_events"] == 0


def test_zscore_std_zero_and_null(spark):
    stats = {"heart_rate": (80.0, 0.0), "spo2": (97.0, 1.0)}
    ev = spark.createDataFrame([("a", 500.0, None)], "event_id string, heart_rate double, spo2 double")
    r = zs.zscore_flags(ev, stats).first()
    assert r["z_heart_rate"] == 0.0 and r["z_spo2"] is None and not r["is_anomalous"]


def test_zscore_summary_empty_batch(spark):
    ev = spark.createDataFrame([], "event_id string, heart_rate double")
    r = zs.zscore_summary(zs.zscore_flags(ev, {"heart_rate": (80.0, 10.0)})).first()
    assert r["total_events"] == 0 and r["flag_rate"] == 0.0 and not r["fault_detected"]


def test_ks_detects_drift_of_impossible_vitals(spark, base):
    rows = [r[:3] + (250.0 + i % 50, 220.0 + i % 30, r[5], 40.0 + i % 20) + r[7:]
            for i, r in enumerate(normal_rows(50, 3000))]
    bad = spark.createDataFrame(rows, SCHEMA)
    d = {r["field"]: r for r in ks.ks_drift(bad, bl.baseline_histogram(base)).collect()}
    assert d["heart_rate"]["drifted"] and d["spo2"]["drifted"]
    assert not d["bp_diastolic"]["drifted"]


def test_ks_skips_small_samples(spark, base):
    few = spark.createDataFrame(normal_rows(9, 2000), SCHEMA)
    assert ks.ks_drift(few, bl.baseline_histogram(base)).count() == 0


def test_ks_bucketed_equals_single_window(spark, base):
    inc = spark.createDataFrame(normal_rows(300, 5000), SCHEMA).withColumn("heart_rate", F.col("heart_rate") + 3)
    g = ks.collapse(bl.baseline_histogram(base), inc)
    one = {r["field"]: r["ks"] for r in ks.ecdf_gap(g).collect()}
    # a small range size cuts even these fields into many ranges
    many = {r["field"]: r["ks"] for r in ks.ecdf_gap(g, range_values=5).collect()}
    assert one == many
    mixed = {r["field"]: r["ks"] for r in ks.ecdf_gap(g, range_values=40).collect()}
    assert one == mixed


def test_ks_pvalue_series(spark):
    lam = [0.2, 0.5, 1.0, 1.36, 2.0]
    got = spark.createDataFrame([(x,) for x in lam], "lam double") \
               .select(ks.ks_pvalue(F.col("lam")).alias("p")).collect()
    ref = [1.0] + [2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)) for x in lam[1:]]
    for g, r in zip(got, ref):
        assert abs(g["p"] - r) < 1e-12
    assert abs(ref[3] - 0.0494) < 1e-3          # the familiar 5 % critical value


@pytest.mark.parametrize("d,n,m,p", [(1.0, 2, 2, 1 / 3), (1.0, 3, 3, 0.1), (2 / 3, 3, 3, 0.6), (0.5, 2, 2, 1.0)])
def test_ks_exact_pvalue_small_cases(d, n, m, p):
    assert abs(ks.ks_exact_pvalue(d, n, m) - p) < 1e-9


def test_ks_exact_method(spark, base):
    bad = spark.createDataFrame(
        [(f"b{i}", "PT-1", "ICU", 250.0 + i % 50, 220.0, 80.0, 40.0, 36.8, 16.0, "t") for i in range(20)], SCHEMA)
    d = {r["field"]: r for r in ks.ks_drift(bad, bl.baseline_histogram(base), method="exact").collect()}
    assert d["heart_rate"]["drifted"] and d["heart_rate"]["p_value"] < 1e-6


def _schema_row(spark, ev: dict):
    cols = ["event_id", "patient_id", "ward", "heart_rate", "bp_systolic", "bp_diastolic", "spo2",
            "temperature_c", "respiratory_rate", "timestamp", "diagnosis_code"]
    ddl = ", ".join(f"{c} {'double' if c in NUMERIC_FIELDS else 'string'}" for c in cols)
    df = spark.createDataFrame([tuple(ev.get(c) for c in cols)], ddl)
    return sd.schema_check(df, rename={}).first()


def test_schema_arithmetic(spark):
    from conftest import event
    full = _schema_row(spark, event())
    assert (full["d_v2"], full["best_schema"], full["anomaly_detected"]) == (0.0, "v2", False)
    v1 = _schema_row(spark, event(respiratory_rate=None))
    assert (v1["d_v1"], v1["best_schema"]) == (0.0, "v1")
    fault = _schema_row(spark, event(spo2=None, diagnosis_code="ICD-9999"))
    assert fault["d_v2"] == 0.1818 and fault["anomaly_detected"]
    assert fault["missing_fields"] == ["spo2"] and fault["extra_fields"] == ["diagnosis_code"]
    dash = _schema_row(spark, event(event_id=None))
    assert dash["distance"] == 0.1 and not dash["anomaly_detected"]
    dash_null = _schema_row(spark, event(event_id=None, spo2=None))
    assert dash_null["distance"] == 0.2 and dash_null["anomaly_detected"]


def test_schema_tie_prefers_v1(spark):
    df = spark.createDataFrame([("x",)], "event_id string")
    r = sd.schema_check(df, contracts=[("v1", ["a"]), ("v2", ["b"])], rename={}).first()
    assert r["d_v1"] == r["d_v2"] and r["best_schema"] == "v1"


def test_schema_empty_contract(spark):
    df = spark.createDataFrame([("x",)], "event_id string")
    r = sd.schema_check(df, contracts=[("v0", [])], rename={}).first()
    assert r["distance"] == 0.0


def test_schema_json_presence(spark):
    df = spark.createDataFrame([('{"event_id":"a","spo2":null}',)], "raw string")
    p = df.select(sd.present_fields(df, presence="json").alias("p")).first()["p"]
    assert p == ["event_id", "spo2"]          # key present even with a null value


def test_ks_by_batch_equals_per_batch_ks(spark, base):
    rows = normal_rows(300, 7000)
    rows = [r[:3] + ((r[3] + 30.0) if i % 3 == 0 else r[3],) + r[4:] for i, r in enumerate(rows)]
    inc = spark.createDataFrame(rows, SCHEMA).withColumn("batch", (F.monotonically_increasing_id() % 3).cast("int"))
    inc = inc.cache()
    hist = bl.baseline_histogram(base)
    by = {(r["batch"], r["field"]): r for r in ks.ks_drift_by(inc, hist, ["batch"]).collect()}
    forced = {(r["batch"], r["field"]): r for r in ks.ks_drift_by(inc, hist, ["batch"], range_values=5).collect()}
    for b in range(3):
        one = {r["field"]: r for r in ks.ks_drift(inc.filter(F.col("batch") == b), hist).collect()}
        for f, r in one.items():
            assert by[(b, f)]["ks_statistic"] == r["ks_statistic"], (b, f)
            assert by[(b, f)]["p_value"] == r["p_value"]
            assert forced[(b, f)]["ks_statistic"] == r["ks_statistic"]


def test_exact_quantiles_match_numpy_on_continuous_data(spark):
    import numpy as np
    from healthwatch.operators.ranks import exact_quantiles
    rng = np.random.default_rng(7)
    a = rng.normal(50, 10, 3000)
    b = np.round(rng.uniform(0, 5, 3000), 1)            # heavy ties
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    qs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    for svals in (7, 10 ** 6):                           # many ranges / one range
        got = {(r["field"], r["q"]): r["value"]
               for r in exact_quantiles(df, ["a", "b"], qs, range_values=svals).collect()}
        for name, arr in (("a", a), ("b", b)):
            for q in qs:
                assert abs(got[(name, q)] - float(np.percentile(arr, q * 100))) < 1e-9, (svals, name, q)


def test_fit_baseline_methods_agree(spark, base):
    e = sorted(bl.fit_baseline(base).collect())
    b = sorted(bl.fit_baseline(base, method="builtin").collect())
    assert e == b


def test_zscore_column_and_ks_summary(spark, base):
    df = spark.createDataFrame([(90.0,), (None,)], "v double")
    got = [r["z"] for r in df.select(zs.zscore(F.col("v"), 80.0, 5.0).alias("z")).collect()]
    assert got == [2.0, None]
    assert df.select(zs.zscore(F.col("v"), 80.0, 0.0).alias("z")).first()["z"] == 0.0
    rows = [r[:3] + (250.0 + i % 50,) + r[4:] for i, r in enumerate(normal_rows(60, 9000))]
    inc = spark.createDataFrame(rows, SCHEMA)
    summ = ks.ks_summary(ks.ks_drift(inc, bl.baseline_histogram(base)), inc).first()
    assert summ["events_tested"] == 60 and summ["drift_detected"] and "heart_rate" in summ["drifted_fields"]
