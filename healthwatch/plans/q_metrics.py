"""Registered reporting queries (D2-D6, D8-D10)."""

from __future__ import annotations

from healthwatch.functions import fields as fd
from healthwatch.operators import baseline as bl
from healthwatch.operators import metrics as mt
from healthwatch.plans import sqlgen as sg
from healthwatch.plans.q_detect import SCHEMA_ROWS, ks_ctes
from healthwatch.plans.registry import register
from healthwatch.sources import fixtures as fx

ATT = "PT-ATTACKER-0000"


def _halves(spark, sf_dir):
    return fx.split_base_inc(fx.vitals(spark, sf_dir))


_KPI_CTES = f"""{ks_ctes()}, {sg.z_cte()}, {SCHEMA_ROWS.format(view='inc').strip()},
kpi AS (SELECT (SELECT COUNT(*) FROM inc) AS events,
               (SELECT COUNT(DISTINCT event_id) FROM zl WHERE z > 3) AS zscore_flagged,
               (SELECT COUNT(*) FROM sb WHERE anomaly_detected) AS schema_errors,
               (SELECT COUNT(*) FROM inc WHERE patient_id = '{ATT}') AS attacker_events,
               (SELECT COUNT(*) FROM p WHERE p < CAST(0.0001 AS DOUBLE)) AS drifted_fields)"""


def _kpis(spark, sf_dir):
    base, inc = _halves(spark, sf_dir)
    return mt.pipeline_kpis(inc, *bl.fit(base, quantiles=False))


# ---------------------------------------------------------------- D2
@register("pipeline_kpis", sql=f"WITH {_KPI_CTES}\nSELECT * FROM kpi", views=("base", "inc"))
def q_pipeline_kpis(spark, sf_dir):
    return _kpis(spark, sf_dir)


# ---------------------------------------------------------------- D3
@register("health_score", sql=f"""WITH {_KPI_CTES},
hs AS (SELECT *, CAST(GREATEST(0, LEAST(100, 100 - 2 * zscore_flagged - 5 * drifted_fields - 3 * schema_errors))
                      AS BIGINT) AS health_score FROM kpi)
SELECT *, CASE WHEN health_score < 40 THEN 'red' WHEN health_score < 70 THEN 'amber' ELSE 'green' END AS band FROM hs""",
          views=("base", "inc"))
def q_health_score(spark, sf_dir):
    return mt.health_score(_kpis(spark, sf_dir))


# Per half day: clean shifts are green, faulty ones amber or red.
@register("health_by_shift", sql=f"""WITH shifts AS (SELECT *, make_timestamp(CAST(floor(epoch_us(ts) / 43200000000) AS BIGINT) * 43200000000) AS shift FROM vitals),
{sg.stats_cte()}, {sg.z_cte('shifts')}, {SCHEMA_ROWS.format(view='shifts').strip()},
zf AS (SELECT DISTINCT event_id FROM zl WHERE z > 3),
k AS (SELECT s.shift, COUNT(*) AS events, COUNT(zf.event_id) AS zscore_flagged, COUNT(*) FILTER (WHERE sb.anomaly_detected) AS schema_errors
      FROM shifts s JOIN sb ON s.event_id = sb.event_id LEFT JOIN zf ON s.event_id = zf.event_id GROUP BY s.shift),
hs AS (SELECT *, CAST(GREATEST(0, LEAST(100, 100 - 2 * zscore_flagged - 3 * schema_errors)) AS BIGINT) AS health_score FROM k)
SELECT *, CASE WHEN health_score < 40 THEN 'red' WHEN health_score < 70 THEN 'amber' ELSE 'green' END AS band FROM hs""", views=("base",))
def q_health_by_shift(spark, sf_dir):
    from pyspark.sql import functions as F
    from healthwatch.operators import alerts as al
    from healthwatch.operators import schema_drift as sd
    from healthwatch.operators import zscore as zs
    v = fx.vitals(spark, sf_dir)
    base, _ = fx.split_base_inc(v)
    rows = al.with_batch(zs.zscore_flags(sd.schema_check(v), bl.baseline_moments(base)), 43_200, name="shift")
    kpis = rows.groupBy("shift").agg(F.count(F.lit(1)).alias("events"), F.count_if("is_anomalous").alias("zscore_flagged"),
                                     F.count_if("anomaly_detected").alias("schema_errors"))
    return mt.health_score(kpis.withColumn("drifted_fields", F.lit(0))).drop("drifted_fields")


# ---------------------------------------------------------------- D4
@register("throughput", sql="SELECT date_trunc('hour', ts) AS bucket, COUNT(*) AS events FROM vitals GROUP BY 1",
          views=("vitals",))
def q_throughput(spark, sf_dir):
    return mt.throughput(fx.vitals(spark, sf_dir))


# ---------------------------------------------------------------- D5
def _hist_sql():
    parts = []
    for f, nb in fd.HIST_BINS.items():
        parts.append(f"""SELECT '{f}' AS field, b AS bin, lo + b * width AS bin_start, lo + (b + 1) * width AS bin_end,
       COUNT(*) AS count FROM (
  SELECT lo, width, CAST(CASE WHEN width = 0 THEN 0 ELSE LEAST(FLOOR((v - lo) / width), {nb} - 1) END AS INTEGER) AS b
  FROM (SELECT CAST({f} AS DOUBLE) AS v FROM vitals WHERE {f} IS NOT NULL) x,
       (SELECT MIN({f}) AS lo, (MAX({f}) - MIN({f})) / {nb} AS width FROM vitals) m) q
GROUP BY b, lo, width""")
    return "\nUNION ALL ".join(parts)


@register("histogram", sql=_hist_sql(), views=("vitals",))
def q_histogram(spark, sf_dir):
    return mt.histogram(fx.vitals(spark, sf_dir))


# ---------------------------------------------------------------- D6
@register("vital_extremes", sql="""
SELECT COALESCE(MAX(COALESCE(heart_rate, 0)), 0) AS max_heart_rate,
       COALESCE(MIN(CASE WHEN spo2 = 0 THEN 100 ELSE spo2 END), 100) AS min_spo2 FROM vitals""", views=("vitals",))
def q_vital_extremes(spark, sf_dir):
    return mt.vital_extremes(fx.vitals(spark, sf_dir))


# ---------------------------------------------------------------- D8-D10
_TRUTH = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fd.GROUND_TRUTH.items())
_DET = f"""d AS (SELECT *, COALESCE(list_contains(string_split(detectors_fired, ','),
                  CASE fault_type {_TRUTH} END), false) AS ok FROM evaluation)"""


@register("evaluation_overall", sql=f"""WITH {_DET}
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE ok) AS detected,
       ROUND(CAST(COUNT(*) FILTER (WHERE ok) AS DOUBLE) / COUNT(*) * 100, 1) AS detection_pct,
       COUNT(*) FILTER (WHERE remediation_success) AS remediated,
       ROUND(CAST(COUNT(*) FILTER (WHERE remediation_success) AS DOUBLE) / COUNT(*) * 100, 1) AS remediation_pct,
       ROUND(AVG(mttr_seconds), 2) AS avg_mttr, MAX(mttr_seconds) AS max_mttr, MIN(mttr_seconds) AS min_mttr
FROM d""", views=("evaluation",))
def q_evaluation_overall(spark, sf_dir):
    return mt.evaluation_overall(fx.evaluation(spark, sf_dir))


@register("evaluation_by_fault", sql=f"""WITH {_DET}
SELECT fault_type, COUNT(*) AS runs, COUNT(*) FILTER (WHERE ok) AS detected,
       COUNT(*) FILTER (WHERE remediation_success) AS remediated, ROUND(AVG(mttr_seconds), 2) AS avg_mttr
FROM d GROUP BY fault_type""", views=("evaluation",))
def q_evaluation_by_fault(spark, sf_dir):
    return mt.evaluation_by_fault(fx.evaluation(spark, sf_dir))


@register("detector_fire_counts", sql="""
SELECT detector, COUNT(*) AS runs FROM (SELECT unnest(string_split(detectors_fired, ',')) AS detector FROM evaluation) q
WHERE length(detector) > 0 GROUP BY detector""", views=("evaluation",))
def q_detector_fire_counts(spark, sf_dir):
    return mt.detector_fire_counts(fx.evaluation(spark, sf_dir))
