"""Registered detector queries: baseline, z-score, KS drift, schema drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from healthwatch.functions import fields
from healthwatch.operators import baseline as bl
from healthwatch.operators import zscore as zs
from healthwatch.plans import sqlgen as sg
from healthwatch.plans.registry import register
from healthwatch.sources import fixtures as fx


def _halves(spark, sf_dir):
    return fx.split_base_inc(fx.vitals(spark, sf_dir))


# ---------------------------------------------------------------- D1
@register("gold_baseline", sql=f"""
WITH bs AS ({sg.melt('base')})
SELECT field, COUNT(*) AS n_samples, ROUND(AVG(v), 4) AS mean, ROUND(STDDEV_POP(v), 4) AS std,
       ROUND(MIN(v), 4) AS min_value, ROUND(MAX(v), 4) AS max_value,
       ROUND(quantile_cont(v, 0.25), 4) AS p25, ROUND(quantile_cont(v, 0.75), 4) AS p75
FROM bs GROUP BY field
""", views=("base",))
def q_gold_baseline(spark, sf_dir):
    base, _ = _halves(spark, sf_dir)
    return bl.fit_baseline(base)


# ---------------------------------------------------------------- E2
@register("zscore_events", sql=f"""
WITH {sg.stats_cte()}, {sg.z_cte()}
SELECT i.event_id, i.patient_id,
       COALESCE(e.n_anomalous, 0) AS n_anomalous,
       COALESCE(e.n_anomalous, 0) > 0 AS is_anomalous,
       e.anomalous_fields, e.max_zscore
FROM inc i LEFT JOIN (
  SELECT event_id, COUNT(*) AS n_anomalous,
         string_agg(field, ',' ORDER BY field) AS anomalous_fields,
         MAX(ROUND(z, 2)) AS max_zscore
  FROM zl WHERE z > 3 GROUP BY event_id) e ON i.event_id = e.event_id
""", views=("base", "inc"))
def q_zscore_events(spark, sf_dir):
    from pyspark.sql import functions as F
    base, inc = _halves(spark, sf_dir)
    flags = zs.zscore_flags(inc, bl.baseline_moments(base))
    return flags.select(
        "event_id", "patient_id", F.col("n_anomalous").cast("long").alias("n_anomalous"),
        "is_anomalous",
        F.when(F.col("n_anomalous") > 0, F.array_join("anomalous_fields", ",")).alias("anomalous_fields"),
        "max_zscore")


# ---------------------------------------------------------------- E3
@register("zscore_summary", sql=f"""
WITH {sg.stats_cte()}, {sg.z_cte()},
fl AS (SELECT COUNT(DISTINCT event_id) AS flagged_events FROM zl WHERE z > 3),
tt AS (SELECT COUNT(*) AS total_events FROM inc)
SELECT tt.total_events, fl.flagged_events,
       CASE WHEN tt.total_events > 0 THEN ROUND(CAST(fl.flagged_events AS DOUBLE) / tt.total_events, 3)
            ELSE CAST(0 AS DOUBLE) END AS flag_rate,
       fl.flagged_events > 0 AS fault_detected
FROM tt, fl
""", views=("base", "inc"))
def q_zscore_summary(spark, sf_dir):
    base, inc = _halves(spark, sf_dir)
    return zs.zscore_summary(zs.zscore_flags(inc, bl.baseline_moments(base)))


@register("zscore_by_field", sql=f"""
WITH {sg.stats_cte()}, {sg.z_cte()}
SELECT field, COUNT(*) AS count, ROUND(MAX(ROUND(z, 2)), 2) AS max_zscore,
       ROUND(AVG(ROUND(z, 2)), 2) AS avg_zscore
FROM zl WHERE z > 3 GROUP BY field
""", views=("base", "inc"))
def q_zscore_by_field(spark, sf_dir):
    base, inc = _halves(spark, sf_dir)
    return zs.zscore_by_field(zs.zscore_flags(inc, bl.baseline_moments(base)))


# ---------------------------------------------------------------- E4
def ks_ctes(inc: str = "inc") -> str:
    return f"""{sg.stats_cte()},
s AS ({sg.melt('base', flag='1 AS a')}
UNION ALL {sg.melt(inc, flag='0 AS a')}),
g AS (SELECT field, v, CAST(SUM(a) AS DOUBLE) AS na, CAST(SUM(1 - a) AS DOUBLE) AS nb FROM s GROUP BY field, v),
c AS (SELECT field, SUM(na) OVER (PARTITION BY field ORDER BY v) / SUM(na) OVER (PARTITION BY field) AS fa,
             SUM(nb) OVER (PARTITION BY field ORDER BY v) / SUM(nb) OVER (PARTITION BY field) AS fb,
             SUM(na) OVER (PARTITION BY field) AS n, SUM(nb) OVER (PARTITION BY field) AS m FROM g),
d AS (SELECT field, MAX(ABS(fa - fb)) AS ks, MAX(n) AS n, MAX(m) AS m FROM c GROUP BY field
      HAVING MAX(m) >= 10 AND MAX(n) > 0),
mn AS (SELECT field, SUM(v * nb) / SUM(nb) AS inc_mean FROM g GROUP BY field),
l AS (SELECT field, ks, n, m, ks * SQRT(n * m / (n + m)) AS lam FROM d),
p AS (SELECT field, ks, n, m, {sg.ks_p('lam')} AS p FROM l)"""


KS_CTES = ks_ctes()

_KS_SQL = f"""
WITH {KS_CTES}
SELECT p.field, ROUND(ks, 4) AS ks_statistic, ROUND(p, 6) AS p_value, p < CAST(0.0001 AS DOUBLE) AS drifted,
       CAST(n AS BIGINT) AS n_baseline, CAST(m AS BIGINT) AS n_incoming,
       ROUND(inc_mean, 2) AS incoming_mean, ROUND(st.mean, 2) AS baseline_mean,
       ROUND(inc_mean - st.mean, 2) AS mean_shift
FROM p JOIN mn ON p.field = mn.field JOIN st ON p.field = st.field
"""


@register("ks_drift", sql=_KS_SQL, views=("base", "inc"))
def q_ks_drift(spark, sf_dir):
    from healthwatch.operators import ks
    base, inc = _halves(spark, sf_dir)
    stats, hist = bl.fit(base, quantiles=False)     # one scan of the clean half
    return ks.ks_drift(inc, hist, base_stats=stats)


# ---------------------------------------------------------------- E5-E7
_P = sg.present_list()
SCHEMA_ROWS = f"""
sc AS (SELECT event_id, {sg.contract_cols(_P, 'v1', fields.CONTRACT_V1)},
              {sg.contract_cols(_P, 'v2', fields.CONTRACT_V2)} FROM {{view}}),
sb AS (SELECT event_id, CASE WHEN d_v1 <= d_v2 THEN 'v1' ELSE 'v2' END AS best_schema,
              LEAST(d_v1, d_v2) AS distance,
              CASE WHEN d_v1 <= d_v2 THEN rate_v1 ELSE rate_v2 END AS match_rate,
              CASE WHEN d_v1 <= d_v2 THEN miss_v1 ELSE miss_v2 END AS missing_fields,
              CASE WHEN d_v1 <= d_v2 THEN extra_v1 ELSE extra_v2 END AS extra_fields,
              LEAST(d_v1, d_v2) > CAST(0.15 AS DOUBLE) AS anomaly_detected, d_v1, d_v2 FROM sc)
"""


@register("schema_distance", sql="WITH " + SCHEMA_ROWS.format(view="vitals") +
          "SELECT event_id, d_v1, d_v2 FROM sb", views=("vitals",))
def q_schema_distance(spark, sf_dir):
    from healthwatch.operators import schema_drift as sd
    return sd.schema_check(fx.vitals(spark, sf_dir)).select("event_id", "d_v1", "d_v2")


@register("schema_best_match", sql="WITH " + SCHEMA_ROWS.format(view="mixed") + f"""
SELECT event_id, best_schema, distance, match_rate, anomaly_detected,
       {sg.joined('missing_fields')} AS missing_fields, {sg.joined('extra_fields')} AS extra_fields FROM sb""",
          views=("mixed",))
def q_schema_best_match(spark, sf_dir):
    from healthwatch.functions.columns import join_or_null
    from healthwatch.operators import schema_drift as sd
    return sd.schema_check(fx.mixed(spark, sf_dir)).select(
        "event_id", "best_schema", "distance", "match_rate", "anomaly_detected",
        join_or_null(F.col("missing_fields")).alias("missing_fields"),
        join_or_null(F.col("extra_fields")).alias("extra_fields"))


@register("schema_summary", sql="WITH " + SCHEMA_ROWS.format(view="vitals") + """
SELECT COUNT(*) AS total_events, COUNT(*) FILTER (WHERE anomaly_detected) AS flagged_events,
       CASE WHEN COUNT(*) > 0 THEN ROUND(CAST(COUNT(*) FILTER (WHERE anomaly_detected) AS DOUBLE) / COUNT(*), 3)
            ELSE CAST(0 AS DOUBLE) END AS flag_rate,
       COUNT(*) FILTER (WHERE anomaly_detected) > 0 AS fault_detected FROM sb""", views=("vitals",))
def q_schema_summary(spark, sf_dir):
    from healthwatch.operators import schema_drift as sd
    return sd.schema_summary(sd.schema_check(fx.vitals(spark, sf_dir)))


@register("schema_field_counts", sql="WITH " + SCHEMA_ROWS.format(view="vitals") + """
SELECT kind, field, COUNT(*) AS count FROM (
  SELECT 'missing' AS kind, unnest(missing_fields) AS field FROM sb WHERE anomaly_detected
  UNION ALL SELECT 'extra' AS kind, unnest(extra_fields) AS field FROM sb WHERE anomaly_detected) q
GROUP BY kind, field""", views=("vitals",))
def q_schema_field_counts(spark, sf_dir):
    from healthwatch.operators import schema_drift as sd
    return sd.schema_field_counts(sd.schema_check(fx.vitals(spark, sf_dir)))
