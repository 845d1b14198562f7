"""Registered repair, validation, audit and incident queries (G1-G13, D7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from healthwatch.operators import alerts as al
from healthwatch.operators import audit as au
from healthwatch.operators import baseline as bl
from healthwatch.operators import metrics as mt
from healthwatch.operators import remediate as rm
from healthwatch.plans.q_triage import PLAN_SELECT, alert_ctes
from healthwatch.plans.registry import register
from healthwatch.sources import events as ev
from healthwatch.sources import fixtures as fx

ATT = "PT-ATTACKER-0000"


def _halves(spark, sf_dir):
    return fx.split_base_inc(fx.vitals(spark, sf_dir))


def _h(col="patient_id"):
    return f"('0x' || substr(md5({col}), 1, 8))::BIGINT"


def _jit(base, mod):
    return f"({base} + ({_h()} % {mod}) / CAST(10 AS DOUBLE))"


_IMP = "COALESCE(heart_rate > 200 OR bp_systolic > 180 OR spo2 < 70, false)"


# ---------------------------------------------------------------- G1
@register("impute_spo2", sql=f"SELECT event_id, COALESCE(spo2, {_jit(96, 30)}) AS spo2 FROM vitals", views=("vitals",))
def q_impute_spo2(spark, sf_dir):
    return rm.impute_null(fx.vitals(spark, sf_dir), "spo2", method="md5").select("event_id", "spo2")


# ---------------------------------------------------------------- G2
@register("impute_vitals", sql=f"""
SELECT event_id, CASE WHEN {_IMP} THEN {_jit(78, 6)} ELSE heart_rate END AS heart_rate,
       CASE WHEN {_IMP} THEN {_jit(115, 10)} ELSE bp_systolic END AS bp_systolic,
       CASE WHEN {_IMP} THEN {_jit(96, 30)} ELSE spo2 END AS spo2 FROM vitals""", views=("vitals",))
def q_impute_vitals(spark, sf_dir):
    return rm.impute_impossible(fx.vitals(spark, sf_dir), method="md5") \
             .select("event_id", "heart_rate", "bp_systolic", "spo2")


# ---------------------------------------------------------------- G3
@register("impute_constant", sql="""
SELECT event_id,
       CASE WHEN COALESCE(heart_rate > 200 OR bp_systolic > 180, false) THEN CAST(80 AS DOUBLE) ELSE heart_rate END AS heart_rate,
       CASE WHEN COALESCE(heart_rate > 200 OR bp_systolic > 180, false) THEN CAST(120 AS DOUBLE) ELSE bp_systolic END AS bp_systolic,
       COALESCE(spo2, CAST(97.6 AS DOUBLE)) AS spo2 FROM vitals""", views=("vitals",))
def q_impute_constant(spark, sf_dir):
    return rm.impute_constant(fx.vitals(spark, sf_dir)).select("event_id", "heart_rate", "bp_systolic", "spo2")


# ---------------------------------------------------------------- G4
@register("delete_impossible", sql=f"SELECT event_id, heart_rate, bp_systolic, spo2 FROM vitals WHERE NOT {_IMP}",
          views=("vitals",))
def q_delete_impossible(spark, sf_dir):
    return rm.drop_impossible(fx.vitals(spark, sf_dir)).select("event_id", "heart_rate", "bp_systolic", "spo2")


# ---------------------------------------------------------------- G5
@register("quarantine", sql=f"""
SELECT event_id, patient_id, COALESCE(patient_id = '{ATT}', false) AS removed FROM vitals""", views=("vitals",))
def q_quarantine(spark, sf_dir):
    kept, removed = rm.quarantine(fx.vitals(spark, sf_dir), f"  '{ATT}' ")
    both = kept.withColumn("removed", F.lit(False)).unionByName(removed.withColumn("removed", F.lit(True)))
    return both.select("event_id", "patient_id", "removed")


# ---------------------------------------------------------------- G6
@register("evolve_schema", sql="""
SELECT json_extract_string(raw, '$.event_id') AS event_id, CAST(json_extract(raw, '$.spo2') AS DOUBLE) AS spo2,
       CAST(NULL AS VARCHAR) AS diagnosis_code
FROM raw WHERE json_valid(raw) AND json_extract(raw, '$.spo2') IS NOT NULL""", views=("raw",))
def q_evolve_schema(spark, sf_dir):
    sink = ev.align_to_schema(ev.decode_events(fx.raw_events(spark, sf_dir)), ev.SINK_SCHEMA)
    return rm.evolve_schema(sink, add={"diagnosis_code": "string"}, drop_null=["spo2"]) \
             .select("event_id", "spo2", "diagnosis_code")


# ---------------------------------------------------------------- G7
@register("fix_impact", sql=f"""
SELECT 'impute_spo2' AS fix, COUNT(*) FILTER (WHERE spo2 IS NULL) AS affected_rows FROM vitals
UNION ALL SELECT 'impute_vitals', COUNT(*) FILTER (WHERE {_IMP}) FROM vitals
UNION ALL SELECT 'delete_impossible', COUNT(*) FILTER (WHERE {_IMP}) FROM vitals
UNION ALL SELECT 'quarantine', COUNT(*) FILTER (WHERE COALESCE(patient_id = '{ATT}', false)) FROM vitals""",
          views=("vitals",))
def q_fix_impact(spark, sf_dir):
    return rm.fix_impact(fx.vitals(spark, sf_dir))


# ---------------------------------------------------------------- G8
# what the plan of the incoming half does: quarantine, jitter, spo2 imputation
_PLANNED = f"""SELECT * REPLACE (CASE WHEN {_IMP} THEN {_jit(78, 6)} ELSE heart_rate END AS heart_rate,
  CASE WHEN {_IMP} THEN {_jit(115, 10)} ELSE bp_systolic END AS bp_systolic,
  COALESCE(CASE WHEN {_IMP} THEN {_jit(96, 30)} ELSE spo2 END, {_jit(96, 30)}) AS spo2) FROM inc
WHERE NOT COALESCE(patient_id = '{ATT}', false)"""


@register("validate_pipeline", sql=f"""
WITH fixed AS ({_PLANNED}), {alert_ctes('fixed', security=False, stall=False)}
SELECT (SELECT COUNT(*) FROM fixed) AS events_checked, (SELECT COUNT(*) FROM alerts) AS n_failures,
       COALESCE((SELECT string_agg(detector, ',' ORDER BY priority) FROM alerts), '') AS failures,
       CASE WHEN (SELECT COUNT(*) FROM alerts) = 0 AND (SELECT COUNT(*) FROM fixed) > 0
            THEN 'STEADY_STATE' ELSE 'STILL_ANOMALOUS' END AS status""", views=("base", "inc"))
def q_validate_pipeline(spark, sf_dir):
    base, inc = _halves(spark, sf_dir)
    kept, _ = rm.quarantine(inc, ATT)
    fixed = rm.repair_vitals(kept, mode="jitter", method="md5")
    out = al.validate(fixed, *bl.fit(base, quantiles=False))
    return out.withColumn("n_failures", F.col("n_failures").cast("long"))


# ---------------------------------------------------------------- G9
def _audit_sql():
    from healthwatch.functions import fields as fd
    expr = "CAST(NULL AS VARCHAR)"
    for pattern, reason in reversed(fd.BLOCKED_SQL):
        if "(?!" in pattern:
            cond = ("len(list_filter(string_split(upper(sql), chr(10)), lambda ln: regexp_matches(ln, '\\bDELETE\\b') "
                    "AND NOT regexp_matches(regexp_extract(ln, '.*\\bDELETE\\b(.*)', 1), '\\bWHERE\\b'))) > 0")
        else:
            cond = f"regexp_matches(sql, '(?i){pattern}')"
        expr = f"CASE WHEN {cond} THEN '{reason}' ELSE {expr} END"
    return f"CASE WHEN sql IS NULL OR regexp_matches(sql, '^\\s*$') THEN '{au.EMPTY_REASON}' ELSE {expr} END"


@register("audit_sql", sql=f"""
SELECT stmt_id, r IS NULL AS approved, COALESCE(r, '{au.APPROVED_REASON}') AS reason
FROM (SELECT stmt_id, {_audit_sql()} AS r FROM statements) q""", views=("statements",))
def q_audit_sql(spark, sf_dir):
    return au.audit_sql(fx.statements(spark, sf_dir)).select("stmt_id", "approved", "reason")


# ---------------------------------------------------------------- G10
@register("clean_statements", sql="""
SELECT stmt_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
         sql, '```sql\\s*', '', 'g'), '```\\s*', '', 'g'), '`', '', 'g'), '^\\s+|\\s+$', '', 'g'), ';+$', '') AS sql
FROM statements""", views=("statements",))
def q_clean_statements(spark, sf_dir):
    s = fx.statements(spark, sf_dir)
    return s.select("stmt_id", au.clean_statement(F.col("sql")).alias("sql"))


# ---------------------------------------------------------------- G11
@register("strip_ansi", sql="""
SELECT line_no, regexp_replace(line, chr(27) || '\\[[0-9;]*m', '', 'g') AS line FROM log_lines""",
          views=("log_lines",))
def q_strip_ansi(spark, sf_dir):
    return fx.log_lines(spark, sf_dir).select("line_no", au.strip_ansi(F.col("line")).alias("line"))


# ---------------------------------------------------------------- G13
@register("mttr_backfill", sql="""
SELECT i.log_id, COALESCE(f.m, i.mttr_seconds) AS mttr_seconds
FROM incidents i LEFT JOIN (
  SELECT log_id, ROUND(CAST(epoch_us(fix_end) - epoch_us(fault_start) AS DOUBLE) / 1000000, 2) AS m
  FROM incidents WHERE validation_status = 'STEADY_STATE') f ON i.log_id = f.log_id""", views=("incidents",))
def q_mttr_backfill(spark, sf_dir):
    """The incidents as a keyed log in 64 buckets, updated in place."""
    import uuid
    from healthwatch.operators import bucket_log as bk
    from healthwatch.session import scratch_path
    path = scratch_path(spark, f"incident-log-{uuid.uuid4().hex[:12]}")
    inc = fx.incidents(spark, sf_dir)
    bk.write_log(inc, path, "log_id")
    fixes = inc.filter(F.col("validation_status") == "STEADY_STATE").select("log_id", "fault_start", "fix_end")
    mt.backfill_log(spark, path, fixes)
    return bk.read_log(spark, path).select("log_id", "mttr_seconds")


# ---------------------------------------------------------------- D7
@register("incident_summary", sql="""
SELECT COUNT(*) AS total_incidents, COUNT(*) FILTER (WHERE validation_status = 'STEADY_STATE') AS resolved,
       ROUND(AVG(CASE WHEN mttr_seconds <> 0 THEN mttr_seconds END), 1) AS avg_mttr,
       MAX(CASE WHEN mttr_seconds <> 0 THEN mttr_seconds END) AS max_mttr,
       MIN(CASE WHEN mttr_seconds <> 0 THEN mttr_seconds END) AS min_mttr FROM incidents""", views=("incidents",))
def q_incident_summary(spark, sf_dir):
    return mt.incident_summary(fx.incidents(spark, sf_dir))


# ---------------------------------------------------------------- G12
def _incident_sql():
    from healthwatch.plans import q_triage as qt
    return f"""WITH fixed AS ({_PLANNED})
SELECT pk.severity, pk.affected_components, pk.fault_signals, ap.actions_taken,
       v.validation_status, v.validation_failures
FROM (WITH {qt.ALERT_CTES} {qt.PACKET_SELECT}) pk,
     (WITH {qt.ALERT_CTES} SELECT string_agg(action, ' | ' ORDER BY step) AS actions_taken
      FROM ({qt.PLAN_SELECT}) q) ap,
     (WITH {alert_ctes('fixed', security=False, stall=False)}
      SELECT CASE WHEN (SELECT COUNT(*) FROM alerts) = 0 AND (SELECT COUNT(*) FROM fixed) > 0
                  THEN 'STEADY_STATE' ELSE 'STILL_ANOMALOUS' END AS validation_status,
             COALESCE((SELECT string_agg(detector, ',' ORDER BY priority) FROM alerts), '') AS validation_failures) v"""


@register("incident_record", sql=_incident_sql(), views=("base", "inc"))
def q_incident_record(spark, sf_dir):
    from healthwatch.operators import triage as tr
    base, inc = _halves(spark, sf_dir)
    stats, hist = bl.fit(base, quantiles=False)
    # the alert table (a few rows) feeds both the packet and the plan: write it once
    from healthwatch.session import write_table
    alerts = write_table(al.detect_all(inc, stats, hist), "alerts")
    plan = tr.action_plan(alerts)
    fixed, _, done = rm.apply_plan(inc, tr.plan_codes(plan), method="md5")
    rec = tr.incident_record(tr.crisis_packet(alerts), plan.filter(F.col("action_code").isin(done)), al.validate(fixed, stats, hist))
    return rec.select("severity", "affected_components", "fault_signals", "actions_taken",
                      "validation_status", "validation_failures")


# ---------------------------------------------------------------- closed loop
# The clean period with a schema fault (spo2 lost, an unknown field) in 1 % of its rows: detect, plan, repair by
# the plan, validate.  The repair restores the steady state.
_GONE = "CAST(substr(event_id, 4) AS BIGINT) % 100 = 3"
_LOST = f"""SELECT * REPLACE (CASE WHEN {_GONE} THEN CAST(NULL AS DOUBLE) ELSE spo2 END AS spo2,
  CASE WHEN {_GONE} THEN 'ICD-1' END AS diagnosis_code) FROM base"""
_RESTORED = f"SELECT * REPLACE (COALESCE(spo2, {_jit(96, 30)}) AS spo2) FROM lost"


@register("closed_loop", sql=f"""
WITH lost AS ({_LOST}), fixed AS ({_RESTORED})
SELECT d.fault_signals, (WITH {alert_ctes('lost', stall=False)} SELECT string_agg(action, ' | ' ORDER BY step) FROM ({PLAN_SELECT}) q
        WHERE action_code IN ('A', 'B', 'D')) AS actions_taken,
       (SELECT COUNT(*) FROM lost WHERE spo2 IS NULL) AS lost_rows, v.validation_status,
       (SELECT COUNT(*) FROM fixed WHERE spo2 IS NULL) AS missing_after
FROM (WITH {alert_ctes('lost', stall=False)} SELECT string_agg(detector, ',' ORDER BY priority) AS fault_signals FROM alerts) d,
     (WITH {alert_ctes('fixed', security=False, stall=False)}
      SELECT CASE WHEN (SELECT COUNT(*) FROM alerts) = 0 THEN 'STEADY_STATE' ELSE 'STILL_ANOMALOUS' END AS validation_status) v""", views=("base",))
def q_closed_loop(spark, sf_dir):
    from healthwatch.operators import triage as tr
    from healthwatch.session import write_table
    base, _ = _halves(spark, sf_dir)
    number = F.substring("event_id", 4, 20).cast("long")
    lost = base.withColumns({"spo2": F.when(number % 100 == 3, F.lit(None).cast("double")).otherwise(F.col("spo2")),
                             "diagnosis_code": F.when(number % 100 == 3, F.lit("ICD-1"))})
    stats, hist = bl.fit(base, quantiles=False)
    alerts = write_table(al.detect_all(lost, stats, hist).filter("detector <> 'stall'"), "alerts")
    plan = tr.action_plan(alerts)
    fixed, _, done = rm.apply_plan(lost, tr.plan_codes(plan), method="md5")
    fixed = write_table(fixed, "repaired")
    rec = tr.incident_record(tr.crisis_packet(alerts), plan.filter(F.col("action_code").isin(done)), al.validate(fixed, stats, hist))
    counts = lost.agg(F.count_if(F.col("spo2").isNull()).alias("lost_rows"))
    after = fixed.agg(F.count_if(F.col("spo2").isNull()).alias("missing_after"))
    from healthwatch.functions.columns import combine_rows
    return combine_rows(rec.select("fault_signals", "actions_taken", "validation_status"), counts, after).select(
        "fault_signals", "actions_taken", "lost_rows", "validation_status", "missing_after")
