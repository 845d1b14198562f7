"""Registered source/sink and predicate queries (A*, B*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from healthwatch.functions import fields as fd
from healthwatch.functions import predicates as pr
from healthwatch.operators.schema_drift import present_fields
from healthwatch.plans import sqlgen as sg
from healthwatch.plans.registry import register
from healthwatch.session import scratch_path
from healthwatch.sources import events as ev
from healthwatch.sources import fixtures as fx

_DEC_COLS = ["event_id", "patient_id", "ward"] + fd.NUMERIC_FIELDS + ["diagnosis_code", "timestamp"]


def _json_sql(names=None):
    cols = []
    for c in names or _DEC_COLS:
        if c in fd.NUMERIC_FIELDS:
            cols.append(f"CAST(json_extract(raw, '$.{c}') AS DOUBLE) AS {c}")
        else:
            cols.append(f"json_extract_string(raw, '$.{c}') AS {c}")
    return ", ".join(cols)


# ---------------------------------------------------------------- A1
@register("latest_n_events", sql="SELECT * FROM vitals ORDER BY ts DESC, event_id DESC LIMIT 50",
          views=("vitals",))
def q_latest_n_events(spark, sf_dir):
    """The newest 50 events of the log: each partition is read from ``high -
    50`` on, as offsets rise with time inside a partition."""
    from healthwatch.sources import offset_log as ol
    path = scratch_path(spark, f"topic-{uuid.uuid4().hex[:12]}")
    ol.follow(fx.event_log(spark, sf_dir), path, len(fx.LOG_CUTS) + 1)
    return ev.latest_n(ol.read_log(spark, path, n=50).drop("partition", "offset"), ["ts", "event_id"], 50)


# ---------------------------------------------------------------- A2
@register("decode_events", sql=f"""
SELECT ts, {_json_sql()}, CAST(len(json_keys(raw)) AS INTEGER) AS n_keys
FROM raw WHERE json_valid(raw)""", views=("raw",))
def q_decode_events(spark, sf_dir):
    d = ev.decode_events(fx.raw_events(spark, sf_dir))
    return d.select("ts", *_DEC_COLS, F.size("keys").alias("n_keys"))


# ---------------------------------------------------------------- A4
_A4 = ["patient_id", "heart_rate", "spo2", "bp_systolic", "bp_diastolic", "temperature_c",
       "respiratory_rate", "ward", "ts"]


@register("latest_table_rows", sql=f"SELECT {', '.join(_A4)} FROM vitals ORDER BY ts DESC, event_id DESC LIMIT 100",
          views=("vitals",))
def q_latest_table_rows(spark, sf_dir):
    return ev.latest_n(fx.vitals(spark, sf_dir).select(*_A4, "event_id"), ["ts", "event_id"], 100).drop("event_id")


# ---------------------------------------------------------------- A5
@register("align_to_sink", sql=f"""
SELECT {_json_sql([f.name for f in ev.SINK_SCHEMA.fields])}
FROM raw WHERE json_valid(raw)""", views=("raw",))
def q_align_to_sink(spark, sf_dir):
    return ev.align_to_schema(ev.decode_events(fx.raw_events(spark, sf_dir)), ev.SINK_SCHEMA)


# ---------------------------------------------------------------- A6
@register("iot_projection", sql="SELECT patient_id, heart_rate, spo2, ts AS timestamp FROM vitals",
          views=("vitals",))
def q_iot_projection(spark, sf_dir):
    return ev.iot_projection(fx.vitals(spark, sf_dir))


# ---------------------------------------------------------------- A7
@register("row_count", sql="SELECT COUNT(*) AS row_count FROM vitals", views=("vitals",))
def q_row_count(spark, sf_dir):
    return ev.row_count(fx.vitals(spark, sf_dir))


# ---------------------------------------------------------------- A8
@register("topic_total", sql="SELECT topic, CAST(SUM(high) AS BIGINT) AS total_messages FROM offsets GROUP BY topic",
          views=("offsets",))
def q_topic_total(spark, sf_dir):
    return ev.topic_total(fx.offsets(spark, sf_dir))


# ---------------------------------------------------------------- A10
@register("telemetry_series", sql="SELECT * FROM telemetry", views=("telemetry",))
def q_telemetry_series(spark, sf_dir):
    """Appended to a JSON-lines log in two parts and read back."""
    tel = fx.telemetry(spark, sf_dir)
    cut = F.lit(fx.INC_START).cast("timestamp_ntz")
    return _through_jsonl(spark, "telemetry", [tel.filter(F.col("ts") < cut), tel.filter(F.col("ts") >= cut)])


def _through_jsonl(spark, name, parts):
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    for part in parts:
        ev.write_jsonl(part, path)
    return ev.read_jsonl(spark, path, parts[0].schema)


# ---------------------------------------------------------------- A12
@register("incident_records", sql="SELECT * FROM incidents", views=("incidents",))
def q_incident_records(spark, sf_dir):
    inc = fx.incidents(spark, sf_dir)
    solved = F.col("validation_status") == "STEADY_STATE"
    return _through_jsonl(spark, "incidents", [inc.filter(solved), inc.filter(~solved)])


# ---------------------------------------------------------------- B1
@register("present_fields", sql=f"""
SELECT event_id, array_to_string({sg.present_list()}, ',') AS present,
       CAST(len({sg.present_list()}) AS INTEGER) AS n_present FROM vitals""", views=("vitals",))
def q_present_fields(spark, sf_dir):
    v = fx.vitals(spark, sf_dir)
    return v.select("event_id", present_fields(v).alias("p")).select(
        "event_id", F.array_join("p", ",").alias("present"), F.size("p").alias("n_present"))


# ---------------------------------------------------------------- B2
@register("suspicious_count", sql="""
SELECT COUNT(*) FILTER (WHERE spo2 IS NULL OR diagnosis_code IS NOT NULL OR COALESCE(heart_rate, 80) > 200
                        OR COALESCE(patient_id = 'PT-ATTACKER-0000', false)) AS suspicious_events,
       COUNT(*) AS total_events FROM vitals""", views=("vitals",))
def q_suspicious_count(spark, sf_dir):
    return fx.vitals(spark, sf_dir).agg(F.count_if(pr.suspicious()).alias("suspicious_events"),
                   F.count(F.lit(1)).alias("total_events"))


# ---------------------------------------------------------------- B3
_KNOWN = sg.sql_list(fd.DASHBOARD_KNOWN_FIELDS)


@register("row_anomaly_flag", sql=f"""
SELECT event_id, (spo2 IS NULL
   OR len(list_filter({sg.present_list()}, lambda x: NOT list_contains({_KNOWN}, x))) > 0
   OR COALESCE(heart_rate > 200, false) OR COALESCE(spo2 < 70, false)
   OR COALESCE(patient_id = 'PT-ATTACKER-0000', false)) AS anomalous FROM vitals""", views=("vitals",))
def q_row_anomaly_flag(spark, sf_dir):
    v = fx.vitals(spark, sf_dir)
    return v.select("event_id", pr.row_anomaly(present_fields(v)).alias("anomalous"))


# ---------------------------------------------------------------- B4
@register("unknown_fields", sql=f"""
SELECT DISTINCT k AS field FROM (SELECT unnest(json_keys(raw)) AS k FROM raw WHERE json_valid(raw)) q
WHERE NOT list_contains({_KNOWN}, k)""", views=("raw",))
def q_unknown_fields(spark, sf_dir):
    r = fx.raw_events(spark, sf_dir)
    keys = r.select(F.explode(F.json_object_keys("raw")).alias("field"))
    return keys.filter(~F.col("field").isin(fd.DASHBOARD_KNOWN_FIELDS)).distinct()


# ---------------------------------------------------------------- B5
def _r1(c):
    return f"CAST(ROUND({c}, 1) AS VARCHAR)"


@register("display_rows", sql=f"""
SELECT event_id, COALESCE(patient_id, '') AS patient_id, COALESCE({_r1('heart_rate')}, '—') AS heart_rate,
       COALESCE({_r1('spo2')}, 'MISSING') AS spo2,
       CASE WHEN bp_systolic IS NOT NULL AND bp_systolic <> 0 THEN {_r1('bp_systolic')} ELSE '—' END AS bp_systolic,
       CASE WHEN respiratory_rate IS NOT NULL AND respiratory_rate <> 0 THEN {_r1('respiratory_rate')} ELSE '—' END AS resp_rate,
       COALESCE(ward, '') AS ward FROM vitals""", views=("vitals",))
def q_display_rows(spark, sf_dir):
    return pr.display_rows(fx.vitals(spark, sf_dir), keep=["event_id"])


# ---------------------------------------------------------------- B6
@register("impossible_vitals", sql="""
SELECT event_id, heart_rate, bp_systolic, spo2 FROM vitals
WHERE heart_rate > 200 OR bp_systolic > 180 OR spo2 < 70""", views=("vitals",))
def q_impossible_vitals(spark, sf_dir):
    return fx.vitals(spark, sf_dir).filter(pr.impossible()) \
             .select("event_id", "heart_rate", "bp_systolic", "spo2")


# ---------------------------------------------------------------- B7
def _violations_sql():
    items = []
    for f in fd.CONTRACT_REQUIRED:
        c = "ts" if f == "timestamp" else f
        items.append(f"CASE WHEN {c} IS NULL THEN 'required:{f}' END")
    for f, allowed in fd.CONTRACT_ENUMS.items():
        items.append(f"CASE WHEN NOT {f} IN ({', '.join(repr(a) for a in allowed)}) THEN 'enum:{f}' END")
    for f, (lo, hi) in fd.CONTRACT_BOUNDS.items():
        items.append(f"CASE WHEN {f} < {lo} THEN 'min:{f}' END")
        items.append(f"CASE WHEN {f} > {hi} THEN 'max:{f}' END")
    return f"list_sort(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL))"


@register("contract_violations", sql=f"""
SELECT event_id, array_to_string(v, ',') AS violations, CAST(len(v) AS INTEGER) AS n_violations
FROM (SELECT event_id, {_violations_sql()} AS v FROM mixed) q WHERE len(v) > 0""", views=("mixed",))
def q_contract_violations(spark, sf_dir):
    v = fx.mixed(spark, sf_dir)
    return (v.select("event_id", pr.contract_violations(v).alias("v"))
             .filter(F.size("v") > 0)
             .select("event_id", F.array_join("v", ",").alias("violations"),
                     F.size("v").alias("n_violations")))


# ---------------------------------------------------------------- B8
@register("range_violations", sql="\nUNION ALL ".join(
    f"SELECT '{f}' AS field, COUNT({f}) AS n_checked, "
    f"COUNT(*) FILTER (WHERE NOT {f} BETWEEN {lo} AND {hi}) AS n_outside FROM vitals"
    for f, (lo, hi) in fd.NORMAL_RANGES.items()), views=("vitals",))
def q_range_violations(spark, sf_dir):
    return pr.range_violations(fx.vitals(spark, sf_dir))


# ---------------------------------------------------------------- B9
def _classify_sql(col):
    expr = "'plain'"
    for name, pats in reversed(fd.LOG_TAGS):
        cond = " OR ".join(f"contains({col}, '{p}')" for p in pats)
        expr = f"CASE WHEN {cond} THEN '{name}' ELSE {expr} END"
    return expr


@register("classify_log_lines", sql=f"""
SELECT line_no, t AS line, {_classify_sql('t')} AS category
FROM (SELECT line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM log_lines) q WHERE t <> ''""", views=("log_lines",))
def q_classify_log_lines(spark, sf_dir):
    return pr.classify_log_lines(fx.log_lines(spark, sf_dir))
