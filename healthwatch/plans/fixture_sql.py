"""The derived views of ``sources.fixtures`` as SQL text for the DuckDB
oracle.  ``with_views(sql, names)`` prefixes a query with the CTEs it needs so
each oracle string runs on the pre-registered base tables alone."""

from __future__ import annotations

import re

from healthwatch.sources.fixtures import LOG_LINES, STATEMENTS

VIEWS: dict[str, str] = {}

VIEWS["vitals"] = """
SELECT 'EV-' || CAST(i AS VARCHAR(20)) AS event_id,
       CASE WHEN slot BETWEEN 21 AND 24 THEN 'PT-ATTACKER-0000'
            ELSE 'PT-' || lpad(CAST(user_id AS VARCHAR(20)), CAST(greatest(4, length(CAST(user_id AS VARCHAR(20)))) AS INTEGER), '0') END AS patient_id,
       CASE event_type WHEN 'error' THEN 'ICU' WHEN 'click' THEN 'CARDIO' WHEN 'view' THEN 'NEURO' ELSE 'GENERAL' END AS ward,
       CASE WHEN slot BETWEEN 11 AND 20 THEN CAST(2200 + i * 7919 % 801 AS DOUBLE)
            ELSE CAST(600 + i * 7919 % 401 AS DOUBLE) END / CAST(10 AS DOUBLE) AS heart_rate,
       CASE WHEN slot BETWEEN 11 AND 20 THEN CAST(2000 + i * 6007 % 801 AS DOUBLE)
            ELSE CAST(900 + i * 6007 % 501 AS DOUBLE) END / CAST(10 AS DOUBLE) AS bp_systolic,
       CAST(600 + i * 5501 % 301 AS DOUBLE) / CAST(10 AS DOUBLE) AS bp_diastolic,
       CASE WHEN slot BETWEEN 3 AND 4 THEN CAST(NULL AS DOUBLE)
            WHEN slot BETWEEN 11 AND 20 THEN CAST(300 + i * 4409 % 301 AS DOUBLE) / CAST(10 AS DOUBLE)
            ELSE CAST(950 + i * 4409 % 51 AS DOUBLE) / CAST(10 AS DOUBLE) END AS spo2,
       CAST(361 + i * 3307 % 18 AS DOUBLE) / CAST(10 AS DOUBLE) AS temperature_c,
       CAST(120 + i * 2203 % 81 AS DOUBLE) / CAST(10 AS DOUBLE) AS respiratory_rate,
       CASE WHEN slot BETWEEN 3 AND 4 THEN 'ICD-' || CAST(1000 + i % 9000 AS VARCHAR(20)) END AS diagnosis_code,
       ts
FROM (SELECT event_id AS i, ts, user_id, event_type,
             CASE WHEN ts >= CAST('2024-01-16 00:00:00' AS TIMESTAMP) THEN event_id % 100 ELSE -1 END AS slot
      FROM events) e
"""

VIEWS["base"] = "SELECT * FROM vitals WHERE ts < CAST('2024-01-16 00:00:00' AS TIMESTAMP)"
VIEWS["inc"] = "SELECT * FROM vitals WHERE ts >= CAST('2024-01-16 00:00:00' AS TIMESTAMP)"

VIEWS["telemetry"] = """
SELECT date_trunc('hour', ts) AS ts,
       CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS consumer_lag,
       MAX(value) / CAST(100 AS DOUBLE) AS db_latency_sec,
       CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / (COUNT(*) * 100) AS cpu_percent,
       CAST(COUNT(DISTINCT user_id) AS DOUBLE) AS memory_percent
FROM events GROUP BY date_trunc('hour', ts)
"""

VIEWS["offsets"] = """
SELECT 'ehr-stream' AS topic, CAST(user_id % 4 AS INTEGER) AS partition_id,
       CAST(CASE WHEN user_id % 4 = 3 THEN -1 ELSE SUM(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) END AS BIGINT) AS committed,
       COUNT(*) AS high
FROM events GROUP BY user_id % 4
"""

VIEWS["evaluation"] = """
SELECT event_id + 1 AS run,
       CASE event_id % 5 WHEN 0 THEN 'schema' WHEN 1 THEN 'data_quality' WHEN 2 THEN 'performance' WHEN 3 THEN 'security' ELSE 'stall' END AS fault_type,
       concat_ws(',', CASE WHEN event_id % 5 = 1 THEN 'zscore' END, CASE WHEN event_id % 5 = 1 OR event_id % 7 = 0 THEN 'ks_test' END,
                 CASE WHEN event_id % 5 = 0 THEN 'schema_entropy' END, CASE WHEN event_id % 5 = 4 THEN 'stall' END) AS detectors_fired,
       event_id % 6 <> 0 AS remediation_success, value / CAST(100 AS DOUBLE) AS mttr_seconds
FROM events
"""

VIEWS["incidents"] = """
SELECT 'INC-' || CAST(user_id AS VARCHAR(20)) AS log_id, CASE WHEN COUNT(*) > 60 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
       CASE WHEN user_id % 4 = 0 THEN 'STILL_ANOMALOUS' ELSE 'STEADY_STATE' END AS validation_status,
       MIN(ts) AS fault_start, MAX(ts) AS fix_end,
       CASE WHEN user_id % 10 = 0 THEN CAST(NULL AS DOUBLE) WHEN user_id % 10 = 1 THEN CAST(0 AS DOUBLE) ELSE MAX(value) END AS mttr_seconds
FROM events GROUP BY user_id
"""

def _text_list(texts: list[str]) -> str:
    """DuckDB list literal; control characters are written with chr()."""
    def literal(t: str) -> str:
        parts = re.split(r"([\x00-\x1f])", t)
        return " || ".join(f"chr({ord(x)})" if len(x) == 1 and ord(x) < 32 else "'" + x.replace("'", "''") + "'" for x in parts if x) or "''"
    return "[" + ", ".join(literal(t) for t in texts) + "]"


VIEWS["statements"] = f"""
SELECT event_id AS stmt_id, {_text_list(STATEMENTS)}[event_id % {len(STATEMENTS)} + 1] AS sql FROM events
"""

VIEWS["raw"] = """
SELECT event_id, CASE WHEN CAST(substr(event_id, 4) AS BIGINT) % 97 = 0 THEN substr(j, 1, length(j) - 1) ELSE j END AS raw, ts
FROM (SELECT event_id, ts, '{' || concat_ws(',', '"event_id":"' || event_id || '"', '"patient_id":"' || patient_id || '"', '"ward":"' || ward || '"',
        '"heart_rate":' || CAST(heart_rate AS VARCHAR(20)), '"bp_systolic":' || CAST(bp_systolic AS VARCHAR(20)),
        '"bp_diastolic":' || CAST(bp_diastolic AS VARCHAR(20)), '"spo2":' || CAST(spo2 AS VARCHAR(20)),
        '"temperature_c":' || CAST(temperature_c AS VARCHAR(20)), '"respiratory_rate":' || CAST(respiratory_rate AS VARCHAR(20)),
        '"diagnosis_code":"' || diagnosis_code || '"', '"timestamp":"' || CAST(ts AS VARCHAR(40)) || '"') || '}' AS j FROM vitals) q
"""

VIEWS["topic"] = VIEWS["raw"].replace("CAST(spo2 AS VARCHAR(20))",
                                      "coalesce(CAST(spo2 AS VARCHAR(20)), CASE WHEN CAST(substr(event_id, 4) AS BIGINT) % 2 = 0 THEN 'null' END)")

VIEWS["log_lines"] = f"""
SELECT event_id AS line_no, {_text_list(LOG_LINES)}[event_id % {len(LOG_LINES)} + 1] AS line FROM events
"""

VIEWS["rush"] = """
SELECT * REPLACE (CASE WHEN patient_id = 'PT-ATTACKER-0000'
  THEN CAST('2024-01-16 00:00:00' AS TIMESTAMP) + to_milliseconds(CAST(substr(event_id, 4) AS BIGINT) % 2500) ELSE ts END AS ts) FROM vitals
"""

_NO = "CAST(substr(event_id, 4) AS BIGINT)"
VIEWS["mixed"] = f"""
SELECT * REPLACE (CASE WHEN {_NO} % 11 = 0 THEN 'LOBBY' ELSE ward END AS ward,
  CASE WHEN {_NO} % 17 = 0 THEN CAST(-5 AS DOUBLE) WHEN {_NO} % 17 = 1 THEN CAST(301.5 AS DOUBLE) ELSE heart_rate END AS heart_rate,
  CASE WHEN {_NO} % 19 = 0 THEN CAST(100.5 AS DOUBLE) ELSE spo2 END AS spo2,
  CASE WHEN {_NO} % 23 = 0 THEN CAST(12.5 AS DOUBLE) WHEN {_NO} % 23 <> 1 THEN temperature_c END AS temperature_c,
  CASE WHEN {_NO} % 2 <> 0 THEN respiratory_rate END AS respiratory_rate) FROM vitals
"""

VIEWS["crowded"] = """
SELECT event_id, CASE WHEN event_id % 10 < 3 THEN 'PT-ATTACKER-0000' WHEN event_id % 10 = 3 THEN 'PT-GATEWAY-0001'
                      ELSE 'PT-' || CAST(event_id AS VARCHAR(20)) END AS patient_id, ts FROM events
"""

# Views that depend on other views.
DEPENDS = {"base": ["vitals"], "inc": ["vitals"], "raw": ["vitals"], "topic": ["vitals"], "rush": ["vitals"], "mixed": ["vitals"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs for ``names`` (and their dependencies)."""
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
