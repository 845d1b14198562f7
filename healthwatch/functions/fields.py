"""Domain constants of the vitals event stream.

Fixed values: these must equal the monitored pipeline's own definitions for
results to agree (field names, contracts, ranges, thresholds, ids).
"""

# --- fixed values ---------------------------------------------------------
NUMERIC_FIELDS = [
    "heart_rate", "bp_systolic", "bp_diastolic",
    "spo2", "temperature_c", "respiratory_rate",
]

EVENT_FIELDS = [
    "event_id", "patient_id", "ward", "heart_rate", "bp_systolic",
    "bp_diastolic", "spo2", "temperature_c", "respiratory_rate", "timestamp",
]

# Schema contracts: property names per version (v2 = v1 + respiratory_rate).
CONTRACT_V1 = [
    "event_id", "patient_id", "ward", "heart_rate", "bp_systolic",
    "bp_diastolic", "spo2", "temperature_c", "timestamp",
]
CONTRACT_V2 = CONTRACT_V1 + ["respiratory_rate"]
CONTRACTS = [("v1", CONTRACT_V1), ("v2", CONTRACT_V2)]

# Declared (never enforced upstream) contract rules.
CONTRACT_REQUIRED = list(CONTRACT_V1)
CONTRACT_ENUMS = {"ward": ["ICU", "GENERAL", "CARDIO", "NEURO"]}
CONTRACT_BOUNDS = {
    "heart_rate": (0, 300),
    "bp_systolic": (0, 300),
    "bp_diastolic": (0, 200),
    "spo2": (0, 100),
    "temperature_c": (30, 45),
    "respiratory_rate": (0, 100),
}

# Physiological normal ranges.
NORMAL_RANGES = {
    "heart_rate": (60, 100),
    "bp_systolic": (90, 140),
    "bp_diastolic": (60, 90),
    "spo2": (95, 100),
    "temperature_c": (36.1, 37.8),
    "respiratory_rate": (12, 20),
}

WARDS = ["ICU", "GENERAL", "CARDIO", "NEURO"]

ATTACKER_ID = "PT-ATTACKER-0000"

ZSCORE_THRESHOLD = 3.0
KS_ALPHA = 0.0001
KS_MIN_SAMPLES = 10
SCHEMA_THRESHOLD = 0.15
DENYLIST_MIN_EVENTS = 5          # alert when count > 5
HOT_KEY_SHARE = 0.20
BURST_EVENTS = 50
BURST_SECONDS = 3
STALL_SECONDS = 30
LATENCY_SECONDS = 3.0
LATENCY_PACKET_MS = 1000

# Keys the dashboard treats as known (it adds inserted_at to the event keys).
DASHBOARD_KNOWN_FIELDS = EVENT_FIELDS + ["inserted_at"]

# Impossible-vitals repair predicate: hr > 200 OR bp_systolic > 180 OR spo2 < 70.
IMPOSSIBLE_HR = 200
IMPOSSIBLE_BP = 180
IMPOSSIBLE_SPO2 = 70

# Jitter imputation: base + (h % modulus) / 10 per column.
JITTER = {
    "heart_rate": (78, 6),
    "bp_systolic": (115, 10),
    "spo2": (96, 30),
}

# Constant imputation (runbook form).
CONSTANT_FILL = {"heart_rate": 80.0, "bp_systolic": 120.0, "spo2": 97.6}

# Health score weights and bands.
HEALTH_WEIGHTS = {"zscore": 2, "drift": 5, "schema": 3}
HEALTH_BANDS = (40, 70)

# Histogram bin caps.
HIST_BINS = {"heart_rate": 25, "spo2": 15, "bp_systolic": 15}

# Detector -> affected components.
DETECTOR_COMPONENTS = [
    (["isolation_forest", "zscore", "ks_test"], ["Kafka_Consumer", "Databricks_Warehouse"]),
    (["schema_entropy"], ["Data_Producer", "Kafka_Topic_ehr-stream"]),
    (["security"], ["Kafka_Topic_ehr-stream", "Databricks_Warehouse"]),
    (["latency_monitor", "warehouse_monitor"], ["Databricks_Warehouse"]),
    (["stall"], ["Kafka_Consumer", "Kafka_Connect"]),
]
UNKNOWN_COMPONENT = "Unknown_Component"

# Completion goals per signal: substring rules, first match wins.
GOAL_RULES = [
    (["schema_entropy"], "spo2 NULLs are fixed"),
    (["zscore", "ks_test"], "heart_rate/BP outliers are imputed"),
    (["warehouse_monitor", "latency"], "the Discord webhook is successfully fired"),
    (["security"], "attacker records are completely purged"),
]
GOAL_FALLBACK = "all signals are resolved"

# Fault-type ground truth for the evaluation harness.
GROUND_TRUTH = {
    "schema": "schema_entropy",
    "data_quality": "ks_test",
    "performance": "zscore",
    "security": "zscore",
    "stall": "stall",
}

# SQL audit: blocked patterns and reasons, first match wins.
BLOCKED_SQL = [
    (r"\bDROP\s+TABLE\b", "DROP TABLE is permanently blocked"),
    (r"\bDROP\s+DATABASE\b", "DROP DATABASE is permanently blocked"),
    (r"\bTRUNCATE\b", "TRUNCATE is permanently blocked"),
    (r"\bDROP\s+SCHEMA\b", "DROP SCHEMA is permanently blocked"),
    (r"\bDELETE\b(?!.*\bWHERE\b)", "DELETE without WHERE clause is blocked"),
    (r"\bALTER\s+USER\b", "ALTER USER is blocked"),
    (r"\bGRANT\b", "GRANT is blocked"),
    (r"\bREVOKE\b", "REVOKE is blocked"),
    (r"\bCREATE\s+USER\b", "CREATE USER is blocked"),
    (r"\bEXEC\b", "EXEC is blocked"),
    (r"\bXP_\w+", "Extended procedures are blocked"),
]
ALLOWED_SQL_PREFIXES = [
    "SELECT", "INSERT", "UPDATE", "DELETE", "ALTER TABLE", "CREATE TABLE",
    "DESCRIBE", "SHOW",
]

# Agent log tags in display order.
LOG_TAGS = [
    ("observe", ["[OBSERVE]"]),
    ("orient", ["[ORIENT]", "[DETECT]"]),
    ("decide", ["[DECIDE]"]),
    ("act", ["[ACT]", "[AGENT]"]),
    ("success", ["SUCCESS"]),
    ("error", ["ERROR", "FAILED"]),
    ("final", ["Final Answer"]),
]
# --- end fixed values -----------------------------------------------------
