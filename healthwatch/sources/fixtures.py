"""Derived views that turn the generic ``events`` table into the monitored
pipeline's inputs: vitals events with planted faults, telemetry, topic
offsets, evaluation runs, incidents, SQL statements, raw JSON and agent log
lines.  All are narrow projections or small group-bys of ``events`` and
grow with it.  ``plans.fixture_sql`` holds the same definitions as SQL text
for the DuckDB oracle.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from healthwatch.functions.fields import ATTACKER_ID
from healthwatch.session import checkpoint_dir
from healthwatch.sources.tables import table

# Rows from this instant on form the incoming half ("inc") of ``vitals``;
# earlier rows are the clean baseline half ("base").
INC_START = "2024-01-16 00:00:00"


def _d(c: Column) -> Column:
    return c.cast("double") / F.lit(10.0)


def _inc_start() -> Column:
    return F.lit(INC_START).cast("timestamp_ntz")


def vitals_from_events(events: DataFrame) -> DataFrame:
    """Map each event to one vitals event; ``event_id % 100`` plants faults in
    the incoming half: 3-4 schema (no spo2, extra diagnosis_code), 11-20 data
    quality (impossible vitals), 21-24 attacker id."""
    i = F.col("i")
    slot = F.col("slot")
    e = events.select(
        F.col("event_id").alias("i"), "ts", "user_id", "event_type",
        F.when(F.col("ts") >= _inc_start(), F.col("event_id") % 100)
         .otherwise(F.lit(-1)).alias("slot"))
    schema_fault = slot.between(3, 4)
    dq_fault = slot.between(11, 20)
    attacker = slot.between(21, 24)
    return e.select(
        F.concat(F.lit("EV-"), i.cast("string")).alias("event_id"),
        F.when(attacker, F.lit("PT-ATTACKER-0000"))
         .otherwise(F.expr("'PT-' || lpad(CAST(user_id AS STRING), "
                           "greatest(4, length(CAST(user_id AS STRING))), '0')"))
         .alias("patient_id"),
        F.when(F.col("event_type") == "error", "ICU")
         .when(F.col("event_type") == "click", "CARDIO")
         .when(F.col("event_type") == "view", "NEURO")
         .otherwise("GENERAL").alias("ward"),
        _d(F.when(dq_fault, 2200 + i * 7919 % 801).otherwise(600 + i * 7919 % 401)).alias("heart_rate"),
        _d(F.when(dq_fault, 2000 + i * 6007 % 801).otherwise(900 + i * 6007 % 501)).alias("bp_systolic"),
        _d(600 + i * 5501 % 301).alias("bp_diastolic"),
        F.when(schema_fault, F.lit(None).cast("double"))
         .when(dq_fault, _d(300 + i * 4409 % 301))
         .otherwise(_d(950 + i * 4409 % 51)).alias("spo2"),
        _d(361 + i * 3307 % 18).alias("temperature_c"),
        _d(120 + i * 2203 % 81).alias("respiratory_rate"),
        F.when(schema_fault, F.concat(F.lit("ICD-"), (1000 + i % 9000).cast("string")))
         .alias("diagnosis_code"),
        "ts",
    )


def materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Write a derived view once per application and folder, then scan it.

    The monitored pipeline reads a stored sink table; deriving it on the fly
    would hand every downstream plan the full derivation expressions (inlined
    again by filter pushdown), which costs seconds of planning per query.
    The table lives in the shared ``spark.checkpoint.dir`` folder, so it
    survives executor loss and is visible to every executor of a cluster."""
    app = spark.sparkContext.applicationId
    key = hashlib.sha1(f"{app}|{os.path.abspath(sf_dir)}|{name}".encode()).hexdigest()[:16]
    path = os.path.join(checkpoint_dir(spark), "views", key)
    if key not in _MATERIALIZED:
        build().write.mode("overwrite").parquet(path)
        _MATERIALIZED.add(key)
    return spark.read.parquet(path)


_MATERIALIZED: set[str] = set()


def vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, sf_dir, "vitals",
                        lambda: vitals_from_events(table(spark, sf_dir, "events")))


def rush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vitals whose attacker events all fall into 2.5 seconds: a planted burst."""
    return rush_of(vitals(spark, sf_dir))


def rush_of(v: DataFrame) -> DataFrame:
    number = F.substring("event_id", 4, 20).cast("long")
    when = F.timestamp_add("MILLISECOND", number % 2500, _inc_start())
    return v.withColumn("ts", F.when(F.col("patient_id") == ATTACKER_ID, when).otherwise(F.col("ts")))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vitals that break every declared rule somewhere, half of them without
    respiratory_rate (the older contract fits these)."""
    v = vitals(spark, sf_dir)
    n = F.substring("event_id", 4, 20).cast("long")
    gone = lambda c, when: F.when(~when, F.col(c))
    return v.withColumns({
        "ward": F.when(n % 11 == 0, F.lit("LOBBY")).otherwise(F.col("ward")),
        "heart_rate": F.when(n % 17 == 0, F.lit(-5.0)).when(n % 17 == 1, F.lit(301.5)).otherwise(F.col("heart_rate")),
        "spo2": F.when(n % 19 == 0, F.lit(100.5)).otherwise(F.col("spo2")),
        "temperature_c": F.when(n % 23 == 0, F.lit(12.5)).otherwise(gone("temperature_c", n % 23 == 1)),
        "respiratory_rate": gone("respiratory_rate", n % 2 == 0)})


def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which 30 % come from one id, 10 % from another, and the rest
    from an id of their own each."""
    i = F.col("event_id")
    key = (F.when(i % 10 < 3, ATTACKER_ID).when(i % 10 == 3, "PT-GATEWAY-0001").otherwise(F.concat(F.lit("PT-"), i.cast("string"))))
    return table(spark, sf_dir, "events").select("event_id", key.alias("patient_id"), "ts")


#: The appends of a log of vitals end at these times; the last ends with the table.
LOG_CUTS = ["2024-01-11 00:00:00", "2024-01-21 00:00:00"]


def event_log(spark: SparkSession, sf_dir: str, name: str = "vitals", cuts: tuple[str, ...] = tuple(LOG_CUTS)) -> str:
    """An offset log of ``vitals`` or ``rush`` (``late``: with repeats and late
    events), written once per application: one append per time slice, then a
    heartbeat a day after the last event, without an id, which lets watermarks
    pass all others.  Returns its folder."""
    from healthwatch.sources import offset_log as ol
    app = spark.sparkContext.applicationId
    key = hashlib.sha1(f"{app}|{os.path.abspath(sf_dir)}|log|{name}|{cuts}".encode()).hexdigest()[:16]
    path = os.path.join(checkpoint_dir(spark), "logs", key)
    if key not in _MATERIALIZED:
        v = vitals(spark, sf_dir)
        rows = rush_of(v) if name == "rush" else v
        ol.create(spark, path, v.schema, partitions=4)
        edges = [None, *cuts, None]
        for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
            part = rows
            if lo:
                part = part.filter(F.col("ts") >= F.lit(lo).cast("timestamp_ntz"))
            if hi:
                part = part.filter(F.col("ts") < F.lit(hi).cast("timestamp_ntz"))
            if name == "late":
                part = part.unionByName(_repeats_and_late(rows, lo))
            ol.append(part, path, "event_id", ["ts", "event_id"])
        beat = rows.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in v.schema.fields if f.name != "ts"]
        ol.append(beat.select("ts", *blank).select(*v.columns), path, "event_id", ["ts", "event_id"])
        _MATERIALIZED.add(key)
    return path


def _repeats_and_late(rows: DataFrame, start: str | None) -> DataFrame:
    """What a slice that begins at ``start`` brings again: every event of the
    day before it, and copies under new ids of every 50th event at least three
    days older."""
    if start is None:
        return rows.filter(F.lit(False))
    begin = F.lit(start).cast("timestamp_ntz")
    number = F.substring("event_id", 4, 20).cast("long")
    again = rows.filter((F.col("ts") < begin) & (F.col("ts") >= begin - F.expr("INTERVAL 1 DAY")))
    late = rows.filter((F.col("ts") < begin - F.expr("INTERVAL 3 DAYS")) & (number % 50 == 7))
    return again.unionByName(late.withColumn("event_id", F.concat(F.lit(f"LATE-{start[8:10]}-"), number.cast("string"))))


def split_base_inc(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Baseline half (before INC_START) and incoming half (from INC_START)."""
    return v.filter(F.col("ts") < _inc_start()), v.filter(F.col("ts") >= _inc_start())


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly telemetry series: consumer lag, warehouse latency, cpu, memory."""
    ev = table(spark, sf_dir, "events")
    # date_trunc returns a session-zone TIMESTAMP: keep the event clock's NTZ type
    return (ev.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
              .agg(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("consumer_lag"),
                   (F.max("value") / F.lit(100.0)).alias("db_latency_sec"),
                   # mean of 2-decimal values from an exact integer sum of hundredths:
                   # one division, so every engine yields the same double
                   (F.sum(F.round(F.col("value") * 100).cast("long")).cast("double")
                    / (F.count(F.lit(1)) * 100)).alias("cpu_percent"),
                   F.count_distinct("user_id").cast("double").alias("memory_percent")))


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-partition committed offset and high watermark of the topic."""
    ev = table(spark, sf_dir, "events")
    part = (F.col("user_id") % 4).cast("int")
    return (ev.groupBy(part.alias("partition_id"))
              .agg(F.sum(F.when(F.col("event_type") == "error", 0).otherwise(1)).alias("committed"),
                   F.count(F.lit(1)).alias("high"))
              .select(F.lit("ehr-stream").alias("topic"), "partition_id",
                      F.when(F.col("partition_id") == 3, F.lit(-1).cast("long"))
                       .otherwise(F.col("committed")).alias("committed"),
                      "high"))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation run per event: fault type, detectors fired, outcome."""
    ev = table(spark, sf_dir, "events")
    i = F.col("event_id")
    fired = F.concat_ws(
        ",",
        F.when(i % 5 == 1, F.lit("zscore")),
        F.when((i % 5 == 1) | (i % 7 == 0), F.lit("ks_test")),
        F.when(i % 5 == 0, F.lit("schema_entropy")),
        F.when(i % 5 == 4, F.lit("stall")))
    fault = (F.when(i % 5 == 0, "schema").when(i % 5 == 1, "data_quality")
              .when(i % 5 == 2, "performance").when(i % 5 == 3, "security")
              .otherwise("stall"))
    return ev.select((i + 1).alias("run"), fault.alias("fault_type"),
                     fired.alias("detectors_fired"),
                     (i % 6 != 0).alias("remediation_success"),
                     (F.col("value") / F.lit(100.0)).alias("mttr_seconds"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident per user: severity, validation status, fault/fix times, MTTR."""
    ev = table(spark, sf_dir, "events")
    u = F.col("user_id")
    return (ev.groupBy("user_id")
              .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("fault_start"),
                   F.max("ts").alias("fix_end"), F.max("value").alias("vmax"))
              .select(F.concat(F.lit("INC-"), u.cast("string")).alias("log_id"),
                      F.when(F.col("n") > 60, "CRITICAL").otherwise("HIGH").alias("severity"),
                      F.when(u % 4 == 0, "STILL_ANOMALOUS").otherwise("STEADY_STATE")
                       .alias("validation_status"),
                      "fault_start", "fix_end",
                      F.when(u % 10 == 0, F.lit(None).cast("double"))
                       .when(u % 10 == 1, F.lit(0.0))
                       .otherwise(F.col("vmax")).alias("mttr_seconds")))


# Audit inputs, one per blocked rule and per cleaning step (fences, backticks,
# closing semicolons, blanks), plus DELETEs whose WHERE is on the same line, on
# the next line and behind a lone carriage return.
STATEMENTS = [
    "UPDATE ward_log SET spo2 = 97.1 WHERE event_id = 'EV-12'",
    "```sql\nSELECT ward, count(*) FROM ward_log GROUP BY ward;\n```",
    "INSERT INTO ward_archive SELECT * FROM ward_log WHERE heart_rate < 60;;",
    "delete from ward_archive where ward = 'ICU'\n",
    "Delete From ward_archive",
    "DELETE FROM ward_archive\nWHERE ward = 'NEURO'",
    "DELETE FROM ward_archive\r WHERE ward = 'NEURO'",
    "drop   table ward_archive",
    "DROP DATABASE staging;",
    "Drop Schema staging",
    "TRUNCATE TABLE ward_archive",
    "alter user nurse set password = 'p'",
    "grant select on ward_archive to nurse",
    "REVOKE SELECT ON ward_archive FROM nurse",
    "create user nurse",
    "exec refresh_archive",
    "SELECT xp_dirtree('x')",
    "SHOW `columns` IN `ward_archive` ; ",
    " \t ",
]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of SQL statements to audit (one per event)."""
    ev = table(spark, sf_dir, "events")
    texts = F.array(*[F.lit(x) for x in STATEMENTS])
    return ev.select(F.col("event_id").alias("stmt_id"),
                     F.get(texts, (F.col("event_id") % len(STATEMENTS)).cast("int")).alias("sql"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vitals as JSON text; key presence carries schema faults and every
    97th event has its closing brace cut (malformed)."""
    return materialized(spark, sf_dir, "raw", lambda: _raw_from_vitals(vitals(spark, sf_dir)))


def topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``raw_events``, but every other event without spo2 names the key with
    a JSON null instead of leaving it out."""
    return materialized(spark, sf_dir, "topic", lambda: _raw_from_vitals(vitals(spark, sf_dir), named_nulls=True))


def _raw_from_vitals(v: DataFrame, named_nulls: bool = False) -> DataFrame:

    def kv_num(name):
        value = F.col(name).cast("string")
        if named_nulls and name == "spo2":
            named = F.substring("event_id", 4, 20).cast("long") % 2 == 0
            value = F.coalesce(value, F.when(named, F.lit("null")))
        return F.concat(F.lit(f'"{name}":'), value)

    def kv_str(name, col=None):
        c = F.col(col or name).cast("string")
        return F.concat(F.lit(f'"{name}":"'), c, F.lit('"'))

    j = F.concat(F.lit("{"), F.concat_ws(
        ",", kv_str("event_id"), kv_str("patient_id"), kv_str("ward"),
        kv_num("heart_rate"), kv_num("bp_systolic"), kv_num("bp_diastolic"),
        kv_num("spo2"), kv_num("temperature_c"), kv_num("respiratory_rate"),
        kv_str("diagnosis_code"), kv_str("timestamp", "ts")), F.lit("}"))
    bad = F.substring("event_id", 4, 20).cast("long") % 97 == 0
    return (v.select("event_id", "ts", j.alias("j"))
             .select("event_id",
                     F.when(bad, F.expr("substr(j, 1, length(j) - 1)")).otherwise(F.col("j")).alias("raw"),
                     "ts"))


# Agent log texts: only the tags are fixed; the last two are blank lines.
LOG_LINES = [
    "[OBSERVE] window of 50 rows loaded", "[ORIENT] baseline attached", "[DETECT] shift seen in heart_rate",
    "[DECIDE] packet is ready", "[ACT] step 1 of 2", "\x1b[92mSUCCESS 12 rows changed\x1b[0m",
    "FAILED after a lock timeout", "  plain note ", "\t \r", "",
]


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent log text, one line per event, incl. ANSI colour codes and blanks."""
    ev = table(spark, sf_dir, "events")
    texts = F.array(*[F.lit(x) for x in LOG_LINES])
    return ev.select(F.col("event_id").alias("line_no"),
                     F.get(texts, (F.col("event_id") % len(LOG_LINES)).cast("int")).alias("line"))
