"""Reporting aggregates: KPIs, health score, throughput, histograms,
extremes, incident summary and evaluation scoring.  Each is one partially
aggregated pass (plus tiny scalar subqueries where a figure comes from
another detector)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from healthwatch.functions import fields as fd
from healthwatch.operators import ks as ksm
from healthwatch.operators import schema_drift as sd
from healthwatch.operators import zscore as zs
from healthwatch.operators.baseline import melt, stats_map


def pipeline_kpis(batch: DataFrame, stats: DataFrame, base_hist: DataFrame,
                  attacker: str = fd.ATTACKER_ID) -> DataFrame:
    """One row: events, z-score flagged events, KS drifted fields, schema
    errors, attacker events.  z-score and schema flags are narrow columns on
    the same rows, so one aggregation covers four figures; the drifted-field
    count is a scalar subquery."""
    # schema presence is read from the batch's own columns, before z columns are added
    checked = zs.zscore_flags(sd.schema_check(batch), stats_map(stats))
    drifted = ksm.ks_drift(batch, base_hist, base_stats=stats).agg(F.count_if("drifted")).scalar()
    return checked.agg(F.count(F.lit(1)).alias("events"),
                       F.count_if("is_anomalous").alias("zscore_flagged"),
                       F.count_if("anomaly_detected").alias("schema_errors"),
                       F.count_if(F.col("patient_id") == attacker).alias("attacker_events")) \
                  .withColumn("drifted_fields", drifted)


def health_score(kpis: DataFrame, weights: dict | None = None, bands=fd.HEALTH_BANDS) -> DataFrame:
    """clamp(100 - wz*zflag - wd*drifted - ws*schema, 0, 100) and its band
    (attacker events do not count)."""
    w = weights or fd.HEALTH_WEIGHTS
    raw = (F.lit(100) - w["zscore"] * F.col("zscore_flagged") - w["drift"] * F.col("drifted_fields")
           - w["schema"] * F.col("schema_errors"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("long")
    lo, hi = bands
    return kpis.select("*", score.alias("health_score")).withColumn(
        "band", F.when(F.col("health_score") < lo, "red").when(F.col("health_score") < hi, "amber")
                 .otherwise("green"))


def throughput(df: DataFrame, ts: str = "ts", unit: str = "hour") -> DataFrame:
    """Events per time bucket (the bucket keeps the type of ``ts``)."""
    bucket = F.date_trunc(unit, ts).cast(df.schema[ts].dataType)
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("events"))


def histogram(df: DataFrame, bins: dict | None = None) -> DataFrame:
    """Equal-width histogram per field over [min, max] with the field's bin
    count; the maximum falls in the last bin.  Per-field min/max is a tiny
    aggregate (one row per field) broadcast back to the rows."""
    bins = bins or fd.HIST_BINS
    long = melt(df, list(bins))
    nb = F.element_at(F.create_map(*[x for f, n in bins.items() for x in (F.lit(f), F.lit(n))]), F.col("field"))
    mm = long.groupBy("field").agg(F.min("value").alias("lo"), F.max("value").alias("hi")) \
             .withColumn("nbins", nb).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("nbins"))
    b = F.when(F.col("width") == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.col("nbins") - 1)).cast("int")
    counted = (long.join(F.broadcast(mm), "field")            # one row per field
                   .groupBy("field", b.alias("bin"), "lo", "width")
                   .agg(F.count(F.lit(1)).alias("count")))
    return counted.select("field", "bin",
                          (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
                          (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"), "count")


def vital_extremes(df: DataFrame) -> DataFrame:
    """Max heart rate (missing or 0 counts as 0; 0 when empty) and min SpO2
    over present values, a stored 0 read as 100 (100 when empty)."""
    return df.agg(F.coalesce(F.max(F.coalesce(F.col("heart_rate"), F.lit(0.0))), F.lit(0.0)).alias("max_heart_rate"),
                  F.coalesce(F.min(F.when(F.col("spo2") == 0, F.lit(100.0)).otherwise(F.col("spo2"))),
                             F.lit(100.0)).alias("min_spo2"))


def _truthy(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != 0), c)


def incident_summary(incidents: DataFrame) -> DataFrame:
    """total, resolved (STEADY_STATE), avg (round 1) / max / min MTTR over
    truthy values (NULL and 0 excluded)."""
    m = _truthy(F.col("mttr_seconds"))
    return incidents.agg(F.count(F.lit(1)).alias("total_incidents"),
                         F.count_if(F.col("validation_status") == "STEADY_STATE").alias("resolved"),
                         F.round(F.avg(m), 1).alias("avg_mttr"), F.max(m).alias("max_mttr"),
                         F.min(m).alias("min_mttr"))


def backfill_mttr(incidents: DataFrame, fixes: DataFrame, id_col: str = "log_id") -> DataFrame:
    """Set ``mttr_seconds = round(fix_end - fault_start, 2)`` on every record
    whose id has a fix; others keep their value.  Of several fixes for one id
    the one with the latest end counts, so no incident is repeated.  A hash
    join on the id (the fix table is shuffled alongside, never collected)."""
    f = _mttr(fixes, id_col).withColumnRenamed("mttr_seconds", "_mttr")
    return (incidents.join(f, id_col, "left")
                     .withColumn("mttr_seconds", F.coalesce("_mttr", "mttr_seconds")).drop("_mttr"))


def _mttr(fixes: DataFrame, id_col: str) -> DataFrame:
    """Seconds from fault to fix per id, of its latest fix."""
    from healthwatch.functions.columns import epoch_micros
    sch = fixes.schema
    f = fixes.select(id_col, F.round((epoch_micros("fix_end", sch["fix_end"].dataType)
                                      - epoch_micros("fault_start", sch["fault_start"].dataType)) / F.lit(1e6), 2)
                     .alias("mttr_seconds"), "fix_end")
    return f.groupBy(id_col).agg(F.max_by("mttr_seconds", "fix_end").alias("mttr_seconds"))


def backfill_log(spark, path: str, fixes: DataFrame, id_col: str = "log_id") -> list[int]:
    """:func:`backfill_mttr` on a stored log (``operators.bucket_log``): only
    the buckets of the ids that have a fix are rewritten; returns them."""
    from healthwatch.operators import bucket_log as bk
    return bk.update(spark, path, _mttr(fixes, id_col), ["mttr_seconds"])


def _truth(col: Column) -> Column:
    expr = F.lit(None).cast("string")
    for k, v in reversed(list(fd.GROUND_TRUTH.items())):
        expr = F.when(col == k, F.lit(v)).otherwise(expr)
    return expr


def detection_correct(ev: DataFrame) -> DataFrame:
    """Expected detector per fault type and whether it fired."""
    exp = _truth(F.col("fault_type"))
    fired = F.split(F.col("detectors_fired"), ",")
    return ev.withColumn("expected_detector", exp).withColumn(
        "detection_correct", F.coalesce(F.array_contains(fired, F.col("expected_detector")), F.lit(False)))


def evaluation_overall(ev: DataFrame) -> DataFrame:
    d = detection_correct(ev)
    n = F.count(F.lit(1))
    return d.agg(n.alias("total"), F.count_if("detection_correct").alias("detected"),
                 F.round(F.try_divide(F.count_if("detection_correct"), n) * 100, 1).alias("detection_pct"),
                 F.count_if("remediation_success").alias("remediated"),
                 F.round(F.try_divide(F.count_if("remediation_success"), n) * 100, 1).alias("remediation_pct"),
                 F.round(F.avg("mttr_seconds"), 2).alias("avg_mttr"),
                 F.max("mttr_seconds").alias("max_mttr"), F.min("mttr_seconds").alias("min_mttr"))


def evaluation_by_fault(ev: DataFrame) -> DataFrame:
    d = detection_correct(ev)
    return d.groupBy("fault_type").agg(F.count(F.lit(1)).alias("runs"),
                                       F.count_if("detection_correct").alias("detected"),
                                       F.count_if("remediation_success").alias("remediated"),
                                       F.round(F.avg("mttr_seconds"), 2).alias("avg_mttr"))


def detector_fire_counts(ev: DataFrame) -> DataFrame:
    d = ev.select(F.explode(F.split(F.col("detectors_fired"), ",")).alias("detector"))
    return d.filter(F.length("detector") > 0).groupBy("detector").agg(F.count(F.lit(1)).alias("runs"))


# Planted fault type -> detectors that count as a correct detection.
FAULT_DETECTORS = {
    "schema": ["schema_entropy"],
    "data_quality": ["zscore", "ks_test"],
    "security": ["security"],
}


# Planted fault type -> row condition (SQL) that marks a faulty row.
FAULT_ROWS = {
    "schema": "diagnosis_code IS NOT NULL OR spo2 IS NULL",
    "data_quality": "COALESCE(heart_rate > 200 OR bp_systolic > 180 OR spo2 < 70, false)",
    "security": "COALESCE(patient_id = 'PT-ATTACKER-0000', false)",
}


def batch_detection(batches: DataFrame, alerts: DataFrame, key: str = "batch_start",
                    faults: dict | None = None, fault_rows: dict | None = None) -> DataFrame:
    """Per batch and planted fault type: was the fault present in the batch
    (``planted``: at least one faulty row) and did an expected detector fire
    (``detected``)?  Presence is one partially aggregated pass over the
    batches; each batch's fired detectors (at most one row per detector) are
    gathered and equi-joined on the batch key; fault types are exploded from
    a literal list (no cross join)."""
    faults = faults or FAULT_DETECTORS
    fault_rows = fault_rows or FAULT_ROWS
    names = list(faults)
    present = batches.groupBy(key).agg(*[F.expr(f"count_if({fault_rows[k]})").alias(f"_p{i}")
                                         for i, k in enumerate(names)])
    spec = F.array(*[F.struct(F.lit(k).alias("fault_type"), F.array(*[F.lit(d) for d in faults[k]]).alias("expected"),
                              (F.col(f"_p{i}") > 0).alias("planted")) for i, k in enumerate(names)])
    rows = present.select(key, F.explode(spec).alias("f"))
    fired = alerts.groupBy(key).agg(F.collect_set("detector").alias("fired"))
    return (rows.join(fired, key, "left")
                .select(key, F.col("f.fault_type").alias("fault_type"), F.col("f.planted").alias("planted"),
                        F.coalesce(F.arrays_overlap("f.expected", "fired"), F.lit(False)).alias("detected")))
